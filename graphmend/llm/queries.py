"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_simhash import op1_simhash
from .op10_shards import op10_shards
from .op11_lines import ORACLE as OP11_SQL
from .op11_lines import op11_lines
from .op12_middle import ORACLE as OP12_SQL
from .op12_middle import op12_middle
from .op13_phrases import ORACLE as OP13_SQL
from .op13_phrases import op13_phrases
from .op2_packing import op2_packing
from .op3_quality import ORACLE as OP3_SQL
from .op3_quality import op3_quality
from .op4_warc import ORACLE as OP4_SQL
from .op4_warc import op4_warc
from .op5_pii import op5_pii
from .op6_store import op6_store
from .op7_secrets import op7_secrets
from .op8_counts import op8_counts
from .op9_winnow import ORACLE as OP9_SQL
from .op9_winnow import op9_winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_store": op6_store,
    "op7_secrets": op7_secrets,
    "op8_counts": op8_counts,
    "op9_winnow": op9_winnow,
    "op10_shards": op10_shards,
    "op11_lines": op11_lines,
    "op12_middle": op12_middle,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op3_quality": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op9_winnow": OP9_SQL,
    "op11_lines": OP11_SQL,
    "op12_middle": OP12_SQL,
    "op13_phrases": OP13_SQL,
}
