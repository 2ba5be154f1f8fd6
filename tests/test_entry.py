"""Registered queries against DuckDB on the smallest tables, a few of each module."""

import math

import duckdb
import pytest

import __spark_entry__
from __spark_entry__ import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SOME = (
    "coverage_focus", "sampling_report", "baseline_majority_family", "fidelity_micro", "policy_labels", "slot_topk", "graph_edges", "registry_build",
    "token_frequency", "parse_corrections", "uri_normalise", "cache_merge", "candidates", "fix_probability",
    "policy_filter", "corpus_build", "factor_wiring_both", "label_fanout", "primary_support", "capped_lines", "resumed_shards", "dense_graph", "node_vectors",
    "registry_cells", "stored_predictions", "filtered_view", "cache_lookup",
)


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_oracle(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    names = sorted(rows.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in rows.select(*names).collect()), key=repr)
    listed = ", ".join(f'"{n}"' for n in names)
    theirs = sorted((tuple(plain(v) for v in r) for r in duck.sql(f"select {listed} from ({ORACLES[name]})").fetchall()), key=repr)
    assert mine == theirs


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(QUERIES) - len(ORACLES) <= 5
