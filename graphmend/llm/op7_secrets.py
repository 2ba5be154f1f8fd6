r"""Secret scan with multipart credential linking.

Base kinds are taken as they match. Parts that are weak alone (other access identifiers, client and user names, mixed
40-character secrets, endpoints) are reported only where complementary parts lie within ``SCOPE`` characters: an
identifier needs a secret, a secret an identifier, an endpoint both. Base matches serve as parts too: access keys as
identifiers, assignments and hex strings as secrets. Weak parts that overlap a base span add nothing and are left out.

Places come from splitting a text at the matches of one kind: lengths of the pieces and matches before a match add up to
its start. The link is an interval join by a sweep in order of place within each document, in both directions: each
candidate sees the nearest end before it and the nearest start behind it of every kind of part. No pairs are made.

Results for odd input: null and empty texts have no spans; long texts are rows like others and their candidates are
sorted, not paired; repeated rows are documents of their own; an empty table gives no rows; carried columns may have
any name, as they travel in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .op3_quality import let
from .shared import read_table, written

SCOPE = 256
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "ident", "secret", "endpoint")
#: Fixed patterns of the base kinds, with the least length of the group that decides.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Weak parts.
WEAK = {
    "ident": (r"\b(?:(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}|(?i:client_id|user_?name|login|access_?key(?:_id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,})", 0, 0),
    "secret": (r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "endpoint": (r"\b(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[A-Za-z0-9._~:@/?#&=%+-]{4,}", 0, 0),
}


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, i, gap, len, good) of one kind's matches in order."""
    pattern, group, least = (PATTERNS | WEAK)[kind]
    number = KINDS.index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    deciding = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    def one(g: Column, d: Column, x: Column, i: Column) -> Column:
        good = F.length(F.get(d, i)) >= least
        if kind == "secret":  # as random strings are: all three classes
            good = good & x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")
        return F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.get(g, i).alias("gap"), F.length(x).alias("len"), good.alias("good")
        )

    found = let(gaps, lambda g: let(deciding, lambda d: F.transform(whole, lambda x, i: one(g, d, x, i))))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,good:boolean>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def candidates(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """Written table (carried, row, parts)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = F.concat(*(_matches(text, k) for k in KINDS))
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")
    return written(docs.select(carried, F.monotonically_increasing_id().alias("row"), parts.alias("parts")), "parts")


def _near(spans: DataFrame, scope: int) -> DataFrame:
    """Adds, for identifiers and for secrets, whether one other than the row itself lies within the scope."""
    before = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    for part in ("ident", "secret"):
        mine = F.col("part") == part
        spans = spans.withColumn(f"{part}_end", F.max(F.when(mine, F.col("end"))).over(before))
    for part in ("ident", "secret"):
        mine = F.col("part") == part
        spans = spans.withColumn(f"{part}_start", F.min(F.when(mine, F.col("start"))).over(behind))
    for part in ("ident", "secret"):
        left = F.col("start") - F.col(f"{part}_end") <= scope
        right = F.col(f"{part}_start") - F.col("end") <= scope
        spans = spans.withColumn(f"near_{part}", F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)))
    return spans


def spans(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end, base): base spans, and weak parts whose complements are near."""
    each = found.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    running = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(running)).where("good")
    base = F.col("kind") < len(BASE)
    placed = placed.select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", base.alias("base"))
    # A weak part that a base span overlaps: the furthest end of base spans before it, the nearest start behind it.
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(before)
    comes = F.min(F.when(F.col("base"), F.col("start"))).over(behind)
    overlapped = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(comes < F.col("end"), F.lit(False))
    placed = placed.withColumn("inside", overlapped).where("base or not inside").drop("inside")
    part = F.element_at(F.create_map(*(F.lit(x) for k, p in enumerate(("secret", "ident", "secret", "ident", "secret", "endpoint")) for x in (k, p))), F.col("kind"))
    near = _near(placed.withColumn("part", part), scope)
    linked = F.expr("case part when 'ident' then near_secret when 'secret' then near_ident else near_ident and near_secret end")
    return near.where(F.col("base") | linked).select("row", "kind", "start", "end", "base")


def secrets(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """(carried, spans) per document: spans are sorted structs (start, kind, end, base), kind an index of ``KINDS``."""
    found = candidates(docs, text_col, docs.columns if carry is None else carry)
    held = spans(found.where("size(parts) > 0"), scope)
    lists = written(held.groupBy(F.col("row").alias("r")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans")), "spans")
    none = F.array().cast(lists.schema["spans"].dataType)
    some = found.where("size(parts) > 0").join(lists, F.col("row") == F.col("r"), "left").select("carried", F.coalesce("spans", none).alias("spans"))
    return some.unionByName(found.where("size(parts) = 0").select("carried", none.alias("spans")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(k) for k in KINDS))
    told = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    return secrets(read_table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        F.col("carried.doc_id").alias("doc_id"), count(0), count(1), count(2),
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
    )
