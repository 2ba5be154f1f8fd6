"""Quality rules: measures of one text, and cross-document line frequency within hosts.

Base measures come from the text alone. Then every line with a word is normalised (lower case, digit runs as 0, white
space as single blanks) and hashed; a line that more than ``SHARE`` of a host's distinct documents hold, and
``LEAST_DOCS`` at least, is boilerplate there and is removed. A document that this leaves with under ``LEAST_WORDS`` words
or under ``LEAST_LEFT`` of its words is depleted and rejected.

Equal texts must not make each other's lines boilerplate: documents with the same set of normalised lines count as one,
all others count apart, near copies too. Near copies that deplete each other are rescued: a depleted text joins the first
text of its host, by doc_id, that is depleted, holds one of its frequent lines or just the same ones, and shares lines of
``NEAR`` of the words of either. Where such a group has two texts or more, and the first of it isn't depleted once each
group counts as one document, the first stays, whole. Every other depleted document is rejected. At most 1 / SHARE times a host's mean number of lines
can be boilerplate, so a host's list stays short at any corpus size.

Results for odd input: a null, empty or blank text has no words, fails the base rules and has no lines; very long
texts are measured whole, with sorting rather than pairwise comparison; a null host is a host of its own; repeated rows
are measured apart and, as copies, counted once; a null doc_id counts as the last of its copies; an empty table gives
no rows; carried columns may have any name, as they travel in one struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, written

BLANK = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
SHARE = 0.05
LEAST_DOCS = 20
LEAST_WORDS = 20
LEAST_LEFT = 0.2
NEAR = 0.8
REPEAT_WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _long(value: Column) -> Column:
    return value.cast("long")


def repeated_words(words: Column, n: int = REPEAT_WINDOW) -> Column:
    """Words that stand in n-word windows which occur twice or more."""
    places = lambda w: F.sequence(F.lit(1), F.size(w) - (n - 1))

    def covered(w: Column) -> Column:
        spelled = F.transform(places(w), lambda i: F.struct(F.array_join(F.slice(w, i, n), " ").alias("g"), i.alias("i")))

        def marked(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
            found = F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull())
            start = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("to"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(n), i - a["to"])).alias("n"), i.alias("to"))
            return F.aggregate(F.array_sort(found), start, step, lambda a: a["n"])

        return let(F.array_sort(spelled), marked)

    def of(w: Column) -> Column:
        hashes = F.transform(places(w), lambda i: F.xxhash64(F.slice(w, i, n)))
        repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) < n, F.lit(0)).when(repeats, covered(w)).otherwise(F.lit(0))

    return _long(of(words))


def _measures(text: Column) -> Column:
    """One struct of all that a text gives: base measures, and (hash, words) of its lines in order."""

    def of_words(w: Column) -> Column:
        return F.struct(
            _long(F.size(w)).alias("n_words"),
            _long(F.length(F.array_join(w, ""))).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")
        dup = let(full, lambda f: _long(F.size(f) - F.size(F.array_distinct(f))))
        return F.struct(dup.alias("n_dup_lines"), let(full, lambda f: F.transform(f, _line)).alias("lines"))

    words = let(F.regexp_extract_all(text, F.lit(f"[^{BLANK}]+"), F.lit(0)), of_words)
    lines = let(F.split(text, "\n", -1), of_lines)
    symbols = _long(F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")))
    return F.struct(words.alias("w"), symbols.alias("n_symbols"), lines.alias("l"))


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACES)), "[0-9]+", "0"), f"[{BLANK}]+", " ")


def _line(line: Column) -> Column:
    words = F.size(F.regexp_extract_all(line, F.lit(f"[^{BLANK}]+"), F.lit(0)))
    return F.struct(F.xxhash64(normal_line(line)).alias("h"), _long(words).alias("w"))


def measured(docs: DataFrame, text_col: str, id_col: str, host_col: str, carry: list[str]) -> DataFrame:
    """Written table (carried, row, id, host, base measures, base_failed, lines, copy)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"), F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), _measures(text).alias("m"),
    ).select("carried", "row", "id", "host", "m.w.*", "m.n_symbols", "m.l.*")
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 30 * n_words")
    same = F.xxhash64(F.array_sort(F.array_distinct("lines.h")))
    return written(found.withColumn("base_failed", failed).withColumn("copy", same), "measured")


def _above(docs: str, of: str, share: float, least_docs: int) -> Column:
    return (F.col(docs) >= least_docs) & (F.col(docs) > share * F.col(of))


def boilerplate(found: DataFrame, share: float = SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(host, frequent, docs, all): hashes and documents of the lines of each host that are above the limits, its documents."""
    held = found.where("size(lines) > 0").select("host", "copy", F.explode(F.array_distinct("lines.h")).alias("h"))
    counts = held.distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)
    hosts = found.select(F.col("host").alias("of"), "copy").distinct().groupBy("of").agg(F.count("*").alias("all"))
    above = counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(_above("docs", "all", share, least_docs))
    lists = above.groupBy("host").agg(F.collect_list(F.struct("h", "docs")).alias("x"), F.max("all").alias("all"))
    return written(lists.select("host", F.col("x.h").alias("frequent"), F.col("x.docs").alias("docs"), "all"), "boilerplate")


def _depleted(n_words: str, n_removed: str) -> Column:
    left = F.col(n_words) - F.col(n_removed)
    return (F.col(n_removed) > 0) & ((left < LEAST_WORDS) | (left < LEAST_LEFT * F.col(n_words)))


def rescued(bare: DataFrame, lists: DataFrame, share: float = SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Written table (first): the rows of depleted documents that stay, as the first of near copies."""
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    texts = bare.groupBy("host", "copy").agg(F.min(rank).alias("rank"), F.min_by(F.struct("n_words", "lines", "frequent"), rank).alias("x"))
    texts = written(texts.select("host", "rank", F.col("rank.row").alias("row"), "x.*"), "depleted")
    lines = texts.select("row", F.explode("lines").alias("x")).groupBy("row", F.col("x.h").alias("h")).agg(F.sum("x.w").alias("w"))
    lines = written(lines, "depleted_lines")

    # Each text meets the first holders of its frequent lines and of just these lines.
    core = F.array_sort(F.array_intersect("lines.h", "frequent"))
    keys = texts.select("host", "rank", F.explode(F.array_append(core, F.xxhash64(core))).alias("key"))
    firsts = keys.groupBy(F.col("host").alias("of"), F.col("key").alias("k")).agg(F.min("rank").alias("lead"))
    met = keys.join(firsts, F.col("host").eqNullSafe(F.col("of")) & (F.col("key") == F.col("k"))).where("lead.row <> rank.row")
    met = met.select(F.col("rank.row").alias("row"), "lead").distinct()
    own = met.join(lines, "row").withColumn("lead_row", F.col("lead.row"))
    theirs = lines.select(F.col("row").alias("lead_row"), "h", F.col("w").alias("lead_w"))
    both = own.join(theirs, ["lead_row", "h"]).groupBy("row", "lead").agg(F.sum("w").alias("w"), F.sum("lead_w").alias("lead_w"))
    sizes = texts.select("row", "n_words")
    both = both.join(sizes, "row").join(sizes.select(F.col("row").alias("r"), F.col("n_words").alias("lead_words")), F.col("lead.row") == F.col("r"))
    near = both.where((F.col("w") >= NEAR * F.col("n_words")) & (F.col("lead_w") >= NEAR * F.col("lead_words")))
    named = texts.join(near.groupBy("row").agg(F.min("lead").alias("lead")), "row", "left")
    named = written(named.select("host", "row", "n_words", F.coalesce("lead.row", "row").alias("group")), "near")

    # The lines once more, with each group as one document.
    of = F.col("host").eqNullSafe(F.col("of"))
    less = lambda group: (F.count("*") - F.count_distinct(group)).alias("less")
    known = lists.select(F.col("host").alias("of"), "all", F.explode(F.arrays_zip(F.col("frequent").alias("h"), F.col("docs").alias("docs"))).alias("x"))
    held = named.join(lines, "row").select("host", "row", "group", F.col("h").alias("line"), "w")
    held = held.join(known, of & (F.col("line") == F.col("x.h"))).select("host", "row", "group", "line", "w", F.col("x.docs").alias("docs"), "all")
    fewer = held.groupBy("host", "line", "docs", "all").agg(less("group")).withColumn("docs", F.col("docs") - F.col("less")).drop("less")
    hosts = named.groupBy(F.col("host").alias("of")).agg(less("group"))
    still = fewer.join(hosts, of).withColumn("all", F.col("all") - F.col("less")).where(_above("docs", "all", share, least_docs))
    still = still.select("of", F.col("line").alias("still"))
    lost = held.join(still, of & (F.col("line") == F.col("still"))).groupBy("row").agg(F.sum("w").alias("lost"))
    twice = named.groupBy("group").agg(F.count("*").alias("texts")).where("texts > 1")
    firsts = named.where(F.col("row") == F.col("group")).join(twice, "group").join(lost, "row", "left").withColumn("lost", F.coalesce("lost", F.lit(0).cast("long")))
    return written(firsts.where(~_depleted("n_words", "lost")).select(F.col("row").alias("first")), "first")


def judged(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The measured documents with ``frequent``, ``n_removed_words``, ``depleted`` and ``kept``."""
    found = measured(docs, text_col, id_col, host_col, docs.columns if carry is None else carry)
    lists = boilerplate(found)
    lost = F.aggregate(
        F.filter("lines", lambda x: F.array_contains("frequent", x["h"])), F.lit(0).cast("long"), lambda a, x: a + x["w"]
    )
    short = lists.select(F.col("host").alias("of"), "frequent")
    found = found.join(short, F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    found = found.withColumn("n_removed_words", F.when(F.col("frequent").isNull(), F.lit(0).cast("long")).otherwise(lost))
    found = found.withColumn("depleted", ~F.col("base_failed") & _depleted("n_words", "n_removed_words"))
    first = rescued(found.where("depleted"), lists)
    emptied = found.where("depleted").join(first, F.col("row") == F.col("first"), "left").withColumn("kept", F.col("first").isNotNull())
    full = found.where("not depleted").withColumn("kept", ~F.col("base_failed"))
    return full.unionByName(emptied.drop("first"))


def without_boilerplate(text: Column, frequent: Column) -> Column:
    """The text without the lines whose hash is in the list."""
    kept = F.filter(
        F.split(text, "\n", -1),
        lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~F.array_contains(frequent, F.xxhash64(normal_line(x))),
    )
    return F.array_join(kept, "\n")


def keep_good(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """The kept documents, all columns, with boilerplate lines removed (but from the first of depleted copies)."""
    found = judged(docs, text_col, id_col, host_col).where("kept")
    text = F.col(f"carried.`{text_col}`")
    cut = F.when(F.col("depleted") | (F.col("n_removed_words") == 0), text).otherwise(without_boilerplate(text, F.col("frequent")))
    return found.select(*((cut if c == text_col else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("carried.doc_id", *names)


_RANK = "(doc_id is null, coalesce(doc_id, 0), r)"
#: Lines stand for themselves here, not their hashes.
ORACLE = rf"""
with d as (select row_number() over () r, doc_id, source host, coalesce(text, '') t from documents),
w as (select r, regexp_extract_all(t, '[^{BLANK}]+') w from d),
g as (select r, i, array_to_string(w[i : i + {REPEAT_WINDOW - 1}], ' ') g from (
  select r, w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) i from w where len(w) >= {REPEAT_WINDOW})),
c as (select r, count(distinct p) n from (select r, unnest(range(i, i + {REPEAT_WINDOW})) p from (
  select r, i from g qualify count(*) over (partition by r, g) > 1)) group by 1),
l as (
  select r, line, len(regexp_extract_all(line, '[^{BLANK}]+')) w,
    regexp_replace(regexp_replace(regexp_replace(lower(line), '^[{BLANK}]+|[{BLANK}]+$', '', 'g'), '[0-9]+', '0', 'g'), '[{BLANK}]+', ' ', 'g') h
  from (select r, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^{BLANK}]')),
m as (
  select d.r, doc_id, host, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, coalesce(x.dup, 0)::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words,
    coalesce(x.copy, '') copy
  from d join w using (r) left join c using (r)
    left join (select r, count(*) - count(distinct line) dup, array_to_string(list_sort(list_distinct(list(h))), chr(10)) copy from l group by 1) x using (r)),
b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > 30 * n_words base_failed from m),
ho as (select host, count(distinct copy) "all" from b group by 1),
fr as (
  select x.host, h, docs, "all" from (select host, h, count(distinct copy) docs from b join l using (r) group by 1, 2) x
    join ho on ho.host is not distinct from x.host where docs >= {LEAST_DOCS} and docs > {SHARE}::double * "all"),
lo as (select r, sum(w) lost from b join l using (r) join fr on fr.host is not distinct from b.host and fr.h = l.h group by 1),
de as (
  select *, not base_failed and lost > 0 and (n_words - lost < {LEAST_WORDS} or n_words - lost < {LEAST_LEFT}::double * n_words) depleted
  from (select b.*, coalesce(lost, 0) lost from b left join lo using (r))),
te as (select * from de where depleted qualify row_number() over (partition by host, copy order by {_RANK}) = 1),
tl as (select r, h, sum(w) w from te join l using (r) group by 1, 2),
fl as (select te.r, te.host, h, w, docs, "all" from te join tl using (r) join fr using (h) where fr.host is not distinct from te.host),
ke as (
  select r, host, h "key" from fl union all select r, any_value(host), 'core' || chr(10) || string_agg(h, chr(10) order by h) from fl group by 1),
le as (select host, "key", arg_min(r, {_RANK}) lead from ke join te using (r, host) group by 1, 2),
me as (select distinct ke.r, lead from ke join le on le."key" = ke."key" and le.host is not distinct from ke.host where lead <> ke.r),
bo as (select me.r, lead, sum(a.w) w, sum(z.w) lead_w from me join tl a on a.r = me.r join tl z on z.r = lead and z.h = a.h group by 1, 2),
ne as (
  select bo.r, arg_min(lead, (y.doc_id is null, coalesce(y.doc_id, 0), y.r)) lead from bo join te x on x.r = bo.r join te y on y.r = lead
  where w >= {NEAR}::double * x.n_words and lead_w >= {NEAR}::double * y.n_words group by 1),
gr as (select te.r, host, n_words, coalesce(lead, te.r) "group" from te left join ne using (r)),
st as (
  select f.host, h from (select fl.host, h, docs - (count(*) - count(distinct "group")) docs, "all" from fl join gr using (r) group by fl.host, h, docs, "all") f
    join (select host, count(*) - count(distinct "group") less from gr group by 1) x on x.host is not distinct from f.host
  where docs >= {LEAST_DOCS} and docs > {SHARE}::double * ("all" - less)),
l2 as (select fl.r, sum(w) lost from fl join st on st.host is not distinct from fl.host and st.h = fl.h group by 1),
rs as (
  select r from (select gr.*, coalesce(lost, 0) lost, count(*) over (partition by "group") n from gr left join l2 using (r))
  where r = "group" and n > 1 and not (lost > 0 and (n_words - lost < {LEAST_WORDS} or n_words - lost < {LEAST_LEFT}::double * n_words)))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (not depleted or r in (select r from rs)) kept from de
"""
