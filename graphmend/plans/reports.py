"""Registered queries of reports, corpus build, vocabulary checks and the second half of the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmend.functions import tokens
from graphmend.operators import baselines, candidates, dense, evaluate, graph, labels, metrics, patterns, profile, registry, reports, scores, textcache, vectors, vocabulary
from graphmend.operators.baselines import SLOTS
from graphmend.operators.evidence import resolved
from graphmend.operators.registry import instances
from graphmend.sources import corrections, ingest
from graphmend.sources.violations import catalog, definitions, table, violations

from . import queries as base

#: Worst cases that a report lists.
WORST = 100
#: Occurrences under which lost factor tokens are looked for.
OFTEN = 2000
VARIANTS = ("normal", "none", "primary")


def density(records: DataFrame) -> DataFrame:
    return records.select("violation_id", evaluate.density_bucket(F.size("local_constraint_ids")).alias("density"))


def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fidelity, repair and global figures of every prediction variant, by density and over all ("all")."""
    records, known = violations(spark, sf_dir), instances(definitions(spark))
    predicted, size = baselines.predictions(records), density(records)
    acts = metrics.outcomes(metrics.by_action(predicted, baselines.gold(records)), patterns.with_patterns(records, known)).join(size, "violation_id")
    levels = lambda rows, *sums: rows.groupingSets([["variant"], ["variant", "density"]], "variant", "density").agg(*sums)
    named = F.coalesce("density", F.lit("all")).alias("density")
    fixed = F.count_if(F.col("outcome").isin("exact", "alternative_fix"))
    hits = metrics.prf(levels(acts, *metrics._hits(), labels.rate(fixed, F.count("*")).alias("primary_fix_rate")))
    numbered = predicted.withColumn("idx", F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant")).cast("int") - 1)
    found = evaluate.evaluate(numbered, records, catalog(spark)).withColumn("variant", F.get(F.array(*map(F.lit, VARIANTS)), F.col("idx"))).join(size, "violation_id")
    means = {"gfr": "post_fraction", "srr": "srr", "sir": "sir", "disruption_add": "add_count", "disruption_del": "del_count", "disruption": "ops"}
    whole = levels(found, F.count("*").alias("support"), *(F.avg(c).alias(n) for n, c in means.items()))
    rows = hits.select("variant", named, "precision", "recall", "f1", "primary_fix_rate")
    return rows.join(whole.select("variant", named, "support", *means), ["variant", "density"])


def variant_overlap(wired: DataFrame) -> DataFrame:
    """(variant, violation_id, targets, shared, most_factors): pressure targets left in each variant."""
    kept = F.array_compact(F.array(F.lit("normal"), F.when(F.col("is_primary"), "primary").otherwise("secondary")))
    each = wired.select(F.explode(kept).alias("variant"), "violation_id", "type", "target", "constraint_id")
    per = each.groupBy("variant", "violation_id", "type", "target").agg(F.count_distinct("constraint_id").alias("n"))
    return per.groupBy("variant", "violation_id").agg(F.count("*").alias("targets"), F.count_if(F.col("n") > 1).alias("shared"), F.max("n").alias("most_factors"))


def density_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, known = violations(spark, sf_dir), catalog(spark)
    if known.bits():
        return reports.held_summary(graph.held_variants(base.with_density(records), known, ("density",)))
    counts = base.factor_nodes(spark, sf_dir).groupBy("violation_id").agg(F.count("*").alias("factors"))
    factors = density(records).join(counts, "violation_id", "left").fillna(0, ["factors"])
    return reports.density_summary(variant_overlap(base.wired(spark, sf_dir)), factors, F.col("density"))


def semantic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda scope: scores.factor_scores(base.labelled(spark, sf_dir, scope, "supported_only").where("supported"))
    return reports.semantic_summary({"base__local": run("local"), "base__focus": run("focus")})


def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three candidates a record those with the policy of the historical edit."""
    records = violations(spark, sf_dir)
    rows = base.simple_candidates(spark, records).join(records.select("violation_id", *patterns.ROLES), "violation_id")
    rows = rows.withColumn("policy", patterns.policy([resolved(F.col(c)) for c in SLOTS])).select("violation_id", "idx", "policy")
    return patterns.policy_filtered(rows, rows.where("idx = 0"))


def bare_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Q-id of each part's raw type item, and its name as a family name."""
    part = base.part_definitions(spark, sf_dir).select("constraint_id", "type_item")
    raw = F.concat(F.lit(f" <{tokens.ENTITY}"), F.col("type_item"), F.lit("> "))
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("constraint_id"), registry.family_name(F.concat("p_name", F.lit(" Constraint!"))).alias("family"))
    return part.select("constraint_id", registry.type_qid(raw).alias("qid")).join(names, "constraint_id").groupBy("qid", "family").agg(F.count("*").alias("entries"))


def cache_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.part_definitions(spark, sf_dir).select(tokens.token(F.col("property")).alias("property"), *("P2306", "P2305"))
    split = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), " "), tokens.token)
    entries = rows.select("property", F.filter(F.concat(split("P2306"), split("P2305")), lambda x: x != "").alias("values"))
    vocab = entries.select(F.col("property").alias("key")).distinct().withColumn("id", F.substring("key", 2, 20).cast("long"))
    return textcache.registry_ids(entries, vocab)


def label_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as labels of the entities that pages spell in several ways."""
    pages = base.spelled_pages(spark, sf_dir)
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("Q"), (F.col("p_partkey") + 1).cast("string")).alias("entity"), F.col("p_name").alias("label"))
    return textcache.with_labels(pages, names).select("page_id", "uri", "entity", "label")


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines to records; lists told as texts."""
    n = F.col("p_partkey")
    known = F.when(n < 9, "P101").when(n == 100, "P102").when(n == 101, "P1")
    defined = table(spark, sf_dir, "part").select(
        F.concat(F.when(known.isNull(), "d").otherwise("c"), n.cast("string")).alias("constraint_id"), F.coalesce(known, F.concat(F.lit("P"), (n + 2000).cast("string"))).alias("property"),
    )
    found = corrections.build(corrections.corpus_lines(spark, sf_dir), defined)
    told = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws("=", f["p"], f["o"])), ";").alias(c)
    lists = ("subject_facts", "object_facts", "other_entity_facts")
    ids = ("local_constraint_ids", "local_constraint_ids_focus")
    return found.select(*(c for c in found.columns if c not in (*lists, *ids)), *map(told, lists), *(F.array_join(c, ",").alias(c) for c in ids))


#: Caps of the line scan: lines a file and lines in all.
PER_FILE, OVERALL, SHARDS, CUT = 200, 2500, 4, 5


def capped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections written as gzipped files, one a constraint and split, read back, numbered and capped."""
    n = F.col("violation_id")
    split = F.when(n % 20 < 14, "train").when(n % 20 < 17, "val").otherwise("test")
    lines = corrections.corpus_lines(spark, sf_dir).withColumn("file", F.concat_ws("-", split, F.concat(F.lit("c"), (n % 11).cast("string"))))
    path = ingest.shared_folder(spark)
    ingest.write_lines(lines, path, "violation_id")
    found = ingest.capped(ingest.numbered_lines(spark, path), PER_FILE, OVERALL)
    parsed = corrections.parse_corrections(found)
    return parsed.select("file", "line", "constraint_id", tokens.token(F.col("subject")).alias("subject"), F.col("del_s").alias("deleted"))


def resumed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with an edit, written in shards by a pass that is cut short and one that goes on: the ledger and what is stored."""
    records = violations(spark, sf_dir).withColumn("shard", F.pmod(F.expr("violation_id div 20"), F.lit(SHARDS)).cast("int"))
    keep = F.exists(F.array(*labels.EDIT), lambda x: x != 0)
    path = ingest.shared_folder(spark)
    ingest.Shards(spark, path, SHARDS).write(records, keep, stop_after=CUT)
    again = ingest.Shards(spark, path, SHARDS)
    again.write(records, keep)
    stored = again.rows().groupBy("split", "shard").agg(F.count("*").alias("rows"), F.sum("violation_id").alias("id_sum"), F.sum(F.size("local_constraint_ids")).alias("attached"))
    return again.ledger().join(stored, ["split", "shard"], "left")


#: Examples that a degeneracy report lists a level.
EXAMPLES = 5


def dense_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as a graph over 0 .. n - 1: facts, then factors with a checker in attached order, with their parameters;
    a digest tells the paths."""
    records = violations(spark, sf_dir)
    params = definitions(spark).where("parameter is not null").select("constraint_id", F.substring("parameter", 2, 20).cast("long").alias("p"), F.col("value").alias("o"))
    rows = dense.numbered(dense.held_factors(records, catalog(spark), params))
    paths = F.array_join(F.transform("paths", lambda x: F.concat_ws(",", *(x[c].cast("string") for c in ("kind", "id", "s", "p", "o")))), ";")
    return rows.select("violation_id", F.col("nodes").cast("long").alias("nodes"), F.size("paths").cast("long").alias("n_paths"), F.md5(paths.cast("binary")).alias("paths_md5"))


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity nodes with cached vectors: customers by id, order states and priorities by literal, all others by the unknown
    token's entry. Vectors are told by their size and first element."""
    cached = table(spark, sf_dir, "embeddings")
    entries = cached.select(
        F.when(F.col("vec_id") % 5 != 4, F.col("vec_id") + 2_000_000_000).alias("id"), F.when(F.col("vec_id") % 5 == 4, F.concat(F.lit("L"), F.col("vec_id").cast("string"))).alias("key"),
        F.when(F.col("vec_id") == 7, "unknown").otherwise(F.col("label").cast("string")).alias("text"), F.col("embedding").alias("vector"),
    )
    nodes = graph.nodes(base.facts(spark, sf_dir)).where("kind = 'entity'")
    wanted = nodes.select("violation_id", "id", F.when(F.col("id").between(8000, 8999), F.concat(F.lit("L"), F.col("id") % 100)).alias("key"))
    found = vectors.VectorCache(entries, ingest.shared_folder(spark)).lookup(wanted)
    return found.select("violation_id", "id", "source", F.size("vector").cast("long").alias("dims"), F.element_at("vector", 1).cast("double").alias("first"))


def degeneracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The historical edit as the model's against delete-focus, over all, by density and by type, with examples."""
    held = base.with_simple_candidates(spark, base.with_density(violations(spark, sf_dir)), (0, 1))
    report = evaluate.degeneracy_levels_of_pairs(evaluate.evaluate_pair(held, catalog(spark), carry=("density",)), EXAMPLES)
    return report.withColumn("examples", _told(F.col("examples")))


def label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, known = violations(spark, sf_dir), catalog(spark)
    if known.checked():
        return graph.held_alignment(labels.held_arrays(records, known))
    return graph.label_alignment(labels.factor_arrays(labels.factors(records, known)), records)


def literal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.literal_texts(corrections.in_tokens(corrections.parse_corrections(corrections.corpus_lines(spark, sf_dir))))


def _told(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def _max_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.baseline_rows(violations(spark, sf_dir))[1]


QUERIES: dict[str, base.Query] = {
    "variant_metrics": variant_metrics,
    "variant_metric_deltas": lambda spark, sf: reports.merged_deltas(variant_metrics(spark, sf), ["density"]),
    "density_summary": density_summary,
    "semantic_summary": semantic_summary,
    "policy_filter": policy_filter,
    "worst_cases": lambda spark, sf: reports.worst_cases(base.held_choices(spark, sf, reports.FIGURES).drop("density"), WORST),
    "choice_averages": lambda spark, sf: reports.choice_averages(base.held_choices(spark, sf, reports.FIGURES)),
    "primary_support": base._attached(labels.support_counts, profile.counted_primary_support),
    "registry_missing_items": lambda spark, sf: registry.missing_items(base.part_definitions(spark, sf)),
    "type_item_frequency": lambda spark, sf: registry.item_frequencies(base.part_definitions(spark, sf).select("constraint_id", "type_item").join(base.registry_build(spark, sf), "constraint_id")),
    "type_families": bare_items,
    "parameter_paths": lambda spark, sf: graph.parameter_paths(base.factor_nodes(spark, sf), definitions(spark)),
    "factor_wiring_both": lambda spark, sf: graph.both_ways(base.wired(spark, sf)),
    "node_features": lambda spark, sf: graph.node_features(graph.nodes(base.facts(spark, sf)), base.vocab(spark, sf)).select("violation_id", "kind", "id", "ord", "feature"),
    "target_classes": lambda spark, sf: graph.normalised_targets(violations(spark, sf), base.vocab(spark, sf)).select("violation_id", _told(F.col("y")).alias("y")),
    "label_alignment": label_alignment,
    "baseline_max_ids": _max_ids,
    "lost_factor_tokens": lambda spark, sf: vocabulary.lost_factor_tokens(violations(spark, sf), vocabulary.kept_tokens(violations(spark, sf).where("split = 'train'"), violations(spark, sf), OFTEN)),
    "registry_cache_ids": cache_ids,
    "label_fanout": label_fanout,
    "corpus_build": corpus_build,
    "capped_lines": capped_lines,
    "resumed_shards": resumed_shards,
    "dense_graph": dense_graph,
    "node_vectors": node_vectors,
    "degeneracy_report": degeneracy_report,
    "literal_texts": literal_texts,
    "exposure_counts": lambda spark, sf: scores.exposure_counts(scores.exposure(violations(spark, sf).where("split = 'train'"))),
    "primary_factor_index": lambda spark, sf: labels.primary_places(violations(spark, sf)).select("violation_id", F.col("position").cast("long").alias("primary_index")),
}
