"""The queries p1_... to p8_..., each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.llm import garbled, leaks, mixture, names, pieces, stars, tokengroups, truth
from litloom.session import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    records, _ = truth.resolved_records(table(spark, d, "manifest_dedup"), Scratch(spark))
    return truth.survivors(records).select("work_id", "record_id")


def p1_merged_works(spark: SparkSession, d: str) -> DataFrame:
    return truth.merged_works(table(spark, d, "manifest_dedup"), Scratch(spark))


def p1_elected_facts(spark: SparkSession, d: str) -> DataFrame:
    """The elected fields after three rounds, which SQL can follow step by step."""
    facts = truth.elected_facts(table(spark, d, "manifest_dedup"), Scratch(spark), rounds=3, tolerance=0.0)
    return facts.select("work_id", "field", "value", F.round("share", 4).alias("share"))


def p1_source_reliability(spark: SparkSession, d: str) -> DataFrame:
    """How far the sources agree on the facts of the works that they share."""
    loads, scratch = table(spark, d, "manifest_dedup"), Scratch(spark)
    records, _ = truth.resolved_records(loads, scratch)
    works = records.filter(F.col("work_id").isNotNull()).select("record_id", "work_id")
    _, trust = truth.discover(truth.fact_claims(loads, works), scratch)
    return trust.select("provider", F.round("reliability", 6).alias("reliability"), "claims")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return tokengroups.near_records(table(spark, d, "dedup_candidates"), Scratch(spark))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return tokengroups.near_groups(table(spark, d, "dedup_candidates"), Scratch(spark))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return stars.match_groups(table(spark, d, "dedup_candidates"), Scratch(spark))


def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    groups = stars.match_groups(table(spark, d, "dedup_candidates"), Scratch(spark))
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(p4_profiles(spark, d))


def p4_profiles(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "dup_pairs_to_label")
    return names.author_profiles(names.spellings(lists), Scratch(spark), names.aligned_names(lists))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.split_oversized(table(spark, d, "chunks_toy"), table(spark, d, "chunk_limits"), with_text=False)
    return cut.filter(F.col("pieces") > 1).select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "chunks_toy"), table(spark, d, "chunk_limits"))


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each oversized chunk hold all its tokens once, without a gap, within its limit."""
    limits = table(spark, d, "chunk_limits").select(F.lower(F.trim("kind")).alias("kind"), "max_tokens").groupBy("kind").agg(F.min("max_tokens").alias("most"))
    held = pieces.invariants(pieces.split_oversized(table(spark, d, "chunks_toy"), table(spark, d, "chunk_limits")))
    kinds = table(spark, d, "chunks_toy").select("chunk_id", F.lower(F.trim("kind")).alias("kind")).distinct().join(limits, "kind")
    within = held.join(kinds, "chunk_id").withColumn("within", F.col("largest") <= F.col("most"))
    return within.select("chunk_id", "new_tokens", "gaps", F.col("missing").cast("bigint").alias("missing"), "within").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), Scratch(spark))
    return found.filter("exact_windows > 0").select("doc_id", "item_id").distinct()


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), Scratch(spark))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), Scratch(spark))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), Scratch(spark))[1]


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture: its sources, what they have, and that no document exceeds its copies."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    report = mixture.mixture(documents, targets, Scratch(spark))[1]
    within = (F.col("most_copies") <= F.greatest("max_repeats", F.lit(0))) & (F.col("tokens") <= F.col("available_tokens") * F.col("max_repeats"))
    return report.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", F.col("available_documents").cast("bigint").alias("available_documents"), within.alias("within"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    records, _, _ = garbled.judge(table(spark, d, "documents"), Scratch(spark))
    return records.select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored(table(spark, d, "documents"), Scratch(spark))


def p8_chain_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of each encoding chain among the units of each source."""
    _, shares, _ = garbled.judge(table(spark, d, "documents"), Scratch(spark))
    return shares.select("source", "field", F.explode("shares").alias("chain", "share")).withColumn("share", F.round("share", 6))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
