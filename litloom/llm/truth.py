"""Problem 1: the best representative of each duplicate group, by iterative truth discovery.

A *claim* says that a field of an entity has a value; its provider is the source that the load
names.  Two steps alternate until the reliabilities stand still:

* votes: a value's support is the sum over its claims of weight x -ln(1 - reliability), so that one
  claim of a source that is right 95 times in 100 outweighs four of sources that are right every other
  time; the value with the highest support is held true (ties: the value that is first by code point);
* reliability: the share of a source's claimed weight that agrees with the values held true, starting
  from and drawn to ``START`` by ``prior`` claims, within ``LOWEST`` and ``HIGHEST``.

*State* fields of a record (source, full text, version, work) change in time, so an older value is no
evidence against a newer one: the claims of the latest instant at which the field was filled are the
candidates, and every provider that states one of them has a vote.  *Fact* fields of a work (title,
authors, year, ...) do not change: every record that states a value is a claim of each source that
loaded it.

Only entities on whose field the claims differ take part in the iteration; the agreement of the rest
is one constant per source, added up once.

Defined results: a load without record_id is left out; a NULL updated_at is older than any; a field
that no load fills is NULL; a record without any work_id forms no work; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.llm.ids import filled, record_id, version_number
from litloom.operators.identity import canonical_key
from litloom.session import Scratch

STATE_FIELDS = ("work_id", "source", "fulltext_status", "arxiv_latest_version", "canonical")
FACT_FIELDS = (
    "arxiv_id", "openalex_id", "doi", "title", "authors", "year", "venue", "published_version_url",
    "source_url", "fulltext_url", "license", "in_scope", "topic", "paper_type",
)
UNKNOWN = "(unknown)"
START, LOWEST, HIGHEST = 0.8, 0.05, 0.99
KEYS = ["entity", "field"]


def source_name(raw: Column) -> Column:
    return F.lower(F.translate(filled(raw), "-", "_"))


def _spoken(field: str) -> Column:
    """A load's value of a field, in the one way of writing it that votes are counted by."""
    if field == "source":
        return source_name(F.col(field))
    if field in ("fulltext_status", "canonical"):
        return F.lower(filled(F.col(field)))
    if field == "arxiv_latest_version":
        return F.when(filled(F.col(field)).isNotNull(), version_number(F.col(field)).cast("string"))
    if field == "doi":
        return F.lower(filled(F.col(field)))
    return filled(F.col(field))


def state_claims(loads: DataFrame) -> DataFrame:
    """One claim for each value and provider at the latest instant at which a record's field was filled.
    Two aggregations with partial results; no record's loads are brought together."""
    said = (
        loads.select(
            record_id(F.col("record_id")).alias("entity"),
            F.coalesce(source_name(F.col("source")), F.lit(UNKNOWN)).alias("provider"),
            F.col("updated_at"),
            _claims(STATE_FIELDS),
        )
        .filter(F.col("entity").isNotNull())
        .select("entity", "provider", "updated_at", "claim.field", "claim.value")
        .groupBy(*KEYS, "value", "provider").agg(F.max("updated_at").alias("seen"))
    )
    # the window holds the distinct values and providers of one record's field, not its loads
    newest = F.max("seen").over(Window.partitionBy(*KEYS))
    return said.withColumn("newest", newest).filter(F.col("seen").eqNullSafe(F.col("newest"))).select(*KEYS, "value", "provider", F.lit(1.0).alias("weight"))


def fact_claims(loads: DataFrame, works: DataFrame) -> DataFrame:
    """The claims of each source on each value of a work's field, weighing the records that state it.
    ``works``: record_id, work_id."""
    said = (
        loads.select(
            record_id(F.col("record_id")).alias("record_id"),
            F.coalesce(source_name(F.col("source")), F.lit(UNKNOWN)).alias("provider"),
            _claims(FACT_FIELDS),
        )
        .select("record_id", "provider", "claim.field", "claim.value")
        .distinct()
    )
    return (
        said.join(works, "record_id")
        .groupBy(F.col("work_id").alias("entity"), "field", "value", "provider")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def _claims(fields) -> Column:
    each = F.array(*[F.struct(F.lit(f).alias("field"), _spoken(f).alias("value")) for f in fields])
    return F.explode(F.filter(each, lambda c: c["value"].isNotNull())).alias("claim")


def discover(claims: DataFrame, scratch: Scratch, rounds: int = 12, tolerance: float = 1e-3, prior: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """claims: entity, field, value, provider, weight.

    -> (values: entity, field, value, support, share; reliability: provider, reliability, claims)

    ``prior`` claims of the starting reliability are added to every source.  ``rounds`` is a guard
    against swinging: the tests and the test tables settle in three or four.
    """
    claims = scratch.keep(claims)
    kinds = claims.groupBy(*KEYS).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    parted = kinds.filter(F.col("low") != F.col("high")).select(*KEYS)
    disputed = scratch.keep(claims.join(parted, KEYS, "left_semi"))
    total = claims.groupBy("provider").agg(F.sum("weight").alias("said"), F.count(F.lit(1)).alias("claims"))
    contested = disputed.groupBy("provider").agg(F.sum("weight").alias("contested"))
    base = scratch.keep(
        total.join(contested, "provider", "left").select(
            "provider", "said", "claims", (F.col("said") - F.coalesce("contested", F.lit(0.0))).alias("settled")
        )
    )
    trust = scratch.keep(base.select("provider", F.lit(START).alias("reliability")))
    for _ in range(rounds):
        best = _elect(_votes(disputed, trust))
        agreed = (
            disputed.join(best.select(*KEYS, F.col("value").alias("held")), KEYS)
            .groupBy("provider")
            .agg(F.sum(F.when(F.col("value") == F.col("held"), F.col("weight")).otherwise(0.0)).alias("agreed"))
        )
        share = (F.col("settled") + F.coalesce("agreed", F.lit(0.0)) + prior * START) / (F.col("said") + prior)
        newer = scratch.keep(
            base.join(agreed, "provider", "left").select(
                "provider", F.round(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), share)), 9).alias("reliability")
            )
        )
        moved = newer.join(trust.withColumnRenamed("reliability", "before"), "provider").agg(
            F.max(F.abs(F.col("reliability") - F.col("before")))
        ).first()[0]
        scratch.drop(trust)
        trust = newer
        if (moved or 0.0) < tolerance:
            break
    values = _elect(_votes(claims, trust))
    return values, trust.join(base.select("provider", "claims"), "provider")


def _votes(claims: DataFrame, trust: DataFrame) -> DataFrame:
    return claims.join(trust, "provider").groupBy(*KEYS, "value").agg(F.sum(F.col("weight") * -F.log(1 - F.col("reliability"))).alias("vote"))


def _elect(votes: DataFrame) -> DataFrame:
    """The value with the most support.  The sums are rounded, so that the order in which they were
    added up decides nothing."""
    vote = F.round("vote", 9)
    return (
        votes.groupBy(*KEYS)
        .agg(F.min(F.struct((-vote).alias("less"), F.col("value"))).alias("top"), F.sum("vote").alias("all"))
        .select(*KEYS, "top.value", (-F.col("top.less")).alias("support"), F.round(-F.col("top.less") / F.col("all"), 6).alias("share"))
    )


def resolved_records(loads: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """-> (records: record_id and the state fields as elected; reliability of the sources)"""
    values, trust = discover(state_claims(loads), scratch)
    records = values.groupBy(F.col("entity").alias("record_id")).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in STATE_FIELDS]
    )
    return scratch.keep(records), trust


def survivors(records: DataFrame) -> DataFrame:
    """work_id, record_id, records, flagged: the survivor of each work with two or more records, and
    whether the old canonical flag named it.  One aggregation with partial results on the map side;
    no work's records are brought together."""
    return (
        records.filter(F.col("work_id").isNotNull())
        .groupBy("work_id")
        .agg(
            F.min(canonical_key(F.col("source"), F.col("fulltext_status"), F.col("arxiv_latest_version").cast("int"), F.col("record_id"))).alias("first"),
            F.count(F.lit(1)).alias("records"),
            F.min(F.when(F.col("canonical") == "true", F.col("record_id"))).alias("flag_low"),
            F.max(F.when(F.col("canonical") == "true", F.col("record_id"))).alias("flag_high"),
        )
        .filter(F.col("records") > 1)
        .select(
            "work_id", F.col("first.record_id").alias("record_id"), "records",
            F.when(F.col("flag_low").isNull(), "none").when(F.col("flag_low") != F.col("flag_high"), "several")
            .when(F.col("flag_low") == F.col("first.record_id"), "same").otherwise("other").alias("old_flag"),
        )
    )


def elected_facts(loads: DataFrame, scratch: Scratch, **settings) -> DataFrame:
    """work_id, field, value, support, share: the fact fields of all works with two or more records."""
    records, _ = resolved_records(loads, scratch)
    works = records.filter(F.col("work_id").isNotNull()).select("record_id", "work_id")
    wanted = works.join(survivors(records).select("work_id"), "work_id", "left_semi")
    values, _ = discover(fact_claims(loads, wanted), scratch, **settings)
    return values.withColumnRenamed("entity", "work_id")


def merged_works(loads: DataFrame, scratch: Scratch) -> DataFrame:
    """The surviving record of each work with two or more records, its fact fields elected from the
    claims of all records of the work, and the lowest support share among them."""
    records, _ = resolved_records(loads, scratch)
    chosen = survivors(records)
    works = records.filter(F.col("work_id").isNotNull()).select("record_id", "work_id")
    wanted = works.join(chosen.select("work_id"), "work_id", "left_semi")
    values, _ = discover(fact_claims(loads, wanted), scratch)
    facts = values.groupBy(F.col("entity").alias("work_id")).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FACT_FIELDS],
        F.min("share").alias("lowest_share"),
    )
    state = records.select("record_id", *[f for f in STATE_FIELDS if f not in ("work_id", "canonical")])
    return chosen.join(state, "record_id").join(facts, "work_id", "left")
