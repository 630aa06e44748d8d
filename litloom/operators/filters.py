"""Rule tables, cascades of reasons, gates and upserts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text as T


def rule_filter(rows: DataFrame, title: Column, body: Column, exclude: Mapping[str, str], include: Mapping[str, str], weak: str, least: int = 2) -> DataFrame:
    """Adds result and rules.

    The first excluding pattern in the title rejects.  A row is included if an including pattern
    stands in the title, one other than ``weak`` in the body, or ``weak`` at least ``least`` times in
    the body; else it is an incidental mention.  ``rules`` names all including patterns found in
    either text, sorted, for rejected rows too.  NULL texts count as empty.
    """
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    rejected = F.coalesce(*[F.when(t.rlike(p), F.lit(f"reject:{name}")) for name, p in exclude.items()])
    hit = T.any_of([t.rlike(p) for p in include.values()])
    strong = T.any_of([b.rlike(p) for name, p in include.items() if name != weak])
    often = F.size(F.regexp_extract_all(b, F.lit(include[weak]), F.lit(0))) >= least
    result = F.coalesce(rejected, F.when(hit | strong | often, "include").otherwise("reject:incidental_mention"))
    rules = F.array(*[F.when(t.rlike(p) | b.rlike(p), F.lit(name)) for name, p in sorted(include.items())])
    return rows.withColumns({"result": result, "rules": F.array_compact(rules)})


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key.  An aggregation with partial results, so a key
    with a third of all rows is combined before the shuffle.  NULL keys form a key; among rows equal
    in ``order`` the greatest row as a whole is taken."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return rows.groupBy(*keys).agg(F.max(packed).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer join; a filled new value replaces the old one, a blank keeps it."""
    o, n = old.select(key, *[F.col(c).alias(f"o_{c}") for c in columns]), new.select(key, *[F.col(c).alias(f"n_{c}") for c in columns])
    return o.join(n, key, "full").select(key, *[F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")), F.col(f"o_{c}")).alias(c) for c in columns])


def reason_cascade(*steps: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds; NULL conditions do not hold."""
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in steps])


def hash_order(seed: int, key: Column) -> Column:
    """A reproducible shuffle: the same on every cluster and in SQL."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_split(rows: DataFrame, key: str, seed: int = 13) -> DataFrame:
    """half: ``dev`` or ``test``, by a bit of the key's hash: no row is ever moved for it."""
    return rows.withColumn("half", F.when(F.substring(hash_order(seed, F.col(key)), 1, 1) < "8", "dev").otherwise("test"))


def seeded_halves(rows: DataFrame, key: str, seed: int = 13) -> DataFrame:
    """half: the first n // 2 of the distinct keys in seeded order are ``dev``, the rest ``test``.  Places are
    counted within groups of hashes, so that no task holds all keys."""
    order = hash_order(seed, F.col(key))
    placed = rows.withColumn("_h", order).withColumn("_g", F.substring("_h", 1, 3))
    sizes = placed.groupBy("_g").agg(F.count(F.lit(1)).alias("_k"))
    before = sizes.select(  # one row for each of at most 4,096 groups
        "_g", F.coalesce(F.sum("_k").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_k").over(Window.partitionBy(F.lit(1))).alias("_n")
    )
    place = F.col("_b") + F.row_number().over(Window.partitionBy("_g").orderBy("_h", key))
    return placed.join(before, "_g").withColumn("half", F.when(place <= F.floor(F.col("_n") / 2), "dev").otherwise("test")).select(*rows.columns, "half")


def cap_flags(rows: DataFrame, tier: Column, key: str, reason: str, n: int, seed: int = 13, flag: str = "corpus_cap") -> DataFrame:
    """Sets ``reason`` to the flag on all but the first n rows by tier and seeded order, and clears it on
    these.  The last row within the cap is found by a take-ordered; every row is compared with it, so
    nothing is joined."""
    ranked = rows.withColumn("_tier", tier).withColumn("_hash", hash_order(seed, F.col(key)))
    place = F.struct("_tier", "_hash", F.col(key).alias("_key"))
    edge = ranked.orderBy("_tier", "_hash", key).limit(n).agg(F.max(place).alias("_edge"))
    kept = F.coalesce(place <= F.col("_edge"), F.lit(False))
    cleared = F.when(F.col(reason) == flag, "").otherwise(F.col(reason))
    return ranked.join(F.broadcast(edge), how="cross").withColumn(reason, F.when(kept, cleared).otherwise(flag)).select(*rows.columns)


def capped(rows: DataFrame, tier: Column, key: str, n: int, seed: int = 13) -> DataFrame:
    """The first n rows by tier, then in hash order.  A take-ordered: n rows of each partition move."""
    return rows.withColumn("tier", tier).orderBy("tier", hash_order(seed, F.col(key)), key).limit(n)


def score_gate(best: DataFrame, tau: float) -> DataFrame:
    """best: query_id, score (NULL where nothing was found) -> abstain; never while tau is 0."""
    return best.withColumn("abstain", F.lit(tau > 0) & (F.col("score").isNull() | (F.col("score") < tau)))


def tune_gate(best: DataFrame, answerable: Column, margin: float = 0.02) -> DataFrame:
    """One row: tau just below the lowest best score of an answerable query, and what it would do."""
    low = F.min(F.when(answerable, F.col("score")))
    tau = best.agg((F.floor((low - margin) * 1000) / 1000).alias("tau"))
    gated = F.col("score") < F.col("tau")
    return best.withColumn("answerable", answerable).join(F.broadcast(tau), how="cross").groupBy("tau").agg(
        F.count_if(gated & ~F.col("answerable")).alias("gated_unanswerable"), F.count_if(gated & F.col("answerable")).alias("gated_answerable"),
        F.count_if(~F.col("answerable")).alias("unanswerable"), F.count_if(F.col("answerable")).alias("answerable"),
    )


def window_completeness(events: DataFrame, at: Column, share: float = 0.01) -> DataFrame:
    """Rows by day summed up, against the total: complete if they differ by no more than ``share``."""
    days = events.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    parts = days.filter("day IS NOT NULL").agg(F.sum("n").alias("by_window"), F.count(F.lit(1)).alias("windows"))
    total = events.agg(F.count(F.lit(1)).alias("total"))
    return parts.join(F.broadcast(total), how="cross").withColumn("complete", F.abs(F.col("total") - F.col("by_window")) <= share * F.col("total"))


def running_budget(rows: DataFrame, part: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each part until their sizes reach the budget; the one that reaches it is the last."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).filter(F.col("before") < budget)


def fixed_batches(rows: DataFrame, part: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1) / n).cast("int"))


def history(turns: DataFrame, conversation: str, order: str, line: Column, last: int) -> DataFrame:
    """The last turns before each turn, one to a line."""
    frame = Window.partitionBy(conversation).orderBy(order).rowsBetween(-last, -1)
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(frame), "\n"))
