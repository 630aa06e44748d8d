"""Problem 3: consolidating pairwise matches into groups, by alternating star rewrites.

Large star: every node hands its larger neighbours to the least node it knows.  Small star: every
node hands its smaller neighbours, and itself, to the least of them.  Both keep connectivity; when
neither changes the edges any more, every node hangs on the least id of its component.

Each rewrite is an aggregation (least neighbour, combined on the map side) and a join of the edges
with its result; no node's neighbours are collected.  A node with more than one in ``HOT`` of all
edges is hot.  There can be no more than ``2 * HOT`` of these, so their least neighbours are
broadcast and their edges are rewritten where they lie; only the other edges are shuffled by node.

Defined results: NULL ids and a node tied to itself tie nothing; repeated edges count once; a node
without an edge to another is in no group; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.llm.ids import record_id
from litloom.session import Scratch

HOT = 1000


def _least(directed: DataFrame, total: int, low: Column) -> tuple[DataFrame, DataFrame]:
    """(least neighbour of the cold nodes, of the hot nodes)"""
    found = directed.groupBy("u").agg(low.alias("m"), F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") * HOT <= total).drop("n"), found.filter(F.col("n") * HOT > total).drop("n")


def _with_least(directed: DataFrame, total: int, low: Column) -> tuple[DataFrame, DataFrame]:
    """(u, v, m for every edge; u, m for every node)"""
    cold, hot = _least(directed, total, low)
    there = F.broadcast(hot)
    edges = directed.join(there, "u").unionByName(directed.join(there, "u", "left_anti").join(cold, "u"))
    return edges, cold.unionByName(hot)


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """edges: u > v, distinct."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, _ = _with_least(both, 2 * total, F.least(F.col("u"), F.min("v")))
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """edges: u > v, distinct."""
    joined, least = _with_least(edges, total, F.min("v"))
    moved = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two parents, or is both parent and child: else all edges lead to the
    least node of their component, and both rewrites would leave them as they are."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    return not ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).filter("child + parent > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component: every node of an edge with the least node it is tied to, itself included.

    Rounds grow with the logarithm of the longest chain; ``rounds`` is only a guard, and reaching it
    raises an error.
    """
    left, right = F.col(a), F.col(b)
    now, count = scratch.keep_counted(
        edges.filter(left.isNotNull() & right.isNotNull() & (left != right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    for _ in range(rounds):
        if not _unsettled(now):
            break
        wide, count = scratch.keep_counted(large_star(now, count))
        new, count = scratch.keep_counted(small_star(wide, count))
        scratch.drop(wide)
        scratch.drop(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def standing_decisions(pairs: DataFrame) -> DataFrame:
    """a, b, decision: of each unordered pair, the decision with the latest scored_at among the rows
    that have one (ties: the row that arrived last; a NULL time is older than any)."""
    a, b = record_id(F.col("record_a")), record_id(F.col("record_b"))
    said = F.lower(F.trim("decision"))
    return (
        pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), said.alias("decision"), "scored_at", "pair_no", a.isNotNull().alias("x"), b.isNotNull().alias("y"))
        .filter(F.col("x") & F.col("y") & F.col("decision").isNotNull() & ~F.col("decision").isin("", "-", "n/a"))
        .groupBy("a", "b")
        .agg(F.max_by("decision", F.struct("scored_at", "pair_no")).alias("decision"))
    )


def match_groups(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """record_id, group_id: the groups that the standing ``merge`` decisions tie together."""
    ties = standing_decisions(pairs).filter(F.col("decision") == "merge")
    return components(ties, scratch).select(F.col("node").alias("record_id"), F.col("component").alias("group_id"))
