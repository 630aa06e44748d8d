"""Problem 7: mixing sources to target weights, by Pareto order sampling.

Every document of a source gets an expected number of copies, proportional to a mild power of its
size (so that a larger document is a little likelier) and never above max_repeats, such that the
expected tokens meet the source's target.  The whole part of that number is allocated for certain.
The fraction f is an inclusion probability, and Pareto order sampling draws the last copies: each
document gets the random odds u / (1 - u) divided by its inclusion odds f / (1 - f), and those with
the smallest ratios are taken until the source's remaining tokens are reached; the document at the
edge is taken if that comes closer to the target.  u comes from a hash of doc_id and seed, so a run
can be repeated on any cluster.

No source is ever brought into one task: expected copies depend only on the size class, so they are
solved on token sums by (source, size class); the ratio at which a source's target is reached is
found on token sums by (source, ratio class), 65,536 classes at most; only the documents of that one
class are put in order.

Defined results: NULL or empty texts have no tokens and are never drawn; a NULL or unlisted source is
reported under its name (``(none)``) with target 0; a source whose documents cannot reach its target
with max_repeats copies each gives all of them, and the report states the shortfall; targets without
documents are reported with 0 tokens; repeated doc_ids are drawn as one; targets named twice count
with their summed share and the smaller max_repeats; no documents give no rows; further columns are
ignored.
"""

from __future__ import annotations

import base64
import importlib.util
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.session import Scratch

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CLASSES, PER_OCTAVE, SIZE_POWER = 1 << 16, 8, 0.25
NO_SOURCE = "(none)"


def load_encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """A tiktoken encoding from a vocabulary file and the pattern beside it."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    lines = Path(folder, name).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(raw: Column) -> Column:
    """The clean name of a source: without case and outer blanks, ``-`` and inner blanks as ``_``."""
    text = F.regexp_replace(F.lower(F.trim(raw)), r"[-\s]+", "_")
    return F.when(F.coalesce(text, F.lit("")) == "", NO_SOURCE).otherwise(text)


def token_sizes(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens over whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": [len(encode(t)) for t in batch["text"]]})

    return (
        documents.filter(F.length("text") > 0)
        .select(F.col("doc_id").cast("bigint"), source_key(F.col("source")).alias("source"), "text")
        .mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")
        .groupBy("doc_id")
        .agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))
        .filter("n_tokens > 0")
    )


def _size_class(tokens: Column) -> Column:
    return F.floor(F.log2(tokens) * PER_OCTAVE).cast("int")


def _scale(target: float, tokens: np.ndarray, weight: np.ndarray, most: float) -> float:
    """x with sum(tokens * min(x * weight, most)) = target, or inf if the target is out of reach."""
    if target >= most * tokens.sum():
        return math.inf
    order = np.argsort(-weight, kind="stable")
    tokens, weight = tokens[order], weight[order]
    capped, free = 0.0, float((tokens * weight).sum())
    for t, w in zip(tokens, weight):
        x = (target - capped) / free
        if x * w <= most:
            return x
        capped += t * most
        free -= t * w
    return math.inf


def _plan(classes: pd.DataFrame) -> pd.DataFrame:
    """Expected copies of each size class of one source: at most a few hundred rows."""
    classes = classes.sort_values("size_class")
    target, most = float(classes["target_tokens"].iloc[0]), float(classes["max_repeats"].iloc[0])
    weight = np.exp2(SIZE_POWER * classes["size_class"].to_numpy() / PER_OCTAVE)
    if target <= 0 or most <= 0:
        copies = np.zeros(len(classes))
    else:
        x = _scale(target, classes["tokens"].to_numpy(float), weight, most)
        copies = np.full(len(classes), most) if math.isinf(x) else np.minimum(x * weight, most)
    return pd.DataFrame({"source": classes["source"], "size_class": classes["size_class"], "expected": copies})


def mixture(documents: DataFrame, targets: DataFrame, scratch: Scratch, total_tokens: int | None = None, share_of_corpus: float = 0.3, seed: int = 13,
            folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """-> (sample: doc_id, source, n_tokens, copies; report by source)

    ``total_tokens``: the requested size; ``share_of_corpus`` of all tokens where it is not given.
    """
    sizes = scratch.keep(token_sizes(documents, folder, vocabulary).withColumn("size_class", _size_class(F.col("n_tokens"))))
    goals = (
        targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(1)).alias("r"))
        .groupBy("source")
        .agg(F.sum("s").alias("target_share"), F.min("r").alias("max_repeats"))
    )
    classes = scratch.keep(sizes.groupBy("source", "size_class").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    if total_tokens is None:
        total_tokens = round(share_of_corpus * (classes.agg(F.sum("tokens")).first()[0] or 0))
    goals = goals.withColumn("target_tokens", F.col("target_share") * F.lit(float(total_tokens)))
    wanted = classes.join(goals, "source")
    expected = wanted.groupBy("source").applyInPandas(_plan, "source string, size_class int, expected double")

    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    whole = F.floor(F.col("expected") + 1e-9).cast("int")
    drawn = sizes.join(expected, ["source", "size_class"]).select(
        "doc_id", "source", "n_tokens", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("expected") - whole).alias("f"), u.alias("u")
    )
    # in (0, 1) and in the order of the ratio of odds; a sure absence comes last
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("f")) / F.col("f")
    ranked = scratch.keep(
        drawn.withColumn("rank", F.when(F.col("f") > 1e-9, odds / (1 + odds)))
        .withColumn("rank_class", F.when(F.col("rank").isNotNull(), F.least(F.lit(CLASSES - 1), F.floor(F.col("rank") * CLASSES))).cast("int"))
        .drop("f", "u")
    )
    certain = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("certain"))
    rest = goals.join(certain, "source").select("source", F.greatest(F.lit(0.0), F.col("target_tokens") - F.col("certain")).alias("rest"))
    # token sums by ratio class: the window runs over at most CLASSES rows of a source
    by_class = ranked.filter("rank_class IS NOT NULL").groupBy("source", "rank_class").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy("source").orderBy("rank_class")
    edges = (
        by_class.withColumn("cum", F.sum("t").over(upto)).join(rest, "source")
        .groupBy("source")
        .agg(
            F.coalesce(F.min(F.when(F.col("cum") >= F.col("rest"), F.col("rank_class"))), F.lit(CLASSES)).alias("edge"),
            F.first("rest").alias("rest"),
            F.coalesce(F.max(F.when(F.col("cum") < F.col("rest"), F.col("cum"))), F.lit(0)).alias("below"),
        )
    )
    placed = ranked.join(edges, "source", "left")
    inside = placed.filter("rank_class IS NULL OR rank_class <> edge OR edge IS NULL").select(
        "doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce((F.col("rank_class") < F.col("edge")).cast("int"), F.lit(0))).alias("copies")
    )
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id")
    at_edge = placed.filter("rank_class = edge").withColumn("cum", F.col("below") + F.sum("n_tokens").over(in_order))
    # a document is taken if most of it lies below the target
    taken = (F.col("cum") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")
    chosen = inside.unionByName(at_edge.select("doc_id", "source", "n_tokens", (F.col("whole") + taken).alias("copies")))
    sample = scratch.keep(chosen.filter("copies > 0").select("doc_id", "source", "n_tokens", F.col("copies").cast("int")))
    return sample, _report(classes, goals, sample, total_tokens)


def _report(classes: DataFrame, goals: DataFrame, sample: DataFrame, total_tokens: int) -> DataFrame:
    there = classes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum("documents").alias("available_documents"))
    got = sample.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    everything = Window.partitionBy(F.lit(1))  # over one row a source
    return (
        there.join(goals, "source", "full").join(got, "source", "left")
        .select(
            "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("available_documents", F.lit(0)).alias("available_documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.greatest(F.lit(0), F.round(F.coalesce("target_tokens", F.lit(0.0)) - F.coalesce("tokens", F.lit(0))).cast("bigint")).alias("shortfall"),
        )
        .withColumn("actual_share", F.round(F.col("tokens") / F.sum("tokens").over(everything), 6))
        .withColumn("requested_tokens", F.lit(int(total_tokens)).cast("bigint"))
    )
