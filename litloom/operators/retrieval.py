"""Keyword and dense ranking, fusion, and diversification of ranked lists.

A ranked list is query_id, doc_id, rank (from 1), score.  Ties are broken by doc_id; scores are rounded
before they are ranked, so that the order of additions decides nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions.stem import stems
from litloom.operators.filters import score_gate
from litloom.session import Scratch, parallel, ship, small

# The parameters of the keyword score, of fusion and of diversification.
K1, B, RRF_K, PER_WORK, TAU = 1.5, 0.75, 60, 4, 0.92
# Words that carry no meaning for the keyword index.
STOP = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: The term that stands for a document's length: no text has it.
_LENGTH = ""
#: The largest matrix of query vectors that is sent to the tasks, in numbers; more go in blocks.
BLOCK = 2_000_000


def postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, text -> doc_id, dl, term, tf.  With ``wanted`` (term), only those terms are
    counted; lengths are of whole texts all the same.  NULL texts have no postings."""
    return _counted(docs.filter(F.col("text").isNotNull()).select("doc_id", T.terms(F.col("text")).alias("w")), wanted)


def _counted(words: DataFrame, wanted: DataFrame | None) -> DataFrame:
    each = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    if wanted is not None:
        each = each.join(wanted, "term", "left_semi")
    return each.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def collection_stats(docs: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return docs.filter(F.col("text").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.terms(F.col("text")))).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Spark keeps k rows of a query in every partition before it shuffles (window group limit)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def matched(docs: DataFrame, queries: DataFrame, scratch: Scratch) -> DataFrame:
    """The postings of the queries' terms, and one row with the empty term for each document, which stands
    for its length: all that a ranking needs, from one reading of the texts.  Postings of other terms are
    dropped before the first shuffle."""
    wanted = query_terms(queries).select("term").unionByName(queries.sparkSession.range(1).select(F.lit(_LENGTH).alias("term"))).distinct()
    words = parallel(docs.filter(F.col("text").isNotNull()).select("doc_id", "text")).select("doc_id", T.terms(F.col("text")).alias("w"))
    each = words.select("doc_id", F.size("w").alias("dl"), F.explode(F.concat(F.array(F.lit(_LENGTH)), "w")).alias("term")).join(small(wanted), "term", "left_semi")
    return scratch.keep(each.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))


def rank_bm25(found: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """found: what ``matched`` gives -> the k best documents of each query."""
    stats = found.filter(F.col("term") == _LENGTH).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    terms = found.filter(F.col("term") != _LENGTH)
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _scored(terms, df, stats, query_terms(queries), k, k1, b)


def _scored(terms: DataFrame, df: DataFrame, stats: DataFrame, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    weighted = terms.join(df, "term").join(F.broadcast(stats), how="cross").select(  # stats has one row
        "doc_id", "term",
        (F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("w"),
    )
    scored = weighted.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(scored, k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B, scratch: Scratch | None = None) -> DataFrame:
    """The k best documents of each query by BM25; documents without a term of the query are not
    ranked."""
    return rank_bm25(matched(docs, queries, scratch or Scratch(docs.sparkSession)), queries, k, k1, b)


def analysed(rows: DataFrame, key: str, stop: tuple[str, ...] = (), stemmed: bool = False) -> DataFrame:
    """key, term, tf, dl: the terms of each text without stop words, as stems.  Each distinct word is stemmed
    once; the lengths are of what is left."""
    words = parallel(rows.filter(F.col("text").isNotNull()).select(key, "text")).select(key, F.explode_outer(T.terms(F.col("text"))).alias("word"))
    kept = words.filter(F.col("word").isNull() | ~F.col("word").isin(*stop)) if stop else words
    counted = kept.groupBy(key, "word").agg(F.count("word").alias("tf"))
    if stemmed:
        known = counted.filter("word IS NOT NULL").select("word").distinct().withColumn("term", stems(F.col("word")))
        counted = counted.join(known, "word", "left").groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    else:
        counted = counted.withColumnRenamed("word", "term")
    dl = counted.groupBy(key).agg(F.sum("tf").alias("dl"))
    return counted.join(dl, key).filter(F.col("term").isNotNull()).select(key, "term", "tf", "dl")


def build_index(docs: DataFrame, path: str, stop: tuple[str, ...] = (), stemmed: bool = False, buckets: int = 64) -> None:
    """Writes a keyword index: postings by bucket of terms with their document frequencies, and one row of
    statistics with how texts were analysed.  A query reads the buckets of its terms alone.  A bucket is
    written by several tasks, so a term in a third of all documents is no one task's.  Raises where an
    index is already."""
    scratch = Scratch(docs.sparkSession)
    terms = scratch.keep(analysed(docs, "doc_id", stop, stemmed))
    there = docs.filter(F.col("text").isNotNull()).select("doc_id").agg(F.count(F.lit(1)).alias("n"))
    total = terms.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    stats = there.join(total, how="cross").select(  # one row each
        "n", (F.col("tokens") / F.nullif("n", F.lit(0))).alias("avgdl"), F.array(*map(F.lit, stop)).cast("array<string>").alias("stop"), F.lit(stemmed).alias("stemmed"), F.lit(buckets).alias("buckets"))
    stats.write.mode("errorifexists").parquet(f"{path}/stats")
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    rows = terms.join(df, "term").withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    rows.sortWithinPartitions("bucket", "term").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    scratch.drop(terms)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents of each query from a stored index; queries are analysed as its texts were."""
    stats = spark.read.parquet(f"{path}/stats")
    how = stats.first()
    asked = analysed(queries, "query_id", tuple(how["stop"]), how["stemmed"]).select("query_id", "term")
    bucket = F.pmod(F.xxhash64("term"), F.lit(how["buckets"])).cast("int")
    wanted = [r[0] for r in asked.select(bucket.alias("bucket")).distinct().collect()]  # at most all buckets
    held = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(*wanted) if wanted else F.lit(False))
    held = held.join(asked.select("term").distinct(), "term", "left_semi")
    return _scored(held.select("doc_id", "term", "tf", "dl", "df").drop("df"), held.select("term", "df").distinct(), stats.select("n", "avgdl"), asked, k, k1, b)


def retrieve(words: DataFrame | None, near: DataFrame | None, about: DataFrame, k: int, mode: str = "r1", cap: int = PER_WORK, vectors: DataFrame | None = None, tau: float = TAU, want_flagged: bool = False) -> DataFrame:
    """words: a keyword ranking, near: a dense one (either may be None; both are fused, the dense one first);
    about: doc_id, work, flagged -> query_id, doc_id, score, rank, folded (ids shown under it).

    mode ``off`` cuts the list to k; ``r1`` folds what is beyond ``cap`` passages of a work; ``r1r2r3`` also
    folds passages of other works with a cosine of ``tau`` or more where ``vectors`` are given, and lets one
    flagged passage into the first five unless they are wanted."""
    given = [x for x in (near, words) if x is not None]
    ranked = (fuse(given) if len(given) > 1 else given[0].select("query_id", "doc_id", "score", "rank")).join(about, "doc_id")
    if mode == "off":
        kept, under = ranked.withColumn("place", F.col("rank")), None
    else:
        if mode == "r1" or vectors is None:
            parted = cap_per_work(ranked, cap).select("query_id", "doc_id", "rank", "score", "flagged", "kept", "under")
        else:
            held = ranked.join(vectors, "doc_id", "left").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "rank", "work", "embedding")
            parted = fold_near(held, tau, cap).drop("rank", "reason").join(ranked.select("query_id", "doc_id", "rank", "score", "flagged"), ["query_id", "doc_id"])
        under = parted.filter("NOT kept").groupBy("query_id", F.col("under").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("d")))), lambda r: r["d"]).alias("folded"))
        kept = parted.filter("kept")
        again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        if mode == "r1r2r3" and not want_flagged:
            kept = cap_category(kept.withColumn("rank", again), F.col("flagged")).withColumnRenamed("new_rank", "place")
        else:
            kept = kept.withColumn("place", again)
    out = kept.filter(F.col("place") <= k).select("query_id", "doc_id", "score", F.col("place").alias("rank"))
    none = F.array().cast("array<bigint>")
    if under is None:
        return out.withColumn("folded", none)
    return out.join(under, ["query_id", "doc_id"], "left").withColumn("folded", F.coalesce("folded", none))


def gated(queries: DataFrame, tau: float, near: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """query_id, score, abstain: the best score is that of the dense ranking where there is one (fused scores
    say nothing), else of the keyword ranking.  Nothing is gated while tau is 0."""
    best = (near if near is not None else words).groupBy("query_id").agg(F.max("score").alias("score"))
    return score_gate(queries.select("query_id").join(best, "query_id", "left"), tau)


def truncated(vector: Column, dims: int) -> Column:
    """The first dims numbers, of length 1 again; a zero vector stays zero."""
    head = F.slice(vector, 1, dims)
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(head, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids, rows = [], []
    for row in queries.select("query_id", "embedding").toLocalIterator():
        if row[1] is None:
            continue
        ids.append(row[0])
        rows.append(np.asarray(row[1], np.float64))
        if sum(map(len, rows[:1])) * len(rows) >= BLOCK:
            yield ids, np.stack(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.stack(rows)


def dense(vectors: DataFrame, queries: DataFrame, k: int | None, least: float | None = None) -> DataFrame:
    """The k vectors nearest each query by dot product, exactly: vectors doc_id, embedding; queries
    query_id, embedding.

    The query set goes to the tasks in blocks of bounded size; a batch of vectors is one matrix
    product, of which only each query's k best leave the task.  NULL vectors match nothing.
    ``least``: only products of at least so much; with k None all of these.
    """
    schema = "query_id bigint, doc_id bigint, score double"
    ship(vectors.sparkSession)
    out = None
    for ids, matrix in _query_blocks(queries):

        def run(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for batch in batches:
                scores = np.round(np.stack(batch["embedding"].to_numpy()).astype(np.float64) @ matrix.T, 6)
                docs = batch["doc_id"].to_numpy()
                parts = []
                for j, query in enumerate(ids):
                    column = scores[:, j]
                    keep = np.flatnonzero(column >= np.partition(column, -k)[-k]) if k is not None and len(column) > k else np.arange(len(column))
                    if least is not None:
                        keep = keep[column[keep] >= least]
                    parts.append(pd.DataFrame({"query_id": query, "doc_id": docs[keep], "score": column[keep]}))
                yield pd.concat(parts)

        part = vectors.filter(F.col("embedding").isNotNull()).select(F.col("doc_id").cast("bigint"), "embedding").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    return out if k is None else top_k(out, k)


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; equal sums keep the order of the lists, then of their ranks."""
    tagged = [x.select("query_id", "doc_id", "rank", F.lit(i).alias("list_no")) for i, x in enumerate(lists)]
    every = tagged[0]
    for x in tagged[1:]:
        every = every.unionByName(x)
    fused = every.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "doc_id")
    return fused.select("query_id", "doc_id", "score", F.row_number().over(order).alias("rank"))


def cap_per_work(ranked: DataFrame, cap: int = PER_WORK) -> DataFrame:
    """ranked with a work column -> kept, and the kept document that a folded one is shown under."""
    order = Window.partitionBy("query_id", "work").orderBy("rank")
    placed = ranked.withColumn("nth", F.row_number().over(order)).withColumn("head", F.first("doc_id").over(order))
    return placed.withColumn("kept", F.col("nth") <= cap).withColumn("under", F.when(~F.col("kept"), F.col("head"))).drop("nth", "head")


def cap_category(ranked: DataFrame, flagged: Column, cap: int = 1, head: int = 5) -> DataFrame:
    """Within the first ``head`` places at most ``cap`` flagged ones; those too many follow the head.
    Closed form of the sequential rule: e counts the eligible rows above."""
    upto = Window.partitionBy("query_id").orderBy("rank")
    eligible = (~F.col("f")) | (F.sum(F.col("f").cast("int")).over(upto) <= cap)
    rows = ranked.withColumn("f", F.coalesce(flagged, F.lit(False))).withColumn("ok", eligible)
    rows = rows.withColumn("e", F.sum(F.col("ok").cast("int")).over(upto) - F.col("ok").cast("int"))
    bucket = F.when(F.col("ok") & (F.col("e") < head), 0).when(~F.col("ok") & (F.col("e") < head), 1).otherwise(2)
    again = Window.partitionBy("query_id").orderBy("bucket", "rank")
    return rows.withColumn("bucket", bucket).withColumn("new_rank", F.row_number().over(again)).drop("f", "ok", "e", "bucket")


def fold_near(ranked: DataFrame, tau: float = TAU, cap: int = PER_WORK) -> DataFrame:
    """ranked with work and embedding -> every row with kept, under and reason.

    In rank order a row is folded under the first kept row of its work once ``cap`` are kept, else
    under the first kept row of another work with cosine >= tau.  The rule is sequential, so each
    query's list (at most a hundred rows) is one group of ``applyInPandas``.
    """
    schema = "query_id bigint, doc_id bigint, rank int, kept boolean, under bigint, reason string"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for r in rows.sort_values("rank").itertuples():
            vector = None if r.embedding is None else np.asarray(r.embedding, float)
            if vector is not None and (norm := np.linalg.norm(vector)):
                vector = vector / norm
            same = [k for k in kept if k[1] == r.work]
            if len(same) >= cap:
                out.append((r.query_id, r.doc_id, r.rank, False, same[0][0], "more from this paper"))
                continue
            near = next((k for k in kept if k[1] != r.work and vector is not None and k[2] is not None and float(k[2] @ vector) >= tau), None)
            if near:
                out.append((r.query_id, r.doc_id, r.rank, False, near[0], "also stated in"))
            else:
                kept.append((r.doc_id, r.work, vector))
                out.append((r.query_id, r.doc_id, r.rank, True, None, None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"under": "Int64"})

    return ranked.groupBy("query_id").applyInPandas(fold, schema)


def hashed_vector(text: Column, dims: int = 256) -> Column:
    """Bag of words hashed by crc32, of length 1 (zeros for a text without words, NULL for NULL): the
    encoder for tests and for text without another."""

    @F.pandas_udf("array<double>")
    def encode(words: pd.Series) -> pd.Series:
        out = []
        for w in words:
            if w is None:
                out.append(None)
                continue
            counts = np.bincount([zlib.crc32(x.encode()) % dims for x in w], minlength=dims).astype(float) if len(w) else np.zeros(dims)
            norm = np.linalg.norm(counts)
            out.append((counts / norm if norm else counts).tolist())
        return pd.Series(out)

    return encode(T.terms(text))
