"""Retrieval metrics, agreement, intervals and funnels."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """ranked with work; gold: query_id, doc_id, work -> by query recall5 (share of gold works with a
    hit among the first five), mrr10, first_hit, duprate5 (places whose work stood above) and works5.
    A query without gold has recall NULL; one without a list has 0 hits."""
    hit = gold.select("query_id", "doc_id", F.col("work").alias("gold_work")).distinct()
    seen = Window.partitionBy("query_id", "work").orderBy("rank")
    rows = ranked.withColumn("again", F.row_number().over(seen) > 1).join(hit, ["query_id", "doc_id"], "left")
    by_query = rows.groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("rank") <= 5, F.col("gold_work"))).alias("hits"),
        F.min(F.when(F.col("gold_work").isNotNull(), F.col("rank"))).alias("first_hit"),
        F.round(F.avg(F.when(F.col("rank") <= 5, F.col("again").cast("double"))), 6).alias("duprate5"),
        F.count_distinct(F.when(F.col("rank") <= 5, F.col("work"))).alias("works5"),
    )
    wanted = gold.groupBy("query_id").agg(F.count_distinct("work").alias("wanted"))
    return queries.select("query_id").join(by_query, "query_id", "left").join(wanted, "query_id", "left").select(
        "query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("wanted"), 6).alias("recall5"),
        F.round(F.coalesce(F.when(F.col("first_hit") <= 10, 1.0 / F.col("first_hit")), F.lit(0.0)), 6).alias("mrr10"),
        "first_hit", "duprate5", F.coalesce("works5", F.lit(0)).alias("works5"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """metrics: retriever, query_id, recall5, mrr10, latency -> by retriever means, latency percentiles,
    difference to the best, wins and losses against it (four decimals)."""
    means = metrics.groupBy("retriever").agg(
        F.round(F.avg("recall5"), 4).alias("recall5"), F.round(F.avg("mrr10"), 4).alias("mrr10"),
        F.round(F.percentile("latency", 0.5), 4).alias("p50"), F.round(F.percentile("latency", 0.95), 4).alias("p95"), F.count(F.lit(1)).alias("n"),
    )
    best = means.agg(F.max_by("retriever", F.struct("recall5", "retriever")).alias("best"))
    of_best = metrics.join(F.broadcast(best), F.col("retriever") == F.col("best")).select("query_id", F.col("recall5").alias("b"))
    against = metrics.join(of_best, "query_id").groupBy("retriever").agg(
        F.round(F.avg(F.col("recall5") - F.col("b")), 4).alias("diff"), F.count_if(F.col("recall5") > F.col("b")).alias("wins"), F.count_if(F.col("recall5") < F.col("b")).alias("losses")
    )
    return means.join(against, "retriever")


def bootstrap_hash(values: DataFrame, key: str, value: str, resamples: int, seed: int = 13) -> DataFrame:
    """values: place (0..n-1) and value of each group -> mean and 95 % interval of the mean, by
    resamples whose indices come from md5(seed:b:i), so that SQL gives the same."""
    n = values.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    draws = n.select(key, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).select(key, "n", "b", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    index = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "i")), 1, 8), 16, 10).cast("bigint") % F.col("n")
    means = draws.withColumn("place", index).join(values, [key, "place"]).groupBy(key, "b").agg(F.round(F.avg(value), 9).alias("m"))
    low_high = means.groupBy(key).agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))
    return values.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean")).join(low_high, key)


def bootstrap(values: DataFrame, key: str, order: str, value: str, resamples: int = 10_000, seed: int = 13) -> DataFrame:
    """mean, low, high by numpy's generator: the same resamples for every group of the same size, so
    groups are paired.  A group is the queries of one retriever; resamples are drawn 500 at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[value].to_numpy(float)
        draw = np.random.default_rng(seed)
        index = draw.integers(0, len(x), (resamples, len(x)))
        means = np.concatenate([x[index[i:i + 500]].mean(axis=1) for i in range(0, resamples, 500)])
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({key: [rows[key].iloc[0]], "mean": [x.mean()], "low": [low], "high": [high]})

    return values.filter(F.col(value).isNotNull()).groupBy(key).applyInPandas(run, f"{key} string, mean double, low double, high double")


def wilson(k: Column, n: Column) -> Column:
    """(low, high) of a share; NULL where n is 0."""
    p = k / F.nullif(n, F.lit(0))
    d = 1 + Z * Z / n
    centre, half = (p + Z * Z / (2 * n)) / d, Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    return F.struct(F.round(centre - half, 6).alias("low"), F.round(centre + half, 6).alias("high"))


def agreement(rows: DataFrame, said: Column, truth: Column, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and accuracy (0.0 on empty denominators) with the accuracy's interval."""
    rows = rows.withColumns({"s": said, "t": truth}).filter("s IS NOT NULL AND t IS NOT NULL")
    c = rows.groupBy(*by).agg(
        F.count_if(F.col("s") & F.col("t")).alias("tp"), F.count_if(F.col("s") & ~F.col("t")).alias("fp"),
        F.count_if(~F.col("s") & F.col("t")).alias("fn"), F.count_if(~F.col("s") & ~F.col("t")).alias("tn"), F.count(F.lit(1)).alias("n"),
    )
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ci = wilson(tp + F.col("tn"), F.col("n"))
    return c.withColumns({
        "precision": F.round(part(tp, tp + fp), 6), "recall": F.round(part(tp, tp + fn), 6), "f1": F.round(part(2 * tp, 2 * tp + fp + fn), 6),
        "accuracy": F.round(part(tp + F.col("tn"), F.col("n")), 6), "low": ci["low"], "high": ci["high"],
    })


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters; NULL where chance agreement is 1 or there are no rows."""
    cells = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))).alias("same"))
    of_a, of_b = cells.groupBy("x").agg(F.sum("n").alias("na")), cells.groupBy("y").agg(F.sum("n").alias("nb"))
    chance = of_a.join(of_b, F.col("x") == F.col("y")).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    po, pe = F.coalesce("same", F.lit(0)) / F.nullif("total", F.lit(0)), F.coalesce("e", F.lit(0)) / F.nullif(F.col("total") * F.col("total"), F.lit(0))
    return total.join(F.broadcast(chance), how="cross").select(
        F.coalesce("total", F.lit(0)).alias("n"), F.round(po, 6).alias("accuracy"), F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa")
    )


def answer_metrics(answers: DataFrame) -> DataFrame:
    """answers: model, answerable, abstained, correct, sentences array<struct<verdict, cited array<int>,
    source int>> -> shares by model; NULL on an empty denominator."""
    facts = F.filter("sentences", lambda s: s["verdict"].isNotNull())
    good = F.filter(facts, lambda s: s["verdict"] == "supported")
    rows = answers.select(
        "model", "answerable", "abstained", "correct", F.size(facts).alias("facts"), F.size(good).alias("good"),
        F.size(F.filter(facts, lambda s: s["verdict"] == "partial")).alias("partial"), F.size(F.filter(facts, lambda s: F.size(s["cited"]) > 0)).alias("cited"),
        F.aggregate(facts, F.lit(0), lambda n, s: n + F.size(s["cited"])).alias("marks"),
        F.aggregate(facts, F.lit(0), lambda n, s: n + F.when((s["verdict"] == "supported") & F.array_contains(s["cited"], s["source"]), 1).otherwise(0)).alias("right"),
    )
    part = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    s = F.sum
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("answers"),
        part(F.count_if(~F.col("abstained") & (F.col("facts") > 0) & (F.col("good") == F.col("facts"))), F.count(F.lit(1))).alias("grounded"),
        part(s("good"), s("facts")).alias("support"), part(s("partial"), s("facts")).alias("partial"),
        part(s("right"), s("marks")).alias("citation_precision"), part(s("cited"), s("facts")).alias("citation_coverage"),
        part(F.count_if("correct"), F.count_if(F.col("answerable"))).alias("correct"),
        part(F.count_if(F.col("abstained") & ~F.col("answerable")), F.count_if(~F.col("answerable"))).alias("abstention_recall"),
        part(F.count_if(F.col("abstained") & F.col("answerable")), F.count_if(F.col("answerable"))).alias("false_abstention"),
    )


def failures(answers: DataFrame) -> DataFrame:
    """model, id, failure: every category an answer falls into."""
    any_of = lambda v: F.exists("sentences", lambda s: s["verdict"] == v)
    found = F.array_compact(F.array(
        F.when(F.col("abstained") & F.col("answerable"), "false_abstention"), F.when(~F.col("abstained") & ~F.col("answerable"), "answered_unanswerable"),
        F.when(any_of("unsupported"), "unsupported_sentence"), F.when(any_of("partial"), "partly_supported"),
        F.when(~F.col("abstained") & F.exists("sentences", lambda s: F.size(s["cited"]) == 0), "uncited_sentence"), F.when(~F.col("abstained") & ~F.col("correct"), "wrong"),
    ))
    return answers.select("model", "id", F.explode(found).alias("failure"))


def with_totals(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by row and column with totals, by one cube."""
    return rows.cube(row, column).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).select(
        F.when(F.col("level").isin(2, 3), "total").otherwise(F.col(row)).alias(row), F.when(F.col("level").isin(1, 3), "total").otherwise(F.col(column)).alias(column), "n"
    )


def question_set(items: DataFrame, question: str, gold: Column, asked: Column) -> DataFrame:
    """One row: questions, those whose own item is missing, and the least, median and greatest number of
    gold items."""
    each = items.groupBy(question).agg(F.count_if(gold).alias("g"), F.bool_or(asked).alias("asked"))
    return each.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(~F.col("asked")).alias("missing_parent"), F.min("g").alias("least"), F.percentile("g", 0.5).alias("median"), F.max("g").alias("most")
    )


def overlap_report(questions: DataFrame, overlap: Column, above: float = 0.3) -> DataFrame:
    """One row: the median overlap of questions with their gold quotes, and how many lie above."""
    return questions.select(overlap.alias("o")).agg(F.round(F.percentile("o", 0.5), 4).alias("median"), F.count_if(F.col("o") > above).alias("above"), F.count("o").alias("questions"))


def pooling(gold: DataFrame, pooled: DataFrame, least: int = 2) -> DataFrame:
    """gold: question_id, doc_id; pooled: question_id, doc_id, grade -> question_id, gold_items, in_pool, extra: how
    many gold items the pool holds, and how many others were graded ``least`` or more."""
    held = gold.join(pooled.select("question_id", "doc_id").distinct().withColumn("there", F.lit(1)), ["question_id", "doc_id"], "left")
    found = held.groupBy("question_id").agg(F.count(F.lit(1)).alias("gold_items"), F.count("there").alias("in_pool"))
    extra = pooled.filter(F.col("grade") >= least).join(gold, ["question_id", "doc_id"], "left_anti").groupBy("question_id").agg(F.count(F.lit(1)).alias("extra"))
    return found.join(extra, "question_id", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
