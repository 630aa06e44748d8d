"""From candidates to a catalogued collection: labels, projections, catalogue look-ups, full texts.

Keys are compared as they are; NULL keys join with nothing and keep their row.  Empty strings count as
missing where a column is filled.  No step collects rows on the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions.fuzzy import fuzz_token_set_ratio
from litloom.session import ship

# Hosts of the archive and of the venue, the archive's own identifiers, the steps of full text.
ARCHIVE_HOST, VENUE_HOSTS, ARCHIVE_DOI = "arxiv.org", r"aclanthology\.org|aclweb\.org/anthology", "10.48550/arxiv."
STEPS = ("html", "ar5iv", "pdf")


def filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def with_labels(candidates: DataFrame, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """Every candidate with the columns of its label, NULL where there is none.  Labels are distinct by key."""
    return candidates.join(labels, key, "left")


def projected(labelled: DataFrame) -> DataFrame:
    """labelled: record_id, stage1, title, authors, year, in_scope, out_reason -> record_id, in_scope,
    reject_reason.

    A label counts only where the first stage included.  The reason is that of the first stage, else the
    label's, else ``incomplete_metadata`` for a record in scope without title, authors or year."""
    counts = (F.col("stage1") == "include") & F.col("in_scope").isNotNull()
    complete = filled(F.col("title")).isNotNull() & filled(F.col("authors")).isNotNull() & F.col("year").isNotNull()
    wanted = F.coalesce(counts & F.col("in_scope"), F.lit(False))
    reason = F.coalesce(
        F.when(F.col("stage1").startswith("reject:"), F.expr("substr(stage1, 8)")),
        F.when(F.coalesce(counts & ~F.col("in_scope"), F.lit(False)), F.coalesce("out_reason", F.lit(""))),
        F.when(wanted & ~complete, "incomplete_metadata"), F.lit(""),
    )
    return labelled.select("record_id", (wanted & complete).alias("in_scope"), reason.alias("reject_reason"))


def incomplete(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, missing: the rows that lack one of the columns, and which."""
    lack = F.array_compact(F.array(*[F.when(filled(F.col(c).cast("string")).isNull(), F.lit(c)) for c in columns]))
    return rows.select(key, F.array_join(lack, " ").alias("missing")).filter("missing <> ''")


def assert_complete(rows: DataFrame, key: str, columns: list[str]) -> None:
    """Raises where a row lacks a column, naming at most twenty keys."""
    bad = [r[0] for r in incomplete(rows, key, columns).select(key).limit(20).collect()]
    if bad:
        raise ValueError(f"rows without {', '.join(columns)}: {bad}")


def joined_or_fallback(left: DataFrame, right: DataFrame, key: str, fallback: Column, right_key: str) -> DataFrame:
    """left with the columns of right by ``key``, or by ``fallback`` where the key is not there.  right is
    distinct by its key."""
    columns = [c for c in right.columns if c != right_key]
    one = right.select(F.col(right_key).alias("_k"), F.struct(*columns).alias("_one"))
    two = right.select(F.col(right_key).alias("_f"), F.struct(*columns).alias("_two"))
    both = left.withColumn("_fallback", fallback).join(one, F.col(key) == F.col("_k"), "left").join(two, F.col("_fallback") == F.col("_f"), "left")
    return both.select(*left.columns, *[F.coalesce(F.col(f"_one.{c}"), F.col(f"_two.{c}")).alias(c) for c in columns])


def appended(rows: DataFrame, more: DataFrame, key: str, column: str) -> DataFrame:
    """rows with ``more``'s elements (key, element) behind their own in an array column, in their order."""
    element = [c for c in more.columns if c != key][0]
    extra = more.groupBy(key).agg(F.array_sort(F.collect_list(element)).alias("_more"))
    empty = F.array().cast(rows.schema[column].dataType)
    return rows.join(extra, key, "left").withColumn(column, F.concat(F.coalesce(column, empty), F.coalesce("_more", empty))).drop("_more")


def batches(ids: DataFrame, key: str, size: int = 50) -> DataFrame:
    """batch (from 0), ids (sorted), cache_key: numbered by a range sort, so that no task sees all ids.
    The cache key is the sha1 of the sorted ids."""
    ordered = ids.select(F.lower(key).alias("id")).filter("id <> ''").distinct()
    numbered = rank_in_order(ordered, "id")
    packed = numbered.groupBy(F.floor(F.col("n") / size).cast("bigint").alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return packed.withColumn("cache_key", F.substring(F.sha1(F.array_join("ids", "|")), 1, 12))


def rank_in_order(rows: DataFrame, key: str, prefix: int = 2) -> DataFrame:
    """n: the place of each distinct key in their order, from 0.  Places within a group of keys with the
    same first letters, plus the sizes of the groups before it: no window over all rows."""
    head = F.substring(key, 1, prefix)
    sizes = rows.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("k"))
    before = sizes.select("head", F.coalesce(F.sum("k").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.withColumn("head", head).withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy(key)) - 1)
    return placed.join(before, "head").select(*rows.columns, (F.col("before") + F.col("place")).alias("n"))


def title_hit(title: Column, year: Column, other: Column, other_year: Column) -> Column:
    """Equal normalised titles, or a token set ratio of 95 and lengths within 0.6; years at most two
    apart.  A missing year never matches."""
    a, b = T.norm_title(title), T.norm_title(other)
    alike = (F.least(F.length(a), F.length(b)) >= 0.6 * F.greatest(F.length(a), F.length(b))) & (fuzz_token_set_ratio(a, b) >= 95)
    return F.coalesce((b != "") & ((a == b) | alike) & (F.abs(year - other_year) <= 2), F.lit(False))


def best_hits(rows: DataFrame, hits: DataFrame, key: str = "record_id") -> DataFrame:
    """rows: key, title, year; hits: key, pos, hit_title, hit_year, published, work -> key, work: the first
    hit in a published version, else the first hit."""
    found = rows.join(hits, key).filter(title_hit(F.col("title"), F.col("year"), F.col("hit_title"), F.col("hit_year")))
    return found.groupBy(key).agg(F.min_by("work", F.struct(~F.coalesce("published", F.lit(False)), F.col("pos"))).alias("work"))


def looked_up(todo: DataFrame, by_title: DataFrame, by_doi: DataFrame, key: str = "record_id") -> DataFrame:
    """todo: key, arxiv_id; by_title: key, work; by_doi: doi, work -> key, work, how.  The second look-up is
    asked only for what the first missed."""
    first = todo.join(by_title, key, "left")
    missed = first.filter("work IS NULL").drop("work").withColumn("doi", F.concat(F.lit(ARCHIVE_DOI), F.lower("arxiv_id")))
    second = missed.join(by_doi.select(F.lower("doi").alias("doi"), "work"), "doi", "left").select(key, "work", F.when(F.col("work").isNotNull(), "doi").alias("how"))
    return first.filter("work IS NOT NULL").select(key, "work", F.lit("title").alias("how")).unionByName(second)


def venue_records(works: DataFrame) -> DataFrame:
    """works: id, title, year, published, doi, locations array<struct<landing, pdf, license>> -> records of
    the venue that are not in the archive: record_id, title, year, published, doi, page, pdf, license."""
    urls = F.filter(F.flatten(F.transform("locations", lambda x: F.array(x["landing"], x["pdf"]))), lambda u: F.coalesce(u, F.lit("")) != "")
    venue = F.filter("urls", lambda u: u.rlike(VENUE_HOSTS))
    kept = works.withColumn("urls", urls).withColumn("venue", venue).filter(~F.exists("urls", lambda u: u.contains(ARCHIVE_HOST)) & (F.size("venue") > 0))
    first = lambda xs: F.get(xs, F.lit(0))
    pdf = F.coalesce(first(F.filter("venue", lambda u: u.endswith(".pdf"))), F.concat(F.rtrim(first(F.col("venue")), F.lit("/")), F.lit(".pdf")))
    page = F.coalesce(first(F.filter("venue", lambda u: ~u.endswith(".pdf"))), F.regexp_replace(pdf, r"\.pdf$", ""))
    own = first(F.filter("locations", lambda x: F.coalesce(x["landing"].rlike(VENUE_HOSTS), F.lit(False)) | F.coalesce(x["pdf"].rlike(VENUE_HOSTS), F.lit(False))))
    return kept.select(
        F.concat(F.lit("oa:"), F.substring_index("id", "/", -1)).alias("record_id"), F.coalesce("title", F.lit("")).alias("title"), "year",
        F.coalesce("published", F.concat(F.col("year").cast("string"), F.lit("-01-01"))).alias("published"),
        F.regexp_replace(F.lower(F.coalesce("doi", F.lit(""))), "^https://doi.org/", "").alias("doi"),
        page.alias("page"), pdf.alias("pdf"), F.coalesce(own["license"], F.lit("")).alias("license"),
    )


def fan_in(found: DataFrame, key: str, order: str, phrase: str) -> DataFrame:
    """The first record of each key, with all phrases that found it in their order."""
    rest = [c for c in found.columns if c not in (key, order, phrase)]
    return found.groupBy(key).agg(
        F.min_by(F.struct(*rest), order).alias("_r"), F.transform(F.array_sort(F.collect_set(F.struct(order, phrase))), lambda p: p[phrase]).alias("phrases")
    ).select(key, *[F.col(f"_r.{c}") for c in rest], F.array_distinct("phrases").alias("matched_queries"))


class Host(Protocol):
    def get(self, url: str) -> tuple[int, bytes] | None: ...


def attempts(todo: DataFrame, host: Callable[[], Host], valid: Callable[[str, bytes], str], pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """todo: key, urls (map of step to address) -> key, step, url, outcome, content.

    The steps are tried in order until one is saved.  ``host`` is made once in every task; ``valid`` gives
    the reason why content is no full text, or ''.  outcome: saved, a reason, http CODE, or no response.
    One host is asked by as many tasks as there are partitions: repartition by host to bound that."""
    ship(todo.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = host()
        for frame in frames:
            out = []
            for key, urls in zip(frame["key"], frame["urls"]):
                urls = dict(urls)
                for step in STEPS:
                    if step not in urls:
                        continue
                    if pause:
                        sleep(pause)
                    reply = client.get(urls[step])
                    why = "no response" if reply is None else f"http {reply[0]}" if reply[0] != 200 else valid(step, reply[1]) or "saved"
                    out.append((key, step, urls[step], why, reply[1] if why == "saved" else None))
                    if why == "saved":
                        break
            yield pd.DataFrame(out, columns=["key", "step", "url", "outcome", "content"])

    return todo.select("key", "urls").mapInPandas(run, "key string, step string, url string, outcome string, content binary")


def status_of(tried: DataFrame) -> DataFrame:
    """tried: key, step, url, outcome -> key, status, url: the first step that was saved; else ``none`` if every
    host answered, and blank (to be tried again) if one did not."""
    place = F.array_position(F.array(*map(F.lit, STEPS)), F.col("step"))
    saved = F.col("outcome") == "saved"
    return tried.groupBy("key").agg(
        F.min(F.when(saved, F.struct(place.alias("p"), "step", "url"))).alias("s"), F.bool_or(F.col("outcome") == "no response").alias("silent")
    ).select("key", F.coalesce("s.step", F.when(F.col("silent"), "").otherwise("none")).alias("status"), F.coalesce("s.url", F.lit("")).alias("url"))


def licence(html: Column, *others: Column) -> Column:
    """What stands behind ``License:`` up to the next tag or line; else the first other that is filled."""
    return F.coalesce(filled(F.regexp_extract(html, r"License:\s*([^<\n]+)", 1)), *[filled(c) for c in others])


def write_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table at ``path`` does not hold yet; returns how many.  Nested columns
    are kept as they are."""
    spark = rows.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def write_once(rows: DataFrame, path: str) -> None:
    """Writes a table that is never overwritten: hand-made labels would be lost.  Raises if it is there."""
    rows.write.mode("errorifexists").parquet(path)
