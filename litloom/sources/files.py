"""Files between the stages: CSV and JSON lines with given schemas, feeds, catalogue replies, vectors,
append-only logs and result tables.

NULL is written to CSV as an empty field, and an empty field is read as NULL.  A missing input is an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

# The columns of the manifest, in order.
MANIFEST = (
    "record_id work_id source arxiv_id arxiv_latest_version openalex_id doi title authors year venue published_version_url "
    "source_url fulltext_url license matched_queries stage1_result in_scope topic paper_type reject_reason fulltext_status "
    "duplicate_of canonical in_index not_indexed_reason n_chunks"
).split()
MANIFEST_SCHEMA = StructType([StructField(c, StringType()) for c in MANIFEST])
_CSV = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "quote": '"', "escape": '"', "multiLine": "true"}


def read_csv(spark: SparkSession, path: str, schema: StructType = MANIFEST_SCHEMA) -> DataFrame:
    try:
        return spark.read.options(**_CSV).schema(schema).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_csv(rows: DataFrame, path: str, schema: StructType = MANIFEST_SCHEMA, mode: str = "overwrite") -> None:
    """Projects to the schema: unknown columns are dropped, missing ones are empty."""
    have = set(rows.columns)
    rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode(mode).options(
        **_CSV, emptyValue="", nullValue=""
    ).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Blank lines are skipped; several paths are read as one."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def union_candidates(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


FEED = (
    "struct<totalResults bigint, entry array<struct<id string, title string, summary string, published string, updated string, "
    "doi string, author array<struct<name string>>, primary_category struct<_term string>, category array<struct<_term string>>>>>"
)


def feed_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """The entries of Atom feeds: arxiv_id and version out of the entry's id, white space collapsed,
    the primary category first without being repeated.  A feed whose entry reports an error raises."""
    from litloom.functions.text import clean_space

    bare = F.regexp_replace(F.regexp_replace(xml, r"<(/?)[A-Za-z]+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    # a feed with one entry and one with many give the same array
    rows = feeds.select(F.from_xml(bare, FEED.removeprefix("struct<").removesuffix(">"), {"rowTag": "feed"}).alias("f"))
    e = F.explode("f.entry").alias("e")
    first = F.array(F.col("e.primary_category._term"))
    return rows.select(F.col("f.totalResults").alias("total"), e).select(
        F.when(F.col("e.id").contains("/api/errors"), F.raise_error(F.concat(F.lit("feed error: "), "e.summary"))).otherwise(F.regexp_extract("e.id", r"abs/(.+)v(\d+)$", 1)).alias("arxiv_id"),
        F.regexp_extract("e.id", r"abs/(.+)v(\d+)$", 2).try_cast("int").alias("version"), "total",
        clean_space(F.col("e.title")).alias("title"), clean_space(F.col("e.summary")).alias("abstract"),
        F.transform("e.author", lambda a: clean_space(a["name"])).alias("authors"),
        F.array_compact(F.array_union(first, F.transform("e.category", lambda c: c["_term"]))).alias("categories"),
        F.substring("e.published", 1, 10).cast("date").alias("published"), F.substring("e.published", 1, 4).try_cast("int").alias("year"),
    )


LOCATION = "struct<landing_page_url string, pdf_url string, version string, source struct<display_name string>>"
CATALOGUE = (
    f"struct<results array<struct<id string, doi string, title string, publication_year int, primary_location {LOCATION}, "
    f"locations array<{LOCATION}>, abstract_inverted_index map<string,array<int>>>>>"
)


def catalogue_works(replies: DataFrame, column: str = "reply") -> DataFrame:
    """One row for each work of JSON catalogue replies, with its place in the reply."""
    return replies.select(F.posexplode(F.from_json(column, CATALOGUE)["results"]).alias("pos", "w")).select("pos", "w.*")


def location_fields(locations: Column, venue_host: str) -> Column:
    """struct<pdf, published>: the first pdf at the venue's host, and whether a version was published."""
    pdfs = F.filter(F.transform(locations, lambda x: x["pdf_url"]), lambda u: u.contains(venue_host))
    return F.struct(F.try_element_at(pdfs, F.lit(1)).alias("pdf"), F.exists(locations, lambda x: x["version"] == "publishedVersion").alias("published"))


def preferred_doi(dois: Column) -> Column:
    """The first that does not stand for the archive copy, else the first."""
    other = F.filter(dois, lambda d: ~F.lower(d).startswith("10.48550/arxiv."))
    return F.coalesce(F.try_element_at(other, F.lit(1)), F.try_element_at(dois, F.lit(1)))


def write_vectors(vectors: DataFrame, path: str, key: str = "chunk_id") -> int:
    """Appends the vectors whose key is not there yet, by variant and model; rows written."""
    spark = vectors.sparkSession
    try:
        done = spark.read.parquet(path).select(key, "variant", "model")
        vectors = vectors.join(done, [key, "variant", "model"], "left_anti")
    except AnalysisException:
        pass
    from pyspark.sql import Observation

    seen = Observation()
    vectors.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("variant", "model").parquet(path)
    return seen.get["n"]


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """One line of text for each row, between bars."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    return rows.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
