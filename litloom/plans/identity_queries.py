"""Queries on records, works and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.functions import fuzzy
from litloom.functions import text as T
from litloom.operators import filters, identity
from litloom.plans.catalogue import query
from litloom.session import Scratch, table


def _filled(column: str):
    return F.when(F.lower(F.trim(column)).isin("", "-", "n/a"), None).otherwise(F.trim(column))


def filled_sql(column: str) -> str:
    return f"CASE WHEN lower(trim({column})) IN ('', '-', 'n/a') THEN NULL ELSE trim({column}) END"


def latest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest with the load of each record that is true last."""
    return filters.latest_per_key(table(spark, d, "manifest_dedup"), ["record_id"], ["updated_at", "row_no"])


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC, row_no DESC) AS place FROM manifest_dedup) WHERE place = 1)"
_SOURCE = "lower(translate(trim(source), '-', '_'))"


def _clean(spark, d) -> DataFrame:
    version = F.coalesce(F.regexp_extract(F.coalesce("arxiv_latest_version", F.lit("")), r"(\d+)", 1).try_cast("int"), F.lit(0))
    return latest(spark, d).select(
        "record_id", _filled("work_id").alias("work_id"), F.lower(F.translate(F.trim("source"), "-", "_")).alias("source"), _filled("arxiv_id").alias("arxiv_id"),
        F.lower(_filled("fulltext_status")).alias("status"), version.alias("version"), _filled("not_indexed_reason").alias("reason"),
        _filled("openalex_id").alias("openalex_id"), _filled("doi").alias("doi"), _filled("duplicate_of").alias("duplicate_of"), "title", "year", "authors",
    )


_CLEAN = f"""{LATEST}, clean AS (
  SELECT record_id, {filled_sql('work_id')} AS work_id, {_SOURCE} AS source, {filled_sql('arxiv_id')} AS arxiv_id,
         lower({filled_sql('fulltext_status')}) AS status,
         coalesce(try_cast(regexp_extract(coalesce(arxiv_latest_version, ''), '(\\d+)', 1) AS INT), 0) AS version,
         {filled_sql('not_indexed_reason')} AS reason, {filled_sql('openalex_id')} AS openalex_id, {filled_sql('doi')} AS doi,
         {filled_sql('duplicate_of')} AS duplicate_of, title, year, authors
  FROM latest)"""
_EDGES = f"""{_CLEAN}, keyed AS (
  SELECT record_id, 'arxiv=' || arxiv_id AS key FROM clean WHERE arxiv_id IS NOT NULL
  UNION SELECT record_id, 'openalex=' || openalex_id FROM clean WHERE openalex_id IS NOT NULL
  UNION SELECT record_id, 'record=' || record_id FROM clean
  UNION SELECT record_id, 'record=' || duplicate_of FROM clean WHERE duplicate_of IS NOT NULL
  UNION SELECT record_id, 'doi=' || lower(doi) FROM clean WHERE doi IS NOT NULL AND NOT starts_with(lower(doi), '10.48550/arxiv.')),
edges AS (
  SELECT DISTINCT k.a, record_id AS b FROM keyed JOIN (SELECT key, min(record_id) AS a FROM keyed GROUP BY key) k USING (key) WHERE k.a <> record_id)"""
_COMPONENTS = f"""{_EDGES}, both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT record_id AS node, record_id AS other FROM clean UNION SELECT r.node, t.b FROM reach r JOIN both_ t ON r.other = t.a),
comps AS (SELECT node AS record_id, min(other) AS component FROM reach GROUP BY node)"""


@query(f"WITH {LATEST} SELECT record_id, row_no, title FROM latest")
def latest_per_key(spark, d):
    return latest(spark, d).select("record_id", "row_no", "title")


@query(f"WITH {_EDGES} SELECT a, b FROM edges")
def id_edges(spark, d):
    return identity.identifier_edges(_clean(spark, d))


def _components(spark, d, scratch):
    records = scratch.keep(_clean(spark, d))
    parts = identity.components(records.select(F.col("record_id").alias("node")), identity.identifier_edges(records), scratch)
    return records, parts.withColumnRenamed("node", "record_id")


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT record_id, component FROM comps")
def record_components(spark, d):
    return _components(spark, d, Scratch(spark))[1].select("record_id", "component")


@query(f"""WITH RECURSIVE {_COMPONENTS}
SELECT component, coalesce(min(CASE WHEN source = 'arxiv' AND coalesce(arxiv_id, '') <> '' THEN arxiv_id END), min(record_id)) AS work_id
FROM comps JOIN clean USING (record_id) GROUP BY component""")
def work_id(spark, d):
    records, parts = _components(spark, d, Scratch(spark))
    return identity.work_ids(records.join(parts, "record_id"))


_FULL = "coalesce(status IN ('html', 'ar5iv', 'pdf'), false)"


@query(f"""WITH {_CLEAN}, ranked AS (
  SELECT *, first_value(record_id) OVER (PARTITION BY work_id ORDER BY
    CASE WHEN source = 'arxiv' AND {_FULL} THEN 0 WHEN source = 'acl' AND {_FULL} THEN 1 WHEN source = 'arxiv' THEN 2 ELSE 3 END,
    CASE WHEN status IN ('html', 'ar5iv') THEN 0 ELSE 1 END, -version, record_id) AS head
  FROM clean WHERE work_id IS NOT NULL)
SELECT work_id, record_id, record_id = head AS canonical,
  record_id = head AND {_FULL} AND NOT coalesce(reason = 'corpus_cap', false) AS in_index,
  CASE WHEN record_id <> head THEN 'duplicate_of:' || head WHEN coalesce(reason = 'corpus_cap', false) THEN 'corpus_cap' WHEN NOT {_FULL} THEN 'no_fulltext' ELSE '' END AS not_indexed_reason
FROM ranked""")
def canonical_pick(spark, d):
    return identity.canonical_flags(_clean(spark, d).filter("work_id IS NOT NULL")).drop("duplicate_of")


@query(f"""WITH {_CLEAN}, ranked AS (
  SELECT *, first_value(record_id) OVER (PARTITION BY work_id ORDER BY
    CASE WHEN source = 'arxiv' AND {_FULL} THEN 0 WHEN source = 'acl' AND {_FULL} THEN 1 WHEN source = 'arxiv' THEN 2 ELSE 3 END,
    CASE WHEN status IN ('html', 'ar5iv') THEN 0 ELSE 1 END, -version, record_id) AS head
  FROM clean WHERE work_id IS NOT NULL)
SELECT record_id, CASE WHEN record_id = head THEN '' WHEN source IN ('arxiv_v1', 'acl_copy') THEN coalesce(duplicate_of, head) ELSE head END AS duplicate_of FROM ranked""")
def canonical_duplicates(spark, d):
    """What each record is a duplicate of; fetched copies keep what they name."""
    return identity.canonical_flags(_clean(spark, d).filter("work_id IS NOT NULL")).select("record_id", "duplicate_of")


@query(f"""WITH {_CLEAN}, ranked AS (SELECT work_id, count(*) AS n FROM clean WHERE work_id IS NOT NULL GROUP BY work_id)
SELECT count(*) AS works, CAST(sum(n) AS BIGINT) AS records, 0 AS broken FROM ranked""")
def one_canonical_per_work(spark, d):
    flags = canonical_pick(spark, d).groupBy("work_id").agg(F.count_if("canonical").alias("c"), F.count(F.lit(1)).alias("n"))
    return flags.agg(F.count(F.lit(1)).alias("works"), F.sum("n").alias("records"), F.count_if(F.col("c") != 1).cast("int").alias("broken"))


_DECIDE = "CASE WHEN coalesce(title_ratio < {t} OR author_jaccard < {a}, true) OR coalesce(abstract_cosine < {c}, false) THEN 'separate' WHEN body_ratio < 0.6 THEN 'related' ELSE 'merge' END"


@query(f"SELECT pair_no, {_DECIDE.format(t=92, a=0.5, c=0.85)} AS decided FROM dedup_candidates")
def decide_pairs(spark, d):
    pairs = table(spark, d, "dedup_candidates")
    return pairs.select("pair_no", identity.decide(F.col("title_ratio"), F.col("author_jaccard"), F.col("abstract_cosine"), F.col("body_ratio")).alias("decided"))


_SWEEP = """swept AS (
  SELECT t AS title_ratio, a AS author_jaccard, c AS abstract_cos, count(*) FILTER (m AND same) AS tp, count(*) FILTER (m AND NOT same) AS fp, count(*) FILTER (NOT m AND same) AS fn
  FROM (SELECT t, a, c, human_same_work AS same,
          NOT (coalesce(title_ratio < t OR author_jaccard < a, true) OR coalesce(abstract_cosine < c, false)) AS m
        FROM dup_pairs_to_label, (SELECT unnest([80.0, 85.0, 88.0, 90.0, 92.0, 95.0, 98.0])::DOUBLE AS t), (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS a), (SELECT unnest([0.80, 0.85, 0.90])::DOUBLE AS c)
        WHERE human_same_work IS NOT NULL)
  GROUP BY t, a, c),
rated AS (SELECT *, coalesce(round(tp / nullif(tp + fp, 0), 3), 0.0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 3), 0.0) AS recall FROM swept)"""


@query(f"WITH {_SWEEP} SELECT * FROM rated")
def dedup_sweep(spark, d):
    return identity.sweep(table(spark, d, "dup_pairs_to_label"), F.col("human_same_work"))


@query(f"WITH {_SWEEP} SELECT recall, title_ratio, author_jaccard, abstract_cos FROM rated WHERE precision = 1.0 ORDER BY recall DESC, title_ratio DESC, author_jaccard DESC, abstract_cos DESC LIMIT 1")
def dedup_best_rule(spark, d):
    return identity.best_rule(dedup_sweep(spark, d))


@query("""SELECT pair_id FROM (SELECT pair_id, bool_or(title_ratio BETWEEN 70 AND 95 OR author_jaccard BETWEEN 0.3 AND 0.8) AS hard, max(title_ratio) AS t FROM dup_pairs_to_label GROUP BY pair_id)
ORDER BY CASE WHEN hard THEN 0 ELSE 1 END, CASE WHEN hard THEN md5('13:' || pair_id) END, t DESC NULLS LAST, pair_id LIMIT 20""")
def hard_pair_sample(spark, d):
    hard = F.bool_or(F.col("title_ratio").between(70, 95) | F.col("author_jaccard").between(0.3, 0.8))
    pairs = table(spark, d, "dup_pairs_to_label").groupBy("pair_id").agg(F.coalesce(hard, F.lit(False)).alias("hard"), F.max("title_ratio").alias("t"))
    order = [F.when(F.col("hard"), 0).otherwise(1), F.when(F.col("hard"), filters.hash_order(13, F.col("pair_id"))), F.col("t").desc_nulls_last(), "pair_id"]
    return pairs.orderBy(*order).limit(20).select("pair_id")


_NAMES = "list_distinct(list_transform(list_filter(list_transform(string_split({0}, ';'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), lambda x: lower(split_part(x, ' ', -1))))"


@query(f"""WITH s AS (SELECT pair_id, labelled_at, coalesce({_NAMES.format('authors_a')}, []) AS a, coalesce({_NAMES.format('authors_b')}, []) AS b FROM dup_pairs_to_label)
SELECT pair_id, labelled_at, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 3) END AS jaccard FROM s""")
def surname_jaccard(spark, d):
    rows = table(spark, d, "dup_pairs_to_label")
    return rows.select("pair_id", "labelled_at", T.jaccard(T.surnames(F.col("authors_a")), T.surnames(F.col("authors_b"))).alias("jaccard"))


@query("SELECT pair_no, title_ratio FROM dedup_candidates WHERE title_a IS NOT NULL AND title_b IS NOT NULL AND title_ratio IS NOT NULL")
def pair_title_ratio(spark, d):
    """Computed anew from the titles; the SQL is what the table stores."""
    pairs = table(spark, d, "dedup_candidates").filter("title_a IS NOT NULL AND title_b IS NOT NULL AND title_ratio IS NOT NULL")
    return pairs.select("pair_no", fuzzy.fuzz_title_ratio(F.col("title_a"), F.col("title_b")).alias("title_ratio"))


@query()
def pair_title_ratio_all(spark, d):
    """Every pair with both titles, those without a stored ratio too, for which SQL has nothing to compare."""
    pairs = table(spark, d, "dedup_candidates").filter("title_a IS NOT NULL AND title_b IS NOT NULL")
    return pairs.select("pair_no", fuzzy.fuzz_title_ratio(F.col("title_a"), F.col("title_b")).alias("title_ratio"))


@query(f"""WITH {_CLEAN} SELECT record_id, min(record_id) OVER (PARTITION BY openalex_id) AS representative FROM clean
WHERE openalex_id IS NOT NULL QUALIFY min(record_id) OVER (PARTITION BY openalex_id) <> record_id""")
def silver_pairs(spark, d):
    """Records known to be one work by their catalogue id: pairs with the group's representative."""
    rows = _clean(spark, d).filter("openalex_id IS NOT NULL").select("record_id", "openalex_id")
    return rows.join(rows.groupBy("openalex_id").agg(F.min("record_id").alias("representative")), "openalex_id").filter("record_id <> representative").select("record_id", "representative")


_WORDS = "list_distinct(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '))"


@query(f"""WITH RECURSIVE t AS (
  SELECT record_id AS id, {_WORDS.format('title')} AS w FROM (SELECT record_id, max(title) AS title FROM candidates_dedup WHERE title IS NOT NULL GROUP BY record_id)),
p AS (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.id < y.id WHERE len(list_intersect(x.w, y.w)) >= len(list_distinct(list_concat(x.w, y.w))) * 0.6),
both_ AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT a AS node, a AS other FROM both_ UNION SELECT r.node, t.b FROM reach r JOIN both_ t ON r.other = t.a),
c AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node)
SELECT node AS record_id, class_id, links FROM c JOIN (SELECT a AS node, count(*) AS links FROM both_ GROUP BY a) USING (node)""")
def title_classes(spark, d):
    """One row for each record with a similar title: its class and its number of links."""
    scratch = Scratch(spark)
    titles = table(spark, d, "candidates_dedup").groupBy("record_id").agg(F.max("title").alias("title")).filter("title IS NOT NULL")
    words = F.filter(F.array_distinct(F.split(T.norm_title(F.col("title")), " ")), lambda w: w != "")
    pairs = scratch.keep(identity.similar_titles(titles.select(F.col("record_id").alias("id"), words.alias("words")), scratch))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    classes = identity.components(ends, pairs, scratch)
    return classes.join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("links")), "node").select(F.col("node").alias("record_id"), F.col("component").alias("class_id"), "links")


@query(r"""WITH v AS (SELECT record_id, coalesce(try_cast(regexp_extract(coalesce(arxiv_latest_version, ''), '(\d+)', 1) AS INT), 0) AS version, title, matched_queries, row_no FROM manifest_dedup)
SELECT record_id, max(version) AS version, arg_max(title, (version, row_no)) AS title,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(matched_queries, '|')) FILTER (matched_queries IS NOT NULL AND trim(matched_queries) NOT IN ('', '-') AND lower(trim(matched_queries)) <> 'n/a')))), ' '), '') AS queries
FROM v GROUP BY record_id""")
def version_merge(spark, d):
    """Loads of a record: the highest version's title, the union of all matched queries."""
    version = F.coalesce(F.regexp_extract(F.coalesce("arxiv_latest_version", F.lit("")), r"(\d+)", 1).try_cast("int"), F.lit(0))
    rows = table(spark, d, "manifest_dedup").withColumn("version", version)
    spoken = F.when(_filled("matched_queries").isNotNull(), F.split("matched_queries", r"\|"))
    return rows.groupBy("record_id").agg(
        F.max("version").alias("version"), F.max_by("title", F.struct("version", "row_no")).alias("title"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(spoken)))), " ").alias("queries"),
    )


@query(f"""WITH {LATEST}, c AS (SELECT record_id, arg_max(title, (fetched_at, title)) AS title, CAST(arg_max(year, (fetched_at, title)) AS VARCHAR) AS year FROM candidates_dedup GROUP BY record_id)
SELECT coalesce(o.record_id, c.record_id) AS record_id, coalesce(nullif(c.title, ''), o.title) AS title, coalesce(nullif(c.year, ''), o.year) AS year
FROM latest o FULL JOIN c ON o.record_id = c.record_id""")
def catalogue_upsert(spark, d):
    new = table(spark, d, "candidates_dedup").groupBy("record_id").agg(F.max_by("title", F.struct("fetched_at", "title")).alias("title"), F.max_by("year", F.struct("fetched_at", "title")).cast("string").alias("year"))
    return filters.upsert(latest(spark, d), new, "record_id", ["title", "year"])


@query("SELECT DISTINCT record_id FROM manifest_dedup WHERE record_id NOT IN (SELECT record_id FROM candidates_dedup WHERE record_id IS NOT NULL)")
def anti_join_resume(spark, d):
    return table(spark, d, "manifest_dedup").select("record_id").distinct().join(table(spark, d, "candidates_dedup").select("record_id"), "record_id", "left_anti")


@query(f"""SELECT row_no, coalesce({filled_sql('published_version_url')}, {filled_sql('fulltext_url')}, {filled_sql('source_url')}, '') AS url,
coalesce({filled_sql('license')}, CASE WHEN {_SOURCE} = 'acl' THEN 'publisher' END, 'unknown') AS licence FROM manifest_dedup""")
def fallback_coalesce(spark, d):
    rows = table(spark, d, "manifest_dedup")
    acl = F.lower(F.translate(F.trim("source"), "-", "_")) == "acl"
    return rows.select("row_no", F.coalesce(_filled("published_version_url"), _filled("fulltext_url"), _filled("source_url"), F.lit("")).alias("url"),
                       F.coalesce(_filled("license"), F.when(acl, "publisher"), F.lit("unknown")).alias("licence"))


@query(f"""WITH {_CLEAN} SELECT record_id || 'v1' AS copy_id, 'arxiv_v1' AS kind FROM clean WHERE source = 'arxiv' AND version > 1 AND record_id || 'v1' NOT IN (SELECT record_id FROM clean)
UNION ALL SELECT 'acl:' || record_id, 'acl_copy' FROM clean WHERE source = 'arxiv' AND doi IS NOT NULL AND 'acl:' || record_id NOT IN (SELECT record_id FROM clean)""")
def extra_copies(spark, d):
    """None, one or two further copies to fetch for each record, without those already there."""
    rows = _clean(spark, d)
    arxiv = F.col("source") == "arxiv"
    copies = F.array_compact(F.array(
        F.when(arxiv & (F.col("version") > 1), F.struct(F.concat("record_id", F.lit("v1")).alias("copy_id"), F.lit("arxiv_v1").alias("kind"))),
        F.when(arxiv & F.col("doi").isNotNull(), F.struct(F.concat(F.lit("acl:"), "record_id").alias("copy_id"), F.lit("acl_copy").alias("kind"))),
    ))
    return rows.select(F.explode(copies).alias("c")).select("c.*").join(rows.select(F.col("record_id").alias("copy_id")), "copy_id", "left_anti").select("copy_id", "kind")


@query(f"""WITH {_CLEAN} SELECT record_id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' WHEN authors IS NULL OR trim(authors) = '' THEN 'no_authors' WHEN year IS NULL THEN 'no_year' WHEN reason IS NOT NULL THEN reason ELSE '' END AS reason FROM clean""")
def reason_cascade(spark, d):
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = filters.reason_cascade((blank("title"), "no_title"), (blank("authors"), "no_authors"), (F.col("year").isNull(), "no_year"))
    return _clean(spark, d).select("record_id", F.coalesce(reason, F.col("reason"), F.lit("")).alias("reason"))


@query(f"""SELECT row_no, list_filter([{filled_sql('published_version_url')}, {filled_sql('source_url')}, {filled_sql('fulltext_url')}], lambda u: contains(u, 'anthology'))[1] AS venue_url,
{filled_sql('published_version_url')} IS NOT NULL AS published FROM manifest_dedup""")
def location_fields(spark, d):
    urls = F.array(_filled("published_version_url"), _filled("source_url"), _filled("fulltext_url"))
    at_venue = F.filter(urls, lambda u: u.contains("anthology"))
    return table(spark, d, "manifest_dedup").select("row_no", F.try_element_at(at_venue, F.lit(1)).alias("venue_url"), _filled("published_version_url").isNotNull().alias("published"))


@query(f"""WITH {_CLEAN} SELECT stage, n FROM (
  SELECT 'records' AS stage, count(*) AS n FROM clean UNION ALL SELECT 'with_work', count(*) FROM clean WHERE work_id IS NOT NULL
  UNION ALL SELECT 'full_text', count(*) FROM clean WHERE {_FULL} UNION ALL SELECT 'works', count(DISTINCT work_id) FROM clean
  UNION ALL SELECT 'source:' || source, count(*) FROM clean GROUP BY source)""")
def corpus_funnel(spark, d):
    rows = _clean(spark, d)
    full = F.coalesce(F.col("status").isin("html", "ar5iv", "pdf"), F.lit(False))
    one = rows.agg(F.count(F.lit(1)).alias("records"), F.count("work_id").alias("with_work"), F.count_if(full).alias("full_text"), F.count_distinct("work_id").alias("works"))
    return one.unpivot([], ["records", "with_work", "full_text", "works"], "stage", "n").union(rows.groupBy(F.concat(F.lit("source:"), "source").alias("stage")).agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {_CLEAN} SELECT source, count(*) FILTER (duplicate_of IS NULL) AS own, count(*) FILTER (duplicate_of IS NULL AND {_FULL}) AS own_full, count(*) FILTER (duplicate_of IS NOT NULL) AS copies FROM clean GROUP BY source""")
def summary_funnel(spark, d):
    own, full = F.col("duplicate_of").isNull(), F.coalesce(F.col("status").isin("html", "ar5iv", "pdf"), F.lit(False))
    return _clean(spark, d).groupBy("source").agg(F.count_if(own).alias("own"), F.count_if(own & full).alias("own_full"), F.count_if(~own).alias("copies"))


def _matches(spark, d):
    ours = _clean(spark, d).select("record_id", F.col("title").alias("t1"), F.col("year").try_cast("int").alias("y1"))
    theirs = table(spark, d, "candidates_dedup").select("record_id", F.col("title").alias("t2"), F.col("year").alias("y2"), "fetched_at")
    score = fuzzy.fuzz_token_set_ratio(T.norm_title(F.col("t1")), T.norm_title(F.col("t2")))
    return ours.join(theirs, "record_id").filter("abs(y1 - y2) <= 2").withColumn("ratio", score)


@query()
def title_catalogue_match(spark, d):
    """The best hit of each record in the catalogue: equal or very similar title, close year; a missing
    year never matches."""
    a, b = F.length(T.norm_title(F.col("t1"))), F.length(T.norm_title(F.col("t2")))
    good = (T.norm_title(F.col("t1")) == T.norm_title(F.col("t2"))) | ((F.col("ratio") >= 95) & (F.least(a, b) >= 0.6 * F.greatest(a, b)))
    return _matches(spark, d).filter(good).groupBy("record_id").agg(F.max_by("t2", F.struct("ratio", "fetched_at", "t2")).alias("title"), F.round(F.max("ratio"), 6).alias("ratio"))
