"""Queries on labels, catalogue look-ups, full texts, answers and question sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.operators import answers as A
from litloom.operators import collection as C
from litloom.operators import documents as D
from litloom.operators import filters, identity, statistics
from litloom.plans.catalogue import query
from litloom.plans.identity_queries import _COMPONENTS, _EDGES, _clean, _filled, filled_sql
from litloom.session import Scratch, table


@query("""SELECT count(*) AS n, count(DISTINCT record_id) AS records FROM (SELECT record_id FROM candidates_dedup UNION ALL SELECT record_id FROM manifest_dedup)""")
def candidates_union(spark, d):
    """Candidate files of two kinds, written and read as one."""
    from litloom.sources import files

    root = f"{Scratch(spark).root}/candidates"
    for name in ("candidates_dedup", "manifest_dedup"):
        files.append_jsonl(table(spark, d, name).select("record_id", "title"), f"{root}/{name}")
    rows = files.union_candidates(*(files.read_jsonl(spark, f"{root}/{name}", "record_id string, title string") for name in ("candidates_dedup", "manifest_dedup")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"))


_SCOPE = f"CASE WHEN lower({filled_sql('in_scope')}) IN ('true', 'false') THEN lower({filled_sql('in_scope')}) = 'true' END"


def _scope():
    said = F.lower(_filled("in_scope"))
    return F.when(said.isin("true", "false"), said == "true")


@query(f"""WITH l AS (SELECT record_id, max({filled_sql('topic')}) AS topic, bool_or({_SCOPE}) AS in_scope FROM manifest_dedup GROUP BY record_id)
SELECT c.record_id, c.title, c.fetched_at, l.topic, l.in_scope FROM candidates_dedup c LEFT JOIN l USING (record_id)""")
def candidates_labels(spark, d):
    labels = table(spark, d, "manifest_dedup").groupBy("record_id").agg(F.max(_filled("topic")).alias("topic"), F.bool_or(_scope()).alias("in_scope"))
    return C.with_labels(table(spark, d, "candidates_dedup").select("record_id", "title", "fetched_at"), labels)


_HOLDS = f"{filled_sql('title')} IS NOT NULL AND {filled_sql('authors')} IS NOT NULL AND try_cast({filled_sql('year')} AS INT) IS NOT NULL"
_STAGE = "CASE WHEN row_no % 7 = 0 THEN 'reject:survey' ELSE 'include' END"


@query(f"""WITH r AS (SELECT row_no, {_STAGE} AS stage1, {_SCOPE} AS s, {_HOLDS} AS whole, {filled_sql('reject_reason')} AS why FROM manifest_dedup)
SELECT CAST(row_no AS VARCHAR) AS record_id, coalesce(stage1 = 'include' AND s AND whole, false) AS in_scope,
CASE WHEN stage1 <> 'include' THEN 'survey' WHEN s = false THEN coalesce(why, '') WHEN s AND NOT whole THEN 'incomplete_metadata' ELSE '' END AS reject_reason FROM r""")
def manifest_projection(spark, d):
    """The first stage's reason, then the label's, then incomplete_metadata."""
    stage = F.when(F.col("row_no") % 7 == 0, "reject:survey").otherwise("include")
    rows = table(spark, d, "manifest_dedup").select(
        F.col("row_no").cast("string").alias("record_id"), stage.alias("stage1"), _filled("title").alias("title"), _filled("authors").alias("authors"),
        _filled("year").try_cast("int").alias("year"), _scope().alias("in_scope"), _filled("reject_reason").alias("out_reason"),
    )
    return C.projected(rows)


_LACK = " || ' ' || ".join(f"CASE WHEN coalesce(trim({c}), '') = '' THEN '{c}' ELSE '' END" for c in ("title", "authors", "year", "source_url"))


@query(f"""SELECT row_no, missing FROM (SELECT row_no, trim(regexp_replace({_LACK}, ' +', ' ', 'g')) AS missing FROM manifest_dedup WHERE lower(trim(in_scope)) = 'true') WHERE missing <> ''""")
def incomplete_rows(spark, d):
    rows = table(spark, d, "manifest_dedup").filter(F.lower(F.trim("in_scope")) == "true")
    return C.incomplete(rows, "row_no", ["title", "authors", "year", "source_url"])


_KNOWN = f"m AS (SELECT record_id, max({filled_sql('venue')}) AS venue, max({filled_sql('license')}) AS license FROM manifest_dedup GROUP BY record_id)"


@query(f"""WITH {_KNOWN}, c AS (SELECT DISTINCT doc_id, work_id FROM chunks_toy)
SELECT c.doc_id, c.work_id, coalesce(a.venue, b.venue) AS venue, coalesce(a.license, b.license) AS license
FROM c LEFT JOIN m a ON a.record_id = c.doc_id LEFT JOIN m b ON b.record_id = 'arxiv:' || c.work_id""")
def parsed_manifest(spark, d):
    """Parsed documents with their record's metadata, by their own id or by that of their work."""
    known = table(spark, d, "manifest_dedup").groupBy(F.col("record_id").alias("k")).agg(F.max(_filled("venue")).alias("venue"), F.max(_filled("license")).alias("license"))
    docs = table(spark, d, "chunks_toy").select("doc_id", "work_id").distinct()
    return C.joined_or_fallback(docs, known, "doc_id", F.concat(F.lit("arxiv:"), "work_id"), "k")


@query("""WITH g AS (SELECT question_id, list(item_id ORDER BY item_id) AS more FROM eval_items WHERE item_type = 'gold_quote' GROUP BY question_id)
SELECT item_id, array_to_string(list_concat([item_id], coalesce(more, [])), ' ') AS gold FROM eval_items LEFT JOIN g USING (question_id) WHERE item_type = 'question'""")
def gold_extended(spark, d):
    """Each question with the gold items that were added to it later."""
    items = table(spark, d, "eval_items")
    asked = items.filter("item_type = 'question'").select("question_id", "item_id", F.array("item_id").alias("gold"))
    rows = C.appended(asked, items.filter("item_type = 'gold_quote'").select("question_id", F.col("item_id").alias("more")), "question_id", "gold")
    return rows.select("item_id", F.array_join(F.col("gold").cast("array<string>"), " ").alias("gold"))


@query(f"""WITH i AS (SELECT DISTINCT lower({filled_sql('arxiv_id')}) AS id FROM manifest_dedup WHERE {filled_sql('arxiv_id')} IS NOT NULL),
b AS (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 50) AS BIGINT) AS batch FROM i)
SELECT batch, count(*) AS n, min(id) AS first, substr(sha1(string_agg(id, '|' ORDER BY id)), 1, 12) AS cache_key FROM b GROUP BY batch""")
def doi_batches(spark, d):
    ids = table(spark, d, "manifest_dedup").select(_filled("arxiv_id").alias("arxiv_id"))
    return C.batches(ids, "arxiv_id", 50).select("batch", F.size("ids").cast("bigint").alias("n"), F.col("ids")[0].alias("first"), "cache_key")


@query(f"""WITH todo AS (SELECT DISTINCT record_id, {filled_sql('arxiv_id')} AS arxiv_id FROM manifest_dedup WHERE {filled_sql('arxiv_id')} IS NOT NULL AND record_id IS NOT NULL),
t AS (SELECT DISTINCT record_id, 't:' || record_id AS work FROM candidates_dedup WHERE year % 2 = 0),
o AS (SELECT '10.48550/arxiv.' || lower({filled_sql('arxiv_id')}) AS doi, max({filled_sql('openalex_id')}) AS work FROM manifest_dedup WHERE {filled_sql('openalex_id')} IS NOT NULL AND {filled_sql('arxiv_id')} IS NOT NULL GROUP BY 1)
SELECT todo.record_id, coalesce(t.work, o.work) AS work, CASE WHEN t.work IS NOT NULL THEN 'title' WHEN o.work IS NOT NULL THEN 'doi' END AS how
FROM todo LEFT JOIN t USING (record_id) LEFT JOIN o ON o.doi = '10.48550/arxiv.' || lower(arxiv_id)""")
def doi_lookup(spark, d):
    """Found by title, else by identifier; the second look-up only for what the first missed."""
    rows = table(spark, d, "manifest_dedup").select("record_id", _filled("arxiv_id").alias("arxiv_id"), _filled("openalex_id").alias("work"))
    by_title = table(spark, d, "candidates_dedup").filter("year % 2 = 0").select("record_id", F.concat(F.lit("t:"), "record_id").alias("work")).distinct()
    by_doi = rows.filter("work IS NOT NULL AND arxiv_id IS NOT NULL").groupBy(F.concat(F.lit(C.ARCHIVE_DOI), F.lower("arxiv_id")).alias("doi")).agg(F.max("work").alias("work"))
    return C.looked_up(rows.filter("arxiv_id IS NOT NULL AND record_id IS NOT NULL").select("record_id", "arxiv_id").distinct(), by_title, by_doi)


@query()
def catalogue_best_hit(spark, d):
    """Replies of a catalogue to a title search, two for each row: a published one goes first."""
    pairs = table(spark, d, "dup_pairs_to_label").dropDuplicates(["pair_id"])
    rows = pairs.select(F.col("pair_id").alias("record_id"), F.col("title_a").alias("title"), F.col("year_a").alias("year"))
    hit = lambda pos, t, y, published: F.struct(F.lit(pos).alias("pos"), F.col(t).alias("hit_title"), F.col(y).alias("hit_year"), published.alias("published"), F.concat(F.col("pair_id"), F.lit(f"#{pos}")).alias("work"))
    hits = pairs.select(F.col("pair_id").alias("record_id"), F.explode(F.array(hit(1, "title_b", "year_b", F.lit(False)), hit(2, "title_a", "year_a", F.col("year_a") % 2 == 0))).alias("h")).select("record_id", "h.*")
    return C.best_hits(rows, hits)


_LOCATIONS = "list_filter([published_version_url, source_url, fulltext_url], lambda u: coalesce(u, '') <> '')"


@query(f"""WITH w AS (SELECT row_no, openalex_id, title, year, doi, license, [replace({filled_sql('published_version_url')}, 'anthology.example', 'aclanthology.org'), {filled_sql('source_url')}, NULL, {filled_sql('fulltext_url')}] AS u FROM manifest_dedup WHERE {filled_sql('openalex_id')} IS NOT NULL),
v AS (SELECT *, list_filter(list_filter(u, lambda x: x IS NOT NULL), lambda x: contains(x, 'aclanthology.org')) AS a FROM w),
k AS (SELECT *, coalesce(list_filter(a, lambda x: ends_with(x, '.pdf'))[1], rtrim(a[1], '/') || '.pdf') AS pdf FROM v WHERE len(a) > 0 AND len(list_filter(u, lambda x: contains(coalesce(x, ''), 'arxiv.org'))) = 0)
SELECT row_no, 'oa:' || {filled_sql('openalex_id')} AS record_id, coalesce(title, '') AS title, coalesce(year, 'none') || '-01-01' AS published, regexp_replace(lower(coalesce(doi, '')), '^https://doi.org/', '') AS doi,
coalesce(list_filter(a, lambda x: NOT ends_with(x, '.pdf'))[1], regexp_replace(pdf, '\\.pdf$', '')) AS page, pdf, coalesce(license, '') AS license FROM k""")
def venue_only_records(spark, d):
    """Works with a page at the venue and none in the archive; each comes from its own load."""
    pair = lambda x, y, l: F.struct(x.alias("landing"), y.alias("pdf"), l.alias("license"))
    venue, none = F.replace(_filled("published_version_url"), F.lit("anthology.example"), F.lit("aclanthology.org")), F.lit(None).cast("string")
    works = table(spark, d, "manifest_dedup").filter(_filled("openalex_id").isNotNull()).select(
        F.concat(F.col("row_no"), F.lit("/"), _filled("openalex_id")).alias("id"), "title", F.coalesce("year", F.lit("none")).alias("year"), none.alias("published"), "doi",
        F.array(pair(venue, _filled("source_url"), F.col("license")), pair(none, _filled("fulltext_url"), none)).alias("locations"), "row_no",
    )
    numbered = works.select("row_no", F.col("id").alias("i"))
    found = C.venue_records(works.withColumn("id", F.concat(F.lit("x/"), F.col("row_no"), F.lit(":"), F.substring_index("id", "/", -1))))
    cut = F.regexp_replace("record_id", r"^oa:\d+:", "oa:")
    return found.join(numbered, F.regexp_extract("record_id", r"^oa:(\d+):", 1).cast("bigint") == numbered["row_no"]).select("row_no", cut.alias("record_id"), "title", "published", "doi", "page", "pdf", "license")


@query(f"""WITH p AS (SELECT record_id, row_no, title, unnest(string_split(matched_queries, '|')) AS phrase FROM manifest_dedup WHERE {filled_sql('matched_queries')} IS NOT NULL),
o AS (SELECT record_id, phrase, min(row_no) AS o FROM p GROUP BY ALL)
SELECT record_id, arg_min(title, row_no) AS title, (SELECT string_agg(phrase, '|' ORDER BY o, phrase) FROM o WHERE o.record_id = p.record_id) AS matched_queries FROM p GROUP BY record_id""")
def phrase_fan_in(spark, d):
    """The first load of a record, with all phrases that found it in their order."""
    found = table(spark, d, "manifest_dedup").filter(_filled("matched_queries").isNotNull()).select("record_id", "row_no", F.struct("title").alias("t"), F.explode(F.split("matched_queries", r"\|")).alias("phrase"))
    return C.fan_in(found, "record_id", "row_no", "phrase").select("record_id", "t.title", F.array_join("matched_queries", "|").alias("matched_queries"))


_TRIED = "t AS (SELECT row_no AS key, i, (['html', 'ar5iv', 'pdf'])[i] AS step, (row_no * 3 + i * i) % 5 AS o FROM manifest_dedup, range(1, 4) r(i))"


@query(f"""WITH {_TRIED} SELECT key, coalesce(arg_min(step, i) FILTER (o = 0), CASE WHEN bool_or(o = 2) THEN '' ELSE 'none' END) AS status, coalesce(arg_min('u' || i, i) FILTER (o = 0), '') AS url FROM t GROUP BY key""")
def fallback_status(spark, d):
    """The first step that was saved; none if all hosts answered, blank if one was silent."""
    i = F.col("i")
    tried = table(spark, d, "manifest_dedup").select(F.col("row_no").alias("key"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i"))
    outcome = F.element_at(F.array(*map(F.lit, ("saved", "http 404", "no response", "not a PDF", "http 500"))), ((F.col("key") * 3 + i * i) % 5 + 1).cast("int"))
    return C.status_of(tried.select("key", F.element_at(F.array(*map(F.lit, C.STEPS)), i).alias("step"), F.concat(F.lit("u"), i).alias("url"), outcome.alias("outcome")))


@query(f"""SELECT row_no, coalesce(nullif(trim(regexp_extract('<p>' || CASE WHEN row_no % 2 = 0 THEN 'License:  ' || coalesce(license, '') || ' </p>' ELSE '' END, 'License:\\s*([^<\\n]+)', 1)), ''), {filled_sql('license')}, 'default') AS licence FROM manifest_dedup""")
def licence_of_pages(spark, d):
    html = F.concat(F.lit("<p>"), F.when(F.col("row_no") % 2 == 0, F.concat(F.lit("License:  "), F.coalesce("license", F.lit("")), F.lit(" </p>"))).otherwise(""))
    return table(spark, d, "manifest_dedup").select("row_no", C.licence(html, _filled("license"), F.lit("default")).alias("licence"))


_WORDS = "len(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' '))"


@query(f"""WITH d AS (SELECT doc_id, repeat(text || ' ', CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 1 END) AS t FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND NOT contains(text, '<'))
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'no content' WHEN doc_id % 13 = 0 THEN 'fatal conversion error' WHEN doc_id % 17 = 0 THEN 'missing element' WHEN doc_id % 19 = 0 THEN 'no main part'
WHEN {_WORDS} < 1500 THEN 'too few words' WHEN doc_id % 3 = 0 THEN 'too few sections' ELSE '' END AS reason FROM d""")
def pages_validity(spark, d):
    """Six checks of a page in their order; the pages are made of the documents."""
    n = F.col("doc_id")
    text = F.repeat(F.concat("text", F.lit(" ")), F.when(n % 2 == 0, 12).otherwise(1))
    html = F.concat(
        F.lit("<html><head><title>"), F.when(n % 11 == 0, "No content available").otherwise("Page"), F.lit("</title><script>var no = 'word of the text';</script></head><body class='x'>"),
        F.when(n % 13 == 0, "<b class='ar5iv-severity-fatal'></b>").otherwise(""), F.when(n % 17 == 0, '<i class="a ltx_missing b"></i>').otherwise(""),
        F.when(n % 19 == 0, "<div>").otherwise('<div class="ltx_page_main">'), F.when(n % 3 == 0, '<section class="ltx_section">').otherwise('<section class="ltx_section"></section><section class="big ltx_section">'),
        F.lit("<p>"), text, F.lit("</p></section></div><style>p { margin: 0 }</style></body></html>"),
    )
    rows = table(spark, d, "documents").filter("text IS NOT NULL AND trim(text) <> '' AND NOT contains(text, '<')")
    return rows.select("doc_id", D.page_reason(html).alias("reason"))


@query("""WITH a AS (SELECT chunk_id, text || chr(10) || chr(10) || 'Sources:' || chr(10) || '[1] x. y' AS answer, loaded_at FROM chunks_toy WHERE kind = 'text' AND text IS NOT NULL),
s AS (SELECT chunk_id, loaded_at, string_split(regexp_replace(trim(split_part(answer, chr(10) || chr(10) || 'Sources:', 1)), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)) AS s FROM a)
SELECT chunk_id, loaded_at, i AS sentence_no, md5(sentence) AS sentence, array_to_string(regexp_extract_all(sentence, '\\[\\d+\\]'), ' ') AS cited
FROM (SELECT chunk_id, loaded_at, unnest(list_filter(s, lambda x: x <> '')) AS sentence, generate_subscripts(list_filter(s, lambda x: x <> ''), 1) AS i FROM s)""")
def sentence_sheet(spark, d):
    rows = table(spark, d, "chunks_toy").filter("kind = 'text' AND text IS NOT NULL")
    answers = rows.select(F.concat("chunk_id", F.lit("\t"), F.col("loaded_at").cast("string")).alias("id"), F.lit("m").alias("model"), F.lit("r").alias("retriever"), F.concat("text", F.lit("\n\nSources:\n[1] x. y")).alias("answer"))
    return A.sentence_sheet(answers).select(F.split_part("id", F.lit("\t"), F.lit(1)).alias("chunk_id"), F.split_part("id", F.lit("\t"), F.lit(2)).cast("timestamp_ntz").alias("loaded_at"), "sentence_no", F.md5("sentence").alias("sentence"), "cited")


_N = r"\[\d+(?:\s*,\s*\d+)*\]"


@query(rf"""WITH r AS (SELECT item_id, regexp_replace(text || ' [1] and [' || item_id % 5 || ', 9]. Is this then left [4]? A sentence without any mark at all.  ' || text || '. [2] [3]', '([.!?])((?:\s*{_N})+)', '\2\1', 'g') AS t FROM eval_items WHERE text IS NOT NULL),
p AS (SELECT item_id, pos, piece FROM (SELECT item_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM (SELECT item_id, string_split(regexp_replace(t, '([.!?])(\s+)', '\1' || chr(30) || '\2' || chr(30), 'g'), chr(30)) AS ps FROM r))),
m AS (SELECT item_id, pos, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM (SELECT item_id, pos, string_split(regexp_replace(piece, '(\s*{_N})', chr(31) || '\1' || chr(31), 'g'), chr(31)) AS xs FROM p)),
n AS (SELECT *, CASE WHEN regexp_matches(x, '^\s*{_N}$') THEN list_transform(regexp_extract_all(x, '\d+'), lambda y: CAST(y AS INT)) END AS nums FROM m),
f AS (SELECT *, list_filter(nums, lambda y: y BETWEEN 1 AND 3) AS good, list_filter(nums, lambda y: NOT y BETWEEN 1 AND 3) AS bad FROM n),
w AS (SELECT item_id, pos, string_agg(CASE WHEN nums IS NULL THEN x WHEN len(good) = 0 THEN '' ELSE regexp_extract(x, '^\s*') || '[' || array_to_string(good, ', ') || ']' END, '' ORDER BY k) AS s,
  flatten(list(good ORDER BY k) FILTER (good IS NOT NULL)) AS good, flatten(list(bad ORDER BY k) FILTER (bad IS NOT NULL)) AS bad FROM f GROUP BY item_id, pos),
z AS (SELECT item_id, pos, good, bad, CASE WHEN len(bad) > 0 THEN regexp_replace(s, '([.!?]*)$', ' [citation removed]\1') ELSE s END AS s FROM w)
SELECT item_id, md5(string_agg(s, '' ORDER BY pos)) AS text, array_to_string(list_sort(list_distinct(flatten(list(good) FILTER (good IS NOT NULL)))), ' ') AS cited,
 array_to_string(flatten(list(bad ORDER BY pos) FILTER (bad IS NOT NULL)), ' ') AS invalid,
 coalesce(md5(string_agg(trim(s), '|' ORDER BY pos) FILTER (trim(s) <> '' AND NOT ends_with(trim(s), '?') AND len(string_split(trim(regexp_replace(s, '\s+', ' ', 'g')), ' ')) > 4 AND NOT regexp_matches(s, '\[\d'))), md5('')) AS uncited FROM z GROUP BY item_id""")
def citation_text(spark, d):
    """The rewritten text, the numbers and the uncited sentences, whole."""
    raw = F.concat("text", F.lit(" [1] and ["), F.col("item_id") % 5, F.lit(", 9]. Is this then left [4]? A sentence without any mark at all.  "), "text", F.lit(". [2] [3]"))
    c = table(spark, d, "eval_items").filter("text IS NOT NULL").select("item_id", A.citations(raw, F.lit(3)).alias("c"))
    return c.select("item_id", F.md5("c.text").alias("text"), F.array_join("c.cited", " ").alias("cited"), F.array_join("c.invalid", " ").alias("invalid"), F.md5(F.array_join("c.uncited", "|")).alias("uncited"))


@query("""WITH a AS (SELECT item_id AS id, split AS model FROM eval_items), j AS (SELECT item_id AS id, split AS model, item_type AS verdict FROM eval_items WHERE item_id % 3 <> 0)
SELECT a.id, a.model, j.verdict FROM a LEFT JOIN j USING (id, model)""")
def answers_judgments(spark, d):
    rows = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("split").alias("model"), F.lit("r").alias("retriever"), F.col("item_type").alias("verdict"))
    return A.with_judgments(rows.drop("verdict"), rows.filter("id % 3 <> 0")).select("id", "model", "verdict")


@query("""WITH h AS (SELECT question_id AS id, row_number() OVER (PARTITION BY question_id ORDER BY item_id) AS n, item_type AS human FROM eval_items),
j AS (SELECT question_id AS id, row_number() OVER (PARTITION BY question_id ORDER BY item_id DESC) AS n, item_type AS verdict FROM eval_items)
SELECT h.human, j.verdict, count(*) AS n FROM h JOIN j USING (id, n) GROUP BY ALL""")
def label_alignment(spark, d):
    """Labels and judged sentences by their place, as every answer has as many of both."""
    from pyspark.sql import Window

    rows = table(spark, d, "eval_items").select(F.col("question_id").alias("id"), F.lit("m").alias("model"), F.lit("r").alias("retriever"), "item_id", "item_type", "text")
    place = lambda order: F.row_number().over(Window.partitionBy("id").orderBy(order))
    humans = rows.select(*A.KEY, place(F.col("item_id")).alias("sentence_no"), F.col("text").alias("sentence"), F.col("item_type").alias("human"))
    judged = rows.select(*A.KEY, place(F.desc("item_id")).alias("pos"), "text", F.col("item_type").alias("verdict"))
    return A.aligned(humans, judged).groupBy("human", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query()
def quote_verification(spark, d):
    """Gold quotes against the items of their question as sections, the first of them named."""
    items = table(spark, d, "eval_items").filter("text IS NOT NULL")
    quotes = items.filter("item_type = 'gold_quote'").select(F.col("question_id").alias("doc"), F.col("item_id").cast("int").alias("no"), F.col("text").alias("quote"), F.lit("question").alias("section"))
    sections = items.groupBy(F.col("question_id").alias("doc"), F.col("item_type").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    return A.verified(quotes, sections).select("doc", "no", "section", F.round("score", 3).alias("score"))


_QUESTIONS = "q AS (SELECT item_id AS id, split, CASE WHEN item_type = 'expected_answer' THEN (SELECT min(p.item_id) FROM eval_items p WHERE p.question_id = e.question_id AND p.item_type = 'question') END AS parent_id, text FROM eval_items e WHERE item_type <> 'gold_quote')"


@query(f"""WITH {_QUESTIONS}, o AS (SELECT id, 'old ' || id AS answer FROM q WHERE id % 4 = 0),
p AS (SELECT id, md5('|' || text) AS answer FROM q WHERE parent_id IS NULL AND id NOT IN (SELECT id FROM o) UNION ALL SELECT * FROM o)
SELECT id, md5(CASE WHEN parent_id IS NULL THEN '' ELSE 'user: ' || (SELECT text FROM q x WHERE x.id = q.parent_id) || chr(10) || 'assistant: ' || (SELECT answer FROM p WHERE p.id = q.parent_id) END || '|' || text) AS answer
FROM q WHERE split = 'test' AND id NOT IN (SELECT id FROM o)""")
def question_waves(spark, d):
    """A question set in two waves: questions and needed parents, then follow-ups with their history."""
    items = table(spark, d, "eval_items")
    parents = items.filter("item_type = 'question'").groupBy("question_id").agg(F.min("item_id").alias("p"))
    rows = items.filter("item_type <> 'gold_quote'").join(parents, "question_id", "left").select(F.col("item_id").alias("id"), "split", F.when(F.col("item_type") == "expected_answer", F.col("p")).alias("parent_id"), "text")
    recorded = rows.filter("id % 4 = 0").select("id", F.concat(F.lit("old "), "id").alias("answer"))
    reply = lambda todo: todo.select("id", F.md5(F.concat(F.coalesce("history", F.lit("")), F.lit("|"), "text")).alias("answer"))
    return A.run_set(rows, recorded, "test", reply)


@query(f"""WITH {_COMPONENTS}, d AS (SELECT record_a AS x, record_b AS y FROM dedup_candidates WHERE lower(trim(decision)) = 'merge' AND record_a IN (SELECT record_id FROM clean) AND record_b IN (SELECT record_id FROM clean)),
all_ AS (SELECT record_id AS a, component AS b FROM comps UNION SELECT component, record_id FROM comps UNION SELECT x, y FROM d UNION SELECT y, x FROM d),
far AS (SELECT record_id AS node, record_id AS other FROM clean UNION SELECT f.node, t.b FROM far f JOIN all_ t ON f.other = t.a),
g AS (SELECT node AS record_id, min(other) AS component FROM far GROUP BY node),
w AS (SELECT component, coalesce(min(arxiv_id) FILTER (source = 'arxiv'), min(record_id)) AS work_id FROM g JOIN clean USING (record_id) GROUP BY component)
SELECT record_id, work_id FROM g JOIN w USING (component)""".replace("WITH latest", "WITH RECURSIVE latest"))
def work_groups(spark, d):
    """Groups by identifiers, joined by the pairs that are merged."""
    rows, scratch = _clean(spark, d), Scratch(spark)
    known = rows.select("record_id")
    merged = table(spark, d, "dedup_candidates").filter(F.lower(F.trim("decision")) == "merge").select(F.col("record_a").alias("a"), F.col("record_b").alias("b"))
    merged = merged.join(known.select(F.col("record_id").alias("a")), "a", "left_semi").join(known.select(F.col("record_id").alias("b")), "b", "left_semi")
    return identity.work_groups(rows, merged, scratch).select("record_id", "work_id")


@query("SELECT 1 AS run, count(DISTINCT doc_id) AS written FROM documents WHERE text IS NOT NULL UNION ALL SELECT 2, 0")
def parsed_tree_sink(spark, d):
    """Parsed documents as nested rows; a second run writes none."""
    path = f"{Scratch(spark).root}/parsed"
    parsed = D.parse_pages(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "text", D.parse_markdown).select("doc_id", "parsed")
    return spark.createDataFrame([(i + 1, C.write_new(parsed, path, "doc_id")) for i in range(2)], "run int, written bigint")


@query("SELECT 1 AS run, 'written' AS outcome UNION ALL SELECT 2, 'refused'")
def label_sink(spark, d):
    """A sheet of labels is written once and never over another."""
    from pyspark.errors import AnalysisException

    path, outcome = f"{Scratch(spark).root}/labels", []
    for run in (1, 2):
        try:
            C.write_once(table(spark, d, "eval_items").select("item_id"), path)
            outcome.append((run, "written"))
        except AnalysisException:
            outcome.append((run, "refused"))
    return spark.createDataFrame(outcome, "run int, outcome string")


@query("""WITH r AS (SELECT DISTINCT pair_id FROM dup_pairs_to_label), o AS (SELECT pair_id, row_number() OVER (ORDER BY md5('13:' || pair_id), pair_id) AS p, count(*) OVER () AS n FROM r)
SELECT pair_id, CASE WHEN p <= n // 2 THEN 'dev' ELSE 'test' END AS half FROM o""")
def dev_test_halves(spark, d):
    """Exactly the first half of a seeded order is dev."""
    ids = table(spark, d, "dup_pairs_to_label").select("pair_id").distinct()
    return filters.seeded_halves(ids, "pair_id").select("pair_id", "half")


@query("""WITH r AS (SELECT doc_id, pos, w, sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
FROM (SELECT doc_id, pos, len(string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' ')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL) WHERE trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''))
SELECT doc_id, CAST(sum(least(w, 60 - coalesce(b, 0))) AS BIGINT) AS words, count(*) AS parts FROM r WHERE coalesce(b, 0) < 60 GROUP BY doc_id""")
def word_budget(spark, d):
    """Parts of a text until 60 words; the last one is cut to what is left."""
    parts = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", D.budgeted(F.split("text", "\n"), 60).alias("p"))
    return parts.select("doc_id", F.aggregate("p", F.lit(0).cast("bigint"), lambda n, s: n + T.word_count(s)).alias("words"), F.size("p").cast("bigint").alias("parts")).filter("parts > 0")


@query("""WITH q AS (SELECT * FROM eval_items), n AS (SELECT question_id, count(*) FILTER (item_type = 'gold_quote') AS g, bool_or(item_type = 'question') AS asked FROM q GROUP BY question_id)
SELECT count(*) AS questions, count(*) FILTER (NOT asked) AS missing_parent, CAST(min(g) AS BIGINT) AS least, CAST(quantile_cont(g, 0.5) AS DOUBLE) AS median, CAST(max(g) AS BIGINT) AS most FROM n""")
def question_set_stats(spark, d):
    return statistics.question_set(table(spark, d, "eval_items"), "question_id", F.col("item_type") == "gold_quote", F.col("item_type") == "question")


@query("""WITH m AS (SELECT row_no AS id, reason, CASE WHEN row_no % 97 = 0 THEN 0 WHEN row_no % 3 = 0 THEN 1 ELSE 2 END AS tier FROM (SELECT row_no, CASE WHEN row_no % 5 = 0 THEN 'corpus_cap' ELSE 'no_fulltext' END AS reason FROM manifest_dedup)),
k AS (SELECT *, row_number() OVER (ORDER BY tier, md5('13:' || id), id) AS p FROM m)
SELECT id, CASE WHEN p > 300 THEN 'corpus_cap' WHEN reason = 'corpus_cap' THEN '' ELSE reason END AS reason FROM k""")
def corpus_cap_flags(spark, d):
    """The first 300 by tier and seeded order are free of the cap, the rest carry it."""
    n = F.col("row_no")
    rows = table(spark, d, "manifest_dedup").select(n.alias("id"), F.when(n % 5 == 0, "corpus_cap").otherwise("no_fulltext").alias("reason"))
    tier = F.when(F.col("id") % 97 == 0, 0).when(F.col("id") % 3 == 0, 1).otherwise(2)
    return filters.cap_flags(rows, tier, "id", "reason", 300).select("id", "reason")


@query("""SELECT row_no, CASE WHEN a > 0 AND b > 0 THEN round(least(a, b) / greatest(a, b), 3) END AS ratio FROM (SELECT row_no, length(coalesce(title, '')) AS a, length(coalesce(authors, '')) AS b FROM manifest_dedup)""")
def body_ratio(spark, d):
    return table(spark, d, "manifest_dedup").select("row_no", T.length_ratio(F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("authors", F.lit("")))).alias("ratio"))


_THREE = "CASE WHEN coalesce(title_ratio < 92 OR author_jaccard < 0.5, true) OR coalesce(abstract_cosine < 0.85, false) THEN 'separate' WHEN coalesce(body_ratio < 0.6, false) THEN 'related' ELSE 'merge' END"


@query(f"""WITH r AS (SELECT lower(trim(rule_says)) AS a, {_THREE} AS b FROM dup_pairs_to_label WHERE rule_says IS NOT NULL),
t AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*) AS po FROM r),
e AS (SELECT sum(x.n * y.n) / (SELECT n * n FROM t) AS pe FROM (SELECT a, count(*) AS n FROM r GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM r GROUP BY b) y ON x.a = y.b)
SELECT n, round(po, 6) AS accuracy, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM t, e""")
def kappa_three_classes(spark, d):
    said = identity.decide(F.col("title_ratio"), F.col("author_jaccard"), F.col("abstract_cosine"), F.col("body_ratio"))
    rows = table(spark, d, "dup_pairs_to_label").select(F.lower(F.trim("rule_says")).alias("a"), said.alias("b"))
    return statistics.kappa(rows, "a", "b")


@query()
def near_title_pairs(spark, d):
    """Titles of 80 and more in different groups, at most two years apart: one row for each record with
    its number of links."""
    rows = _clean(spark, d).filter("source IN ('arxiv', 'acl')")
    titled = rows.select(F.col("record_id").alias("id"), "title", F.col("year").try_cast("int").alias("year"), F.coalesce("work_id", "record_id").alias("group"))
    pairs = Scratch(spark).keep(identity.near_title_pairs(titled, Scratch(spark)))
    return pairs.select(F.explode(F.array("a", "b")).alias("record_id")).groupBy("record_id").agg(F.count(F.lit(1)).alias("links"))


@query()
def pair_features(spark, d):
    """The four features of the scored pairs, computed from the records."""
    rows = _clean(spark, d).select("record_id", "title", "authors", F.length(F.coalesce("title", F.lit(""))).alias("body_words"))
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("record_id"), "embedding")
    pairs = table(spark, d, "dedup_candidates").select(F.col("record_a").alias("a"), F.col("record_b").alias("b")).distinct()
    return identity.pair_features(pairs, rows, vectors).select("a", "b", "title_ratio", "author_jaccard", "abstract_cosine", "body_ratio")


@query()
def parser_comparison(spark, d):
    """Two parses of one text: heading F1, word recall, whether the references are left out; and the means."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    half = F.regexp_replace("text", r"(?m)^(\d+) ", "$1. ")
    both = D.parse_pages(D.parse_pages(docs, "text", D.parse_markdown).withColumnRenamed("parsed", "first").withColumn("other", half), "other", D.parse_markdown).withColumnRenamed("parsed", "second")
    return D.compared(both, "doc_id")


@query("""SELECT least(record_a, record_b) AS low, greatest(record_a, record_b) AS high, count(*) AS n FROM dedup_candidates WHERE record_a IS NOT NULL AND record_b IS NOT NULL GROUP BY ALL""")
def unordered_pairs(spark, d):
    pairs = table(spark, d, "dedup_candidates").filter("record_a IS NOT NULL AND record_b IS NOT NULL")
    return pairs.groupBy(F.least("record_a", "record_b").alias("low"), F.greatest("record_a", "record_b").alias("high")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT DISTINCT record_id FROM manifest_dedup), f AS (SELECT record_id FROM candidates_dedup WHERE year % 2 = 0)
SELECT record_id, record_id IN (SELECT record_id FROM f WHERE record_id IS NOT NULL) AS found FROM s""")
def found_and_missed(spark, d):
    """Seeds that were found (semi join) and those that were missed (difference)."""
    seeds = table(spark, d, "manifest_dedup").select("record_id").distinct()
    found = table(spark, d, "candidates_dedup").filter("year % 2 = 0").select("record_id")
    return seeds.join(found, "record_id", "left_semi").withColumn("found", F.lit(True)).unionByName(seeds.subtract(found).withColumn("found", F.lit(False)))


@query("""WITH c AS (SELECT DISTINCT doc_id, chunk_id FROM chunks_toy WHERE doc_id NOT IN (SELECT doc_id FROM chunks_toy WHERE year % 10 = 5))
SELECT doc_id, chunk_id, doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1) AS number, count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM c""")
def chunk_numbers(spark, d):
    """Chunks numbered in their documents, without the documents under the cap, and how many each has."""
    from pyspark.sql import Window

    rows = table(spark, d, "chunks_toy")
    kept = rows.select("doc_id", "chunk_id").distinct().join(rows.filter("year % 10 = 5").select("doc_id").distinct(), "doc_id", "left_anti")
    counts = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")) - 1  # a document's chunks are few
    return kept.select("doc_id", "chunk_id", F.concat("doc_id", F.lit("#"), place).alias("number")).join(counts, "doc_id")


@query()
def document_chunker_abstract(spark, d):
    """Documents with an abstract: it goes first."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.after_first_line(F.col("text")).alias("body"), T.first_line(F.col("text")).alias("abstract"))
    return D.chunk_documents(D.parse_pages(docs, "body", D.parse_markdown)).select("doc_id", "chunk_no", "section", "kind", "n_tokens")


@query()
def title_classes_all(spark, d):
    """One row for each record with a similar title, all titles of a record compared: its class and how many
    other titles are similar to one of its own."""
    scratch = Scratch(spark)
    named = scratch.keep(table(spark, d, "candidates_dedup").select("record_id", T.norm_title(F.col("title")).alias("title")).filter("title <> ''").distinct())
    titles = scratch.keep(named.select("title").distinct().withColumn("no", F.monotonically_increasing_id()))
    held = scratch.keep(named.join(titles, "title").select("record_id", "no"))
    words = F.filter(F.array_distinct(F.split("title", " ")), lambda w: w != "")
    near = scratch.keep(identity.similar_titles(titles.select(F.col("no").alias("id"), words.alias("words")), scratch))
    scratch.clear(held, near)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = held.groupBy("no").agg(F.min("record_id").alias("hub"))
    # every record hangs on the least record of its own and of all similar titles
    same = held.join(hubs, "no").select(F.col("record_id").alias("a"), F.col("hub").alias("b"))
    other = held.join(both, F.col("no") == F.col("a")).select("record_id", "b").join(hubs, F.col("b") == F.col("no")).select(F.col("record_id").alias("a"), F.col("hub").alias("b"))
    edges = scratch.keep(same.unionByName(other).filter("a <> b").distinct())
    classes = identity.components(edges.select(F.explode(F.array("a", "b")).alias("node")), edges, scratch)
    links = held.join(both, F.col("no") == F.col("a"), "left").groupBy("record_id").agg(F.count_distinct("b").alias("links"))
    return classes.join(links, F.col("node") == F.col("record_id")).select("record_id", F.col("component").alias("class_id"), "links")
