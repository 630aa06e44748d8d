"""Queries on texts: rules, words, parsing, chunks, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.operators import answers as A
from litloom.operators import documents as D
from litloom.operators import filters, models
from litloom.plans.catalogue import query
from litloom.session import Scratch, table
from litloom.sources import files
from litloom.streaming import resume

_TITLE = "split_part(text, chr(10), 1)"
_BODY = "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"
EXCLUDE = {"survey": "survey|review of", "tutorial": "tutorial|lecture"}
INCLUDE = {"segment": "segmentation", "subword": "sub-?word", "token": "tokeni[sz]", "vocab": "vocabular"}
_IN = " OR ".join(f"regexp_matches(t, '{p}')" for p in INCLUDE.values())
_STRONG = " OR ".join(f"regexp_matches(b, '{p}')" for n, p in INCLUDE.items() if n != "token")
_RULES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') OR regexp_matches(b, '{p}') THEN '{n}' END" for n, p in sorted(INCLUDE.items())) + "], lambda x: x IS NOT NULL), ' ')"
_RULED = f"""ruled AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(t, '{p}') THEN 'reject:{n}'" for n, p in EXCLUDE.items())}
  WHEN {_IN} OR {_STRONG} OR len(regexp_extract_all(b, 'tokeni[sz]')) >= 2 THEN 'include' ELSE 'reject:incidental_mention' END AS result, {_RULES} AS rules
  FROM (SELECT doc_id, lower({_TITLE}) AS t, lower({_BODY}) AS b FROM documents))"""


def _ruled(spark, d):
    docs = table(spark, d, "documents")
    return filters.rule_filter(docs, T.first_line(F.col("text")), T.after_first_line(F.col("text")), EXCLUDE, INCLUDE, "token")


@query(f"WITH {_RULED} SELECT doc_id, result, rules FROM ruled")
def documents_rule_filter(spark, d):
    return _ruled(spark, d).select("doc_id", "result", F.array_join("rules", " ").alias("rules"))


@query(f"WITH {_RULED} SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(rules, ' ')) AS rule FROM ruled WHERE result = 'include' AND rules <> '') GROUP BY rule")
def rule_hit_histogram(spark, d):
    return _ruled(spark, d).filter("result = 'include'").select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, trim(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def norm_title(spark, d):
    return table(spark, d, "documents").select("doc_id", T.norm_title(T.first_line(F.col("text"))).alias("norm"))


_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN {_CLEAN} = '' THEN 0 ELSE len(string_split({_CLEAN}, ' ')) END AS words FROM documents")
def body_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(r"""SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9$(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS INT) AS sentences FROM documents""")
def documents_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query(f"SELECT doc_id, md5({_CLEAN}) AS rebuilt FROM documents")
def inverted_index_rebuild(spark, d):
    return D.rebuilt(D.inverted_index(table(spark, d, "documents"))).select("doc_id", F.md5("text").alias("rebuilt"))


_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]'))"


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, i, {_TOKENS.format('lines[i]')} AS n FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
r AS (SELECT doc_id, i, 0 AS chunk_no, n AS total FROM l WHERE i = 1
  UNION ALL SELECT r.doc_id, l.i, CASE WHEN r.total + l.n <= 350 THEN r.chunk_no ELSE r.chunk_no + 1 END, CASE WHEN r.total + l.n <= 350 THEN r.total + l.n ELSE l.n END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(max(total) AS INT) AS n_tokens FROM r GROUP BY doc_id, chunk_no""")
def documents_chunks(spark, d):
    packed = table(spark, d, "documents").select("doc_id", F.posexplode(D.packed(F.split("text", "\n"))).alias("chunk_no", "c"))
    return packed.select("doc_id", "chunk_no", F.col("c.n").alias("n_tokens"))


@query(f"SELECT kind, count(*) AS chunks, count(DISTINCT doc_id) AS docs, median({_TOKENS.format('text')}) AS median_tokens, CAST(max({_TOKENS.format('text')}) AS INT) AS most FROM chunks_toy GROUP BY kind")
def chunk_stats(spark, d):
    rows = table(spark, d, "chunks_toy").withColumn("t", T.token_count(F.col("text")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.percentile("t", 0.5).alias("median_tokens"), F.max("t").alias("most"))


@query("SELECT chunk_id, loaded_at, coalesce(year, 2000 + try_cast(regexp_extract(doc_id, '(\\d\\d)\\d\\d\\.', 1) AS INT)) AS year, regexp_replace(doc_id, 'v[0-9]+$', '') AS record_id, translate(doc_id, ':/', '__') AS tag FROM chunks_toy")
def chunk_metadata(spark, d):
    year = F.coalesce("year", 2000 + F.regexp_extract("doc_id", r"(\d\d)\d\d\.", 1).try_cast("int"))
    return table(spark, d, "chunks_toy").select("chunk_id", "loaded_at", year.alias("year"), T.without_version(F.col("doc_id")).alias("record_id"), T.file_tag(F.col("doc_id")).alias("tag"))


@query("""SELECT chunk_id, loaded_at, title || CASE WHEN concat_ws(', ', year, nullif(trim(venue), '')) <> '' THEN ' (' || concat_ws(', ', year, nullif(trim(venue), '')) || ')' ELSE '' END || CASE WHEN coalesce(section, '') <> '' THEN ', § ' || section ELSE '' END AS label,
lower(trim(regexp_replace(split_part(section, ' > ', -1), '^[0-9.]+\\s+', ''))) AS heading FROM chunks_toy""")
def label_rendering(spark, d):
    label = T.label(F.col("title"), F.col("year"), F.col("venue"), F.col("section"))
    return table(spark, d, "chunks_toy").select("chunk_id", "loaded_at", label.alias("label"), T.heading(F.col("section")).alias("heading"))


@query("""WITH s AS (SELECT doc_id, chunk_id, loaded_at, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_id, loaded_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM chunks_toy)
SELECT doc_id, chunk_id, loaded_at, CAST(coalesce(before, 0) AS BIGINT) AS before FROM s WHERE coalesce(before, 0) < 3000""")
def doc_word_budget(spark, d):
    rows = table(spark, d, "chunks_toy").select("doc_id", "chunk_id", "loaded_at", F.length("text").alias("size"))
    return filters.running_budget(rows, ["doc_id"], ["chunk_id", "loaded_at"], "size", 3000).drop("size")


@query("SELECT DISTINCT chunk_id FROM chunks_toy WHERE canonical")
def chunk_scan_canonical(spark, d):
    return table(spark, d, "chunks_toy").filter("canonical").select("chunk_id").distinct()


@query("SELECT doc_id, CASE WHEN substr(md5('13:' || doc_id), 1, 1) < '8' THEN 'dev' ELSE 'test' END AS half FROM documents")
def seeded_split(spark, d):
    return filters.seeded_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, CASE WHEN record_id IS NOT NULL THEN 0 WHEN source IS NOT NULL THEN 1 ELSE 2 END AS tier FROM documents ORDER BY tier, md5('13:' || doc_id), doc_id LIMIT 100")
def corpus_cap(spark, d):
    """The cap is the feature: the first hundred by tier, then in hash order."""
    tier = F.when(F.col("record_id").isNotNull(), 0).when(F.col("source").isNotNull(), 1).otherwise(2)
    return filters.capped(table(spark, d, "documents"), tier, "doc_id", 100).select("doc_id", "tier")


@query(r"""WITH w AS (SELECT pair_no, string_split(trim(regexp_replace(lower(title_a), '[^a-z0-9]+', ' ', 'g')), ' ') AS a, string_split(trim(regexp_replace(lower(title_b), '[^a-z0-9]+', ' ', 'g')), ' ') AS b FROM dedup_candidates WHERE title_a IS NOT NULL AND title_b IS NOT NULL),
x AS (SELECT pair_no, word, count(*) AS n FROM (SELECT pair_no, unnest(a) AS word FROM w) GROUP BY ALL), y AS (SELECT pair_no, word, count(*) AS m FROM (SELECT pair_no, unnest(b) AS word FROM w) GROUP BY ALL)
SELECT pair_no, round(sum(least(n, coalesce(m, 0))) / sum(n), 6) AS recall FROM x LEFT JOIN y USING (pair_no, word) GROUP BY pair_no""")
def word_recall(spark, d):
    """The share of one title's words, with multiplicity, that the other has."""
    pairs = table(spark, d, "dedup_candidates").filter("title_a IS NOT NULL AND title_b IS NOT NULL")
    words = lambda c: F.explode(F.split(T.norm_title(F.col(c)), " ")).alias("word")
    x = pairs.select("pair_no", words("title_a")).groupBy("pair_no", "word").agg(F.count(F.lit(1)).alias("n"))
    y = pairs.select("pair_no", words("title_b")).groupBy("pair_no", "word").agg(F.count(F.lit(1)).alias("m"))
    shared = x.join(y, ["pair_no", "word"], "left")
    return shared.groupBy("pair_no").agg(F.round(F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n"), 6).alias("recall"))


_MARKED = "text || ' [1] and [' || (item_id % 5) || ', 9].'"


@query(rf"""WITH c AS (SELECT item_id, list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all({_MARKED}, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda m: string_split(replace(m, ' ', ''), ','))), lambda n: n::INT))) AS n FROM eval_items)
SELECT item_id, array_to_string(list_filter(n, lambda x: x BETWEEN 1 AND 3), ' ') AS cited, array_to_string(list_filter(n, lambda x: NOT x BETWEEN 1 AND 3), ' ') AS invalid FROM c""")
def citation_check(spark, d):
    marked = F.concat("text", F.lit(" [1] and ["), F.col("item_id") % 5, F.lit(", 9]."))
    checked = table(spark, d, "eval_items").select("item_id", A.citations(marked, F.lit(3)).alias("c"))
    return checked.select("item_id", F.array_join("c.cited", " ").alias("cited"), F.array_join("c.invalid", " ").alias("invalid"))


@query("""SELECT item_id, coalesce(string_agg(item_type || ': ' || text, chr(10)) OVER (PARTITION BY question_id ORDER BY item_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS history FROM eval_items""")
def conversation_history(spark, d):
    line = F.concat("item_type", F.lit(": "), "text")
    return filters.history(table(spark, d, "eval_items"), "question_id", "item_id", line, 2).select("item_id", "history")


@query("SELECT a.item_id, md5(coalesce(b.text || ' ', '') || a.text) AS joined FROM eval_items a LEFT JOIN (SELECT question_id, min(item_id) AS item_id FROM eval_items GROUP BY question_id) f ON f.question_id = a.question_id AND f.item_id <> a.item_id LEFT JOIN eval_items b ON b.item_id = f.item_id")
def followup_concat(spark, d):
    items = table(spark, d, "eval_items")
    first = items.groupBy("question_id").agg(F.min(F.struct("item_id", "text")).alias("f"))
    joined = items.join(first, "question_id", "left")
    before = F.when(F.col("f.item_id") != F.col("item_id"), F.concat("f.text", F.lit(" "))).otherwise("")
    return joined.select("item_id", F.md5(F.concat(F.coalesce(before, F.lit("")), "text")).alias("joined"))


@query("SELECT item_id, item_type AS verdict, item_id % 7 AS score FROM eval_items")
def json_lenient(spark, d):
    """Model replies with and without a code fence."""
    bare = F.to_json(F.struct(F.col("item_type").alias("verdict"), (F.col("item_id") % 7).alias("score")))
    reply = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).otherwise(bare)
    parsed = table(spark, d, "eval_items").select("item_id", T.parse_lenient(reply, "verdict string, score bigint").alias("p"))
    return parsed.select("item_id", "p.verdict", "p.score")


@query("SELECT record_id, nullif(title, '') AS title, nullif(authors, '') AS authors FROM manifest_dedup")
def csv_round_trip(spark, d):
    path = f"{Scratch(spark).root}/manifest_csv"
    files.write_csv(table(spark, d, "manifest_dedup"), path)
    return files.read_csv(spark, path).select("record_id", "title", "authors")


@query("SELECT record_id, title, abstract, year FROM candidates_dedup")
def jsonl_round_trip(spark, d):
    path = f"{Scratch(spark).root}/candidates_jsonl"
    rows = table(spark, d, "candidates_dedup").select("record_id", "title", "abstract", "year")
    files.append_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema)


def _pages(spark, d):
    """Pages made of the documents' lines."""
    lines = F.split("text", "\n")
    paragraphs = F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.concat(F.lit("<p>"), x)), "")
    html = F.concat(F.lit("<html><head><script>'</p>'</script></head><body><nav>menu</nav><div class='ad'>ad</div><article><h1>"), lines[0], F.lit("</h1><h2>Body</h2>"), paragraphs, F.lit("</article></body></html>"))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", html.alias("html"))


@query()
def pages_parse(spark, d):
    p = D.parse_pages(_pages(spark, d).select("doc_id", "html"), "html")
    return p.select("doc_id", "parsed.title", F.size("parsed.sections").alias("sections"), "parsed.words", D.body_size(F.col("parsed")).alias("characters"))


@query()
def parse_gate(spark, d):
    both = D.parse_pages(_pages(spark, d), "html").withColumnRenamed("parsed", "first")
    both = D.parse_pages(both, "text", D.parse_markdown).withColumnRenamed("parsed", "second")
    return both.select("doc_id", D.better_parse(F.col("first"), F.col("second")).alias("chosen"))


@query()
def document_chunker(spark, d):
    parsed = D.parse_pages(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "text", D.parse_markdown)
    chunks = D.chunk_documents(parsed.withColumn("abstract", F.lit(None).cast("string")))
    return chunks.select("doc_id", "chunk_no", "section", "kind", "n_tokens")


@query("SELECT event_id, user_id FROM events")
def incremental_resume(spark, d):
    """Structured streaming: each event once, appended to what is there; a second run adds nothing."""
    root = Scratch(spark).root
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    for _ in range(2):
        resume.append_missing(stream, f"{root}/events", "event_id", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/events").select("event_id", "user_id")


@query()
def vector_index_resume(spark, d):
    """Vectors written by variant and model; a second run writes none."""
    path = f"{Scratch(spark).root}/vectors"
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.lit("canonical").alias("variant"), F.lit("given").alias("model"))
    written = [files.write_vectors(rows, path), files.write_vectors(rows, path)]
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(written)], "run int, written bigint")


@query()
def result_table(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return files.markdown_table(counts, ["lang"])
