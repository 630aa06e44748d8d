"""Queries on ranked lists: keyword, dense, fused and diversified."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.functions import fuzzy
from litloom.functions import text as T
from litloom.operators import filters, models, retrieval
from litloom.plans.catalogue import query
from litloom.session import Scratch, table

_TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_POSTINGS = f"""words AS (SELECT doc_id, {_TERMS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term)"""


def _bm25_sql(name: str, k: int, k1: float, b: float) -> str:
    return f"""{name} AS (
  SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank
  FROM (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
        FROM asked JOIN tf USING (term) JOIN df USING (term), stats GROUP BY query_id, doc_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k})"""


_ASKED = f"asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS.format('text')}) AS term FROM eval_items WHERE item_type = 'question')"
_BASE = f"{_POSTINGS}, {_ASKED}, {_bm25_sql('bm', 20, 1.5, 0.75)}"
_FUSED = f"""{_BASE}, {_bm25_sql('bm2', 20, 0.9, 0.0)},
fused0 AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((l, rank)) AS first
  FROM (SELECT query_id, doc_id, rank, 0 AS l FROM bm UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm2) GROUP BY query_id, doc_id),
fused AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS INT) AS rank FROM fused0)"""


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def questions(spark, d):
    return table(spark, d, "eval_items").filter("item_type = 'question'").select(F.col("item_id").alias("query_id"), "text")


def _work(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("work"), F.coalesce("lang", F.lit("")).alias("lang"))


_WORK = "work_of AS (SELECT doc_id, coalesce(source, '') AS work, coalesce(lang, '') AS lang FROM documents)"


def bm(spark, d, k=20):
    return retrieval.bm25(documents(spark, d), questions(spark, d), k)


def fused(spark, d):
    return retrieval.fuse(two_rankings(spark, d))


def two_rankings(spark, d):
    """Two keyword rankings from one reading of the texts."""
    asked = questions(spark, d)
    found = retrieval.matched(documents(spark, d), asked, Scratch(spark))
    return [retrieval.rank_bm25(found, asked, 20), retrieval.rank_bm25(found, asked, 20, k1=0.9, b=0.0)]


@query(f"WITH {_POSTINGS} SELECT term, df, cf FROM df")
def bm25_index_stats(spark, d):
    return retrieval.postings(documents(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_BASE} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, d):
    return bm(spark, d, 10)


@query(f"WITH {_FUSED} SELECT query_id, doc_id, score, rank FROM fused")
def rrf_fusion(spark, d):
    return fused(spark, d)


_R1 = f"""{_BASE}, {_WORK}, placed AS (
  SELECT query_id, doc_id, rank, work, row_number() OVER w AS nth, first_value(doc_id) OVER w AS head
  FROM bm JOIN work_of USING (doc_id) WINDOW w AS (PARTITION BY query_id, work ORDER BY rank))"""


@query(f"WITH {_R1} SELECT query_id, doc_id, rank, work, nth <= 2 AS kept, CASE WHEN nth > 2 THEN head END AS under FROM placed")
def collapse_r1(spark, d):
    ranked = bm(spark, d).join(_work(spark, d).drop("lang"), "doc_id")
    return retrieval.cap_per_work(ranked, 2).select("query_id", "doc_id", "rank", "work", "kept", "under")


@query(f"WITH {_R1} SELECT query_id, head AS doc_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS folded FROM placed WHERE nth > 2 GROUP BY query_id, head")
def collapse_r1_folded(spark, d):
    folded = collapse_r1(spark, d).filter("NOT kept").groupBy("query_id", F.col("under").alias("doc_id"))
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d"))))
    return folded.agg(F.array_join(F.transform(rows, lambda r: r["d"]), " ").alias("folded"))


@query(f"""WITH {_BASE}, {_WORK}, f AS (SELECT query_id, doc_id, rank, lang <> 'en' AS flagged FROM bm JOIN work_of USING (doc_id)),
g AS (SELECT *, NOT flagged OR sum(CAST(flagged AS INT)) OVER (PARTITION BY query_id ORDER BY rank) <= 1 AS ok FROM f),
h AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY query_id ORDER BY rank) - CAST(ok AS INT) AS e FROM g)
SELECT query_id, doc_id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ok AND e < 5 THEN 0 WHEN NOT ok AND e < 5 THEN 1 ELSE 2 END, rank) AS INT) AS new_rank FROM h""")
def collapse_r3(spark, d):
    ranked = bm(spark, d).join(_work(spark, d), "doc_id")
    return retrieval.cap_category(ranked, F.col("lang") != "en").select("query_id", "doc_id", "rank", "new_rank")


@query()
def collapse_r2(spark, d):
    """Near-duplicate folding with hashed word vectors of the ranked documents only."""
    ranked = Scratch(spark).keep(bm(spark, d))
    wanted = documents(spark, d).join(ranked.select("doc_id").distinct(), "doc_id", "left_semi")
    vectors = wanted.select("doc_id", retrieval.hashed_vector(F.col("text")).alias("embedding"))
    return retrieval.fold_near(ranked.join(_work(spark, d).drop("lang"), "doc_id").join(vectors, "doc_id"), cap=2)


@query(f"""WITH {_FUSED}, {_WORK}, placed AS (SELECT query_id, doc_id, score, rank, work, row_number() OVER (PARTITION BY query_id, work ORDER BY rank) AS nth FROM fused JOIN work_of USING (doc_id))
SELECT query_id, doc_id, score, work, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM placed WHERE nth <= 4
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8""")
def hybrid_retrieve(spark, d):
    """The flagship: two keyword rankings fused, at most four of a work, the first eight."""
    kept = retrieval.cap_per_work(fused(spark, d).join(_work(spark, d).drop("lang"), "doc_id")).filter("kept")
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("place", again).filter("place <= 8").select("query_id", "doc_id", "score", "work", F.col("place").alias("rank"))


@query(f"WITH {_BASE} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_stored_index(spark, d):
    """The same ranking from an index on disk."""
    path = f"{Scratch(spark).root}/index"
    retrieval.build_index(documents(spark, d), path)
    return retrieval.search_index(spark, path, questions(spark, d), 10)


@query()
def bm25_stemmed_index(spark, d):
    """Without stop words, over stems."""
    path = f"{Scratch(spark).root}/index"
    retrieval.build_index(documents(spark, d), path, retrieval.STOP, stemmed=True)
    return retrieval.search_index(spark, path, questions(spark, d), 10)


_NEAR = """near0 AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id IN (SELECT item_id FROM eval_items WHERE item_type = 'question') AND v.vec_id IN (SELECT doc_id FROM documents)),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM near0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20)"""
_HYBRID = f"""{_BASE}, {_WORK}, {_NEAR},
both0 AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((l, rank)) AS first FROM (SELECT query_id, doc_id, rank, 0 AS l FROM near UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm) GROUP BY query_id, doc_id),
both_ AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM both0),
placed AS (SELECT query_id, doc_id, score, rank, row_number() OVER (PARTITION BY query_id, work ORDER BY rank) AS nth FROM both_ JOIN work_of USING (doc_id))"""


def near_and_words(spark, d):
    """A dense ranking (the vector with a question's number stands for it) and a keyword ranking."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.join(questions(spark, d).select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    return retrieval.dense(vectors.join(documents(spark, d).select("doc_id"), "doc_id", "left_semi"), asked, 20), bm(spark, d)


def _about(spark, d):
    return _work(spark, d).select("doc_id", "work", (F.col("lang") != "en").alias("flagged"))


@query(f"""WITH {_HYBRID} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM placed WHERE nth <= 4
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8""")
def hybrid_dense(spark, d):
    """The flagship: vectors and words fused, at most four of a work, the first eight."""
    near, words = near_and_words(spark, d)
    return retrieval.retrieve(words, near, _about(spark, d), 8, "r1").drop("folded")


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM both_ WHERE rank <= 8")
def hybrid_dense_off(spark, d):
    near, words = near_and_words(spark, d)
    return retrieval.retrieve(words, near, _about(spark, d), 8, "off").drop("folded")


@query()
def hybrid_dense_folded(spark, d):
    """With near passages folded, by the given vectors, and one passage in another language in front."""
    near, words = near_and_words(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = retrieval.retrieve(words, near, _about(spark, d), 8, "r1r2r3", vectors=vectors)
    return out.withColumn("folded", F.array_join(F.col("folded").cast("array<string>"), " "))


@query(f"""WITH {_NEAR} SELECT item_id AS query_id, max(score) AS score, max(score) IS NULL OR max(score) < 0.4 AS abstain
FROM eval_items LEFT JOIN near ON query_id = item_id WHERE item_type = 'question' GROUP BY item_id""")
def dense_gate(spark, d):
    """Hybrids are gated on the dense score."""
    near, words = near_and_words(spark, d)
    return retrieval.gated(questions(spark, d), 0.4, near=near, words=words)


_UNIT = "list_transform(embedding[1:16], lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16], lambda y: y::DOUBLE * y::DOUBLE))))"


@query(f"SELECT vec_id, round(({_UNIT})[1], 6) AS first, round(({_UNIT})[16], 6) AS last, 16 AS dims FROM embeddings")
def embedding_truncate(spark, d):
    cut = table(spark, d, "embeddings").select("vec_id", retrieval.truncated(F.col("embedding"), 16).alias("v"))
    return cut.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("last"), F.size("v").alias("dims"))


_DOT = """dots AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)"""


def _vectors(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors, vectors.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


@query(f"WITH {_DOT} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM dots QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def dense_topk(spark, d):
    return retrieval.dense(*_vectors(spark, d), 10)


@query(f"WITH {_DOT} SELECT query_id, doc_id, score FROM dots WHERE score >= 0.3 AND query_id <> doc_id")
def near_vectors(spark, d):
    """Every vector near one of the query set, however many there are."""
    return retrieval.dense(*_vectors(spark, d), None, least=0.3).filter("query_id <> doc_id")


@query(f"WITH {_BASE}, best AS (SELECT item_id AS query_id, max(score) AS score FROM eval_items LEFT JOIN bm ON query_id = item_id WHERE item_type = 'question' GROUP BY item_id) SELECT query_id, score, score IS NULL OR score < 12.0 AS abstain FROM best")
def score_gate(spark, d):
    return filters.score_gate(_best(spark, d), 12.0)


def _best(spark, d):
    return questions(spark, d).select("query_id").join(bm(spark, d).groupBy("query_id").agg(F.max("score").alias("score")), "query_id", "left")


@query(f"""WITH {_BASE}, best AS (SELECT item_id AS query_id, item_id % 4 <> 0 AS answerable, max(score) AS score FROM eval_items LEFT JOIN bm ON query_id = item_id WHERE item_type = 'question' GROUP BY item_id),
t AS (SELECT floor((min(score) FILTER (answerable) - 0.02) * 1000) / 1000 AS tau FROM best)
SELECT tau, count(*) FILTER (score < tau AND NOT answerable) AS gated_unanswerable, count(*) FILTER (score < tau AND answerable) AS gated_answerable,
count(*) FILTER (NOT answerable) AS unanswerable, count(*) FILTER (answerable) AS answerable FROM best, t GROUP BY tau""")
def gate_tuning(spark, d):
    return filters.tune_gate(_best(spark, d), F.col("query_id") % 4 != 0)


@query(f"""WITH {_BASE} SELECT query_id, md5(string_agg('[' || rank || '] ' || coalesce(source, '') || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context
FROM bm JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id""")
def context_assembly(spark, d):
    texts = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("label"), "text")
    top = bm(spark, d, 3).join(texts, "doc_id")
    return models.contexts(top, 3).select("query_id", F.md5("context").alias("context"))


@query(f"WITH {_BASE}, {_bm25_sql('bm2', 20, 0.9, 0.0)} SELECT query_id, doc_id FROM (SELECT query_id, doc_id FROM bm WHERE rank <= 5 UNION SELECT query_id, doc_id FROM bm2 WHERE rank <= 5) WHERE (query_id + doc_id) % 3 <> 0")
def pool_union(spark, d):
    lists = two_rankings(spark, d)
    judged = lists[0].unionByName(lists[1]).select("query_id", "doc_id").distinct().filter("(query_id + doc_id) % 3 = 0")
    return models.pool(lists, 5, judged)


@query()
def retrieval_gold_hits(spark, d):
    """Ranked documents that hold a gold quote of the question, a few letters apart or in part."""
    items = table(spark, d, "eval_items")
    quotes = items.filter("item_type = 'gold_quote'").select("question_id", F.lower(F.col("text")).alias("quote"))
    asked = items.filter("item_type = 'question'").select("question_id", F.col("item_id").alias("query_id"))
    ranked = bm(spark, d, 20).join(documents(spark, d), "doc_id").join(asked, "query_id").join(quotes, "question_id")
    # only the best-matching line is scored against the quote
    lines = ranked.select("query_id", "doc_id", "rank", "quote", F.explode(F.split(F.lower(F.col("text")), "\n")).alias("line")).filter("length(line) > 0")
    scored = lines.withColumn("ratio", fuzzy.fuzz_partial_ratio(F.col("quote"), F.col("line"), 85))
    return scored.groupBy("query_id", "doc_id", "rank").agg(F.round(F.max("ratio"), 4).alias("ratio")).filter("ratio >= 85")


@query("""WITH q AS (SELECT question_id, min(text) FILTER (item_type = 'question') AS question, string_agg(text, ' ' ORDER BY item_id) FILTER (item_type = 'gold_quote') AS quotes FROM eval_items GROUP BY question_id),
w AS (SELECT question_id, """ + ", ".join(
    f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')), lambda x: NOT list_contains(string_split('{' '.join(T.OVERLAP_STOP)}', ' '), x)) AS {n}" for c, n in (("question", "a"), ("quotes", "b"))
) + """ FROM q)
SELECT question_id, coalesce(round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 4), 0.0) AS overlap FROM w""")
def lexical_overlap(spark, d):
    texts = F.array_sort(F.collect_list(F.when(F.col("item_type") == "gold_quote", F.struct("item_id", "text"))))
    rows = table(spark, d, "eval_items").groupBy("question_id").agg(F.min(F.when(F.col("item_type") == "question", F.col("text"))).alias("q"), F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("g"))
    return rows.select("question_id", T.lexical_overlap(F.coalesce("q", F.lit("")), F.coalesce("g", F.lit(""))).alias("overlap"))
