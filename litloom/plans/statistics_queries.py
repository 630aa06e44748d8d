"""Queries on metrics, agreement, intervals and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.operators import filters, identity, retrieval, statistics
from litloom.plans.catalogue import query
from litloom.plans.retrieval_queries import _BASE, _WORK, _bm25_sql, _work, bm, documents, questions, two_rankings
from litloom.session import Scratch, parallel, small, table

_GOLD = r"""said AS (SELECT q.item_id AS query_id, regexp_extract_all(lower(g.text), '[\p{L}\p{N}_]{2,}') AS w
  FROM eval_items g JOIN eval_items q ON q.question_id = g.question_id AND q.item_type = 'question' WHERE g.item_type = 'gold_quote'),
sized AS (SELECT query_id, w, least(8, len(w)) AS n FROM said WHERE len(w) > 0),
quotes AS (SELECT DISTINCT query_id, n, array_to_string(w[p:p + n - 1], ' ') AS head FROM (SELECT query_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
grams AS (SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS head FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM words, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
gold AS (SELECT DISTINCT query_id, doc_id, work FROM quotes JOIN grams USING (n, head) JOIN work_of USING (doc_id))"""


def gold(spark, d):
    """Documents that hold eight words in a row from anywhere in a gold quote of the question, or a shorter
    quote as it is."""
    items = table(spark, d, "eval_items")
    asked = items.filter("item_type = 'question'").select("question_id", F.col("item_id").alias("query_id"))
    quotes = items.filter("item_type = 'gold_quote'").join(asked, "question_id").select("query_id", T.terms(F.col("text")).alias("w")).filter(F.size("w") > 0)
    run = lambda p, n: F.array_join(F.slice("w", p, n), " ")
    places = lambda n: F.sequence(F.lit(1), F.size("w") - n + 1)
    n = F.least(F.lit(8), F.size("w"))
    sizes = [r.n for r in quotes.select(n.alias("n")).distinct().collect()]  # eight at most
    heads = quotes.select("query_id", F.explode(F.transform(places(n), lambda p: run(p, n))).alias("head")).distinct()
    words = parallel(documents(spark, d)).select("doc_id", T.terms(F.col("text")).alias("w"), F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n")).filter(F.size("w") >= F.col("n"))
    grams = words.select("doc_id", F.explode(F.transform(places(F.col("n")), lambda p: run(p, F.col("n")))).alias("head"))
    return grams.join(small(heads), "head").select("query_id", "doc_id").distinct().join(_work(spark, d).drop("lang"), "doc_id")


def _metrics_sql(ranked: str) -> str:
    return f"""(SELECT q.query_id, round(coalesce(hits, 0) / wanted, 6) AS recall5, round(coalesce(CASE WHEN first_hit <= 10 THEN 1.0 / first_hit END, 0.0), 6) AS mrr10, first_hit, duprate5, coalesce(works5, 0) AS works5
  FROM (SELECT item_id AS query_id FROM eval_items WHERE item_type = 'question') q
  LEFT JOIN (SELECT query_id, count(DISTINCT CASE WHEN rank <= 5 THEN gold_work END) AS hits, min(CASE WHEN gold_work IS NOT NULL THEN rank END) AS first_hit,
      round(avg(CASE WHEN rank <= 5 THEN CAST(again AS INT) END), 6) AS duprate5, count(DISTINCT CASE WHEN rank <= 5 THEN work END) AS works5
    FROM (SELECT r.query_id, r.rank, w.work, g.work AS gold_work, row_number() OVER (PARTITION BY r.query_id, w.work ORDER BY r.rank) > 1 AS again
          FROM {ranked} r JOIN work_of w USING (doc_id) LEFT JOIN gold g ON g.query_id = r.query_id AND g.doc_id = r.doc_id) GROUP BY query_id) m USING (query_id)
  LEFT JOIN (SELECT query_id, count(DISTINCT work) AS wanted FROM gold GROUP BY query_id) USING (query_id))"""


@query(f"WITH {_BASE}, {_WORK}, {_GOLD} SELECT * FROM {_metrics_sql('bm')}")
def retrieval_metrics_whole(spark, d):
    """With gold from whole quotes."""
    ranked = bm(spark, d).join(_work(spark, d).drop("lang"), "doc_id")
    return statistics.retrieval_metrics(ranked, gold(spark, d), questions(spark, d))


def _two(spark, d):
    scratch = Scratch(spark)
    asked, works = questions(spark, d), _work(spark, d).drop("lang")
    held = scratch.keep(gold(spark, d))
    parts = []
    for name, ranked in zip(("bm25", "bm25-flat"), two_rankings(spark, d)):
        parts.append(statistics.retrieval_metrics(ranked.join(works, "doc_id"), held, asked).withColumn("retriever", F.lit(name)))
    both = parts[0].unionByName(parts[1]).join(asked, "query_id").withColumn("latency", F.length("text") / F.lit(1000.0))
    return scratch.keep(both.select("retriever", "query_id", "recall5", "mrr10", "latency"))


_TWO = f"""{_BASE}, {_bm25_sql('bm2', 20, 0.9, 0.0)}, {_WORK}, {_GOLD}, two AS (
  SELECT r.*, length(text) / 1000.0 AS latency FROM (SELECT 'bm25' AS retriever, * FROM {_metrics_sql('bm')} UNION ALL SELECT 'bm25-flat', * FROM {_metrics_sql('bm2')}) r JOIN eval_items ON item_id = query_id)"""


@query(f"""WITH {_TWO}, means AS (SELECT retriever, round(avg(recall5), 4) AS recall5, round(avg(mrr10), 4) AS mrr10, round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.95), 4) AS p95, count(*) AS n FROM two GROUP BY retriever),
best AS (SELECT arg_max(retriever, (recall5, retriever)) AS best FROM means)
SELECT m.*, diff, wins, losses FROM means m JOIN (
  SELECT t.retriever, round(avg(t.recall5 - b.recall5), 4) AS diff, count(*) FILTER (t.recall5 > b.recall5) AS wins, count(*) FILTER (t.recall5 < b.recall5) AS losses
  FROM two t JOIN two b ON t.query_id = b.query_id AND b.retriever = (SELECT best FROM best) GROUP BY t.retriever) USING (retriever)""")
def retriever_summary_whole(spark, d):
    """With gold from whole quotes."""
    return statistics.summary(_two(spark, d))


@query()
def bootstrap_ci(spark, d):
    out = statistics.bootstrap(_two(spark, d), "retriever", "query_id", "recall5")
    return out.select("retriever", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


_PLACES = """vals AS (SELECT r_name AS grp, round(avg(c_acctbal), 6) AS v, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS place
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_nationkey)"""


@query(f"""WITH {_PLACES}, sizes AS (SELECT grp, count(*) AS n FROM vals GROUP BY grp),
draws AS (SELECT grp, b, CAST('0x' || substr(md5('13:' || b || ':' || i), 1, 8) AS BIGINT) % n AS place FROM sizes, range(200) t(b), range(100) u(i) WHERE i < n),
means AS (SELECT grp, b, round(avg(v), 9) AS m FROM draws JOIN vals USING (grp, place) GROUP BY grp, b)
SELECT grp, mean, low, high FROM (SELECT grp, round(avg(v), 6) AS mean FROM vals GROUP BY grp) JOIN (SELECT grp, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means GROUP BY grp) USING (grp)""")
def bootstrap_hash_ci(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    by_nation = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("grp"), "n_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("v"))
    places = F.row_number().over(Window.partitionBy("grp").orderBy("n_nationkey")) - 1
    return statistics.bootstrap_hash(by_nation.withColumn("place", places.cast("bigint")), "grp", "v", 200)


_W = {"low": "-", "high": "+"}
_WILSON = ", ".join(f"round(({{p}} + 1.96 * 1.96 / (2.0 * {{n}}) {s} 1.96 * sqrt({{p}} * (1 - {{p}}) / {{n}} + 1.96 * 1.96 / (4.0 * {{n}} * {{n}})) * 1.0) / (1 + 1.96 * 1.96 / {{n}}), 6) AS {c}" for c, s in _W.items())


@query(f"SELECT o_orderpriority, count(*) AS n, {_WILSON.format(p='(count(*) FILTER (o_orderstatus = chr(70)) / count(*))', n='count(*)')} FROM orders GROUP BY o_orderpriority")
def wilson_interval(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    ci = statistics.wilson(F.col("k"), F.col("n"))
    return counts.select("o_orderpriority", "n", ci["low"].alias("low"), ci["high"].alias("high"))


_SAID = "(NOT (coalesce(title_ratio < 92 OR author_jaccard < 0.5, true) OR coalesce(abstract_cosine < 0.85, false)))"


@query(f"""WITH r AS (SELECT CASE WHEN substr(md5('13:' || pair_id), 1, 1) < '8' THEN 'dev' ELSE 'test' END AS half, {_SAID} AS s, human_same_work AS t FROM dup_pairs_to_label WHERE human_same_work IS NOT NULL),
c AS (SELECT half, count(*) FILTER (s AND t) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (NOT s AND t) AS fn, count(*) FILTER (NOT s AND NOT t) AS tn, count(*) AS n FROM r GROUP BY half)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
round((tp + tn) / n, 6) AS accuracy, {_WILSON.format(p='((tp + tn) / n)', n='n')} FROM c""")
def label_agreement(spark, d):
    rows = filters.seeded_split(table(spark, d, "dup_pairs_to_label"), "pair_id")
    said = identity.decide(F.col("title_ratio"), F.col("author_jaccard"), F.col("abstract_cosine"), F.lit(None).cast("double")) == "merge"
    return statistics.agreement(rows, said, F.col("human_same_work"), ["half"])


@query(f"""WITH r AS (SELECT CAST(human_same_work AS VARCHAR) AS a, CAST({_SAID} AS VARCHAR) AS b FROM dup_pairs_to_label WHERE human_same_work IS NOT NULL),
t AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*) AS po FROM r),
e AS (SELECT sum(x.n * y.n) / (SELECT n * n FROM t) AS pe FROM (SELECT a, count(*) AS n FROM r GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM r GROUP BY b) y ON x.a = y.b)
SELECT n, round(po, 6) AS accuracy, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM t, e""")
def cohen_kappa(spark, d):
    said = identity.decide(F.col("title_ratio"), F.col("author_jaccard"), F.col("abstract_cosine"), F.lit(None).cast("double")) == "merge"
    rows = table(spark, d, "dup_pairs_to_label").select(F.col("human_same_work").cast("string").alias("a"), said.cast("string").alias("b"))
    return statistics.kappa(rows, "a", "b")


def answers(spark, d):
    """Judged answers made from the item numbers by a rule, the same in SQL."""
    n = F.col("item_id")
    verdict = lambda i: F.element_at(F.array(F.lit("supported"), F.lit("supported"), F.lit("partial"), F.lit("unsupported"), F.lit(None)), ((n + i) % 5 + 1).cast("int"))
    cited = lambda i: F.when((n + i) % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(i, i + 1))
    sentence = lambda i: F.struct(verdict(i).alias("verdict"), cited(i).alias("cited"), (i + F.when(n % 2 == 0, 0).otherwise(2)).alias("source"))
    return table(spark, d, "eval_items").select(
        F.col("split").alias("model"), n.alias("id"), (n % 5 != 0).alias("answerable"), (n % 7 == 0).alias("abstained"), (n % 3 != 0).alias("correct"),
        F.transform(F.sequence(F.lit(1), (n % 4 + 1).cast("int")), sentence).alias("sentences"),
    )


_ANSWERS = """a AS (SELECT split AS model, item_id AS id, item_id % 5 <> 0 AS answerable, item_id % 7 = 0 AS abstained, item_id % 3 <> 0 AS correct FROM eval_items),
s AS (SELECT id, (['supported', 'supported', 'partial', 'unsupported', NULL])[(id + i) % 5 + 1] AS verdict, (id + i) % 3 = 0 AS bare, i, i + CASE WHEN id % 2 = 0 THEN 0 ELSE 2 END AS source FROM a, range(1, 5) t(i) WHERE i <= id % 4 + 1),
f AS (SELECT id, count(verdict) AS facts, count(*) FILTER (verdict = 'supported') AS good, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict IS NOT NULL AND NOT bare) AS cited,
  coalesce(sum(2) FILTER (verdict IS NOT NULL AND NOT bare), 0) AS marks, count(*) FILTER (verdict = 'supported' AND NOT bare AND source IN (i, i + 1)) AS right_,
  bool_or(verdict = 'unsupported') AS un, bool_or(verdict = 'partial') AS pa, bool_or(bare) AS bare FROM s GROUP BY id)"""


@query(f"""WITH {_ANSWERS} SELECT model, count(*) AS answers, round(count(*) FILTER (NOT abstained AND facts > 0 AND good = facts) / count(*), 4) AS grounded,
round(sum(good) / nullif(sum(facts), 0), 4) AS support, round(sum(partial) / nullif(sum(facts), 0), 4) AS partial, round(sum(right_) / nullif(sum(marks), 0), 4) AS citation_precision,
round(sum(cited) / nullif(sum(facts), 0), 4) AS citation_coverage, round(count(*) FILTER (correct) / nullif(count(*) FILTER (answerable), 0), 4) AS correct,
round(count(*) FILTER (abstained AND NOT answerable) / nullif(count(*) FILTER (NOT answerable), 0), 4) AS abstention_recall,
round(count(*) FILTER (abstained AND answerable) / nullif(count(*) FILTER (answerable), 0), 4) AS false_abstention FROM a JOIN f USING (id) GROUP BY model""")
def answer_metrics(spark, d):
    return statistics.answer_metrics(answers(spark, d))


@query(f"""WITH {_ANSWERS} SELECT model, id, failure FROM (SELECT model, id, unnest(list_filter([CASE WHEN abstained AND answerable THEN 'false_abstention' END, CASE WHEN NOT abstained AND NOT answerable THEN 'answered_unanswerable' END,
CASE WHEN un THEN 'unsupported_sentence' END, CASE WHEN pa THEN 'partly_supported' END, CASE WHEN NOT abstained AND bare THEN 'uncited_sentence' END, CASE WHEN NOT abstained AND NOT correct THEN 'wrong' END], lambda x: x IS NOT NULL)) AS failure FROM a JOIN f USING (id))""")
def failure_cases(spark, d):
    return statistics.failures(answers(spark, d))


@query("SELECT coalesce(item_type, 'total') AS item_type, coalesce(split, 'total') AS split, count(*) AS n FROM eval_items GROUP BY CUBE (item_type, split)")
def type_split_pivot(spark, d):
    return statistics.with_totals(table(spark, d, "eval_items"), "item_type", "split")


@query("SELECT coalesce(event_type, 'all') AS form, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")
def form_means(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("form"), "mean", "n")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max("value").alias("most"))


@query("SELECT (SELECT count(*) FROM events WHERE ts IS NOT NULL) AS by_window, (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS windows, (SELECT count(*) FROM events) AS total, true AS complete")
def window_completeness(spark, d):
    return filters.window_completeness(table(spark, d, "events"), F.col("ts"))


@query("SELECT event_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INT) AS place FROM events GROUP BY event_type")
def top_groups(spark, d):
    """Group counts, most common first."""
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "event_type")))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS seen FROM events")
def seen_before(spark, d):
    return table(spark, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) > 1).alias("seen"))


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS ids, md5(string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id)) AS cache_key FROM events WHERE event_type = 'error' GROUP BY user_id")
def group_lists(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), " ")
    return table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(ids.alias("ids")).withColumn("cache_key", F.md5("ids"))


@query("WITH b AS (SELECT date_trunc('month', min(ts)) AS lo, date_trunc('month', max(ts)) AS hi FROM events) SELECT CAST(m AS DATE) AS first_day, CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS last_day FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM b)")
def date_windows(spark, d):
    bounds = table(spark, d, "events").agg(F.trunc(F.min("ts"), "month").alias("lo"), F.trunc(F.max("ts"), "month").alias("hi"))
    return bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("first_day")).select("first_day", F.last_day("first_day").alias("last_day"))


@query("SELECT n_nationkey, c_custkey, CAST(floor((row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1) / 50) AS INT) AS batch FROM customer JOIN nation ON c_nationkey = n_nationkey")
def fixed_batches(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey").join(table(spark, d, "nation").select("n_nationkey"), "n_nationkey")
    return filters.fixed_batches(rows, "n_nationkey", "c_custkey", 50)


@query("SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error'")
def set_difference(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'click'").select("user_id").subtract(e.filter("event_type = 'error'").select("user_id"))


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def set_intersection(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'click'").select("user_id").intersect(e.filter("event_type = 'error'").select("user_id"))
