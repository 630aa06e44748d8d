"""Queries that do the whole job, where the SQL of their neighbours covers a part."""


import __spark_entry__ as entry
from litloom.functions.fuzzy import title_ratio
from litloom.plans import statistics_queries


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_gold_of_whole_quotes(spark, tmp_path):
    quote = [f"word{i}" for i in range(20)]
    docs = [(1, " ".join(["other", *quote[6:18]]), "s", "en"), (2, " ".join(quote[:8]), "s", "en"), (3, "say three short words", "s", "en"), (4, " ".join(quote[::2]), "s", "en"), (5, None, None, None)]
    items = [(1, 1, "question", "word1 word7"), (2, 1, "gold_quote", " ".join(quote)), (3, 2, "question", "short"), (4, 2, "gold_quote", "Three short words."), (5, 2, "gold_quote", "?")]
    d = write(spark, tmp_path, documents=(docs, "doc_id long, text string, source string, lang string"), eval_items=(items, "item_id long, question_id long, item_type string, text string"))
    assert {(r.query_id, r.doc_id) for r in statistics_queries.gold(spark, d).collect()} == {(1, 1), (1, 2), (3, 3)}


def test_pair_title_ratio_all(spark, tmp_path):
    rows = [(1, "Deep parsing", "Deep parsing!", 100.0), (2, "Deep parsing", "Deep parsers", None), (3, None, "x", None)]
    d = write(spark, tmp_path, dedup_candidates=(rows, "pair_no long, title_a string, title_b string, title_ratio double"))
    got = {r.pair_no: r.title_ratio for r in entry.queries()["pair_title_ratio_all"](spark, d).collect()}
    assert got == {n: title_ratio(a, b) for n, a, b, _ in rows if a and b}


def test_pages_of_long_documents(spark, tmp_path):
    text = "Title\n" + "\n".join(f"word{i}" for i in range(12_000))
    d = write(spark, tmp_path, documents=([(1, text), (2, "Title")], "doc_id long, text string"))
    got = {r.doc_id: r.words for r in entry.queries()["pages_parse"](spark, d).collect()}
    assert got[1] >= 12_000 and 2 in got
