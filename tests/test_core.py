"""Golden values, edge cases and cross-checks of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from litloom.functions import fuzzy, stem
from litloom.functions import text as T
from litloom.operators import documents as D
from litloom.operators import answers, collection, filters, identity, models, retrieval, statistics
from litloom.session import Scratch
from litloom.sources import files


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_equals_the_plain_one():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(0, 30))) for _ in range(2))
        assert fuzzy.lcs(a, b) == plain_lcs(a, b)


def test_ratios():
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("", "a") == 0
    assert fuzzy.token_set_ratio("a b c", "c b a") == 100 and fuzzy.token_set_ratio("", "a") == 0
    assert fuzzy.title_ratio("Byte pair encoding", "Byte pair encoding for the neural translation of rare words") < 60
    assert fuzzy.partial_ratio("gold quote", "here a gold quote stands") == 100
    assert fuzzy.partial_ratio("gold qoute", "here a gold quote stands", 85) >= 85
    rng = random.Random(2)
    for _ in range(200):
        a, b = "".join(rng.choices("ab ", k=8)), "".join(rng.choices("ab ", k=20))
        full = fuzzy.partial_ratio(a, b)
        assert fuzzy.partial_ratio(a, b, 80) == (full if full >= 80 else 0)


def test_fusion_and_caps(spark):
    lists = [spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, doc_id bigint, rank int"), spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id int, doc_id bigint, rank int")]
    got = retrieval.fuse(lists).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [20, 10, 30] and got[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    ranked = spark.createDataFrame([(1, 1, 1, "w1"), (1, 2, 2, "w1"), (1, 3, 3, "w4"), (1, 4, 4, "w1")], "query_id int, doc_id bigint, rank int, work string")
    rows = retrieval.cap_per_work(ranked, 2).orderBy("rank").collect()
    assert [r.kept for r in rows] == [True, True, True, False] and rows[3].under == 1
    flagged = spark.createDataFrame([(1, i, i, s) for i, s in enumerate([True, False, True, False, False, False, False], 1)], "query_id int, doc_id bigint, rank int, survey boolean")
    assert [r.doc_id for r in retrieval.cap_category(flagged, F.col("survey")).orderBy("new_rank").collect()] == [1, 2, 4, 5, 6, 3, 7]


def test_near_folding(spark):
    rows = [(1, 1, 1, "a", [1.0, 0.0]), (1, 2, 2, "b", [1.0, 0.01]), (1, 3, 3, "a", [0.0, 1.0]), (1, 4, 4, "a", None)]
    got = retrieval.fold_near(spark.createDataFrame(rows, "query_id bigint, doc_id bigint, rank int, work string, embedding array<double>"), 0.9, 2).orderBy("rank").collect()
    assert [(r.kept, r.under, r.reason) for r in got] == [(True, None, None), (False, 1, "also stated in"), (True, None, None), (False, 1, "more from this paper")]


def test_paged_source(spark, tmp_path):
    """Pages of every window, a failure tried again, and nothing fetched again from the cache."""
    (tmp_path / "pagedfetch.py").write_text(
        "import pathlib\nlog = pathlib.Path(__file__).with_name('asked')\n"
        "class Busy(OSError):\n    after = 0.0\n"
        "def fetch(window, page):\n"
        "    with log.open('a') as f: f.write(f'{window}{page} ')\n"
        "    if (window, page) == ('b', 0) and log.read_text().count('b0') == 1: raise Busy()\n"
        "    if (window, page) == ('a', 1) and log.read_text().count('a1') == 1: raise OSError()\n"
        "    return [{'n': f'{window}{page}'}] if page < 2 else []\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "pagedfetch.py"))
    from litloom.sources import paged

    spark.dataSource.register(paged.PagedSource)
    read = lambda: spark.read.format("paged").option("fetch", "pagedfetch:fetch").option("windows", "a,b").option("cache", str(tmp_path / "cache")).option("back_off", "0.01").load()
    want = [("a", 0, '{"n": "a0"}'), ("a", 1, '{"n": "a1"}'), ("b", 0, '{"n": "b0"}'), ("b", 1, '{"n": "b1"}')]
    assert sorted(r[:] for r in read().collect()) == want and sorted(r[:] for r in read().collect()) == want
    assert sorted((tmp_path / "cache").glob("*")) == [tmp_path / "cache/a.jsonl", tmp_path / "cache/b.jsonl"]


def test_stems():
    known = "consign consigned consigning consignment consist consistency consistently consolation consolatory knackeries knightly knots relational hopping hoped happy sky news generously communism ties cries agreed plastered motoring falling skis by"
    want = "consign consign consign consign consist consist consist consol consolatori knackeri knight knot relat hop hope happi sky news generous communism tie cri agre plaster motor fall ski by"
    assert [stem.stem(w) for w in known.split()] == want.split() and stem.stem("étés") == "étés"


def test_stored_index_equals_plain_bm25(spark, tmp_path):
    rng = random.Random(17)
    words = "pairs merging merged tokens token the of vocabulary vocabularies model".split()
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(80)] + [(99, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "Merging tokens"), (2, "the vocabulary of models"), (3, None), (4, "absent")], "query_id bigint, text string")
    plain = [r[:] for r in retrieval.bm25(docs, asked, 5).orderBy("query_id", "rank").collect()]
    retrieval.build_index(docs, str(tmp_path / "i"), buckets=4)
    assert [r[:] for r in retrieval.search_index(spark, str(tmp_path / "i"), asked, 5).orderBy("query_id", "rank").collect()] == plain
    retrieval.build_index(docs, str(tmp_path / "s"), buckets=4, stop=retrieval.STOP, stemmed=True)
    read = lambda t: " ".join(stem.stem(w) for w in t.lower().split() if w not in retrieval.STOP)
    again = lambda rows: [(i, None if t is None else read(t)) for i, t in rows]
    want = retrieval.bm25(spark.createDataFrame(again(r[:] for r in docs.collect()), docs.schema), spark.createDataFrame(again(r[:] for r in asked.collect()), asked.schema), 5)
    got = retrieval.search_index(spark, str(tmp_path / "s"), asked, 5)
    assert [r[:] for r in got.orderBy("query_id", "rank").collect()] == [r[:] for r in want.orderBy("query_id", "rank").collect()]
    with pytest.raises(Exception, match="exists"):
        retrieval.build_index(docs, str(tmp_path / "i"))


def test_retrieve_modes_and_gate(spark):
    ranked = lambda rows: spark.createDataFrame([(1, d, r, s) for r, (d, s) in enumerate(rows, 1)], "query_id bigint, doc_id bigint, rank int, score double")
    words, near = ranked([(10, 9.0), (11, 8.0), (12, 7.0)]), ranked([(12, 0.9), (13, 0.8), (10, 0.7)])
    about = spark.createDataFrame([(10, "w", False), (11, "w", True), (12, "w", False), (13, "v", True)], "doc_id bigint, work string, flagged boolean")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 1.0]), (13, [1.0, 0.01])], "doc_id bigint, embedding array<double>")
    ids = lambda **how: [r.doc_id for r in retrieval.retrieve(words, near, about, 3, **how).orderBy("rank").collect()]
    assert ids(mode="off") == [12, 10, 13] and ids(mode="r1", cap=1) == [12, 13] and ids(mode="r1", cap=2) == [12, 10, 13]
    assert ids(mode="r1r2r3", cap=4, vectors=vectors, tau=0.95) == [12, 10, 11]
    assert [r.doc_id for r in retrieval.retrieve(words, None, about, 2, mode="off").orderBy("rank").collect()] == [10, 11]
    folded = {r.doc_id: list(r.folded) for r in retrieval.retrieve(words, near, about, 3, mode="r1", cap=1).collect()}
    assert folded == {12: [10, 11], 13: []}
    asked = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    gate = lambda **by: {r.query_id: r.abstain for r in retrieval.gated(asked, 0.95, **by).collect()}
    assert gate(near=near, words=words) == {1: True, 2: True} and gate(words=words) == {1: False, 2: True}


def test_bm25_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "byte pair"), (2, None), (3, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(9, "Byte"), (8, None), (7, "")], "query_id bigint, text string")
    assert [(r.query_id, r.doc_id) for r in retrieval.bm25(docs, asked, 3).collect()] == [(9, 1)]
    assert retrieval.bm25(docs.limit(0), asked, 3).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "doc_id bigint, embedding array<double>")
    assert retrieval.dense(vectors, vectors.withColumnRenamed("doc_id", "query_id"), 5).count() == 1


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(150)], "node int")
    got = {r.node: r.component for r in identity.components(nodes, frame, Scratch(spark)).collect()}
    assert got == {i: find(i) for i in range(150)}


def test_similar_titles_match_brute_force(spark):
    rng = random.Random(4)
    sets = {i: sorted(set(rng.choices("abcdefghij", k=rng.randint(1, 8)))) for i in range(60)}
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.6 * len({*sets[a]} | {*sets[b]})}
    frame = spark.createDataFrame(list(sets.items()), "id int, words array<string>")
    assert {(r.a, r.b) for r in identity.similar_titles(frame, Scratch(spark)).collect()} == want


def test_similar_titles_of_common_words(spark):
    """Titles of one pattern share common words throughout: few pairs may meet, however many titles there are."""
    rng = random.Random(5)
    parts = [[f"{p}{i}" for i in range(30)] for p in "abcdefgh"]
    sets = {i: ["on", "for", "in", "of", *map(rng.choice, parts), f"x{i}", f"y{i // 2}"] for i in range(1500)}
    sets |= {2000 + i: [*sets[i][:-2], f"z{i}"] for i in range(0, 300, 3)} | {3000: ["on"], 3001: ["on"], 3002: ["on", "for"], 3003: [f"w{i}" for i in range(40)], 3004: [f"w{i}" for i in range(9, 40)], 3005: [f"v{i}" for i in range(150)], 3006: [f"v{i}" for i in range(60, 151)]}
    held = {k: set(v) for k, v in sets.items()}
    want = {(a, b) for a in held for b in held if a < b and len(held[a] & held[b]) >= 0.6 * len(held[a] | held[b])}
    found = identity.similar_titles(spark.createDataFrame(list(sets.items()), "id int, words array<string>"), Scratch(spark))
    got = [(r.a, r.b) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 100
    plan = found._jdf.queryExecution().executedPlan()
    joins = [line for line in plan.toString().splitlines() if "Join" in line and "key" in line]
    assert any("array_intersect" in line for line in joins)  # compared where they meet: no candidates are written


def test_decide_and_agreement(spark):
    rows = spark.createDataFrame([(95.0, 0.6, None, None), (95.0, 0.6, 0.9, 0.5), (95.0, 0.6, 0.8, None), (91.0, 0.9, None, None), (None, 0.9, None, None)], "t double, a double, c double, b double")
    got = [r.d for r in rows.select(identity.decide(F.col("t"), F.col("a"), F.col("c"), F.col("b")).alias("d")).collect()]
    assert got == ["merge", "related", "separate", "separate", "separate"]
    said = [(True, True)] * 6 + [(True, False), (False, True), (False, False)]
    r = statistics.agreement(spark.createDataFrame(said, "x boolean, y boolean"), F.col("x"), F.col("y"), []).first()
    assert (round(r.precision, 3), round(r.recall, 3), round(r.f1, 3), round(r.accuracy, 3)) == (0.857, 0.857, 0.857, 0.778)
    assert 0.44 < r.low < 0.46 and 0.93 < r.high < 0.95


def test_citations(spark):
    cases = [
        ("BPE merges pairs of symbols. [1] It is old [9].", 3, "BPE merges pairs of symbols [1]. It is old [citation removed].", [1], [9], ["It is old [citation removed]."]),
        ("a [2][3] b [1, 3].", 3, "a [2][3] b [1, 3].", [1, 2, 3], [], []),
        ("This sentence has no citation at all.", 2, "This sentence has no citation at all.", [], [], ["This sentence has no citation at all."]),
        ("", 0, "", [], [], []), (None, None, "", [], [], []),
        ("One fact here [7, 1]!\n\nAnother  fact [8] there [8]? Yes.", 2, "One fact here [1] [citation removed]!\n\nAnother  fact there [citation removed]? Yes.", [1], [7, 8, 8], []),
        (f"{models.ABSTAIN} Is this one then a question? Two words. [2]", 2, f"{models.ABSTAIN} Is this one then a question? Two words [2].", [2], [], []),
    ]
    frame = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, raw string, n int")
    got = frame.select("i", answers.citations(F.col("raw"), F.coalesce("n", F.lit(0))).alias("c")).orderBy("i").select("c.*").collect()
    for row, case in zip(got, cases):
        assert row[:] == case[2:], (row, case)


KEYED = ("i", "m", "r")


def test_sheet_alignment_and_judgments(spark):
    frame = spark.createDataFrame([(*KEYED, "First one [1]. Second one! Third\n\nSources:\n[1] x."), ("e", "m", "r", ""), ("n", "m", "r", None)], "id string, model string, retriever string, answer string")
    sheet = answers.sentence_sheet(frame).orderBy("sentence_no").collect()
    assert [(r.sentence_no, r.sentence, r.cited) for r in sheet] == [(1, "First one [1].", "[1]"), (2, "Second one!", ""), (3, "Third", "")]
    human = "id string, model string, retriever string, sentence_no int, sentence string, human string"
    judge = "id string, model string, retriever string, pos int, text string, verdict string"
    humans = [(*KEYED, 1, "x", "Supported "), (*KEYED, 2, "y", "-"), ("b", "m", "r", 1, "the second sentence", "partial"), ("b", "m", "r", 2, "quite another thing", "supported"), ("c", "m", "r", 1, "z", "partial")]
    judged = [(*KEYED, 1, "q", "supported"), (*KEYED, 2, "w", "partial"), ("b", "m", "r", 1, "the first sentence", "supported"), ("b", "m", "r", 2, "the second sentence.", "unsupported"), ("b", "m", "r", 3, "a third", "partial")]
    both = answers.aligned(spark.createDataFrame(humans, human), spark.createDataFrame(judged, judge))
    assert {(r.id, r.sentence_no): r.verdict for r in both.collect()} == {("i", 1): "supported", ("i", 2): "partial", ("b", 1): "unsupported", ("b", 2): None, ("c", 1): None}
    pairs, left = answers.labelled_pairs(both)
    assert sorted(r[:] for r in pairs.collect()) == [("partial", "unsupported"), ("supported", "supported")] and left.first().unaligned == 2


class Scripted:
    def ask(self, prompt):
        return {"good": '```json\n{"correctness": "correct"}\n```', "bad": "no JSON"}[prompt]


def test_judging_and_patience(spark):
    frame = spark.createDataFrame([("1", "good", False), ("2", "bad", False), ("3", None, True), ("4", "good", False)], "key string, prompt string, abstained boolean")
    done = spark.createDataFrame([("4", False), ("1", True)], "key string, unjudged boolean")
    got = {r.key: (r.unjudged, r.judgment and r.judgment.correctness) for r in answers.judged(frame, done, Scripted, "struct<correctness string>").collect()}
    assert got == {"1": (False, "correct"), "2": (True, None), "3": (False, None)}

    class Busy:
        cost, left = 0.5, 3

        def ask(self, prompt):
            self.left -= 1
            if self.left:
                raise models.Refused(7.0 if self.left == 1 else None)
            return "x"

    slept = []
    patient = models.Patient(Busy(), sleep=slept.append)
    assert patient.ask("p") == "x" and slept == [1.0, 7.0] and patient.costs == 0.5
    with pytest.raises(OSError):
        models.Patient(Busy(), tries=2, sleep=slept.append).ask("p")


def test_run_set_answers_parents_of_other_splits(spark):
    rows = [("p1", "dev", None, "P1"), ("f1", "test", "p1", "F1"), ("q1", "test", None, "Q1"), ("f2", "test", "p2", "F2"), ("p2", "dev", None, "P2"), ("q2", "test", None, "Q2")]
    questions = spark.createDataFrame(rows, "id string, split string, parent_id string, text string")
    recorded = spark.createDataFrame([("p2", "old"), ("q2", "old")], "id string, answer string")
    reply = lambda todo: todo.select("id", F.concat(F.coalesce("history", F.lit("")), F.lit("|"), "text").alias("answer"))
    got = {r.id: r.answer for r in answers.run_set(questions, recorded, "test", reply).collect()}
    assert got == {"q1": "|Q1", "f1": "user: P1\nassistant: |P1|F1", "f2": "user: P2\nassistant: old|F2"}


def test_verified_quotes(spark):
    quotes = spark.createDataFrame([("d", 1, "gold quote text", "A"), ("d", 2, "only in the other", "A"), ("d", 3, "nowhere to be seen 123456", "A")], "doc string, no int, quote string, section string")
    sections = spark.createDataFrame([("d", "A", "here the gold quote text stands"), ("d", "B", "gold quote text; it is only in the other section")], "doc string, path string, text string")
    got = {r.no: (r.section, r.score >= 90) for r in answers.verified(quotes, sections).collect()}
    assert got[1] == ("A", True) and got[2] == ("B", True) and not got[3][1]
    kept, dropped = answers.kept_questions(answers.verified(quotes, sections))
    assert kept.count() == 2 and dropped.first().dropped == 1
    themes = spark.createDataFrame([("t", "w1", 95.0), ("t", "w2", 91.0), ("u", "w1", 95.0), ("u", "w2", 80.0)], "theme string, work string, score double")
    assert [r[:] for r in answers.themed(themes).collect()] == [("t", 2)]


def test_composed_answers(spark):
    replies = spark.createDataFrame([(1, " Pairs merge often here [2]. ", 2), (2, f'"{models.ABSTAIN}"', 2)], "id int, raw string, n int")
    sources = spark.createDataFrame([(1, 1, "One"), (1, 2, "Two"), (2, 1, "One")], "id int, n int, label string")
    got = {r.id: (r.text, r.abstained) for r in answers.composed(replies, sources).collect()}
    assert got == {1: ("Pairs merge often here [2].\n\nSources:\n[2] Two", False), 2: (f'"{models.ABSTAIN}"', True)}


def test_metrics_and_failures(spark):
    S = "array<struct<text string, factual boolean, verdict string, cited array<int>, source int>>"
    schema = f"id string, model string, retriever string, type string, abstained boolean, gate_abstained boolean, invalid array<int>, cost double, latency double, correctness string, sentences {S}, answer string, reasoning string, gold array<string>, sources array<string>"
    rows = [
        ("1", "m", "r", "factual", False, False, [9], 0.1, 1.0, "correct", [("a", True, "supported", [1, 2], 1), ("b", False, None, [], None)], "A", "", ["w1"], ["w1", "w2"]),
        ("2", "m", "r", "multi", False, False, [], 0.2, 3.0, "wrong", [("c", True, "unsupported", [], None), ("d", True, "partial", [3], 3)], "B", "because", ["w9"], ["w1"]),
        ("3", "m", "r", "unanswerable", True, True, [], 0.0, 0.5, "not_applicable", [], "", None, [], []),
        ("4", "m", "r", "unanswerable", False, False, [], 0.1, 2.0, "correct", [("e", True, "supported", [1], 1)], "C\n\nSources:\n[1] x", None, [], ["w1"]),
        ("5", "m", "r", "factual", True, False, [], 0.0, 9.0, None, None, "", None, ["w1"], []), ("6", "m", "r", "factual", False, False, [], 0.2, 4.0, None, None, "D", None, None, ["w1"]),
    ]
    frame = spark.createDataFrame(rows, schema)
    r = answers.metrics(frame).first().asDict()
    want = {"n": 6, "fully_grounded_rate": 0.3333, "sentence_support_rate": 0.5, "partial_rate": 0.25, "citation_precision": 0.5, "citation_coverage": 0.75, "correctness_correct": 0.5,
            "correctness_partial": 0.0, "unanswerable_n": 2, "abstained_on_unanswerable": 1, "answered_unanswerable": 1, "answerable_n": 4, "abstained_on_answerable": 1, "answered_answerable": 3,
            "abstention_recall": 0.5, "false_abstention_rate": 0.25, "abstention_f1": 0.5, "gate_abstentions": 1, "invalid_citations_total": 1, "unjudged": 1, "cost_per_answer": 0.1, "p50_latency_s": 2.5}
    assert {k: r[k] for k in want} == want and len(r) == 24
    assert {(x.id, x.category, x.evidence) for x in answers.failures(frame).collect()} == {
        ("1", "invalid_citation", "[9]"), ("2", "unsupported_sentence", "c"), ("2", "retrieval_miss", "w9"), ("2", "wrong_answer", "because"), ("4", "missed_abstention", "C"), ("5", "false_abstention", "model"), ("5", "retrieval_miss", "w1"),
    }


def test_parsing_and_chunks():
    page = D.parse_html("<h1>T</h1><nav>menu</nav><h2>Intro</h2><p>one two<p>three <b>four<br>five<script>'</p>'</script><h3>Deep</h3><table><tr><td>a</td><td>b</td></tr></table><section class='ltx_bibliography'><ul><li>r</li></ul></section>")
    assert page["title"] == "T" and [s["path"] for s in page["sections"]] == ["Intro", "Intro > Deep"] and page["references"] == 1
    assert page["sections"][0]["paragraphs"] == ["one two", "three four five"] and page["sections"][1]["tables"] == [{"caption": "", "rows": [["a", "b"]]}]
    assert D.parse_html(None)["sections"] == [] and D.parse_html("")["words"] == 0
    table = {"path": "R", "level": 1, "paragraphs": [], "captions": ["Figure 1: of the section"], "tables": [{"caption": "Table 1: x", "rows": [["h1", "h2"], *[[f"r{i}", str(i)] for i in range(300)]]}]}
    parts = [t for _, kind, t in D.chunks_of({"sections": [table]}) if kind == "table"]
    assert len(parts) > 1 and all(p.startswith("Table 1: x\nh1 | h2\n") for p in parts)
    assert [line for p in parts for line in p.split("\n")[2:]] == [f"r{i} | {i}" for i in range(300)]
    long = {"path": "L", "level": 1, "paragraphs": [" ".join(f"Sentence number {i} is here." for i in range(400))], "captions": [], "tables": []}
    texts = [t for *_, t in D.chunks_of({"sections": [long]})]
    assert len(texts) > 2 and all(D._count(t) <= D.LIMIT for t in texts)
    short = {"path": "S", "level": 1, "paragraphs": ["only five words are here"], "captions": [], "tables": []}
    assert len(D.chunks_of({"sections": [short, long | {"paragraphs": ["word " * 50]}]})) == 1
    assert max(map(D._count, D.halves("x," * 2000, 480))) <= 480


def test_tables_keep_their_own_captions():
    page = D.parse_html("<h2>R</h2><figure class='ltx_figure'><figcaption>Figure 1: f</figcaption></figure><figure class='ltx_table'><figcaption>Table 1: a</figcaption><table><tr><td>1</td></tr></table></figure>"
                        "<figure class='ltx_table'><table><tr><td>2</td></tr></table><figcaption>Table 2: b</figcaption></figure><table><caption>Table 3: c</caption><tr><td>3</td></tr></table><table><tr><td>4</td></tr></table>")  # fmt: skip
    section = page["sections"][0]
    assert section["captions"] == ["Figure 1: f"] and [(t["caption"], t["rows"]) for t in section["tables"]] == [("Table 1: a", [["1"]]), ("Table 2: b", [["2"]]), ("Table 3: c", [["3"]]), ("", [["4"]])]
    text = D.parse_markdown("# R\nTable 1: a\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\nFigure 2: f\n\n| z |\n")
    assert [t["caption"] for t in text["sections"][0]["tables"]] == ["Table 1: a", ""] and text["sections"][0]["captions"] == ["Figure 2: f"]


def test_parse_gate_counts_all_text(spark):
    long = {"title": "", "sections": [{"path": str(i), "level": 1, "paragraphs": ["x"], "tables": [{"caption": "c" * 900, "rows": [["y" * 900]]}], "captions": ["z" * 100]} for i in range(3)], "references": 0, "errors": 0, "words": 0}
    short = long | {"sections": long["sections"][:2]}
    frame = spark.createDataFrame([(long, short), (short, long), (short, short), (None, None)], f"first {D.PARSED}, second {D.PARSED}")
    got = [r[:] for r in frame.select(D.body_size(F.col("first")), D.better_parse(F.col("first"), F.col("second"))).collect()]
    assert got[0] == (3 * (1 + 900 + 900 + 100) + 11, "first") and got[1][1] == "second" and got[2][1] == "failed" and got[3][0] == 0


def test_page_reasons(spark):
    page = lambda body, title="T": f"<html><head><title>{title}</title></head><body>{body}</body></html>"
    main = lambda n, k: "<div class='ltx_page_main'>" + '<section class="ltx_section a">' * k + "word " * n + "<script>" + "no " * 3000 + "</script></div>"
    cases = [(page("", "No content available"), "no content"), (page("ar5iv-severity-fatal"), "fatal conversion error"), (page("<b class='x ltx_missing'>"), "missing element"), (page("<p class='ltx_page_mainx'>"), "no main part"),
             (page(main(1499, 3)), "too few words"), (page(main(1500, 1)), "too few sections"), (page(main(1500, 2)), ""), (None, "no main part")]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, html string")
    assert [r[0] for r in frame.orderBy("i").select(D.page_reason(F.col("html"))).collect()] == [c[1] for c in cases]


def test_budget_and_comparison(spark):
    frame = spark.createDataFrame([(["a b", "", "c d e", "f"],), (["a b c d e f"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in frame.select(D.budgeted(F.col("p"), 4)).collect()] == [["a b", "c d"], ["a b c d"], [], None]
    a, b = D.parse_markdown("# 1 Intro\nbyte pairs merge\n# Results\nmore words"), D.parse_markdown("# Intro\nbyte pairs\n# Resuls\nmore words\n# Other\nxx yy")
    assert D.heading_f1(a, b) == pytest.approx(0.8) and D.word_recall(a, b) == pytest.approx(4 / 5) and D.heading_f1(a, D.parse_markdown("")) == 0


class Pages:
    def get(self, url):
        return {"a1": (404, b""), "a2": (200, b"bad"), "a3": (200, b"%PDF"), "b1": None, "b2": (500, b""), "c1": (200, b"good")}[url]


def test_full_text_chain(spark):
    todo = spark.createDataFrame([("a", {"html": "a1", "ar5iv": "a2", "pdf": "a3"}), ("b", {"html": "b1", "ar5iv": "b2"}), ("c", {"html": "c1", "pdf": "never asked"}), ("d", {})], "key string, urls map<string,string>")
    tried = collection.attempts(todo, Pages, lambda step, content: "" if step == "pdf" or content == b"good" else "too short")
    rows = [(r.key, r.step, r.outcome) for r in tried.collect()]
    assert rows == [("a", "html", "http 404"), ("a", "ar5iv", "too short"), ("a", "pdf", "saved"), ("b", "html", "no response"), ("b", "ar5iv", "http 500"), ("c", "html", "saved")]
    assert {r[:] for r in collection.status_of(tried).collect()} == {("a", "pdf", "a3"), ("b", "", ""), ("c", "html", "c1")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"a": [1]}), (2, None)], "k int, v map<string,array<int>>")
    assert [collection.write_new(rows, str(tmp_path / "t"), "k") for _ in range(2)] == [2, 0] and spark.read.parquet(str(tmp_path / "t")).count() == 2
    collection.write_once(rows, str(tmp_path / "o"))
    with pytest.raises(Exception, match="exists"):
        collection.write_once(rows, str(tmp_path / "o"))
    with pytest.raises(ValueError, match="without"):
        collection.assert_complete(spark.createDataFrame([("r", "t", None)], "id string, title string, year int"), "id", ["title", "year"])
    collection.assert_complete(rows.limit(0), "k", ["k"])


def test_best_hits(spark):
    rows = spark.createDataFrame([("r", "Byte pair encoding for all", 2020), ("s", "Byte pair encoding for all", None), ("t", "Another one", 2019)], "record_id string, title string, year int")
    hit = "record_id string, pos int, hit_title string, hit_year int, published boolean, work string"
    hits = [("r", 1, "Byte Pair Encoding for All", 2021, False, "w1"), ("r", 2, "Byte pair-encoding, for all!", 2022, True, "w2"), ("r", 3, "Byte pair encoding for all", 2025, True, "late"), ("r", 4, "Byte pair", 2020, True, "subset"),
            ("s", 1, "Byte pair encoding for all", 2020, True, "w"), ("t", 1, None, 2019, None, "w3"), ("t", 2, "another  one", 2018, None, "w4")]
    assert {r[:] for r in collection.best_hits(rows, spark.createDataFrame(hits, hit)).collect()} == {("r", "w2"), ("t", "w4")}


def test_near_title_pairs_match_brute_force(spark):
    rng = random.Random(16)
    words = "byte pair coding of rare words with neural models in many languages".split()
    rows = [(f"r{i:03}", " ".join(rng.sample(words, rng.randint(1, 7))) + rng.choice(["", "", "s", "xy"]), rng.choice([None, 1, 2, 2003, 2004, 2006, 2009]), f"g{rng.randrange(60)}") for i in range(150)] + [("n", None, 2003, "g"), ("e", "--", 2003, "h")]
    want = set()
    for i, x in enumerate(rows[:150]):
        for y in rows[i + 1:150]:
            if x[3] != y[3] and abs((x[2] or 0) - (y[2] or 0)) <= 2 and fuzzy.token_set_ratio(fuzzy.norm_title(x[1]), fuzzy.norm_title(y[1])) >= 80:
                want.add((x[0], y[0]))
    frame = spark.createDataFrame(rows, "id string, title string, year int, group string")
    got = [(r.a, r.b) for r in identity.near_title_pairs(frame, Scratch(spark)).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    assert identity.near_title_pairs(frame.limit(0), Scratch(spark)).count() == 0


def test_near_title_bounds_leave_few_pairs():
    """Titles of one pattern have the same letters in another order: hardly any is scored, and none that is near is lost."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice(["s", "sh", "ch", "t", "r", "l", "m", "n"]) + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    for long in (8, 30):  # one and several machine words of ordered letters
        stock = [[word() for _ in range(20)] for _ in range(long)]
        made = [["for", "in", "of", *map(rng.choice, stock)] for _ in range(150)]
        made += [[w[1:] if rng.random() < 0.3 else w for w in t] for t in made[:50]]
        titles = [" ".join(sorted(set(t))) for t in made]
        x, y = identity._Titles(titles[:120]), identity._Titles(titles[80:])
        want = {(i, j) for i, p in enumerate(x.titles) for j, q in enumerate(y.titles) if fuzzy.token_set_ratio(p, q) >= 80}
        got = list(identity._near_titles(x, y, 80.0, False))
        assert len(want) >= 40 and want <= set(got) and len(got) == len(set(got)) < x.bounds(y, 80.0)[1].sum() / 4  # of what counted letters leave


def test_near_title_pairs_of_equal_titles(spark):
    """Copies of a title meet each other and all near titles, in reach of their years, whatever their group's value."""
    rows = [("a", "Byte pair coding", 2003, "g"), ("b", "byte pair coding!", 2003, None), ("c", "Byte pair coding", 2003, "g"), ("d", "coding byte pair", 2005, "h"), ("e", "Byte pair codings", 2006, "g"), ("f", "Byte pair coding", 2009, "x"), ("g", "b", 2005, "y")]
    frame = spark.createDataFrame(rows, "id string, title string, year int, group string")
    got = sorted((r.a, r.b) for r in identity.near_title_pairs(frame, Scratch(spark)).collect())
    assert got == [("a", "b"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("d", "e")]


def test_pair_features_and_flags(spark):
    records = spark.createDataFrame([("a", "Byte pairs", "A Lee; B Roy", 100), ("b", "Byte  pairs!", "C Lee", 50), ("c", None, None, 0)], "record_id string, title string, authors string, body_words int")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "record_id string, embedding array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "zz")], "a string, b string")
    got = {r.b: r[2:] for r in identity.pair_features(pairs, records, vectors).collect()}
    assert got["b"] == (100.0, 0.5, 0.6, 0.5) and got["c"] == (0.0, 0.0, None, None) and got["zz"] == (0.0, 0.0, None, None)
    rows = [("w", "h", "arxiv", "html", 1, "", ""), ("w", "v", "arxiv_v1", "none", 1, "", "kept"), ("w", "o", "acl", "none", 1, "", "lost")]
    flags = identity.canonical_flags(spark.createDataFrame(rows, "work_id string, record_id string, source string, status string, version int, reason string, duplicate_of string"))
    assert {r.record_id: r.duplicate_of for r in flags.collect()} == {"h": "", "v": "kept", "o": "h"}


def test_pooling_and_overlap(spark):
    gold = spark.createDataFrame([("q", 1), ("q", 2), ("p", 9)], "question_id string, doc_id int")
    pooled = spark.createDataFrame([("q", 1, None), ("q", 3, 2), ("q", 4, 1), ("p", 8, 3)], "question_id string, doc_id int, grade int")
    assert {r[:] for r in statistics.pooling(gold, pooled).collect()} == {("q", 2, 1, 1), ("p", 1, 0, 1)}
    asked = spark.createDataFrame([("what is a byte pair", "a byte pair"), ("tokens", "none of it")], "q string, g string")
    assert statistics.overlap_report(asked, T.lexical_overlap(F.col("q"), F.col("g"))).first()[:] == (0.5, 1, 2)


def test_feed_and_catalogue(spark):
    xml = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="urn:o"><o:totalResults>1234</o:totalResults>
    <entry><id>http://x/abs/2301.00001v2</id><title>A
      title</title><summary> text </summary><published>2023-01-02T00:00:00Z</published><author><name>A B</name></author><o:primary_category term="cs.CL"/><category term="cs.LG"/><category term="cs.CL"/></entry>
    <entry><id>http://x/abs/cs/0102003v1</id><title>B</title><summary>s</summary><published>2001-02-03T00:00:00Z</published><author><name>C</name></author><o:primary_category term="cs.CL"/><category term="cs.CL"/></entry></feed>"""
    got = files.feed_entries(spark.createDataFrame([(xml,)], "xml string")).orderBy("year").collect()
    assert [(r.arxiv_id, r.version, r.total) for r in got] == [("cs/0102003", 1, 1234), ("2301.00001", 2, 1234)]
    assert got[1].title == "A title" and got[1].categories == ["cs.CL", "cs.LG"] and got[1].year == 2023
    index = spark.sql("SELECT map('tokens', array(1, 4), 'Byte', array(0), 'are', array(2), 'not', array(3)) AS m, CAST(NULL AS map<string, array<int>>) AS n")
    assert index.select(D.from_inverted(F.col("m")), D.from_inverted(F.col("n"))).first()[:] == ("Byte tokens are not tokens", "")


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([("a", "d1", "1"), ("b", "d2", "2")], "id string, doi string, n string")
    new = spark.createDataFrame([("a", "", "9"), ("c", "d3", None)], "id string, doi string, n string")
    assert {r[:] for r in filters.upsert(old, new, "id", ["doi", "n"]).collect()} == {("a", "d1", "9"), ("b", "d2", "2"), ("c", "d3", None)}
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), (None, 1, "z"), ("k", 2, "y")], "key string, at int, v string")
    assert {r[:] for r in filters.latest_per_key(rows, ["key"], ["at"]).collect()} == {("k", 2, "y"), (None, 1, "z")}
    assert filters.latest_per_key(rows.limit(0), ["key"], ["at"]).count() == 0


def test_missing_files_and_models(spark, tmp_path):
    assert files.read_csv(spark, str(tmp_path / "none")).count() == 0
    todo = spark.createDataFrame([("1", "p"), ("2", "q"), ("3", None)], "key string, prompt string")

    class Echo:
        def ask(self, prompt):
            return "" if prompt == "q" else prompt.upper()

    got = models.ask_missing(todo, spark.createDataFrame([], "key string"), Echo, failed="unjudged").collect()
    assert sorted(r[:] for r in got) == [("1", "P"), ("2", "unjudged")]
    assert models.ask_missing(todo, todo.select("key"), Echo).count() == 0


def test_text_columns(spark):
    row = spark.createDataFrame([("2 Method > 2.1 Data Sets", "A; B  Lee ;c lee", "x [3] y [1, 3]", "  a  b ")], "h string, a string, c string, w string").select(
        T.heading(F.col("h")), T.surnames(F.col("a")), T.cited_numbers(F.col("c")), T.word_count(F.col("w"))
    ).first()
    assert row[:] == ("data sets", ["a", "lee"], [1, 3], 2)
