"""Answers with citations: checking, judging, aligning with labels, composing; proposed questions.

Everything but asking a model is a column expression or a plan of joins and aggregations.  NULL texts
count as empty; an answer without sentences has no facts; shares with an empty denominator are NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions.fuzzy import fuzz_partial_ratio, fuzz_ratio
from litloom.operators import models
from litloom.operators.models import ABSTAIN, REMOVED

# The score of a quote that is found, and of a sentence that is the same.
FOUND, SAME = 90.0, 80.0
KEY = ["id", "model", "retriever"]
_NUMBERS = r"\[\d+(?:\s*,\s*\d+)*\]"
_CUT, _EDGE = "\x1e", "\x1f"


def body(answer: Column) -> Column:
    """Without the list of sources below it."""
    return F.split_part(answer, F.lit("\n\nSources:"), F.lit(1))


def citations(raw: Column, n: Column) -> Column:
    """struct<text, cited, invalid, uncited> of an answer with n sources.

    Marks behind the end of a sentence go before it.  Each sentence keeps its numbers from 1 to n; one
    that loses a number is marked with REMOVED before its final stops.  cited: the distinct numbers in
    order; invalid: all numbers that were removed, as they come; uncited: sentences of more than four
    words without a number that are no question and do not abstain.  White space stays as it is."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), rf"([.!?])((?:\s*{_NUMBERS})+)", "$2$1")
    pieces = F.split(F.regexp_replace(text, r"([.!?])(\s+)", f"$1{_CUT}$2{_CUT}"), _CUT)
    blank = lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) == ""
    numbers = lambda mark: F.transform(F.regexp_extract_all(mark, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("bigint"))
    good = lambda x: x.between(1, n)

    def mended(mark: Column) -> Column:
        kept = F.filter(numbers(mark), good)
        lead = F.regexp_extract(mark, r"^(\s*)", 1)
        return F.when(~mark.rlike(rf"^\s*{_NUMBERS}$"), mark).when(F.size(kept) == 0, "").otherwise(F.concat(lead, F.lit("["), F.array_join(kept.cast("array<string>"), ", "), F.lit("]")))

    def sentence(piece: Column) -> Column:
        parts = F.split(F.regexp_replace(piece, rf"(\s*{_NUMBERS})", f"{_EDGE}$1{_EDGE}"), _EDGE)
        marks = F.flatten(F.transform(F.filter(parts, lambda p: p.rlike(rf"^\s*{_NUMBERS}$")), numbers))
        bad = F.filter(marks, lambda x: ~good(x))
        whole = F.array_join(F.transform(parts, mended), "")
        stops = F.regexp_extract(whole, r"([.!?]*)$", 1)
        marked = F.concat(F.substring(whole, F.lit(1), F.length(whole) - F.length(stops)), F.lit(" " + REMOVED), stops)
        return F.struct(F.when(F.size(bad) > 0, marked).otherwise(whole).alias("text"), F.filter(marks, good).alias("good"), bad.alias("bad"))

    read = F.transform(pieces, lambda p: F.when(blank(p), F.struct(p.alias("text"), F.array().cast("array<bigint>").alias("good"), F.array().cast("array<bigint>").alias("bad"))).otherwise(sentence(p)))
    says = F.filter(F.transform(read, lambda r: F.regexp_replace(r["text"], r"^\s+|\s+$", "")), lambda s: s != "")
    bare = F.filter(says, lambda s: ~s.contains(ABSTAIN) & ~s.endswith("?") & (T.word_count(s) > 4) & ~s.rlike(r"\[\d"))
    return F.struct(
        F.array_join(F.transform(read, lambda r: r["text"]), "").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(read, lambda r: r["good"])))).cast("array<int>").alias("cited"),
        F.flatten(F.transform(read, lambda r: r["bad"])).cast("array<int>").alias("invalid"), bare.alias("uncited"),
    )


def sentence_sheet(answers: DataFrame) -> DataFrame:
    """answers: id, model, retriever, answer -> one row for each sentence: its number (from 1), its text, the
    marks in it, an empty verdict."""
    cut = F.filter(F.split(F.regexp_replace(F.trim(body(F.col("answer"))), r"([.!?])\s+", f"$1{_CUT}"), _CUT), lambda s: s != "")
    rows = answers.select(*KEY, F.posexplode(cut).alias("pos", "sentence"))
    return rows.select(*KEY, (F.col("pos") + 1).alias("sentence_no"), "sentence", F.array_join(F.regexp_extract_all("sentence", F.lit(r"\[\d+\]"), F.lit(0)), " ").alias("cited"), F.lit("").alias("human_verdict"))


def with_judgments(answers: DataFrame, judgments: DataFrame) -> DataFrame:
    """Every answer with its judgment, NULL where there is none."""
    return answers.join(judgments, KEY, "left")


def aligned(humans: DataFrame, judged: DataFrame) -> DataFrame:
    """humans: key, sentence_no, sentence, human; judged: key, pos (from 1), text, verdict -> key, sentence_no,
    human, verdict (NULL where no sentence fits).  By place where an answer has as many sentences on both
    sides, else with the most similar one of ratio SAME or more (ties: the first)."""
    n_human = humans.groupBy(*KEY).agg(F.count(F.lit(1)).alias("nh"))
    n_judge = judged.groupBy(*KEY).agg(F.count(F.lit(1)).alias("nj"))
    sized = humans.join(n_human, KEY).join(n_judge, KEY, "left").withColumn("even", F.col("nh") == F.coalesce("nj", F.lit(0)))
    by_place = sized.filter("even").join(judged.withColumnRenamed("pos", "sentence_no"), [*KEY, "sentence_no"], "left").select(*KEY, "sentence_no", "human", "verdict")
    # an answer has some tens of sentences: the pairs within one are few
    tried = sized.filter("NOT even").join(judged, KEY, "left").withColumn("score", F.coalesce(fuzz_ratio(F.col("sentence"), F.col("text")), F.lit(0.0)))
    best = tried.groupBy(*KEY, "sentence_no").agg(F.first("human").alias("human"), F.max_by(F.struct("score", "verdict"), F.struct(F.col("score"), -F.col("pos"))).alias("b"))
    return by_place.unionByName(best.select(*KEY, "sentence_no", "human", F.when(F.col("b.score") >= SAME, F.col("b.verdict")).alias("verdict")))


def labelled_pairs(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (human, verdict of the labelled sentences that were aligned; one row: unaligned)"""
    said = both.withColumn("human", F.lower(F.trim("human"))).filter(F.col("human").isNotNull() & ~F.col("human").isin("", "-"))
    return said.filter("verdict IS NOT NULL").select("human", "verdict"), said.agg(F.count_if(F.col("verdict").isNull()).alias("unaligned"))


def _median(c: Column) -> Column:
    return F.percentile(c, 0.5)


def metrics(judged: DataFrame) -> DataFrame:
    """judged: id, model, retriever, type, abstained, gate_abstained, invalid array, cost, latency, correctness,
    sentences array<struct<factual, verdict, cited array<int>, source>> (NULL: not judged) -> the 24 measures
    by model and retriever."""
    facts = F.filter(F.coalesce("sentences", F.array().cast(judged.schema["sentences"].dataType)), lambda s: s["factual"])
    spoken, seen, unanswerable = ~F.col("abstained"), F.col("sentences").isNotNull() & ~F.col("abstained"), F.col("type") == "unanswerable"
    of = lambda test: F.size(F.filter("facts", test))
    hit = F.aggregate("facts", F.lit(0), lambda a, s: a + F.when(s["verdict"] == "supported", F.size(F.filter(s["cited"], lambda m: m == s["source"]))).otherwise(0))
    rows = judged.withColumn("facts", F.when(seen, facts).otherwise(F.array().cast(judged.schema["sentences"].dataType))).select(
        "model", "retriever", "abstained", "gate_abstained", "cost", "latency", spoken.alias("spoken"), seen.alias("seen"), unanswerable.alias("un"),
        F.size("facts").alias("f"), of(lambda s: s["verdict"] == "supported").alias("good"), of(lambda s: s["verdict"] == "partial").alias("part"),
        of(lambda s: F.size(s["cited"]) > 0).alias("with"), F.aggregate("facts", F.lit(0), lambda a, s: a + F.size(s["cited"])).alias("marks"), hit.alias("hit"),
        F.when(seen & ~unanswerable, F.col("correctness")).alias("c"), F.size("invalid").alias("bad"),
    )
    div = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    n, count = F.count(F.lit(1)), F.count_if
    tp, fp = count(F.col("abstained") & F.col("un")), count(F.col("abstained") & ~F.col("un"))
    fn, tn, un = count(F.col("spoken") & F.col("un")), count(F.col("spoken") & ~F.col("un")), count(F.col("un"))
    return rows.groupBy("model", "retriever").agg(
        n.alias("n"), div(count((F.col("f") > 0) & (F.col("good") == F.col("f"))), n).alias("fully_grounded_rate"),
        div(F.sum("good"), F.sum("f")).alias("sentence_support_rate"), div(F.sum("part"), F.sum("f")).alias("partial_rate"),
        div(F.sum("hit"), F.sum("marks")).alias("citation_precision"), div(F.sum("with"), F.sum("f")).alias("citation_coverage"),
        div(count(F.col("c") == "correct"), F.count("c")).alias("correctness_correct"), div(count(F.col("c") == "partial"), F.count("c")).alias("correctness_partial"),
        un.alias("unanswerable_n"), tp.alias("abstained_on_unanswerable"), fn.alias("answered_unanswerable"),
        (n - un).alias("answerable_n"), fp.alias("abstained_on_answerable"), tn.alias("answered_answerable"),
        div(tp, un).alias("abstention_recall"), div(fp, n - un).alias("false_abstention_rate"), div(2 * tp, 2 * tp + fp + fn).alias("abstention_f1"),
        count("gate_abstained").alias("gate_abstentions"), F.sum("bad").alias("invalid_citations_total"), count(F.col("spoken") & ~F.col("seen")).alias("unjudged"),
        div(F.sum("cost"), n).alias("cost_per_answer"), F.round(_median(F.col("latency")), 4).alias("p50_latency_s"),
    )


def failures(judged: DataFrame) -> DataFrame:
    """judged: as for ``metrics``, with text in the sentences, answer, reasoning, gold and sources (arrays of
    works) -> id, model, retriever, category, evidence: one row for each failure of an answer."""
    one = lambda category, evidence: F.struct(F.lit(category).alias("category"), evidence.alias("evidence"))
    when = lambda test, category, evidence: F.when(F.coalesce(test, F.lit(False)), F.array(one(category, evidence))).otherwise(none)
    none = F.array().cast("array<struct<category:string,evidence:string>>")
    un, sentences = F.col("type") == "unanswerable", F.coalesce("sentences", F.array().cast(judged.schema["sentences"].dataType))
    found = F.concat(
        F.transform(F.filter(sentences, lambda s: s["factual"] & (s["verdict"] == "unsupported")), lambda s: one("unsupported_sentence", s["text"])),
        F.transform("invalid", lambda m: one("invalid_citation", F.concat(F.lit("["), m.cast("string"), F.lit("]")))),
        when(un & ~F.col("abstained"), "missed_abstention", F.substring(body(F.col("answer")), 1, 200)),
        when(~un & F.col("abstained"), "false_abstention", F.when(F.col("gate_abstained"), "score gate").otherwise("model")),
        when(~un & (F.size("gold") > 0) & ~F.arrays_overlap("gold", "sources"), "retrieval_miss", F.array_join(F.array_sort(F.array_distinct("gold")), " ")),
        when(F.col("correctness") == "wrong", "wrong_answer", F.col("reasoning")),
    )
    return judged.select(*KEY, F.explode(found).alias("f")).select(*KEY, "f.category", "f.evidence")


def verified(quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """quotes: doc, no, quote, section; sections: doc, path, text -> doc, no, quote, section, score: the named
    section where it holds the quote (FOUND or more), else the one that holds it best."""
    tried = quotes.withColumnRenamed("section", "named").join(sections, "doc").withColumn("s", fuzz_partial_ratio(F.col("quote"), F.col("text")))
    rank = F.struct((F.col("path") == F.col("named")) & (F.col("s") >= FOUND), F.col("s"), F.col("path"))
    best = tried.groupBy("doc", "no").agg(F.max_by(F.struct("quote", F.col("path").alias("section"), F.col("s").alias("score")), rank).alias("b"))
    return best.select("doc", "no", "b.*")


def kept_questions(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """checked: what ``verified`` gives -> (those whose quote is found; doc, dropped)"""
    return checked.filter(F.col("score") >= FOUND), checked.groupBy("doc").agg(F.count_if(F.col("score") < FOUND).alias("dropped"))


def themed(checked: DataFrame, least: int = 2) -> DataFrame:
    """checked: theme, work, score -> theme, works of those whose quotes are found in ``least`` works or more."""
    return checked.filter(F.col("score") >= FOUND).groupBy("theme").agg(F.count_distinct("work").alias("works")).filter(F.col("works") >= least)


def composed(replies: DataFrame, sources: DataFrame) -> DataFrame:
    """replies: id, raw, n (sources shown); sources: id, n, label -> id, text, cited, invalid, uncited, abstained:
    the checked answer with the list of the sources it cites."""
    said = replies.select("id", F.trim("raw").alias("raw"), citations(F.trim("raw"), F.col("n")).alias("c")).withColumn("abstained", F.ltrim("raw", F.lit(" \t\n\"'")).startswith(ABSTAIN))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("["), F.col("n"), F.lit("] "), F.col("label")).alias("line")))), lambda s: s["line"]), "\n")
    named = said.select("id", "abstained", F.explode("c.cited").alias("n")).filter("NOT abstained").join(sources, ["id", "n"]).groupBy("id").agg(lines.alias("lines"))
    return said.join(named, "id", "left").select(
        "id", F.concat("c.text", F.coalesce(F.concat(F.lit("\n\nSources:\n"), "lines"), F.lit(""))).alias("text"), "c.cited", "c.invalid", "c.uncited", "abstained"
    )


def judged(answers: DataFrame, done: DataFrame, client: Callable[[], models.Client], schema: str) -> DataFrame:
    """answers: key (id, model, retriever in one string), prompt, abstained; done: key, unjudged -> key,
    judgment, unjudged of those without a judgment.  Abstentions are not sent; a reply that is no JSON of the
    schema is asked for once more and then recorded as unjudged, to be asked again by the next run."""
    todo = answers.join(done.filter("NOT unjudged").select("key"), "key", "left_anti")
    asked = models.ask_missing(todo.filter("NOT abstained").select("key", "prompt"), done.filter("NOT unjudged").select("key"), client, models.is_json, tries=2, failed="")
    parsed = asked.select("key", T.parse_lenient(F.col("reply"), schema).alias("judgment"))
    silent = todo.filter("abstained").select("key", F.lit(None).cast(parsed.schema["judgment"].dataType).alias("judgment"), F.lit(False).alias("unjudged"))
    return parsed.select("key", "judgment", F.col("judgment").isNull().alias("unjudged")).unionByName(silent)


def run_set(questions: DataFrame, recorded: DataFrame, split: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """questions: id, split, parent_id, text; recorded: id, answer -> id, answer of the questions of the split
    that have none yet.

    Two waves: first what is asked by itself, and the parents that the follow-ups need though they are of
    another split (these are answered and not recorded); then the follow-ups with their parent's question
    and answer as history.  ``answer``: id, text, history -> id, answer."""
    wanted = questions.filter(F.lit(split == "all") | (F.col("split") == split)).join(recorded.select("id"), "id", "left_anti")
    follow = wanted.filter("parent_id IS NOT NULL")
    needed = follow.select(F.col("parent_id").alias("id")).distinct().join(recorded.select("id"), "id", "left_anti")
    first = questions.join(needed.unionByName(wanted.filter("parent_id IS NULL").select("id")).distinct(), "id", "left_semi")
    one = answer(first.select("id", "text", F.lit(None).cast("string").alias("history")))
    known = questions.select("id", "text").join(one.unionByName(recorded.select("id", "answer")), "id")
    parent = known.select(F.col("id").alias("parent_id"), F.concat(F.lit("user: "), "text", F.lit("\nassistant: "), "answer").alias("history"))
    two = answer(follow.join(parent, "parent_id").select("id", "text", "history"))
    return one.join(wanted.select("id"), "id", "left_semi").unionByName(two)
