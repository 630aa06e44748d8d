"""Operators that ask a language model, behind a client that can be replayed.

A client is an object with ``ask(prompt) -> str``; it is made once in every task by a factory, so it
need not be serialisable.  Asked prompts are keyed by md5: what is answered already is not asked again.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.session import ship

# How an abstaining answer begins, and the mark left where a citation was removed.
ABSTAIN = "The corpus does not support an answer to this question."
REMOVED = "[citation removed]"


class Client(Protocol):
    def ask(self, prompt: str) -> str: ...


class Replay:
    """Answers from a dict of md5(prompt) to reply; an unknown prompt is an error."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def ask(self, prompt: str) -> str:
        return self.replies[hashlib.md5(prompt.encode()).hexdigest()]


class Refused(OSError):
    """A host that is busy; ``after`` are the seconds it names, if any."""

    def __init__(self, after: float | None = None):
        super().__init__("refused")
        self.after = after


class Patient:
    """A client that tries again where its host fails: after the time that the host names, else after 1, 2,
    4, ... seconds.  ``costs`` adds up what the replies cost, where the client tells."""

    def __init__(self, client: Client, tries: int = 6, sleep: Callable[[float], None] = time.sleep):
        self.client, self.tries, self.sleep, self.costs = client, tries, sleep, 0.0

    def ask(self, prompt: str) -> str:
        for i in range(self.tries):
            try:
                reply = self.client.ask(prompt)
                self.costs += getattr(self.client, "cost", 0.0)
                return reply
            except OSError as e:
                if i + 1 == self.tries:
                    raise
                after = getattr(e, "after", None)
                self.sleep(2.0**i if after is None else after)
        raise AssertionError("not reached")


def is_json(reply: str) -> bool:
    """Whether a reply is JSON, with or without a code fence around it."""
    bare = re.sub(r"\s*```$", "", re.sub(r"^```[a-z]*\s*", "", (reply or "").strip()))
    try:
        json.loads(bare)
    except ValueError:
        return False
    return True


def ask_missing(todo: DataFrame, done: DataFrame, client: Callable[[], Client], accept: Callable[[str], bool] = bool, tries: int = 2, failed: str = "") -> DataFrame:
    """todo: key, prompt; done: key -> key, reply for keys not done.  A reply that is not accepted is
    asked for again; after ``tries`` the row carries ``failed``, as it does where a patient client gives
    up.  NULL prompts are not asked.  Write the result before using it twice: it is asked anew otherwise."""
    ship(todo.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for batch in batches:
            out = []
            for key, prompt in zip(batch["key"], batch["prompt"]):
                reply = failed
                for _ in range(tries):
                    try:
                        said = model.ask(prompt)
                    except (OSError, KeyError):
                        continue
                    if accept(said):
                        reply = said
                        break
                out.append((key, reply))
            yield pd.DataFrame(out, columns=["key", "reply"])

    return todo.filter("prompt IS NOT NULL").join(done.select("key"), "key", "left_anti").select("key", "prompt").mapInPandas(run, "key string, reply string")


def contexts(ranked: DataFrame, k: int) -> DataFrame:
    """ranked: query_id, rank, label, text -> query_id, context: the numbered sources of a prompt."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("label"), F.lit("\n"), F.col("text"))
    top = ranked.filter(F.col("rank") <= k)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("context"))


def pool(lists: list[DataFrame], depth: int, judged: DataFrame) -> DataFrame:
    """query_id, doc_id of the union of the lists' top rows that are not judged yet."""
    every = lists[0].filter(F.col("rank") <= depth).select("query_id", "doc_id")
    for x in lists[1:]:
        every = every.union(x.filter(F.col("rank") <= depth).select("query_id", "doc_id"))
    return every.distinct().join(judged, ["query_id", "doc_id"], "left_anti")


def standalone(turns: DataFrame, rewrite: Column) -> DataFrame:
    """The query that is searched for: the first turn as it is, later ones rewritten."""
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    return turns.withColumn("query", F.when(first, F.col("text")).otherwise(F.coalesce(rewrite, F.col("text"))))
