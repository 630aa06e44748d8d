"""Problem 8: garbled text from wrong character encoding, by expectation-maximisation.

A *unit* is a run of characters beyond ASCII with its two neighbours.  Its latent variable is the
chain of encodings it went through: none, or one of ``encodings.restorations``.  Its likelihood under
a chain is that of the restored run as sound text: a model of neighbouring characters, counted over
the whole collection, and the shapes of letters and marks side by side.

One pass over all texts counts the units of every source and field.  All units that any chain can
have made go through EM; the rest make up the first model of sound text:

* E: the posterior of every chain for every distinct unit of every source and field;
* M: the chain shares of every source and field (smoothed by those of all sources, which pools weak
  evidence across records), and the character counts, which the restored readings join with their
  posteriors.

Rounds go on until the pooled shares move by less than ``TOLERANCE``.  A second pass weighs every
record.  In a garbled record each unit is garbled by the record's chain with a probability, one of
``RATES``, because records can be garbled in places; so sound units speak against a chain, weak
evidence adds up, and strong evidence in one place is enough.  Runs whose shapes a chain does not
improve (one sound letter for another) are judged by all their places in the record together, and one
such run alone is no evidence: it cannot be told from an unusual letter; where there is no other
evidence, the odds are divided by the number of letter tables that are tried.  The prior odds of the record
follow from its source's share of the chain.  A record is garbled where the posterior odds of some chain
exceed even.  Its text is repaired run by run: each run takes the reading with the highest posterior,
given the posteriors of the record's chains; none is a reading too.

The model of characters is a table of fixed size (hashed), so what is sent to the tasks has a bound.
Only counts of distinct units and the evidence of suspicious records are shuffled, never texts.

Characters between backticks are shown as examples and are no text.  Numeric character references are
read as the characters they stand for.  Replacement characters prove a wrong decoding that cannot be
restored.

Defined results: NULL, empty and ASCII texts are sound; repeated doc_ids are judged together; a NULL
source is a source of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.encodings import LOST, QUOTED, REFERENCE, RUN, TABLES, restorations, structure
from litloom.llm.mixture import source_key
from litloom.session import Scratch, spread

PAIRS, SINGLES = 1 << 18, 1 << 16
NONE, UNRESTORABLE = "none", "lost"
#: Prior share of garbled units, weight of the shapes, most log odds of one unit that count, claims of
#: the pooled shares for each source, probabilities of a unit of a garbled record to be garbled.
PRIOR, SHAPES, MOST, POOLED, RATES = 0.05, 0.6, 15.0, 20.0, (0.01, 0.1, 0.5, 0.95)
#: Movement of the pooled shares that ends the rounds, least gain in shape of a reading and of one that
#: speaks for a chain by itself, units whose odds a task remembers, garblings
#: of one text.
TOLERANCE, WORST, GAIN, REMEMBERED, DEPTH = 1e-3, -1.0, 0.5, 100_000, 5
FLOOR = -12.0


def _plain(ch: str) -> str:
    return "0" if ch.isdigit() and ch < "\x80" else " " if ch.isspace() and ch < "\x80" else ch


def _read(text: str) -> str:
    """The text that is judged: references as characters, shown examples blanked."""
    if "&#" in text:
        text = REFERENCE.sub(_character, text)
    if "`" in text:
        text = QUOTED.sub(lambda m: "`" + " " * (len(m[0]) - 2) + "`", text)
    return text


def _character(m) -> str:
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 0x80 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def units_of(text: str) -> Counter:
    """left + run + right of every run; blanks and digits beside it as one of a kind."""
    if text.isascii() and "&#" not in text:
        return Counter()
    text = _read(text)
    padded = f" {text} "
    return Counter(_plain(padded[a]) + padded[a + 1:b + 1] + _plain(padded[b + 1]) for a, b in (m.span() for m in RUN.finditer(text)))


def readings(unit: str) -> list[tuple[str, str, float]]:
    """(chain, restored run, gain in shape) of all chains that can have made the unit.  What is sound as it
    stands can be read as rubbish in many ways; a reading whose shapes are worse is not sound text."""
    left, run, right = unit[0], unit[1:-1], unit[-1]
    own = structure(left, run, right)
    each = [(chain, text, structure(left, text, right) - own) for chain, text in restorations(run, right == " ")]
    return [reading for reading in each if reading[2] > WORST]


def buckets(unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the table of the transitions of a unit: pairs, first characters, second characters."""
    codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first, second = codes[:-1], codes[1:]
    return (first * 8191 + second * 131) % PAIRS, PAIRS + first % SINGLES, PAIRS + SINGLES + second % SINGLES


class Model:
    """Log-likelihood of units as sound text."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.total = float(counts[PAIRS + SINGLES:].sum())
        self.known: dict[str, float] = {}

    def likelihood(self, unit: str) -> float:
        if unit not in self.known:
            if len(self.known) > 20 * REMEMBERED:
                self.known.clear()
            pair, first, second = buckets(unit)
            single = (self.counts[second] + 0.05) / (self.total + 0.05 * SINGLES)
            # a pair is no more frequent than its characters: without this, pairs that share a place lend
            # their counts to characters that never occur
            both = np.minimum(self.counts[pair], np.minimum(self.counts[first], self.counts[second]))
            each = np.log((both + single) / (self.counts[first] + 1.0))
            self.known[unit] = float(np.maximum(each, FLOOR).sum())
        return self.known[unit]

    def odds(self, unit: str) -> list[tuple[str, str, float, bool]]:
        """(chain, restored run, log odds of the chain against none, without the shares, whether the shapes
        speak for it)"""
        own = self.likelihood(unit)
        return [(chain, text, self.likelihood(unit[0] + text + unit[-1]) - own + SHAPES * gain, gain > GAIN) for chain, text, gain in readings(unit)]


def _share(shares: dict, chain: str) -> float:
    return math.log(max(shares.get(chain, 0.0), PRIOR / 50) / max(shares.get(NONE, 1 - PRIOR), 1e-9))


def fielded(documents: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, source, field, text: one row for each filled field of a record."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f")
    return documents.select(F.col("doc_id").cast("bigint"), source_key(F.col("source")).alias("source"), each).select("doc_id", "source", "f.field", "f.text").filter(F.length("text") > 0)


_SCAN = "what int, source string, field string, unit string, place int, n double"


def scan(texts: DataFrame) -> DataFrame:
    """what 0: units that some chain can have made, by source and field; 1: character counts of the
    rest; 2: numbers of the rest by source and field."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, verdict = [c.split()[0] for c in _SCAN.split(", ")], {}
        for batch in batches:
            mine, sound, totals = Counter(), Counter(), Counter()
            for source, field, text in zip(batch["source"], batch["field"], batch["text"]):
                for unit, n in units_of(text).items():
                    bad = verdict.get(unit)
                    if bad is None:
                        if len(verdict) > REMEMBERED:
                            verdict.clear()
                        bad = verdict[unit] = LOST in unit or bool(readings(unit))
                    if bad:
                        mine[source, field, unit] += n
                    else:
                        sound[unit] += n
                        totals[source, field] += n
            rows = [(0, *key, None, float(n)) for key, n in mine.items()]
            rows += [(2, *key, None, None, float(n)) for key, n in totals.items()]
            rows += [(1, None, None, None, place, n) for place, n in _counted(sound)]
            yield pd.DataFrame(rows, columns=names).astype({"place": "Int32"})

    return texts.select("source", "field", "text").mapInPandas(run, _SCAN)


def _counted(units) -> list[tuple[int, float]]:
    """(place, weight) of the transitions of weighted units."""
    if not units:
        return []
    counts = np.zeros(PAIRS + 2 * SINGLES)
    for unit, weight in units.items():
        for places in buckets(unit):
            np.add.at(counts, places, weight)
    there = np.flatnonzero(counts)
    return list(zip(there.tolist(), counts[there].tolist()))


def _table(rows: DataFrame) -> np.ndarray:
    """Counts by place; no more rows than the table has places reach the driver."""
    counts = np.zeros(PAIRS + 2 * SINGLES, np.float32)
    got = rows.groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts[got["place"].to_numpy(int)] = got["n"].to_numpy(np.float32)
    return counts


def _pool(counted: DataFrame) -> dict[str, float]:
    """The shares of the chains over all sources."""
    pooled = counted.groupBy("chain").agg(F.sum("n").alias("n"))
    everything = pooled.agg(F.map_from_entries(F.collect_list(F.struct("chain", "n"))).alias("m")).first()["m"] or {}
    total = sum(everything.values()) or 1.0
    base = {c: (1 - PRIOR) * n / total + PRIOR / 50 for c, n in everything.items()}
    return base | {NONE: max(base.get(NONE, 0.0), 0.5)}


def _shares(counted: DataFrame, pool: dict[str, float]) -> DataFrame:
    """counted: source, field, chain, n -> source, field, shares: map of chain to share, smoothed by all
    sources."""
    own = counted.groupBy("source", "field").agg(F.map_from_entries(F.collect_list(F.struct("chain", "n"))).alias("m"), F.sum("n").alias("all"))
    base = F.create_map(*[x for c, v in pool.items() for x in (F.lit(c), F.lit(float(v)))])
    mixed = F.transform_values(base, lambda c, v: (F.coalesce(F.element_at("m", c), F.lit(0.0)) + POOLED * v) / (F.col("all") + POOLED))
    return own.select("source", "field", mixed.alias("shares"))


_STEP = "what int, source string, field string, chain string, place int, n double"


def _expect(units: DataFrame, shares: DataFrame, counts: np.ndarray | None) -> DataFrame:
    """The E step over distinct units: what 1: character counts, 2: chains by source and field.  Without
    counts, the shapes alone decide, against odds of e**3 for sound text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(counts) if counts is not None else None
        for batch in batches:
            weights, chains = Counter(), Counter()
            for source, field, unit, n, held in zip(batch["source"], batch["field"], batch["unit"], batch["n"], batch["shares"]):
                post = posterior(model, unit, held or {}) if model else first_guess(unit)
                for chain, (text, p) in post.items():
                    chains[source, field, chain] += n * p
                    if text is not None and p > 0.01:
                        weights[unit[0] + text + unit[-1]] += n * p
            rows = [(2, *key, None, n) for key, n in chains.items()]
            rows += [(1, None, None, None, place, n) for place, n in _counted(weights)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _STEP.split(", ")]).astype({"place": "Int32"})

    return units.join(shares, ["source", "field"], "left").mapInPandas(run, _STEP)


def first_guess(unit: str) -> dict[str, tuple[str | None, float]]:
    if LOST in unit:
        return {UNRESTORABLE: (None, 1.0)}
    chain, text, gain = max(readings(unit), key=lambda r: r[2])
    sound = 1 / (1 + math.exp(min(50.0, SHAPES * gain - 3)))
    # a frequent sound unit must not lend a share of its counts to characters that occur nowhere else
    return {NONE: (unit[1:-1], sound), chain: (text, 1 - sound)} if sound < 0.5 else {NONE: (unit[1:-1], 1.0)}


def posterior(model: Model, unit: str, shares: dict) -> dict[str, tuple[str | None, float]]:
    """chain -> (restored run or None, probability)"""
    if LOST in unit:
        return {UNRESTORABLE: (None, 1.0)}
    odds = {chain: (text, min(MOST * 2, odd) + _share(shares, chain)) for chain, text, odd, _ in model.odds(unit)}
    top = max([0.0, *(o for _, o in odds.values())])
    weight = {chain: math.exp(o - top) for chain, (_, o) in odds.items()}
    none = math.exp(-top)
    total = none + sum(weight.values())
    return {NONE: (unit[1:-1], none / total)} | {c: (odds[c][0], w / total) for c, w in weight.items()}


def fit(texts: DataFrame, scratch: Scratch, rounds: int = 20, tolerance: float = TOLERANCE) -> tuple[DataFrame, np.ndarray]:
    """-> (shares: source, field, map of chain to share; the model of sound text).  ``rounds`` is a guard:
    the test tables settle in five to eight."""
    scanned = scratch.keep(scan(texts))
    units = scratch.keep(spread(scanned.filter("what = 0").groupBy("source", "field", "unit").agg(F.sum("n").alias("n")), "unit"))
    sound_places = _table(scanned.filter("what = 1").select("place", "n"))
    sound = scratch.keep(scanned.filter("what = 2").groupBy("source", "field").agg(F.sum("n").alias("n")).select("source", "field", F.lit(NONE).alias("chain"), "n"))
    pool = _pool(sound)
    counts, shares = None, scratch.keep(_shares(sound, pool))
    for _ in range(rounds):
        step = scratch.keep(_expect(units, shares, counts))
        settled = counts is not None
        counts = sound_places + _table(step.filter("what = 1").select("place", "n"))
        counted = step.filter("what = 2").select("source", "field", "chain", "n").unionByName(sound)
        before, pool = pool, _pool(counted)
        scratch.drop(shares)
        shares = scratch.keep(_shares(counted.groupBy("source", "field", "chain").agg(F.sum("n").alias("n")), pool))
        scratch.drop(step)
        if settled and sum(abs(pool.get(c, 0.0) - before.get(c, 0.0)) for c in {*pool, *before}) < tolerance:
            break
    for table in (scanned, units):
        scratch.drop(table)
    return shares, counts


def record_odds(units: list[tuple[str, dict[str, tuple[float, bool]]]]) -> dict[str, list[float]]:
    """units: of each distinct unit of a record, its run and the chains with (log odds, whether the shapes
    gain) -> chain: the log odds of the record at each of RATES, without the prior."""
    out = {}
    for chain in dict.fromkeys(c for _, odds in units for c, (odd, _) in odds.items() if odd > 0):
        shaped, plain = [], Counter()
        for run, odds in units:
            if chain in odds:
                odd, gains = odds[chain]
                if gains:
                    shaped.append(odd)
                else:
                    plain[run] += odd
        if max(shaped, default=0.0) > 0 or sum(o > 0 for o in plain.values()) > 1:
            each = [*shaped, *(min(MOST, o) for o in plain.values())]
            tried = 0.0 if max(shaped, default=0.0) > 0 else math.log(TABLES)
            out[chain] = [len(units) * math.log1p(-r) - tried + sum(math.log1p(r / (1 - r) * math.exp(o)) for o in each) for r in RATES]
    return out


def judge(documents: DataFrame, scratch: Scratch, fields: tuple[str, ...] = ("text",)) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """-> (records: doc_id, field, source, chain, log_odds, chains (log odds of all chains in question),
    units, lost of the garbled records; shares by source and field; the model of sound text)"""
    texts = fielded(documents, fields)
    shares, counts = fit(texts, scratch)
    rates = [f"r{k}" for k in range(len(RATES))]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = Model(counts), {}
        for batch in batches:
            rows = []
            for doc, source, field, text in zip(batch["doc_id"], batch["source"], batch["field"], batch["text"]):
                units, open_ = [], False
                for unit in units_of(text):
                    if LOST in unit:
                        rows.append((doc, source, field, UNRESTORABLE, 1, *[MOST] * len(RATES)))
                        continue
                    odds = known.get(unit)
                    if odds is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        each = {chain: (min(MOST, odd), gains) for chain, _, odd, gains in model.odds(unit)}
                        odds = known[unit] = each, any(odd > 0 for odd, _ in each.values())
                    units.append((unit[1:-1], odds[0]))
                    open_ |= odds[1]
                if open_:
                    # a prior of even odds is the most that counts
                    rows += [(doc, source, field, chain, len(units), *at) for chain, at in record_odds(units).items() if any(x > math.log(r) for x, r in zip(at, RATES))]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "field", "chain", "units", *rates])

    evidence = texts.mapInPandas(weigh, "doc_id bigint, source string, field string, chain string, units bigint, " + ", ".join(f"{r} double" for r in rates))
    share = lambda chain: F.greatest(F.coalesce(F.element_at("shares", chain), F.lit(0.0)), F.lit(PRIOR / 50))
    # a record's prior odds: the share of its source's units, over the rate at which a garbled record has them
    prior = lambda r: F.log(F.least(F.lit(0.5), share(F.col("chain")) / r)) - F.log(F.greatest(F.lit(0.5), share(F.lit(NONE))))
    odds = F.greatest(*[F.col(name) + prior(r) for name, r in zip(rates, RATES)])
    weighed = (
        evidence.groupBy("doc_id", "field", "chain").agg(F.min("source").alias("source"), F.sum("units").alias("units"), *[F.sum(r).alias(r) for r in rates])
        .join(shares, ["source", "field"], "left")
        .withColumn("log_odds", F.when(F.col("chain") == UNRESTORABLE, F.lit(MOST)).otherwise(odds))
    )
    records = (
        weighed.groupBy("doc_id", "field")
        .agg(F.max(F.struct("log_odds", "chain")).alias("top"), F.max("units").alias("units"), F.min("source").alias("source"),
             F.max(F.when((F.col("chain") != UNRESTORABLE) & (F.col("log_odds") > 0), F.struct("log_odds", "chain"))).alias("mend"),
             F.map_from_entries(F.collect_list(F.struct("chain", "log_odds"))).alias("chains"))
        .filter("top.log_odds > 0")
        .select("doc_id", "field", "source", F.coalesce("mend.chain", "top.chain").alias("chain"), F.round("top.log_odds", 3).alias("log_odds"), "chains", "units",
                (F.col("top.chain") == UNRESTORABLE).alias("lost"))
    )
    return scratch.keep(records), shares, counts


def restore(text: str, chains: dict[str, float], model: Model) -> str:
    """Every run in the reading with the highest posterior.  ``chains``: the log odds of the record's
    chains; a run of a record that went through a chain did so with even odds, any other with PRIOR."""
    if "&#" in text:
        text = REFERENCE.sub(_character, text)
    shown = [m.span() for m in QUOTED.finditer(text)] if "`" in text else []
    top = max([0.0, *chains.values()])
    total = math.exp(-top) + sum(math.exp(o - top) for o in chains.values())
    shares = {c: 0.5 * math.exp(o - top) / total + PRIOR / 50 for c, o in chains.items()} | {NONE: 0.5}
    padded = f" {text} "
    out, last = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        if LOST in m[0] and len(m[0]) == 1 or any(x <= a < y for x, y in shown):
            continue
        unit = _plain(padded[a]) + m[0] + _plain(padded[b + 1])
        best = max(((odd + _share(shares, chain), fixed) for chain, fixed, odd, _ in model.odds(unit)), default=(0.0, ""))
        if best[0] > 0:
            out += [text[last:a], best[1]]
            last = b
    return "".join([*out, text[last:]])


def restored(documents: DataFrame, scratch: Scratch, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, field, chain, log_odds, restorable, restored_text: the garbled records and their repair."""
    records, _, counts = judge(documents, scratch, fields)
    schema = "doc_id bigint, field string, chain string, log_odds double, restorable boolean, restored_text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(counts)
        for batch in batches:
            texts = []
            for text, chains in zip(batch["text"], batch["chains"]):
                for _ in range(DEPTH):  # what went through several chains comes back step by step
                    before, text = text, restore(text, dict(chains), model)
                    if text == before:
                        break
                texts.append(text)
            ok = [LOST not in t and t != o for t, o in zip(texts, batch["text"])]
            yield batch[["doc_id", "field", "chain", "log_odds"]].assign(restorable=ok, restored_text=texts)

    return fielded(documents, fields).drop("source").join(records.select("doc_id", "field", "chain", "log_odds", "chains"), ["doc_id", "field"]).mapInPandas(run, schema)
