"""Problem 6: evaluation texts leaking into training text.

Words are longest runs of letters and digits in lower case.  An item is cut into windows at every
position, once of ``PASSAGE`` words (or all its words, if it has fewer) and once of its own size, read
down to a ladder of sizes that grow by ``STEP``, so that there are few sizes however long items are.
Documents are read in windows of the same sizes.  A window's fingerprint is the SimHash of its words:
64 sums of +-1 over the words' hash bits, reduced to their signs.

Fingerprints within Hamming distance ``RADIUS`` = 7 are found by a multi-index: of the four 16-bit
blocks of two such fingerprints at least one differs in no more than one bit.  The items' blocks are
stored with all 17 values that are that near, so an equality join on (size, block, value) misses
none.  Each pair found is verified by the exact similarity of the two windows' word shingles (five
words, or all of a shorter window), weighted by their letters.  Equal windows have equal
fingerprints, so every verbatim passage is found.

Windows that cannot reach the similarity are not fingerprinted: a weighted Jaccard of s needs at
least the share s of the window's own shingle weight among the items' shingles of that size.  These
are kept as a table of bits of at most ``MOST_BITS`` (more shingles only make it less selective, never
wrong), which is all that is sent to the tasks.  Items stay a table however many there are; documents
are read once and never shuffled, only their few windows that pass are, each distinct one once.

Defined results: NULL, empty and wordless texts match nothing; a NULL item_id is left out; repeated
item texts match under every item_id; repeated documents are reported under their doc_id once, with
their windows added up; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from litloom.session import Scratch, ship

WORDS = re.compile(r"[^\W_]+")
PASSAGE, STEP, LONGEST, SHINGLE, SIMILARITY, RADIUS, BITS = 12, 1.2, 1 << 14, 5, 0.8, 7, 64
BLOCKS, BLOCK_BITS = 4, 16
#: Words whose sums are held at once, distinct words a task remembers, bits of the table of shingles.
STRETCH, REMEMBERED, FEWEST_BITS, MOST_BITS, CHUNK, ANY = 1 << 15, 400_000, 1 << 18, 1 << 28, 1 << 15, 1 << 20


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def item_size(n: int) -> int:
    """The greatest size of the ladder up to n; n itself up to PASSAGE."""
    size = n
    if n > PASSAGE:
        size, larger = PASSAGE, PASSAGE
        while larger <= min(n, LONGEST):
            size, larger = larger, int(larger * STEP) + 1
    return size


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words that begin at each word."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(31) + hashes[k:k + count])
    return out


def _places(shingles: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each shingle; ``bits`` is a power of two up to 1 << 32."""
    mixed = _mixed(shingles + np.uint64(size))
    return (mixed & np.uint64(bits - 1)).astype(np.int64), (mixed >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def prints_of(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words that begin at the places ``at`` (ascending)."""
    out = np.empty(len(at), np.uint64)
    parts = np.flatnonzero(np.diff(at // STRETCH)) + 1
    for where in np.split(np.arange(len(at)), parts):
        if not len(where):
            continue
        begin = at[where[0]]
        here = hashes[begin:at[where[-1]] + size]
        signs = 2 * np.unpackbits(here.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8) - 1
        sums = np.zeros((len(here) + 1, BITS), np.int32)
        np.cumsum(signs, axis=0, dtype=np.int32, out=sums[1:])
        first = at[where] - begin
        out[where] = np.packbits(sums[first + size] - sums[first] >= 0, axis=1).view(np.uint64).ravel()
    return out


_WINDOW = "size int, print bigint, window bigint, words string"


def _rows(key: int, words: list[str], hashes: np.ndarray, at: np.ndarray, size: int) -> dict[tuple, int]:
    """Distinct windows of one text, with their numbers."""
    held: dict[tuple, int] = {}
    for place, mark in zip(at.tolist(), prints_of(hashes, at, size).view(np.int64).tolist()):
        text = " ".join(words[place:place + size])
        row = (key, size, mark, xxhash.xxh64_intdigest(text) - (1 << 63), text)
        held[row] = held.get(row, 0) + 1
    return held


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, size, print, window, words, passage (of PASSAGE words or the whole item), whole (of the
    item's own size)."""
    schema = f"item_id bigint, {_WINDOW}, passage boolean, whole boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"], batch["text"]):
                words = words_of(text)
                if words:
                    hashes, n, own = known.of(words), min(PASSAGE, len(words)), item_size(len(words))
                    for size in {n, own}:
                        out += [(*row, size == n, size == own) for row in _rows(item, words, hashes, np.arange(len(words) - size + 1), size)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text").mapInPandas(run, schema)


def _table_of_bits(windows: DataFrame, bits: int) -> np.ndarray:
    """The shingles of the items' windows, by size and of any size, as a table of bits; no more than that
    reaches the driver."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            held = [np.empty(0, np.int64)]
            for size, text in zip(batch["size"], batch["words"]):
                n = min(SHINGLE, size)
                own = _shingles(known.of(text.split(" ")), n)
                held += [*_places(own, size, bits), *_places(own, ANY + n, bits)]
            there = np.unique(np.concatenate(held))
            yield pd.DataFrame({"chunk": there // CHUNK, "place": there % CHUNK})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(CHUNK, np.uint8)
        held[rows["place"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "bits": [np.packbits(held).tobytes()]})

    packed = windows.select("size", "words").mapInPandas(places, "chunk bigint, place bigint").distinct().groupBy("chunk").applyInPandas(pack, "chunk bigint, bits binary")
    table = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for row in packed.collect():  # at most bits / CHUNK rows
        table[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def _held(table: np.ndarray, shingles: np.ndarray, size: int) -> np.ndarray:
    """1 where a shingle is in the table."""
    a, b = (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) for at in _places(shingles, size, len(table) * 8))
    return a & b & 1


def _open_windows(hashes: np.ndarray, weights: np.ndarray, shingles: dict[int, np.ndarray], size: int, table: np.ndarray) -> np.ndarray:
    """Where the windows of one text begin that share the weight a similar window must share."""
    n = min(SHINGLE, size)
    if len(hashes) < size:
        return np.empty(0, np.int64)
    own = shingles.setdefault(n, _shingles(hashes, n))
    there = _held(table, own, size)
    if not there.any():
        return np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(weights)])
    letters = ends[n:] - ends[:-n]
    all_, hit = (np.concatenate([[0], np.cumsum(x)]) for x in (letters, letters * there))
    span = size - n + 1
    return np.flatnonzero(hit[span:] - hit[:-span] >= SIMILARITY * (all_[span:] - all_[:-span]) - 1e-9)


def document_windows(documents: DataFrame, sizes: list[int], table: np.ndarray) -> DataFrame:
    """doc_id, size, print, window, words, n: the windows that can be similar to one of an item."""
    schema = f"doc_id bigint, {_WINDOW}, n int"
    sent = documents.sparkSession.sparkContext.broadcast(table)

    lengths = sorted({min(SHINGLE, size) for size in sizes})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits = _Hashes(), sent.value

        def opened(docs: list[int], texts: list[list[str]]) -> Iterator[tuple]:
            """First whether a text holds any shingle of an item at all: most do not."""
            flat = known.of([w for words in texts for w in words])
            ends = np.cumsum([len(words) for words in texts])
            hit = [np.flatnonzero(_held(bits, _shingles(flat, n), ANY + n)) for n in lengths]
            for k in np.unique(np.searchsorted(ends, np.concatenate([*hit, np.empty(0, np.int64)]), side="right")):
                words, hashes = texts[k], flat[ends[k] - len(texts[k]):ends[k]]
                weights = np.fromiter(map(len, words), np.int64, len(words))
                shingles: dict[int, np.ndarray] = {}
                for size in sizes:
                    at = _open_windows(hashes, weights, shingles, size, bits)
                    if len(at):
                        yield from ((*row, n) for row, n in _rows(docs[k], words, hashes, at, size).items())

        for batch in batches:
            out, docs, texts, size = [], [], [], 0
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                docs.append(doc)
                texts.append(words)
                size += len(words)
                if size >= STRETCH:
                    out += opened(docs, texts)
                    docs, texts, size = [], [], 0
            if texts:
                out += opened(docs, texts)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return documents.filter(F.length("text") > 0).select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, schema)


def shingle_similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Weighted Jaccard of the windows' shingles; a shingle weighs its letters."""

    def shingles(words):
        n = min(SHINGLE, len(words))
        held: dict[tuple[str, ...], int] = {}
        for i in range(len(words) - n + 1):
            key = words[i:i + n]
            held[key] = held.get(key, 0) + sum(map(len, key))
        return held

    x, y = shingles(a), shingles(b)
    both = sum(min(w, y[k]) for k, w in x.items() if k in y)
    return both / (sum(x.values()) + sum(y.values()) - both)


def _block(mark: Column, k: int) -> Column:
    return F.shiftrightunsigned(mark, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def near_prints(asked: DataFrame, held: DataFrame) -> DataFrame:
    """asked, held: size, print and further columns, distinct -> all pairs of equal size whose prints
    differ in at most RADIUS bits, with the columns of ``held`` under held_...  Every pair once: from the
    first of its blocks that differ in at most one bit."""
    near = F.array(*[F.lit(m) for m in (0, *(1 << i for i in range(BLOCK_BITS)))])
    left = asked.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("value")) for k in range(BLOCKS)])).alias("key"))
    right = held.select(*[F.col(c).alias(f"held_{c}") for c in held.columns])

    def values(k: int) -> Column:
        mine = _block(F.col("held_print"), k)
        return F.transform(near, lambda m: F.struct(F.lit(k).alias("block"), mine.bitwiseXOR(m.cast("bigint")).alias("value")))

    right = right.select("*", F.explode(F.flatten(F.array(*map(values, range(BLOCKS))))).alias("held_key"))
    differ = F.col("print").bitwiseXOR(F.col("held_print"))
    first = reduce(lambda a, b: a & b, [(F.col("key.block") <= k) | (F.bit_count(_block(differ, k)) > 1) for k in range(BLOCKS - 1)])
    return (
        left.join(right, (F.col("size") == F.col("held_size")) & (F.col("key.block") == F.col("held_key.block")) & (F.col("key.value") == F.col("held_key.value")))
        .filter((F.bit_count(differ) <= RADIUS) & first)
        .drop("key", "held_key", "held_size")
    )


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if x == y else shingle_similarity(tuple(x.split(" ")), tuple(y.split(" "))) for x, y in zip(a, b)], dtype="float64")


def leaks(documents: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, item_id, exact_windows, near_windows, similarity.

    exact_windows: windows of the document that equal one of the item of PASSAGE words (or the whole
    shorter item); near_windows: those of the item's own size that are as similar as SIMILARITY without
    being equal; similarity: the best of the windows of the item's own size, 0.0 where none reaches it.
    """
    ship(documents.sparkSession)
    wanted = scratch.keep(item_windows(items))
    about = wanted.agg(F.sum(F.greatest(F.lit(1), F.col("size") - SHINGLE + 1)).alias("n"), F.collect_set("size").alias("sizes")).first()
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (int(about["n"] or 0) * 64).bit_length()))
    distinct = wanted.groupBy("size", "print", "window").agg(F.min("words").alias("words"))
    there = scratch.keep(document_windows(documents, sorted(about["sizes"]), _table_of_bits(wanted, bits)))
    asked = there.groupBy("size", "print", "window").agg(F.min("words").alias("words"))
    similar = scratch.keep(
        near_prints(asked, distinct)
        .select("size", "window", "held_window", _similarity("words", "held_words").alias("similarity"))
        .filter(F.col("similarity") >= SIMILARITY)
    )
    found = similar.join(wanted.select("size", F.col("window").alias("held_window"), "item_id", "passage", "whole"), ["size", "held_window"])
    # of one window and item: whether it is a passage of it, and how similar it is at the item's size
    found = found.groupBy("size", "window", "item_id").agg(
        F.bool_or(F.col("passage") & (F.col("window") == F.col("held_window"))).alias("exact"), F.max(F.when(F.col("whole"), F.col("similarity"))).alias("whole"),
    )
    return (
        there.groupBy("doc_id", "size", "window").agg(F.sum("n").alias("n")).join(found, ["size", "window"])
        .groupBy("doc_id", "item_id")
        .agg(
            F.sum(F.when(F.col("exact"), F.col("n")).otherwise(0)).cast("int").alias("exact_windows"),
            F.sum(F.when(F.col("whole") < 1, F.col("n")).otherwise(0)).cast("int").alias("near_windows"),
            F.round(F.coalesce(F.max("whole"), F.lit(0.0)), 6).alias("similarity"),
        )
        .filter("exact_windows > 0 OR near_windows > 0")
    )
