"""Records to works: identifier edges, components, pair decisions, canonical records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, sqrt
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import fuzzy
from litloom.functions import text as T
from litloom.session import Scratch, ship

# The thresholds of the default rule, and the grid that is swept.
TITLE, AUTHOR, COSINE, RELATED = 92.0, 0.5, 0.85, 0.6
GRID = ((80, 85, 88, 90, 92, 95, 98), (0.3, 0.4, 0.5, 0.6, 0.7), (0.80, 0.85, 0.90))


def identifier_edges(records: DataFrame) -> DataFrame:
    """node, key value: every record is tied to the least record with the same identifier.  Blank and
    NULL identifiers tie nothing, nor do identifiers that stand for the archive copy itself."""
    doi = F.lower(F.trim("doi"))
    value = lambda c: F.when(F.lower(F.trim(c)).isin("", "-", "n/a"), None).otherwise(F.trim(c))
    keys = F.array(
        F.concat(F.lit("arxiv="), value("arxiv_id")), F.concat(F.lit("openalex="), value("openalex_id")),
        F.concat(F.lit("record="), F.col("record_id")), F.concat(F.lit("record="), value("duplicate_of")),
        F.when(~doi.startswith("10.48550/arxiv.") & value("doi").isNotNull(), F.concat(F.lit("doi="), doi)),
    )
    held = records.select("record_id", F.explode(F.array_compact(keys)).alias("key")).distinct()
    least = held.groupBy("key").agg(F.min("record_id").alias("a"))
    return held.join(least, "key").filter("a <> record_id").select("a", F.col("record_id").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """nodes: node; edges: a, b -> node, component (its least node), nodes without edges included.

    Each round every node takes the least label among its neighbours, then the label of its label,
    so labels travel twice as far each round.  Rounds are written tables; when no label changed, they
    are final.  Neighbours are combined before the shuffle.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = scratch.keep(nodes.select("node").distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        heard = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = now.join(heard, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        nearer = scratch.keep(nearer)
        jump = nearer.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = scratch.keep(nearer.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = not new.filter("old <> label").isEmpty()
        scratch.drop(nearer)
        scratch.drop(now)
        now = new
        if not changed:
            return now.select("node", F.col("label").alias("component"))
        now = now.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def decide(title: Column, author: Column, cosine: Column, body: Column, t=TITLE, a=AUTHOR, c=COSINE, r=RELATED) -> Column:
    """A NULL cosine or body ratio passes its test; a NULL title ratio or author overlap fails it."""
    apart = F.coalesce((title < t) | (author < a), F.lit(True)) | F.coalesce(cosine < c, F.lit(False))
    return F.when(apart, "separate").when(body < r, "related").otherwise("merge")


def work_ids(members: DataFrame) -> DataFrame:
    """members: component, record_id, source, arxiv_id -> component, work_id: the least archive id of a
    main archive record, else the least record id."""
    archive = F.when((F.col("source") == "arxiv") & (F.coalesce("arxiv_id", F.lit("")) != ""), F.col("arxiv_id"))
    return members.groupBy("component").agg(F.coalesce(F.min(archive), F.min("record_id")).alias("work_id"))


def canonical_key(source: Column, status: Column, version: Column, record: Column) -> Column:
    """Least first: full text of the archive, of the venue, the archive without text, the rest; then
    structured text, the higher version, the smaller id."""
    full = F.coalesce(status.isin("html", "ar5iv", "pdf"), F.lit(False))
    tier = F.when((source == "arxiv") & full, 0).when((source == "acl") & full, 1).when((source == "arxiv") & ~full, 2).otherwise(3)
    flat = F.when(status.isin("html", "ar5iv"), 0).otherwise(1)
    return F.struct(tier.alias("tier"), flat.alias("flat"), (-F.coalesce(version, F.lit(0))).alias("older"), record.alias("record_id"))


def canonical_flags(records: DataFrame) -> DataFrame:
    """records: work_id, record_id, source, status, version, reason[, duplicate_of] -> canonical, in_index, why
    not, and what it is a duplicate of: copies that were fetched as such keep theirs, the rest name the
    canonical record."""
    key = canonical_key(F.col("source"), F.col("status"), F.col("version"), F.col("record_id"))
    first = records.groupBy("work_id").agg(F.min(key).alias("k")).select("work_id", F.col("k.record_id").alias("head"))
    full, is_head = F.coalesce(F.col("status").isin("html", "ar5iv", "pdf"), F.lit(False)), F.col("record_id") == F.col("head")
    cap = F.coalesce(F.col("reason") == "corpus_cap", F.lit(False))
    own = F.nullif(F.trim("duplicate_of"), F.lit("")) if "duplicate_of" in records.columns else F.lit(None).cast("string")
    kept = F.when(F.col("source").isin("arxiv_v1", "acl_copy"), own)
    return records.join(first, "work_id").select(
        "work_id", "record_id", is_head.alias("canonical"), (is_head & full & ~cap).alias("in_index"), F.when(is_head, "").otherwise(F.coalesce(kept, "head")).alias("duplicate_of"),
        F.when(~is_head, F.concat(F.lit("duplicate_of:"), "head")).when(cap, "corpus_cap").when(~full, "no_fulltext").otherwise("").alias("not_indexed_reason"),
    )


def sweep(pairs: DataFrame, truth: Column) -> DataFrame:
    """Precision and recall of every rule of the grid over labelled pairs (three decimals, 0.0 on an
    empty denominator).  The grid's 105 rules are exploded from a literal, no table is crossed."""
    rules = [F.struct(F.lit(float(t)).alias("t"), F.lit(a).alias("a"), F.lit(c).alias("c")) for t in GRID[0] for a in GRID[1] for c in GRID[2]]
    tried = pairs.select("title_ratio", "author_jaccard", "abstract_cosine", truth.alias("same"), F.explode(F.array(*rules)).alias("g")).filter("same IS NOT NULL")
    merged = decide(F.col("title_ratio"), F.col("author_jaccard"), F.col("abstract_cosine"), F.lit(None).cast("double"), F.col("g.t"), F.col("g.a"), F.col("g.c")) == "merge"
    counted = tried.withColumn("m", merged).groupBy("g.t", "g.a", "g.c").agg(
        F.count_if(F.col("m") & F.col("same")).alias("tp"), F.count_if(F.col("m") & ~F.col("same")).alias("fp"), F.count_if(~F.col("m") & F.col("same")).alias("fn")
    )
    part = lambda n, d: F.coalesce(F.round(F.col(n) / F.nullif(F.col(n) + F.col(d), F.lit(0)), 3), F.lit(0.0))
    return counted.select(F.col("t").alias("title_ratio"), F.col("a").alias("author_jaccard"), F.col("c").alias("abstract_cos"), "tp", "fp", "fn", part("tp", "fp").alias("precision"), part("tp", "fn").alias("recall"))


def best_rule(swept: DataFrame) -> DataFrame:
    """Among rules without a false merge the one with the highest recall, the strictest of equals."""
    top = F.max(F.struct("recall", "title_ratio", "author_jaccard", "abstract_cos")).alias("top")
    return swept.filter("precision = 1.0").agg(top).filter("top IS NOT NULL").select("top.*")


def _chosen(words: str, k: int) -> Column:
    """The hashes of all choices of k words, three at most, of an array, in its order."""
    n, at = f"size({words})", [f"{words}[i{j} - 1]" for j in range(k)]
    every = f"xxhash64({', '.join(at)})"
    for j in reversed(range(k)):
        every = f"transform(sequence({f'i{j - 1} + 1' if j else '1'}, {n} - {k - 1 - j}), i{j} -> {every})"
        every = f"flatten({every})" if j < k - 1 else every
    return F.expr(f"CASE WHEN {n} >= {k} THEN {every} ELSE CAST(array() AS array<bigint>) END")


def similar_titles(titles: DataFrame, scratch: Scratch, least: float = 0.6) -> DataFrame:
    """titles: id, words (distinct) -> a, b of all pairs with word Jaccard >= least, exactly.

    Prefix filtering by choices of words: two sets that similar share 2 least / (1 + least) of the words
    of the shorter or more, and least of those of the longer.  So the first k words that they share, in the
    order of rarity, stand among the first len - shared + k words of either, and both have the key of
    these k words: three, fewer where a short title need not share three, or a very long one has too many
    choices.  A pair is compared where it meets and counts only at that key, so candidates are neither
    written nor met twice.  Words of a single title make no key, and keys without a partner are left out."""
    eps, most = 1e-9, 3
    sets = scratch.keep(titles.filter(F.size("words") > 0).select("id", "words", F.monotonically_increasing_id().alias("no")))
    said = sets.select("no", F.explode("words").alias("w"))
    rarity = said.groupBy("w").agg(F.count(F.lit(1)).alias("df")).orderBy("df", "w")
    order = scratch.keep(rarity.select("w", "df", F.monotonically_increasing_id().alias("k")))
    ranked = said.join(order, "w").groupBy("no").agg(F.array_sort(F.collect_list("k")).alias("r"), F.count_if(F.col("df") == 1).cast("int").alias("lone"))
    ranked = scratch.keep(ranked)
    n = F.size("r")
    must = lambda size: F.ceil(size * (2 * least / (1 + least)) - eps)
    run = lambda size: F.least(must(size), F.when(size <= 30, most).when(size <= 100, 2).otherwise(1))
    reach = F.transform(F.sequence(F.ceil(n * least - eps), n.cast("bigint")), run)  # the k of all that are shorter

    def keys(share: Column, k_least: Column, k_most: Column) -> DataFrame:
        prefix = lambda k: F.slice("r", F.col("lone") + 1, F.greatest(F.lit(0), (n - share + k).cast("int") - F.col("lone")))
        held = ranked.select("no", *[F.when(F.lit(k).between(k_least, k_most), prefix(k)).otherwise(F.array().cast("array<bigint>")).alias(f"p{k}") for k in range(1, most + 1)])
        return held.select("no", F.explode(F.concat(*[_chosen(f"p{k}", k) for k in range(1, most + 1)])).alias("key"))

    short = keys(must(n), run(n), run(n)).withColumn("short", F.lit(True))
    every = scratch.keep(short.unionByName(keys(F.ceil(n * least - eps), F.array_min(reach), F.array_max(reach)).withColumn("short", F.lit(False))))
    met = every.groupBy("key").agg(F.count_if("short").alias("s"), F.count_if(~F.col("short")).alias("l")).filter("s > 0 AND l > 1")
    live = scratch.keep(every.join(met.select("key"), "key", "left_semi"))
    scratch.drop(every)
    side = lambda kind, k: live.filter(kind).join(ranked.select("no", "r"), "no").select("key", F.col("no").alias(f"n{k}"), F.col("r").alias(k))
    both, nx, ny = F.array_intersect("x", "y"), F.size("x"), F.size("y")
    shared = F.size(both)
    first = lambda k: F.xxhash64(*[F.get(both, F.lit(i)) for i in range(k)])
    here = F.col("key") == F.when(run(nx) == 1, first(1)).when(run(nx) == 2, first(2)).otherwise(first(most))
    fits = ((nx < ny) | ((nx == ny) & (F.col("nx") < F.col("ny")))) & (nx >= ny * least - eps)
    found = side("short", "x").join(side("NOT short", "y"), "key").filter(fits & (shared >= (nx + ny - shared) * least) & here).select("nx", "ny")
    x, y = (sets.select(F.col("no").alias(f"n{k}"), F.col("id").alias(k)) for k in "xy")
    return found.join(x, "nx").join(y, "ny").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def work_groups(records: DataFrame, merged: DataFrame, scratch: Scratch) -> DataFrame:
    """records: record_id, source and identifiers; merged: a, b of the pairs that are one work -> record_id,
    component, work_id: the closure of identifiers and merged pairs together."""
    edges = identifier_edges(records).unionByName(merged.select("a", "b").filter("a <> b")).distinct()
    groups = scratch.keep(components(records.select(F.col("record_id").alias("node")), edges, scratch).select(F.col("node").alias("record_id"), "component"))
    named = work_ids(groups.join(records.select("record_id", "source", "arxiv_id"), "record_id"))
    return groups.join(named, "component")


def pair_features(pairs: DataFrame, records: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs: a, b; records: record_id, title, authors, body_words; vectors: record_id, embedding (unit length) ->
    a, b, title_ratio, author_jaccard, abstract_cosine and body_ratio (NULL where a side has none)."""
    side = lambda k: records.select(F.col("record_id").alias(k), F.col("title").alias(f"t_{k}"), T.surnames(F.col("authors")).alias(f"s_{k}"), F.col("body_words").alias(f"w_{k}")).join(
        vectors.select(F.col("record_id").alias(k), F.col("embedding").cast("array<double>").alias(f"v_{k}")), k, "left")
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    dot = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)
    return rows.select(
        "a", "b", F.coalesce(fuzzy.fuzz_title_ratio(F.coalesce("t_a", F.lit("")), F.coalesce("t_b", F.lit(""))), F.lit(0.0)).alias("title_ratio"), T.jaccard(F.col("s_a"), F.col("s_b")).alias("author_jaccard"),
        F.round(dot, 4).alias("abstract_cosine"), T.length_ratio(F.col("w_a"), F.col("w_b")).alias("body_ratio"),
    )


#: Letters whose order is compared before a pair is scored, and those that are only counted.
_ORDERED, _COUNTED = "dghlmnrst", "abcefijkopquvwxyz0123456789 "
_TITLE_BLOCK, _WORDS, _PAIRS, _ALL = 1024, 512, 8192, np.uint64(2**64 - 1)


class _Titles:
    """A block of titles, each its distinct words in order: counts of letters and of hashed words, weighed by
    their length, and the ordered letters of each as codes and as bits."""

    def __init__(self, titles: list[str]):
        self.titles, n = titles, len(titles)
        self.size = np.array([len(t) for t in titles], np.float32)
        text = np.frombuffer("\n".join(titles).encode(), np.uint8)
        code = np.full(256, -1)
        code[list((_ORDERED + _COUNTED).encode())] = np.arange(len(_ORDERED + _COUNTED))
        title = np.cumsum(text == ord("\n"))[text != ord("\n")]
        letter = code[text[text != ord("\n")]]
        kind = np.uint16 if self.size.max() < 60_000 else np.uint32
        self.letters = np.bincount(letter * n + title, minlength=len(_ORDERED + _COUNTED) * n).reshape(-1, n).astype(kind)
        title, letter = title[letter < len(_ORDERED)], letter[letter < len(_ORDERED)]
        held = np.bincount(title, minlength=n)
        place = np.arange(len(title)) - np.repeat(np.cumsum(held) - held, held)
        self.wide = max(1, -(-int(held.max()) // 64))
        #: One column a title; one code more than there are letters, for nothing.
        self.codes = np.full((held.max(), n), len(_ORDERED), np.uint8)
        self.codes[place, title] = letter
        self.bits = np.zeros((self.wide, n, len(_ORDERED) + 1), np.uint64)
        np.bitwise_or.at(self.bits, (place // 64, title, letter), np.uint64(1) << (place % 64).astype(np.uint64))
        self.weighed = np.zeros((n, _WORDS), np.float32)
        self.held = np.zeros((n, _WORDS), np.float32)
        self.ordered: dict[str, int] = {}  # ordered letters of a word
        self.words: list[list[tuple[str, int]]] = []  # with the place of the first ordered letter
        self._who: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(titles):
            words, j = [], 0
            for word in t.split(" "):
                k = crc32(word.encode()) % _WORDS
                self.weighed[i, k] += len(word) + 1
                self.held[i, k] = 1
                if (m := self.ordered.get(word)) is None:
                    m = self.ordered[word] = sum(map(word.count, _ORDERED))
                words.append((word, j))
                self._who.setdefault(word, []).append((i, j))
                j += m
            self.words.append(words)
        self._at: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The titles with a word, and the places of its ordered letters in ``codes``, as one row."""
        if word not in self._at:
            who, first = np.array(self._who.get(word, ()), np.int64).reshape(-1, 2).T
            self._at[word] = who, ((first + np.arange(self.ordered.get(word, 0))[:, None]) * len(self.titles) + who).ravel()
        return self._at[word]

    def bounds(self, other: _Titles, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words that two titles share may alone give the ratio; where the letters that they share,
        which bound their common subsequence, allow it; and how many of the ordered letters must then be in order."""
        kind = np.promote_types(self.letters.dtype, other.letters.dtype)
        common, one = np.zeros((len(self.titles), len(other.titles)), kind), np.empty((len(self.titles), len(other.titles)), kind)
        need = least / 200 * (self.size[:, None] + other.size[None, :]) - 1e-2
        for k in reversed(range(len(self.letters))):
            if k == len(_ORDERED) - 1:
                ordered = need - common
            if self.letters[k].any() and other.letters[k].any():
                common += np.minimum.outer(self.letters[k], other.letters[k], out=one)
        shared = np.minimum(self.weighed @ other.held.T, self.size[:, None] + 1)
        small = np.minimum(self.size[:, None], other.size[None, :])
        return 200 * shared >= (least - 1e-2) * (shared + small), common >= need, ordered


def _in_order(x: _Titles, i: np.ndarray, keep: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of titles i of x, at the letters whose bits are kept, with the
    columns of codes: one bit a letter of x, one addition a letter of the other, all pairs at once."""
    wide, base = len(keep), i * (len(_ORDERED) + 1)
    bits = x.bits.reshape(wide, -1)
    free = [np.full(len(i), _ALL) for _ in range(wide)]
    at, hit, total = np.empty(len(i), np.int64), np.empty(len(i), np.uint64), np.empty(len(i), np.uint64)
    for row in codes:
        np.add(base, row, out=at)
        carry = None
        for w in range(wide):
            np.take(bits[w], at, out=hit, mode="clip")
            hit &= keep[w]
            hit &= free[w]
            np.add(free[w], hit, out=total)
            over = total < hit if w + 1 < wide else None
            if carry is not None:
                total += carry
                if over is not None:
                    over |= total < carry
            free[w] -= hit
            free[w] |= total
            carry = over
    return sum(np.bitwise_count(~f).astype(np.int64) for f in free)


def _near_titles(x: _Titles, y: _Titles, least: float, same: bool) -> Iterator[tuple[int, int]]:
    """Places of the pairs, each once, that the exact bounds leave to be scored.

    The words that two titles share lead both, so their common subsequence has these and that of the other
    words, which is at most that of their ordered letters and the number of those only counted."""
    shared, open_, need = x.bounds(y, least)
    if same:
        shared, open_ = np.triu(shared, 1), np.triu(open_, 1)
    yield from zip(*(k.tolist() for k in np.nonzero(shared)))
    open_ &= ~shared
    held: list[tuple[np.ndarray, ...]] = []
    for i in range(len(x.titles)):
        j = np.flatnonzero(open_[i])
        if len(j):
            keep, codes, led = np.full((x.wide, len(y.titles)), _ALL), y.codes.copy(), np.zeros(len(y.titles), np.int64)
            for word, first in x.words[i]:
                if (m := y.ordered.get(word)):
                    who, where = y.at(word)
                    codes.reshape(-1)[where] = len(_ORDERED)
                    led[who] += m
                    mask = (1 << first + m) - (1 << first)
                    for w in range(x.wide):
                        keep[w, who] &= np.uint64(~(mask >> 64 * w) & (2**64 - 1))
            held.append((np.full(len(j), i), j, keep[:, j], codes[:, j], need[i, j] - led[j]))
        if held and (i + 1 == len(x.titles) or sum(len(h[1]) for h in held) >= _PAIRS):
            i_, j_, keep, codes, left = (np.concatenate(h, axis=-1) for h in zip(*held))
            fits = np.flatnonzero(_in_order(x, i_, keep, codes) >= left)
            yield from zip(i_[fits].tolist(), j_[fits].tolist())
            held = []


def near_title_pairs(records: DataFrame, scratch: Scratch, least: float = 80.0, gap: int = 2) -> DataFrame:
    """records: id, title, year, group -> a < b, score: all pairs of different groups with a token set ratio
    of ``least`` or more and years at most ``gap`` apart (a missing year is year 0).

    Titles of one year with the same words are compared once.  They stand in blocks of about 1,024; blocks of
    years in reach meet by a product without a shuffle, and bounds on the ratio, exact, leave few pairs to be
    scored.  NULL and wordless titles match nothing."""
    ship(records.sparkSession)
    words = F.array_join(F.array_sort(F.array_distinct(F.split(T.norm_title(F.col("title")), " "))), " ")
    rows = scratch.keep(records.select(F.col("id").cast("string").alias("id"), words.alias("words"), F.coalesce("year", F.lit(0)).cast("bigint").alias("year"), F.col("group").cast("string").alias("group")).filter("words <> ''"))
    titles = scratch.keep(rows.groupBy("year", "words").agg(F.count(F.lit(1)).alias("n")))
    sizes = titles.groupBy("year").agg(F.ceil(F.count(F.lit(1)) / _TITLE_BLOCK).cast("int").alias("k"))
    placed = titles.join(sizes, "year").withColumn("block", F.pmod(F.xxhash64("words"), F.col("k")).cast("int"))
    packed, n = scratch.keep_counted(placed.groupBy("year", "block").agg(F.array_join(F.array_sort(F.collect_list("words")), "\n").alias("titles")))
    # parts of few blocks, some products of two for each core
    parts = max(1, min(n, max(-(-n // 128), ceil(sqrt(8 * records.sparkSession.sparkContext.defaultParallelism)))))
    blocks = packed.repartition(parts, "year", "block")
    left = blocks.select(*[F.col(c).alias(f"{c}_x") for c in blocks.columns])
    apart = F.col("year") - F.col("year_x")
    met = left.hint("shuffle_replicate_nl").join(blocks, apart.between(0, gap) & ((apart > 0) | (F.col("block_x") <= F.col("block"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = lru_cache(16)(lambda titles: _Titles(titles.split("\n")))
        for batch in batches:
            for year_x, block_x, titles_x, year, block, titles in zip(*(batch[c] for c in ("year_x", "block_x", "titles_x", "year", "block", "titles"))):
                x, y = built(titles_x), built(titles)
                found = [(x.titles[i], y.titles[j]) for i, j in _near_titles(x, y, least, year_x == year and block_x == block)]
                scored = [(p, q, score) for p, q in found if (score := fuzzy.token_set_ratio(p, q)) >= least]
                yield pd.DataFrame(scored, columns=["words_x", "words_y", "score"]).assign(year_x=year_x, year_y=year)

    near = met.mapInPandas(run, "words_x string, words_y string, score double, year_x bigint, year_y bigint")
    alike = titles.filter("n > 1").select(F.col("words").alias("words_x"), F.col("words").alias("words_y"), F.lit(100.0).alias("score"), F.col("year").alias("year_x"), F.col("year").alias("year_y"))
    links = scratch.keep(near.unionByName(alike))
    x, y = (rows.select(*[F.col(c).alias(f"{c}_{k}") for c in rows.columns]) for k in "xy")
    once = (F.col("words_x") != F.col("words_y")) | (F.col("year_x") != F.col("year_y")) | (F.col("id_x") < F.col("id_y"))
    pairs = links.join(x, ["words_x", "year_x"]).join(y, ["words_y", "year_y"]).filter(once & ~F.col("group_x").eqNullSafe(F.col("group_y")))
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), "score")
