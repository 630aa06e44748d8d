"""Problem 5: splitting oversized items at natural boundaries.

A text is read as tokens (a longest run of letters and digits, or any other single character that is
not blank).  Before every token lies a boundary of a level: section, paragraph, sentence, word or
character.  The hierarchy is walked from the top: what is left of a text and does not fit is cut at
the last section boundary that the limit reaches; where none lies in reach, at the last paragraph
boundary, then sentence, word and character.  So a piece takes whole parts of the highest level as
long as they fit and never fills up across a boundary higher than the one it ends at.  The next piece
begins with the last ``overlap`` tokens of the one before.

The text of a chunk begins with its header, ``title | section``; the columns title and section tell
where it ends (or, where they do not match the text, the first line).  The header belongs to the text
below it: it is parted from it only where the limit reaches no end of a sentence, paragraph or
section.  A line that repeats a name of the section path opens a section, as does a numbered or
marked heading.

Pieces are slices of the text, so without the overlaps they add up to the text exactly.  An overlap
that leaves no room for new text is cut to one token less than the limit; one longer than the piece
before is that piece.

Defined results: a NULL or empty text, and a kind without a limit or with a limit below 1, give no
pieces (nothing is oversized); repeated rows give their pieces once; NULL titles and sections name no
header; a NULL or outdated n_tokens is reported as ``stale``, tokens are always counted; further
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Lines that open a section: a numbered or marked heading of at most a dozen words.
HEADING = re.compile(r"(?:#{1,6}\s+|\d+(?:\.\d+)*\.?\s+(?=[^\W\d_]))\S+(?:[ \t]+\S+){0,11}\s*")
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]")
SECTION, PARAGRAPH, SENTENCES, WORD, CHARACTER = range(5)
LEVELS = ("section", "paragraph", "sentence", "word", "character")


def boundary_levels(text: str, spans: list[tuple[int, int]], header: int = 0, section: str = "") -> list[int]:
    """The level of the boundary before each token.  ``header``: characters of the header line;
    ``section``: the section path, whose names open sections where they stand as a line."""
    level = [WORD if i and spans[i - 1][1] < spans[i][0] else CHARACTER for i in range(len(spans))]
    starts = [a for a, _ in spans]

    def raise_at(position: int, to: int) -> None:
        i = bisect_left(starts, position)
        if i < len(level):
            level[i] = min(level[i], to)

    for m in SENTENCE.finditer(text, header):
        raise_at(m.end(), SENTENCES)
    names = {name.strip().lower() for name in section.split(">")} - {""}
    begin = 0
    for line in text.splitlines(keepends=True):
        if begin >= header > 0 or header == 0 < begin:
            opens = HEADING.fullmatch(line) or line.strip().lower() in names
            at_header = begin - header in (0, 1) and header
            raise_at(begin, SENTENCES if at_header else SECTION if opens else PARAGRAPH)
        begin += len(line)
    return level


def header_length(text: str, title: str | None, section: str | None) -> int:
    """Characters of the header line with its line break: ``title | section`` where the text begins with
    it, else the first line of a text of several lines; 0 where there is none."""
    named = f"{title or ''} | {section or ''}"
    if len(named) > 3 and text.startswith(named + "\n"):
        return len(named) + 1
    end = text.find("\n")
    return end + 1 if 0 <= end < len(text) - 1 else 0


def split_spans(text: str, limit: int, overlap: int, title: str | None = None, section: str | None = None) -> list[tuple[int, int, int, int, int]]:
    """(first char, last char, tokens, tokens shared with the piece before, level of the boundary it
    begins at) of each piece; one piece if the text is within the limit."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, len(text), n, 0, SECTION)]
    overlap = max(0, min(overlap, limit - 1))
    level = boundary_levels(text, spans, header_length(text, title, section), section or "")
    places: list[list[int]] = [[] for _ in range(CHARACTER + 1)]
    for i, at in enumerate(level):
        places[at].append(i)
    out, start, end, shared, begun = [], 0, 0, 0, SECTION
    while end < n:
        reach = start + limit
        stop, at = n, SECTION
        if reach < n:
            for at, held in enumerate(places):  # the last boundary of the highest level in reach
                k = bisect_right(held, reach)
                if k and held[k - 1] > end:
                    stop = held[k - 1]
                    break
        out.append((spans[start][0] if out else 0, spans[stop][0] if stop < n else len(text), stop - start, shared, begun))
        shared = min(overlap, stop - start)
        start, end, begun = stop - shared, stop, at
    return out


def split_oversized(chunks: DataFrame, limits: DataFrame, text: str = "embed_text", with_text: bool = True) -> DataFrame:
    """The pieces of every chunk with more tokens than its kind allows.

    -> chunk_id, piece_no (from 1), pieces, first_char, last_char, n_tokens, overlap_tokens, cut_at (the
    level of the boundary that the piece begins at)[, piece], stale (whether no load of the chunk states
    its number of tokens)

    One pass over the chunks; only pieces of oversized chunks are shuffled, to drop repeats.
    """
    kinds = limits.select(
        F.lower(F.trim("kind")).alias("_kind"), F.col("max_tokens").cast("int").alias("_most"), F.coalesce(F.col("overlap_tokens").cast("int"), F.lit(0)).alias("_shared")
    ).groupBy("_kind").agg(F.min("_most").alias("_most"), F.min("_shared").alias("_shared"))
    named = [F.col(c).cast(t).alias(f"_{c}") if c in chunks.columns else F.lit(None).cast(t).alias(f"_{c}") for c, t in (("title", "string"), ("section", "string"), ("n_tokens", "int"))]
    rows = (
        chunks.select("chunk_id", F.lower(F.trim("kind")).alias("_kind"), F.col(text).alias("_text"), *named)
        .join(kinds, "_kind")
        # a token has at least one character, so a text no longer than the limit is never oversized
        .filter((F.col("_most") >= 1) & (F.length("_text") > F.col("_most")))
        .select("chunk_id", "_most", "_shared", "_text", "_title", "_section", F.coalesce("_n_tokens", F.lit(-1)).alias("_stored"))
    )
    schema = "chunk_id string, piece_no int, pieces int, first_char int, last_char int, n_tokens int, overlap_tokens int, cut_at string, stale boolean"
    if with_text:
        schema += ", piece string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = TOKEN.findall
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for key, most, shared, body, title, section, stored in batch.itertuples(index=False):
                total = len(count(body))
                if total <= most:
                    continue
                cut = split_spans(body, int(most), int(shared), title, section)
                for k, (a, b, n, o, at) in enumerate(cut, 1):
                    row = (key, k, len(cut), a, b, n, o, LEVELS[at], stored != total)
                    out.append((*row, body[a:b]) if with_text else row)
            yield pd.DataFrame(out, columns=names)

    cut = rows.mapInPandas(run, schema)
    return cut.groupBy(*[c for c in cut.columns if c != "stale"]).agg(F.bool_and("stale").alias("stale"))


def invariants(pieces: DataFrame) -> DataFrame:
    """What must hold of each chunk's pieces: chunk_id, new_tokens (without overlaps), pieces, and how
    many pieces begin where the one before does not reach, miss their number or pass beyond its end."""
    by = Window.partitionBy("chunk_id").orderBy("piece_no")
    before, reach = F.lag("last_char").over(by), F.lag("n_tokens").over(by)
    return (
        pieces.select("*", F.coalesce((F.col("first_char") > before) | (F.col("overlap_tokens") > reach), F.col("first_char") != 0).cast("int").alias("bad"))
        .groupBy("chunk_id")
        .agg(
            F.sum(F.col("n_tokens") - F.col("overlap_tokens")).alias("new_tokens"), F.max("n_tokens").alias("largest"),
            F.sum("bad").alias("gaps"), (F.max("pieces") - F.count(F.lit(1))).alias("missing"),
        )
    )
