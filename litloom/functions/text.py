"""Text functions as column expressions: they stay inside generated code.

NULL gives NULL throughout; an empty text gives an empty result (no tokens, zero words).  Word
classes are spelled with \\p{...}, so that accented letters count as letters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words left out of lexical overlap.
OVERLAP_STOP = "a an the of to in on for and or is are be by with as it this that what which how why does do".split()


def clean_space(text: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm_title(text: Column) -> Column:
    """Lower case; everything but ASCII letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def terms(text: Column, least: int = 2) -> Column:
    """Lower-case words of at least ``least`` letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{%d,}" % least), F.lit(0))


def token_count(text: Column) -> Column:
    """Runs of letters and digits, and other single characters that are not white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0)))


def word_count(text: Column) -> Column:
    cleaned = clean_space(text)
    return F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    return F.when(F.instr(text, "\n") > 0, text.substr(F.instr(text, "\n") + 1, F.length(text))).otherwise("")


def sentences(text: Column) -> Column:
    """Split after ``.!?`` where a capital, digit, ``$``, ``(`` or ``[`` follows."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9$(\[])")


def surnames(authors: Column) -> Column:
    """The distinct last words of names parted by semicolons, in lower case."""
    names = F.filter(F.transform(F.split(authors, ";"), clean_space), lambda x: x != "")
    return F.array_distinct(F.transform(names, lambda x: F.lower(F.element_at(F.split(x, " "), -1))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0.0 where either is empty or NULL."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(
        F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 3)
    )


def overlap_words(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*[F.lit(w) for w in OVERLAP_STOP]))


def lexical_overlap(question: Column, quotes: Column) -> Column:
    """Jaccard of the words of two texts without stop words, four decimals; 0.0 where none is left."""
    a, b = overlap_words(question), overlap_words(quotes)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 4)).otherwise(0.0)


def heading(path: Column) -> Column:
    """The last part of a section path in lower case, without its number."""
    last = F.element_at(F.split(path, " > "), -1)
    return F.lower(F.trim(F.regexp_replace(last, r"^[0-9.]+\s+", "")))


def without_version(record: Column) -> Column:
    return F.regexp_replace(record, r"v[0-9]+$", "")


def file_tag(record: Column) -> Column:
    """An id that is safe as a file name."""
    return F.translate(record, ":/", "__")


def length_ratio(a: Column, b: Column) -> Column:
    """Smaller to larger, three decimals; NULL where either is 0."""
    return F.when((a > 0) & (b > 0), F.round(F.least(a, b) / F.greatest(a, b), 3))


def label(title: Column, year: Column, venue: Column, section: Column) -> Column:
    """``Title (Year, Venue), § Section``; what is absent is left out."""
    inner = F.concat_ws(", ", year.cast("string"), F.nullif(F.trim(venue), F.lit("")))
    return F.concat(title, F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(""),
                    F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", § "), section)).otherwise(""))


def cited_numbers(text: Column) -> Column:
    """The numbers of all citations ``[1]``, ``[1, 3]``, ascending and distinct."""
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*")))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))


def parse_lenient(reply: Column, schema: str) -> Column:
    """JSON with or without a code fence around it; NULL where it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    return F.from_json(bare, schema)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
