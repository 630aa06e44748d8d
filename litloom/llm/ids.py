"""How written values of the record tables are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_id(raw: Column) -> Column:
    """Without outer blanks, the part before the colon in lower case; blank becomes NULL."""
    text = F.trim(raw)
    colon = F.instr(text, ":")
    head = F.lower(F.substring_index(text, ":", 1))
    return F.when(text == "", None).when(colon > 0, F.concat(head, text.substr(colon, F.length(text)))).otherwise(text)


def filled(raw: Column) -> Column:
    """NULL for what stands for no value: NULL, blanks, ``-`` and ``n/a``.  ``none`` is a value."""
    text = F.trim(raw)
    return F.when(F.lower(text).isin("", "-", "n/a"), None).otherwise(text)


def version_number(raw: Column) -> Column:
    """The whole number in any notation (``v3``, ``03``, ``3.0``); 0 where there is none."""
    return F.coalesce(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(\d+)", 1).try_cast("int"), F.lit(0))
