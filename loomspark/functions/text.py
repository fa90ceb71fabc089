"""Column helpers for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What closes a chunk, and how a list item begins.
SENTENCE_END = r"[.)\]]$"
LIST_ITEM = r"(?U)^\s*(?:\d+[.)]|[A-Za-z][.)]|i{1,3}\.)"


def strip(text: str | Column) -> Column:
    """Unicode whitespace removed at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def stable_id(*parts: str | Column) -> Column:
    """Deterministic id of the given columns."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *cols), 256)


def normalize(text: str | Column) -> Column:
    """Lower case, single blanks, numbered endings to ". ", marks off both ends."""
    x = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return F.btrim(F.regexp_replace(x, r"\.[0-9]+\s*", ". "), F.lit(".,;:"))


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def is_list_item(text: Column) -> Column:
    return text.rlike(LIST_ITEM)
