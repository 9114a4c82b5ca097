"""Composed texts of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def composed(title: Column, text: Column) -> Column:
    """title, line feed, text; of two only the non-empty one; nulls count as empty."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    return F.when((t != "") & (b != ""), F.concat(t, F.lit("\n"), b)).otherwise(F.concat(t, b))


def composed_trimmed(title: Column, text: Column, empty: str = "[empty]") -> Column:
    """The same of trimmed parts, `empty` if nothing is left."""
    c = composed(F.trim(title), F.trim(text))
    return F.when(c == "", F.lit(empty)).otherwise(c)


def truncated(text: Column, max_tokens: int, chars_per_token: int = 4, empty: str = " ") -> Column:
    """At most as many characters as max_tokens usually have; `empty` for an empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(empty)).otherwise(F.substring(text, 1, max_tokens * chars_per_token))


def short_model_name(model: Column, length: int = 20) -> Column:
    """The last part of a model's path, cut to `length`: the tag in the names of its chunks."""
    return F.substring(F.element_at(F.split(model, "/"), -1), 1, length)
