"""Small column helpers: emptiness, coalescing, keyword tests, ordered distinct."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """``c`` as a string, null as the empty one."""
    return F.coalesce(c.cast("string"), F.lit(""))


def is_empty(c: Column) -> Column:
    """Null or the empty string; 0 and false are values."""
    return c.isNull() | (c.cast("string") == "")


def first_nonblank(*cols: Column, limit: int = 300) -> Column:
    """The first column that isn't blank, trimmed and cut."""
    return F.substring(F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols]), 1, limit)


def any_term(c: Column, terms: Iterable[str]) -> Column:
    """Whether any term is contained; a chain of ``contains`` stays in generated code and needs no quoting."""
    found = F.lit(False)
    for t in terms:
        found = found | c.contains(t)
    return found


def ends_with_any(c: Column, suffixes: Iterable[str]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | c.endswith(s)
    return found


def present(*pairs: tuple[Column, str | Column]) -> Column:
    """The values whose condition holds, in order, without repeats."""
    items = [F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in pairs]
    return F.array_distinct(F.filter(F.array(*items), lambda x: x.isNotNull() & (x != "")))


def normalized_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def place_token(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def slug(c: Column, default: str = "") -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 80)
    return F.when(s == "", F.lit(default)).otherwise(s)


def distinct_ignoring_case(values: Column) -> Column:
    """Ordered distinct of an array by lower case; the first spelling stays."""
    folded = F.transform(values, lambda x: F.lower(x))
    return F.filter(values, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def short_hash(c: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text(c), 256), 1, 16)


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and the short hash of the parts joined by bars; a null part is empty."""
    return F.concat(F.lit(prefix + ":"), short_hash(F.concat_ws("|", *[text(p) for p in parts])))
