"""Methods of lists as column expressions on arrays. Positions count from 0, and -1 says 'not there'."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(a: Column, i: int) -> Column:
    """The element; from the end for negative i; NULL beyond the ends."""
    return F.get(a, i) if i >= 0 else F.try_element_at(a, F.lit(i))


def map_(a: Column, f: Callable[..., Column]) -> Column:
    """f(x) or f(x, position) of each element."""
    return F.transform(a, f)


def filter_(a: Column, p: Callable[..., Column]) -> Column:
    return F.filter(a, p)


def index_of(a: Column, x) -> Column:
    return (F.array_position(a, x) - 1).cast("long")


def includes(a: Column, x) -> Column:
    return F.array_contains(a, x)


def every(a: Column, p: Callable[[Column], Column]) -> Column:
    return F.forall(a, lambda x: F.coalesce(p(x), F.lit(False)))


def some(a: Column, p: Callable[[Column], Column]) -> Column:
    return F.exists(a, lambda x: F.coalesce(p(x), F.lit(False)))


def reduce_(a: Column, f: Callable[[Column, Column], Column], start: Column) -> Column:
    return F.aggregate(a, start, f)


def find(a: Column, p: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(a, p), 0)


def find_index(a: Column, p: Callable[[Column], Column]) -> Column:
    return (F.array_position(F.transform(a, lambda x: F.coalesce(p(x), F.lit(False))), True) - 1).cast("long")


def slice_(a: Column, start: int = 0, end: int | None = None) -> Column:
    """Elements from start up to, not including, end; both count from the end if negative, and both are cut to the list's ends."""
    n = F.size(a)
    clip = lambda i: F.greatest(F.lit(0), F.least(n, (F.lit(i) if i >= 0 else n + i)))
    s = clip(start)
    e = n if end is None else clip(end)
    return F.slice(a, s + 1, F.greatest(F.lit(0), e - s))


def concat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def flat(a: Column) -> Column:
    return F.flatten(a)


def flat_map(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(a, f))


def join(a: Column, separator: str = ",") -> Column:
    """Elements as text; NULL elements are empty."""
    return F.array_join(F.transform(a, lambda x: x.cast("string")), separator, "")


def reverse(a: Column) -> Column:
    return F.reverse(a)


def sort_as_text(a: Column) -> Column:
    """The default order of lists: by the elements' text, so 10 comes before 9."""
    keyed = F.array_sort(F.transform(a, lambda x: F.struct(x.cast("string").alias("k"), x.alias("v"))))
    return F.transform(keyed, lambda s: s["v"])


def sort_by_value(a: Column) -> Column:
    return F.array_sort(a)
