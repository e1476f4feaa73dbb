"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def dedupe_ordered(items: Column, key=lambda x: F.lower(F.trim(x))) -> Column:
    """First occurrence of each key, order kept.

    Groups are found by sorting (key, position) rather than by comparing all elements; the sorted array is made once a
    row, not once an element.
    """
    tagged = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))

    def firsts(by_key: Column) -> Column:
        return F.filter(by_key, lambda t, j: (j == 0) | (F.get(by_key, j - 1)["k"] != t["k"]))

    in_order = F.sort_array(F.transform(once(F.sort_array(tagged), firsts), lambda t: F.struct(t["i"].alias("i"), t["x"].alias("x"))))
    return F.transform(in_order, lambda t: t["x"])


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row: a lambda evaluates what it closes over again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
