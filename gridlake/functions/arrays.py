"""Container functions over array columns."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def let(value: Column, body: Fn) -> Column:
    """Bind a value once so that a lambda below does not compute it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(function: Callable[..., Column]) -> Callable[..., Column]:
    """Compute the first argument of a column function once, however often its body mentions it."""
    @functools.wraps(function)
    def bind(value: Column, *args, **kwargs) -> Column:
        return let(value, lambda x: function(x, *args, **kwargs))

    return bind


def upto(n: Column) -> Column:
    """``[0, 1, .., n-1]``, empty when n < 1."""
    empty = F.array().cast("array<int>")
    return F.when(n < 1, empty).otherwise(F.sequence(F.lit(0), n.cast("int") - 1))


def interval(start: Column, stop: Column, step: Column) -> Column:
    """End-exclusive range."""
    last = stop - F.signum(step).cast("int")
    empty = F.array().cast("array<int>")
    runs = ((step > 0) & (start < stop)) | ((step < 0) & (start > stop))
    return F.when(runs, F.sequence(start, last, step)).otherwise(empty)


def contained(value: Column, container: Column) -> Column:
    return F.array_contains(container, value)


def size(container: Column) -> Column:
    return F.size(container)


def repeat(value: Column, n: Column | int) -> Column:
    return F.array_repeat(value, n)


def initset(value: Column) -> Column:
    return F.array(value)


def totuple(container: Column) -> Column:
    """Containers are arrays already; a set is shown in ascending order."""
    return F.array_sort(container)


def insert(value: Column, container: Column) -> Column:
    return F.array_union(container, F.array(value))


def remove(value: Column, container: Column) -> Column:
    return F.array_remove(container, value)


def other(container: Column, value: Column) -> Column:
    """First element that differs from ``value``."""
    return F.get(F.array_remove(container, value), F.lit(0))


def extract(container: Column, condition: Fn) -> Column:
    """First element that satisfies the condition."""
    return F.get(F.filter(container, condition), F.lit(0))


def sfilter(container: Column, condition: Fn) -> Column:
    return F.filter(container, condition)


def mfilter(container: Column, condition: Fn) -> Column:
    return F.flatten(F.filter(container, condition))


def apply(function: Fn, container: Column) -> Column:
    return F.transform(container, function)


def mapply(function: Fn, container: Column) -> Column:
    return F.flatten(F.transform(container, function))


def rapply(functions: list[Fn], value: Column) -> Column:
    return F.array(*[f(value) for f in functions])


def papply(function: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """Pairwise application; the longer side is cut to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), function)


def mpapply(function: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    return F.flatten(papply(function, a, b))


def pair(a: Column, b: Column) -> Column:
    return papply(lambda x, y: F.struct(x.alias("a"), y.alias("b")), a, b)


def product(a: Column, b: Column) -> Column:
    """All pairs of two small arrays of the same row."""
    return prapply(lambda x, y: F.struct(x.alias("a"), y.alias("b")), a, b)


def prapply(function: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: function(x, y))))


def merge(containers: Column) -> Column:
    return F.flatten(containers)


def combine(a: Column, b: Column) -> Column:
    """Concatenation of tuples."""
    return F.concat(a, b)


def union(a: Column, b: Column) -> Column:
    """Union of sets."""
    return F.array_union(a, b)


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def difference(a: Column, b: Column) -> Column:
    """Elements of ``a`` not in ``b``; repeated elements of ``a`` stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def dedupe(a: Column) -> Column:
    return F.array_distinct(a)


def maximum(container: Column) -> Column:
    return F.coalesce(F.array_max(container), F.lit(0))


def minimum(container: Column) -> Column:
    return F.coalesce(F.array_min(container), F.lit(0))


def _keyed(container: Column, key: Fn) -> Column:
    """Elements with their key and position, so that ties keep the container's order."""
    return F.transform(
        container, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))
    )


def order(container: Column, key: Fn) -> Column:
    """Stable ascending sort by ``key``."""
    return F.transform(F.array_sort(_keyed(container, key)), lambda s: s["x"])


def argmin(container: Column, key: Fn) -> Column:
    """First element with the smallest key."""
    return F.array_min(_keyed(container, key))["x"]


def argmax(container: Column, key: Fn) -> Column:
    """First element with the largest key."""
    ranked = F.transform(
        container, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x"))
    )
    return F.array_max(ranked)["x"]


def valmax(container: Column, key: Fn) -> Column:
    return maximum(F.transform(container, key))


def valmin(container: Column, key: Fn) -> Column:
    return minimum(F.transform(container, key))


def first(container: Column) -> Column:
    return F.get(container, F.lit(0))


def last(container: Column) -> Column:
    return F.try_element_at(container, F.lit(-1))


def counts(container: Column) -> Column:
    """``[(n, -x, x)]`` per distinct element of a small numeric array."""
    return F.transform(
        F.array_distinct(container),
        lambda x: F.struct(
            F.size(F.filter(container, lambda y: y == x)).alias("n"),
            (-x).alias("t"),
            x.alias("x"),
        ),
    )


def mostcommon(container: Column) -> Column:
    """Most frequent element, the smaller one on a tie."""
    return F.array_max(counts(container))["x"]


def leastcommon(container: Column) -> Column:
    """Least frequent element, the smaller one on a tie."""
    flipped = F.transform(counts(container), lambda s: F.struct(s["n"], s["x"]))
    return F.array_min(flipped)["x"]
