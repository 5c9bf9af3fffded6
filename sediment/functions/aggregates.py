"""Aggregates with embedded-database semantics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.functions.json_fns import quote


def total(x: Column) -> Column:
    """Sum as a double, 0.0 over no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, sep: str = ",", order: Column | None = None, distinct: bool = False, descending: bool = False) -> Column:
    """The non-null values joined, in the given order or else by value; NULL over none."""
    if distinct:
        joined = F.array_join(F.array_sort(F.collect_set(x.cast("string"))), sep)
        return F.when(F.count(x) > 0, joined)
    if order is None:
        return F.when(F.count(x) > 0, F.array_join(F.array_sort(F.collect_list(x.cast("string"))), sep))
    pairs = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.cast("string").alias("v")))))
    pairs = F.reverse(pairs) if descending else pairs
    return F.when(F.count(x) > 0, F.array_join(F.transform(pairs, lambda p: p["v"]), sep))


def bare_at_max(by: Column, *columns: Column, tie: Column | None = None) -> Column:
    """A struct of columns from the row that holds the maximum of by; of ties the one with the smallest tie value."""
    key = F.struct(by.alias("b"), (-tie if tie is not None else F.lit(0)).alias("t"))
    return F.max_by(F.struct(*columns), key)


def bare_at_min(by: Column, *columns: Column, tie: Column | None = None) -> Column:
    key = F.struct(by.alias("b"), (tie if tie is not None else F.lit(0)).alias("t"))
    return F.min_by(F.struct(*columns), F.when(by.isNotNull(), key))


def json_group_array(x: Column, order: Column) -> Column:
    """JSON array of all values in the given order, NULLs included."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), quote(x).alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: p["v"]), ","), F.lit("]"))


def json_group_object(key: Column, value: Column, order: Column) -> Column:
    """JSON object of the pairs in the given order; of equal keys the last one's value counts, at the first one's place."""
    pairs = F.array_sort(F.collect_list(F.when(key.isNotNull(), F.struct(order.alias("o"), quote(key.cast("string")).alias("k"), quote(value).alias("v")))))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), -1)
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(":"), last(k))), ","), F.lit("}"))


def first_by(x: Column, *order: Column) -> Column:
    """The value with the smallest order among non-null values."""
    return F.min_by(x, F.when(x.isNotNull(), F.struct(*order)))


def last_by(x: Column, *order: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), F.struct(*order)))
