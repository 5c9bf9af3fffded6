"""Relational operators whose embedded-database semantics differ from a plain Spark call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.runtime import cut


def compound(first: DataFrame, *members: tuple[str, DataFrame]) -> DataFrame:
    """Set operations strictly from left to right: union, union all, intersect, except; columns by place, names of the first."""
    out = first
    for op, df in members:
        df = df.toDF(*out.columns)
        out = {"union all": lambda a, b: a.unionAll(b), "union": lambda a, b: a.unionAll(b).distinct(), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}[op](out, df)
    return out


def recursive(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, rounds: int = 1000) -> DataFrame:
    """Recursive query: step is applied to the newest rows until none come. With distinct (UNION) rows already found are dropped
    by an anti join, so it ends on cycles. Each round's rows are written to the checkpoint folder."""
    new = cut(base.distinct() if distinct else base)
    found = new
    for _ in range(rounds):
        more = step(new).toDF(*base.columns)
        if distinct:
            condition = None
            a, b = more.distinct().alias("a"), found.alias("b")
            for c in base.columns:
                one = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
                condition = one if condition is None else condition & one
            more = a.join(b, condition, "left_anti").select("a.*")
        new = cut(more)
        if new.isEmpty():
            return found
        found = found.unionAll(new)
    raise ValueError(f"the recursion didn't end in {rounds} rounds")


def limit_offset(df: DataFrame, limit: int | None, offset: int | None = None) -> DataFrame:
    """A null or negative limit is none, a negative offset is 0."""
    df = df.offset(offset) if offset and offset > 0 else df
    return df if limit is None or limit < 0 else df.limit(limit)


def not_in_value(left: DataFrame, key: str, values: DataFrame, column: str, name: str) -> DataFrame:
    """left with the three-valued result of key NOT IN values as 1, 0 or NULL: an empty set gives 1, a NULL among the values
    or as the key gives NULL where no match decides. One aggregate of the values and one semi-join-like lookup."""
    facts = values.agg(F.count("*").alias("__n"), F.count_if(F.col(column).isNull()).alias("__nulls"))
    hit = values.select(F.col(column).alias("__v")).filter("__v is not null").distinct().withColumn("__hit", F.lit(1))
    joined = left.join(hit, F.col(key) == F.col("__v"), "left").join(F.broadcast(facts))  # one row
    value = F.when(F.col("__n") == 0, 1).when(F.col(key).isNull(), None).when(F.col("__hit") == 1, 0).when(F.col("__nulls") > 0, None).otherwise(1)
    return joined.withColumn(name, value).drop("__v", "__hit", "__n", "__nulls")


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Correlated scalar lookup: of the matching right rows the first in order; NULL without one. One row a key is kept before the join."""
    one = right.groupBy(*on).agg(F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__r"))
    return left.join(one, on, "left").select(*[left[c] for c in left.columns], *[F.col(f"__r.{c}").alias(c) for c in columns])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, numeric: type = float) -> DataFrame:
    """Rows of left joined to the rows of right whose [low, high] holds point, by buckets of `width`: an equi-join on
    the bucket in place of a nested loop. Intervals are put into every bucket they touch; NULL bounds match nothing."""
    bucket = lambda c: F.floor(c / width).cast("bigint")
    many = right.filter(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return left.withColumn("__b", bucket(F.col(point))).join(many, "__b").filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__b")


def number_rows(df: DataFrame, order: list[str], name: str = "rowid") -> DataFrame:
    """Row numbers from 1 in order over any number of partitions: range partitions are counted, then numbered from their offsets."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    first = placed.groupBy("__p").agg(F.min("__i").alias("__from"), F.count("*").alias("__n"))
    offsets = first.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return placed.join(F.broadcast(offsets.drop("__n")), "__p").withColumn(name, F.col("__before") + F.col("__i") - F.col("__from") + 1).drop("__p", "__i", "__from", "__before")
