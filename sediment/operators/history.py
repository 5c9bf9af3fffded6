"""Row history and file events over versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.operators.snapshot_diff import consecutive
from sediment.runtime import small_or_not


def changed_rows(events: DataFrame, key: list[str], columns: list[str], generation: Column, late: Column) -> DataFrame:
    """(generation, op, *columns) from rows that left (late false) or arrived (late true) in a generation; rows that did both alike are none.

    One shuffle on (generation, key), pre-aggregated. Values are compared with NULLs as values.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    sides = events.groupBy(generation.alias("generation"), *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)]).agg(
        F.first(F.when(~late, row), ignorenulls=True).alias("old"), F.first(F.when(late, row), ignorenulls=True).alias("new")
    )
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return sides.select("generation", op.alias("op"), F.coalesce("new", "old").alias("r")).filter("op is not null").select("generation", "op", "r.*")


def row_history(versions: DataFrame, key: list[str], generation: str = "generation", known: list[int] | None = None) -> DataFrame:
    """insert, update and delete events of each key from full snapshots in one frame: (generation, op, *columns).

    known: all generation numbers, so that one in which the table holds no rows is seen too; by default those in the frame. Each row
    arrives in its own generation and leaves in the next one, so one shuffle brings the two sides of every change together.
    """
    columns = [c for c in versions.columns if c != generation]
    spark = versions.sparkSession
    if known is None:
        around = small_or_not(consecutive(versions.select(F.lit(1).alias("g"), generation), "g", generation).select(generation, "after"))
    else:
        numbers = sorted(known)
        around = small_or_not(spark.createDataFrame(list(zip(numbers, [*numbers[1:], None], strict=True)), f"`{generation}` int, after int"))
    marked = versions.join(around, generation).withColumn("__e", F.explode(F.array(F.struct(F.col(generation).alias("g"), F.lit(True).alias("late")), F.struct(F.col("after").alias("g"), F.lit(False).alias("late")))))
    found = changed_rows(marked.filter("__e.g is not null"), key, columns, F.col("__e.g"), F.col("__e.late"))
    return found.withColumnRenamed("generation", generation)


def file_timeline(files: DataFrame, path: str) -> DataFrame:
    """The versions of one path: (archive, generation, sha256, op) with op added or changed."""
    w = Window.partitionBy("archive").orderBy("generation")
    mine = files.filter(F.col("path") == path).select("archive", "generation", "sha256")
    return mine.withColumn("b", F.lag("sha256").over(w)).withColumn("op", F.when(F.row_number().over(w) == 1, "added").when(~F.col("sha256").eqNullSafe(F.col("b")), "changed")).filter("op is not null").drop("b")
