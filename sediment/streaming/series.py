"""Append-only time series with partitions, retention and incrementally mergeable rollups.

Times are nanoseconds since 1970 UTC. Rows are appended to a buffer; sealing sorts them into files by partition, feeds the rollups'
partial states and drops partitions past retention, all in one generation, so no row counts twice.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.dates import duration_ns
from sediment.sources.lake import ConstraintError, Lake, Table, UnsupportedError

DAY = 86_400 * 10**9
_SIZES = {"hour": 3600 * 10**9, "day": DAY}
#: Buffered rows at which an append seals (a fixed value), and files of a rollup's states at which a seal merges them.
SEAL_ROWS, ROLLUP_FILES = 1_048_576, 16


def partition_start(ns: Column, unit: str) -> Column:
    """Start of the hour, day, week (from Monday) or month, floored below 1970 as well."""
    if unit in _SIZES:
        return ns - F.pmod(ns, F.lit(_SIZES[unit]))
    if unit == "week":
        return ns - F.pmod(ns + F.lit(3 * DAY), F.lit(7 * DAY))
    day = F.call_function("div", ns - F.pmod(ns, F.lit(DAY)), F.lit(DAY))
    return F.unix_date(F.trunc(F.date_from_unix_date(day.cast("int")), "month")).cast("bigint") * DAY


def partition_end(start: Column, unit: str) -> Column:
    if unit in _SIZES:
        return start + _SIZES[unit]
    if unit == "week":
        return start + 7 * DAY
    day = F.date_from_unix_date(F.call_function("div", start, F.lit(DAY)).cast("int"))
    return F.unix_date(F.add_months(day, 1)).cast("bigint") * DAY


def start_of(ns: int, unit: str) -> int:
    """partition_start of one time, on the driver."""
    if unit in _SIZES:
        return ns - ns % _SIZES[unit]
    day = ns // DAY
    if unit == "week":
        return (day - (day + 3) % 7) * DAY
    epoch = datetime(1970, 1, 1)
    return ((epoch + timedelta(days=day)).replace(day=1) - epoch).days * DAY


@dataclass(frozen=True)
class Rollup:
    """Aggregates per bucket of `every` and group: name -> (function, column); count sum total avg min max first last."""

    name: str
    every: str
    groups: tuple[str, ...]
    aggregates: dict[str, tuple[str, str]]
    where: str = "true"
    retention: str | None = None

    def __post_init__(self):
        for f, _ in self.aggregates.values():
            if f not in ("count", "sum", "total", "avg", "min", "max", "first", "last"):
                raise UnsupportedError(f"{f} in a rollup")

    @property
    def columns(self) -> list[str]:
        return sorted({c for _, c in self.aggregates.values() if c != "*"})

    def states(self, rows: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
        """Partial states of rows: one line per bucket and group. Order of equal times is that of appending."""
        step = duration_ns(self.every)
        bucket = F.col(ts) - F.pmod(F.col(ts), F.lit(step))
        at = F.struct(F.col(ts), F.col(seq))
        out = [F.count("*").alias("n__")]
        for c in self.columns:
            x = F.col(c)
            known = F.when(x.isNotNull(), at)
            out += [F.count(x).alias(f"{c}__count"), F.sum(x).alias(f"{c}__sum"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
            out += [F.min(known).alias(f"{c}__first_at"), F.min_by(x, known).alias(f"{c}__first"), F.max(known).alias(f"{c}__last_at"), F.max_by(x, known).alias(f"{c}__last")]
        return rows.filter(F.expr(self.where)).groupBy(bucket.alias("bucket"), *self.groups).agg(*out)

    def merged(self, states: DataFrame) -> DataFrame:
        out = [F.sum("n__").alias("n__")]
        for c in self.columns:
            s = lambda k, c=c: F.col(f"{c}__{k}")
            out += [F.sum(s("count")).alias(f"{c}__count"), F.sum(s("sum")).alias(f"{c}__sum"), F.min(s("min")).alias(f"{c}__min"), F.max(s("max")).alias(f"{c}__max")]
            out += [F.min(s("first_at")).alias(f"{c}__first_at"), F.min_by(s("first"), s("first_at")).alias(f"{c}__first"), F.max(s("last_at")).alias(f"{c}__last_at"), F.max_by(s("last"), s("last_at")).alias(f"{c}__last")]
        return states.groupBy("bucket", *self.groups).agg(*out)

    def final(self, states: DataFrame) -> DataFrame:
        """avg is sum over count of the merged states, never an average of averages."""

        def one(f: str, c: str) -> Column:
            if c == "*":
                return F.col("n__")
            if f == "avg":
                return F.try_divide(F.col(f"{c}__sum").cast("double"), F.col(f"{c}__count").cast("double"))
            if f == "total":
                return F.coalesce(F.col(f"{c}__sum").cast("double"), F.lit(0.0))
            return F.col(f"{c}__{f}")

        return states.select("bucket", *self.groups, *[one(f, c).alias(n) for n, (f, c) in self.aggregates.items()])

    def of(self, rows: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
        return self.final(self.states(rows, ts, seq))


def _test(word: str, start: bool):
    return lambda t: t.startswith(word) if start else t == word


class Series:
    """A time series `name` on a lake: sealed rows, a buffer and its rollups are tables of the lake."""

    def __init__(self, lake: Lake, name: str, schema: str = "", unit: str = "day", retention: str | None = None, tags: tuple[str, ...] = (), seal_rows: int = SEAL_ROWS):
        self.lake, self.name = lake, name
        if f"{name}.sealed" not in lake.tables():
            options = {"unit": unit, "retention": retention, "tags": list(tags), "partition": "part", "seq": 0, "seal_rows": seal_rows}
            with lake._transaction(f"create series {name}"):
                lake.create(f"{name}.buffer", Table(f"{schema}, seq bigint", not_null=("ts",), kind="series"))
                lake.create(f"{name}.sealed", Table(f"{schema}, seq bigint, part bigint", kind="series", options=options))
        o = lake._entry(f"{name}.sealed")["options"]
        self.unit, self.retention, self.tags, self.seal_rows = o["unit"], o["retention"], o["tags"], o.get("seal_rows", SEAL_ROWS)

    def append(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Rows get their sequence numbers in `order`, by default that of time; a NULL time is a constraint error."""
        from sediment.operators.relational import number_rows

        numbered = number_rows(rows, order or ["ts"], "seq")
        e = self.lake._entry(f"{self.name}.sealed")
        base = self.lake.read(f"{self.name}.buffer").agg(F.max("seq")).first()[0] or e["options"]["seq"]
        added = self.lake.insert(f"{self.name}.buffer", numbered.withColumn("seq", F.col("seq") + base))
        if self.lake._staged is None and self.lake.read(f"{self.name}.buffer").count() >= self.seal_rows:
            self.seal()
        return added

    def update(self, *_: object) -> None:
        raise UnsupportedError("a series is append-only")

    delete = update

    def _sealed(self, generation: int | None = None) -> DataFrame:
        """Sealed rows of the partitions that retention has left; dropped ones aren't read."""
        name = f"{self.name}.sealed"
        floor = self.lake._entry(name, generation)["options"].get("floor")
        rows = self.lake.read(name, generation)
        return rows if floor is None else rows.filter(F.col("part") >= floor)

    def search(self, column: str, words: str, **bounds) -> DataFrame:
        """Rows within bounds (see rows) whose column holds all of the words; one that ends in * matches by its start."""
        from sediment.operators import fts

        out = self.rows(**bounds)
        found = fts.tokens(F.coalesce(F.col(column), F.lit("")))
        for w in words.split():
            start = w.endswith("*")
            for x in fts.words_of(w):
                out = out.filter(F.exists(found, _test(x, start)))
        return out

    def history(self) -> DataFrame:
        """HISTORY OF a series: every row with the generation that appended it; a series has inserts only."""
        first = {}
        for g in self.lake.generations():
            for p in self.lake.manifest(g)["tables"].get(f"{self.name}.buffer", {"paths": []})["paths"]:
                first.setdefault(p, g)
        entry = self.lake._entry(f"{self.name}.buffer")
        out = None
        for g in sorted(set(first.values())):
            one = self.lake._load(entry | {"paths": [p for p, at in first.items() if at == g]}).select(F.lit(g).alias("generation"), F.lit("insert").alias("op"), "*")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.lake._load(entry | {"paths": []}).select(F.lit(0).alias("generation"), F.lit("insert").alias("op"), "*")

    def drop(self) -> None:
        """DROP TIMESERIES: its rows and rollups."""
        with self.lake._transaction(f"drop series {self.name}"):
            for n in self.lake.tables():
                if n.startswith(f"{self.name}."):
                    self.lake.drop(n)

    def drop_rollup(self, name: str) -> None:
        self.lake.drop(f"{self.name}.{name}")

    def rows(self, start: int | None = None, end: int | None = None, buffer: bool = True, where: str | None = None, descending: bool | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Rows with start <= ts < end; the bounds also prune partitions. descending None leaves the order open."""
        sealed = self._sealed()
        if start is not None:
            sealed = sealed.filter((F.col("part") >= start_of(start, self.unit)) & (F.col("ts") >= start))
        if end is not None:
            sealed = sealed.filter((F.col("part") <= start_of(end, self.unit)) & (F.col("ts") < end))
        out = sealed.drop("part")
        if buffer:
            held = self.lake.read(f"{self.name}.buffer")
            held = held.filter(F.col("ts") >= start) if start is not None else held
            held = held.filter(F.col("ts") < end) if end is not None else held
            out = out.unionByName(held)
        if where:
            out = out.filter(where)
        if descending is not None:
            out = out.orderBy(F.desc("ts"), F.desc("seq")) if descending else out.orderBy("ts", "seq")
        out = out.limit(limit) if limit is not None else out
        return out.select(*columns) if columns else out

    def rollups(self) -> list[Rollup]:
        found = []
        for n, e in (self.lake._base or self.lake.manifest())["tables"].items():
            if e["kind"] == "rollup" and e["options"]["series"] == self.name:
                o = e["options"]
                found.append(Rollup(n.split(".")[-1], o["every"], tuple(o["groups"]), {k: tuple(v) for k, v in o["aggregates"].items()}, o["where"], o["retention"]))
        return found

    def create_rollup(self, rollup: Rollup) -> None:
        """Filled from sealed rows; buffered ones join at read."""
        states = rollup.states(self.rows(buffer=False))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in states.schema)
        options = {"series": self.name, "every": rollup.every, "groups": list(rollup.groups), "aggregates": {k: list(v) for k, v in rollup.aggregates.items()}, "where": rollup.where, "retention": rollup.retention}
        self.lake.create(f"{self.name}.{rollup.name}", Table(schema, kind="rollup", options=options), states)

    def rollup(self, name: str, now_ns: int | None = None) -> DataFrame:
        """Stored states merged with those of the buffer; buckets past the rollup's retention are hidden."""
        r = next((x for x in self.rollups() if x.name == name), None)
        if r is None:
            raise UnsupportedError(f"no rollup {name}")
        stored = self.lake.read(f"{self.name}.{name}")
        merged = r.merged(stored.unionByName(r.states(self.lake.read(f"{self.name}.buffer"))))
        if r.retention:
            merged = merged.filter(F.col("bucket") >= (now_ns or time.time_ns()) - duration_ns(r.retention))
        return r.final(merged)

    def seal(self, now_ns: int | None = None) -> None:
        """Buffer into partitioned files, states into the rollups, old partitions dropped: one generation.

        Only the buffer is read: its states are appended to a rollup's files, which are merged when read and now and then. A partition whose
        end is at or before now less retention is dropped by a floor in the definition; its files go with the next vacuum.
        """
        lake, now = self.lake, now_ns or time.time_ns()
        with lake._transaction(f"seal {self.name}") as staged:
            sealed, buffer = lake._entry(f"{self.name}.sealed"), lake._entry(f"{self.name}.buffer")
            held = lake.read(f"{self.name}.buffer")
            options = dict(sealed["options"])
            for r in self.rollups():
                e = lake._entry(f"{self.name}.{r.name}")
                new = [lake._write(r.states(held))]
                if len(e["paths"]) >= ROLLUP_FILES:
                    merged = r.merged(lake._load(e | {"paths": [*e["paths"], *new]}))
                    if r.retention:
                        merged = merged.filter(F.col("bucket") >= now - duration_ns(r.retention))
                    staged[f"{self.name}.{r.name}"] = e | {"paths": [lake._write(merged)]}
                else:
                    staged[f"{self.name}.{r.name}"] = e | {"paths": [*e["paths"], *new]}
            placed = held.withColumn("part", partition_start(F.col("ts"), self.unit))
            if self.retention:
                options["floor"] = max(options.get("floor") or start_of(now - duration_ns(self.retention), self.unit), start_of(now - duration_ns(self.retention), self.unit))
                placed = placed.filter(F.col("part") >= options["floor"])
            options["seq"] = max(held.agg(F.max("seq")).first()[0] or 0, options["seq"])
            path = lake._write(placed.repartition("part").sortWithinPartitions("part", "ts", "seq"), ["part"])
            staged[f"{self.name}.sealed"] = sealed | {"paths": [*sealed["paths"], path], "options": options}
            staged[f"{self.name}.buffer"] = buffer | {"paths": []}

    def stats(self) -> DataFrame:
        return self.rows(buffer=False).agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn("buffered", F.lit(self.lake.read(f"{self.name}.buffer").count()))


def append_stream(stream: DataFrame, series: Series, checkpoint: str):
    """Feeds a streaming frame into a series batch by batch. Late rows are never dropped: they go to their own partition at the next seal.

    A batch repeated after a failure isn't taken twice: its number is kept with the series' options, in the generation of its rows.
    """

    def batch(df: DataFrame, number: int) -> None:
        name = f"{series.name}.sealed"
        entry = series.lake._entry(name)
        if entry["options"].get("batch", -1) >= number:
            return
        with series.lake._transaction(f"append batch {number} to {series.name}") as staged:
            if not df.isEmpty():
                series.append(df)
            staged[name] = entry | {"options": entry["options"] | {"batch": number}}

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def tumbling(stream: DataFrame, ts: str, width: str, groups: list[str], value: str) -> DataFrame:
    """Counts and sums per window and group of a streaming or static frame, without dropping late rows."""
    return stream.groupBy(F.window(ts, width).alias("w"), *groups).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("bucket"), *groups, "n", "total")


__all__ = ["ConstraintError", "Rollup", "Series", "append_stream", "partition_end", "partition_start", "tumbling"]
