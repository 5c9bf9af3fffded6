"""A versioned store of tables: Parquet files per table version and one manifest entry per generation.

A transaction reads one generation from its begin to its end and stages files; a commit claims the next generation by creating a
file that mustn't be there, refuses if another writer has changed one of its tables since, then publishes the manifest by a rename.
Everything goes through Hadoop's file system API, so any shared storage works.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators.history import changed_rows
from sediment.runtime import small_or_not

#: A claim of a generation that is older without a manifest was left by a writer that died.
STALE_S = 600


class EngineError(Exception):
    """kind: syntax, constraint, unsupported, busy, readOnly, notFound or corrupt."""

    kind = "corrupt"


class ConstraintError(EngineError):
    kind = "constraint"


class NotFoundError(EngineError):
    kind = "notFound"


class UnsupportedError(EngineError):
    kind = "unsupported"


class BusyError(EngineError):
    kind = "busy"


@dataclass
class Table:
    """A table's definition: key columns are unique and not null, unique ones are but for NULLs; checks are SQL conditions that pass on
    NULL; defaults are SQL expressions for columns that inserted rows lack."""

    schema: str
    key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    defaults: dict[str, str] | None = None
    kind: str = "table"
    options: dict | None = None


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_manifest"))
        self._staged: dict[str, dict | None] | None = None
        self._base: dict | None = None
        self.changes = self.total_changes = 0
        #: The rows of the last insert, update or delete, for RETURNING.
        self.returned: DataFrame | None = None

    # -- manifest ---------------------------------------------------------------------------------------------------

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def generations(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._path(f"{self.root}/_manifest")) if s.getPath().getName().endswith(".json"))

    def manifest(self, generation: int | None = None, time_ns: int | None = None) -> dict:
        """The newest manifest, that of a generation, or the last one at a time; an error if there is none."""
        known = self.generations()
        if generation is not None:
            if generation not in known:
                raise NotFoundError(f"no generation {generation}")
            return self._read(f"{self.root}/_manifest/{generation:012d}.json")
        if time_ns is not None:
            lo, hi, found = 0, len(known), None
            while lo < hi:  # times don't go back
                mid = (lo + hi) // 2
                m = self._read(f"{self.root}/_manifest/{known[mid]:012d}.json")
                if m["time_ns"] <= time_ns:
                    lo, found = mid + 1, m
                else:
                    hi = mid
            if found is None:
                raise NotFoundError("no generation at that time")
            return found
        return self._read(f"{self.root}/_manifest/{known[-1]:012d}.json") if known else {"generation": 0, "time_ns": 0, "comment": "", "tables": {}}

    def begin(self) -> None:
        if self._staged is not None:
            raise BusyError("a transaction is open")
        self._staged, self._base = {}, self.manifest()

    def rollback(self) -> None:
        self._staged = self._base = None

    def commit(self, comment: str = "", time_ns: int | None = None) -> int:
        """Publishes what is staged as one generation; nothing staged makes none. BusyError if another writer has changed, made or
        dropped one of the staged tables since the transaction began; then nothing is published."""
        staged, base = self._staged, self._base
        self._staged = self._base = None
        last = self.manifest()
        if not staged:
            return last["generation"]
        tables = dict(last["tables"])
        for name, entry in staged.items():
            if tables.get(name) != base["tables"].get(name):
                raise BusyError(f"another writer changed {name}")
            if entry is None:
                tables.pop(name, None)
            else:
                tables[name] = entry
        g = last["generation"] + 1
        body = {"generation": g, "time_ns": max(time_ns or time.time_ns(), last["time_ns"]), "comment": comment, "tables": tables}
        temp, claim, target = (self._path(f"{self.root}/_manifest/{n}") for n in (f"_{uuid.uuid4().hex}", f"_claim_{g:012d}", f"{g:012d}.json"))
        self._claim(claim, target)
        try:
            if self._fs.exists(target):
                raise BusyError("another writer committed first")
            out = self._fs.create(temp)
            out.write(bytearray(json.dumps(body).encode()))
            out.close()
            if not self._fs.rename(temp, target):
                self._fs.delete(temp, False)
                raise BusyError("another writer committed first")
        finally:
            self._fs.delete(claim, False)
        return g

    def _claim(self, claim, target) -> None:
        """Creates a file that mustn't exist: the one step that a store does for one writer only."""
        for last_try in (False, True):
            try:
                self._fs.create(claim, False).close()
                return
            except Exception as e:  # the store's own exception, by Py4J
                if last_try or not self._fs.exists(claim) or time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 < STALE_S:
                    raise BusyError("another writer commits") from e
                self._fs.delete(claim, False)

    @contextmanager
    def _transaction(self, comment: str, time_ns: int | None = None) -> Iterator[dict[str, dict | None]]:
        """What is staged; a transaction of its own unless one is open. An error stages nothing of this statement."""
        if self._staged is not None:
            held = dict(self._staged)
            try:
                yield self._staged
            except BaseException:
                self._staged = held
                raise
            return
        self.begin()
        try:
            yield self._staged
        except BaseException:
            self.rollback()
            raise
        self.commit(comment, time_ns)

    def _entry(self, name: str, generation: int | None = None, time_ns: int | None = None) -> dict:
        if generation is not None or time_ns is not None or self._staged is None:
            entry = self.manifest(generation, time_ns)["tables"].get(name)
        else:
            entry = self._staged.get(name) if name in self._staged else self._base["tables"].get(name)
        if entry is None:
            raise NotFoundError(f"no such table: {name}")
        return entry

    def _write(self, df: DataFrame, partition: list[str] | None = None, codec: str | None = None) -> str:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        w = df.write.option("compression", codec or "zstd")
        (w.partitionBy(*partition) if partition else w).parquet(path)
        return path

    # -- tables -----------------------------------------------------------------------------------------------------

    def create(self, name: str, table: Table, df: DataFrame | None = None, time_ns: int | None = None) -> None:
        with self._transaction(f"create {name}", time_ns) as staged:
            if name in self.tables():
                raise ConstraintError(f"table {name} already exists")
            entry = {
                "schema": table.schema, "key": list(table.key), "not_null": list(table.not_null), "checks": list(table.checks), "unique": [list(u) for u in table.unique],
                "defaults": table.defaults or {}, "kind": table.kind, "options": table.options or {}, "paths": [],
            }
            if df is not None:
                entry["paths"] = [self._write(self._typed(df, entry))]
                self._check(name, entry, self._load(entry))
            staged[name] = entry

    def drop(self, name: str) -> None:
        with self._transaction(f"drop {name}") as staged:
            self._entry(name)
            staged[name] = None

    def tables(self) -> list[str]:
        names = set((self._base or self.manifest())["tables"])
        for n, e in (self._staged or {}).items():
            names = names - {n} if e is None else names | {n}
        return sorted(names)

    def _typed(self, df: DataFrame, entry: dict) -> DataFrame:
        schema = T._parse_datatype_string(entry["schema"])
        other = entry.get("defaults", {})
        return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.expr(other[f.name]) if f.name in other else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _load(self, entry: dict) -> DataFrame:
        schema = T._parse_datatype_string(entry["schema"])
        if not entry["paths"]:
            return self.spark.createDataFrame([], schema)
        if entry.get("options", {}).get("partition") and len(entry["paths"]) > 1:
            parts = [self.spark.read.schema(schema).parquet(p) for p in entry["paths"]]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        return self.spark.read.schema(schema).parquet(*entry["paths"])

    def read(self, name: str, generation: int | None = None, time_ns: int | None = None) -> DataFrame:
        """The table now, AS OF a generation, or AS OF a time, with the schema of that generation."""
        return self._load(self._entry(name, generation, time_ns))

    def _check(self, name: str, entry: dict, new: DataFrame, old: DataFrame | None = None) -> None:
        """All constraints of new rows in one aggregate, uniqueness in one grouped by the key; nothing is published if one fails.

        old, the rows that stay, is only looked at for equal keys: by a semi join that doesn't shuffle it where the new rows are few.
        """
        filled = [*entry["not_null"], *entry["key"]]
        tests = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(filled)]
        tests += [F.count_if(~F.coalesce(F.expr(c).cast("boolean"), F.lit(True))).alias(f"c{i}") for i, c in enumerate(entry["checks"])]
        if tests:
            row = new.agg(*tests).first()
            for i, c in enumerate(filled):
                if row[f"n{i}"]:
                    raise ConstraintError(f"NOT NULL constraint failed: {name}.{c}")
            for i, c in enumerate(entry["checks"]):
                if row[f"c{i}"]:
                    raise ConstraintError(f"CHECK constraint failed: {c}")
        for unique in [entry["key"]] * bool(entry["key"]) + entry.get("unique", []):
            keys = new.select(*unique).dropna()
            twice = not keys.groupBy(*unique).count().filter("count > 1").isEmpty()
            if twice or (old is not None and not old.select(*unique).join(small_or_not(keys), unique, "left_semi").isEmpty()):
                raise ConstraintError("UNIQUE constraint failed: " + ", ".join(f"{name}.{c}" for c in unique))

    def _replace(self, name: str, entry: dict, df: DataFrame, comment: str, time_ns: int | None) -> None:
        """The table's rows are df from now on."""
        with self._transaction(comment, time_ns) as staged:
            new = entry | {"paths": [self._write(self._typed(df, entry))]}
            self._check(name, new, self._load(new))
            staged[name] = new

    def _count(self, n: int, rows: DataFrame | None) -> int:
        self.changes, self.returned = n, rows
        self.total_changes += n
        return n

    def insert(self, name: str, rows: DataFrame, conflict: str = "abort", time_ns: int | None = None) -> int:
        """Appends rows; columns that they lack get their defaults. conflict: abort raises, ignore keeps the rows there, replace takes the
        new ones, on equal keys.

        Of several new rows with one key, ignore keeps the first by row order given in a column __order if there is one, replace the
        last; without it, by their values. Only the new rows are checked; replace rewrites the files.
        """
        with self._transaction(f"insert into {name}", time_ns) as staged:
            entry = self._entry(name)
            key = entry["key"]
            new = self._typed(rows, entry)
            old = self._load(entry)
            if conflict != "abort" and key:
                body = F.struct(*[F.col(c) for c in old.columns])
                order = F.col("__order") if "__order" in rows.columns else F.lit(0)
                pick = (F.max if conflict == "replace" else F.min)(F.struct(order.alias("o"), body.alias("r")))
                kept = self._typed(rows, entry) if "__order" not in rows.columns else self._typed(rows, entry | {"schema": entry["schema"] + ", __order bigint"})
                new = kept.groupBy(*key).agg(pick.alias("__r")).select("__r.r.*")
                if conflict == "ignore":
                    new = new.join(old.select(*key), key, "left_anti").select(*old.columns)
            path = self._write(new)
            written = self.spark.read.schema(new.schema).parquet(path)
            n = written.count()
            if n:
                if conflict == "replace" and key:
                    rest = old.join(small_or_not(written.select(*key)), key, "left_anti").select(*old.columns)
                    gone = self._write(rest) if entry["paths"] else None
                    self._check(name, entry | {"unique": []}, written)
                    staged[name] = entry | {"paths": [p for p in (gone, path) if p]}
                else:
                    self._check(name, entry, written, old if entry["paths"] else None)
                    staged[name] = entry | {"paths": [*entry["paths"], path]}
            return self._count(n, written)

    def upsert(self, name: str, rows: DataFrame, set_: dict[str, str] | None, where: str = "true", time_ns: int | None = None) -> int:
        """INSERT ... ON CONFLICT DO UPDATE: set_ and where are SQL over the old columns (t.*) and excluded.*; set_ None: DO NOTHING.

        Of several new rows with one key the last by a column __order counts, without it the largest by their values. Rows that
        where leaves alone don't count as changes.
        """
        with self._transaction(f"upsert into {name}", time_ns) as staged:
            entry = self._entry(name)
            key = entry["key"]
            if not key:
                raise UnsupportedError("upsert without a key")
            typed = self._typed(rows, entry if "__order" not in rows.columns else entry | {"schema": entry["schema"] + ", __order bigint"})
            old = self._load(entry)
            order = F.col("__order") if "__order" in rows.columns else F.lit(0)
            new = typed.groupBy(*key).agg(F.max(F.struct(order.alias("o"), F.struct(*old.columns).alias("r"))).alias("__r")).select("__r.r.*")
            joined = old.withColumn("__old", F.lit(True)).alias("t").join(new.withColumn("__new", F.lit(True)).alias("excluded"), [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in key], "full_outer")
            hit = F.col("__old").isNotNull() & F.col("__new").isNotNull()
            take = hit & (F.coalesce(F.expr(where), F.lit(False)) if set_ is not None else F.lit(False))
            types = dict(old.dtypes)
            out = [
                F.when(take, F.expr(set_[c]).cast(types[c]) if set_ and c in set_ else F.col(f"t.{c}")).when(F.col("__old").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"excluded.{c}")).alias(c)
                for c in old.columns
            ]
            path = self._write(joined.select(*out, (take | F.col("__old").isNull()).alias("__changed")))
            done = self.spark.read.parquet(path)
            changed = done.filter("__changed").drop("__changed")
            n = changed.count()
            if n:
                self._replace(name, entry, done.drop("__changed"), "", None)
            return self._count(n, changed)

    def update(self, name: str, set_: dict[str, str], where: str = "true", time_ns: int | None = None, source: DataFrame | None = None, alias: str = "source") -> DataFrame:
        """UPDATE; returns the new rows (RETURNING). With source (UPDATE ... FROM), set_ and where may name its columns by `alias`; of
        several rows of it that fit one row, the one with the smallest values counts. The table needs a key then."""
        with self._transaction(f"update {name}", time_ns):
            entry = self._entry(name)
            old = self._load(entry)
            types = dict(old.dtypes)
            if source is None:
                hit = F.coalesce(F.expr(where).cast("boolean"), F.lit(False))
                done = old.withColumn("__hit", hit).select(*[(F.when(F.col("__hit"), F.expr(set_[c]).cast(types[c])).otherwise(F.col(c)) if c in set_ else F.col(c)).alias(c) for c in old.columns], "__hit")
            else:
                key = entry["key"]
                if not key:
                    raise UnsupportedError("update from without a key")
                values = F.struct(*[F.expr(set_[c]).cast(types[c]).alias(c) for c in set_])
                found = old.alias(name).join(source.alias(alias), F.expr(where)).groupBy(*[F.col(f"{name}.{k}").alias(k) for k in key]).agg(F.min(values).alias("__v"))
                both = old.join(found, key, "left")
                done = both.select(*[(F.when(F.col("__v").isNotNull(), F.col(f"__v.{c}")).otherwise(F.col(c)) if c in set_ else F.col(c)).alias(c) for c in old.columns], F.col("__v").isNotNull().alias("__hit"))
            path = self._write(done)
            written = self.spark.read.parquet(path)
            new = written.filter("__hit").drop("__hit")
            if self._count(new.count(), new):
                self._replace(name, entry, written.drop("__hit"), "", None)
            return new

    def delete(self, name: str, where: str = "true", time_ns: int | None = None) -> DataFrame:
        """DELETE; returns the old rows (RETURNING). Without a condition no row is rewritten."""
        with self._transaction(f"delete from {name}", time_ns) as staged:
            entry = self._entry(name)
            old = self._load(entry)
            hit = F.coalesce(F.expr(where).cast("boolean"), F.lit(False))
            gone = old.filter(hit)
            if self._count(gone.count(), gone):
                staged[name] = entry | {"paths": [] if where == "true" else [self._write(old.filter(~hit))]}
            return gone

    def alter(self, name: str, rename: str | None = None, add: str | None = None, drop: str | None = None, rename_column: tuple[str, str] | None = None, options: dict | None = None) -> None:
        """ALTER TABLE; a column that is part of the key, unique or in a check can't be dropped."""
        with self._transaction(f"alter {name}") as staged:
            entry = dict(self._entry(name))
            schema = T._parse_datatype_string(entry["schema"])
            listed = lambda fields: ", ".join(f"`{n}` {t}" for n, t in fields)
            if drop:
                if drop not in schema.names:
                    raise NotFoundError(f"no such column: {drop}")
                if drop in entry["key"] or any(drop in u for u in entry.get("unique", [])):
                    raise ConstraintError(f"cannot drop key column {drop}")
                if any(re.search(rf"\b{re.escape(drop)}\b", c) for c in entry["checks"]):
                    raise ConstraintError(f"cannot drop column {drop} of a check")
                entry["schema"] = listed((f.name, f.dataType.simpleString()) for f in schema if f.name != drop)
                entry["not_null"] = [c for c in entry["not_null"] if c != drop]
            if add:
                entry["schema"] = f"{entry['schema']}, {add}"
            if rename_column:
                a, b = rename_column
                df = self._load(entry).withColumnRenamed(a, b)
                entry["schema"] = listed((b if f.name == a else f.name, f.dataType.simpleString()) for f in schema)
                swap = lambda cs: [b if c == a else c for c in cs]
                entry |= {"key": swap(entry["key"]), "not_null": swap(entry["not_null"]), "unique": [swap(u) for u in entry.get("unique", [])]}
                entry["paths"] = [self._write(df)]
            if options:
                entry["options"] = entry["options"] | options
            if rename:
                if rename in self.tables():
                    raise ConstraintError(f"table {rename} already exists")
                staged[name] = None
            staged[rename or name] = entry

    # -- history ----------------------------------------------------------------------------------------------------

    def _changes(self, name: str) -> list[tuple[int, int, dict | None]]:
        """(generation, time, entry) of each generation in which the table's files changed, it was made or dropped."""
        out: list[tuple[int, int, dict | None]] = []
        last: dict | None = None
        for g in self.generations():
            m = self.manifest(g)
            entry = m["tables"].get(name)
            if (entry or {}).get("paths") != (last or {}).get("paths") or (entry is None) != (last is None):
                out.append((g, m["time_ns"], entry))
            last = entry
        if not any(e for _, _, e in out):
            raise NotFoundError(f"no such table: {name}")
        return out

    def history(self, name: str) -> DataFrame:
        """HISTORY OF a keyed table: (generation, time_ns, op, *columns).

        Files that two generations share can't hold an event, so each file is read once: its rows arrive in the generation that
        first names it and leave in the one that no longer does. Columns are those of the newest definition.
        """
        changes = self._changes(name)
        entry = next(e for _, _, e in reversed(changes) if e is not None)
        key = entry["key"]
        if not key:
            raise UnsupportedError("history of a table without a key")
        life: dict[str, list[int | None]] = {}
        before: set[str] = set()
        for g, _, e in changes:
            now = set(e["paths"]) if e else set()
            for p in now - before:
                life[p] = [g, None]
            for p in before - now:
                life[p][1] = g
            before = now
        schema = T._parse_datatype_string(entry["schema"])
        columns = [f.name for f in schema]
        empty = ", ".join(["generation int", "time_ns bigint", "op string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in schema]])
        if not life:
            return self.spark.createDataFrame([], empty)
        spans = self.spark.createDataFrame([(p.rsplit("/", 1)[1], *v) for p, v in life.items()], "__file string, __in int, __out int")  # one row a commit
        rows = self.spark.read.schema(schema).parquet(*life).select(*columns, F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]+)/", 1).alias("__file"))
        events = rows.join(small_or_not(spans), "__file").withColumn("__e", F.explode(F.array(F.struct(F.col("__in").alias("generation"), F.lit(True).alias("late")), F.struct(F.col("__out").alias("generation"), F.lit(False).alias("late")))))
        times = self.spark.createDataFrame([(g, t) for g, t, _ in changes], "generation int, time_ns bigint")  # one row a commit
        found = changed_rows(events.filter("__e.generation is not null"), key, columns, F.col("__e.generation"), F.col("__e.late"))
        return found.join(small_or_not(times), "generation").select("generation", "time_ns", "op", *columns)

    def generation_table(self) -> DataFrame:
        rows = [(g, (m := self.manifest(g))["time_ns"], m["comment"], len(m["tables"])) for g in self.generations()]
        return self.spark.createDataFrame(rows, "number int, time_ns bigint, comment string, tables int")

    def schema_table(self) -> DataFrame:
        """type, name, tbl_name and definition of every table."""
        entries = self.manifest()["tables"]
        return self.spark.createDataFrame([(e["kind"], n, n, f"CREATE TABLE {n} ({e['schema']})") for n, e in sorted(entries.items())], "type string, name string, tbl_name string, sql string")

    def table_info(self, name: str) -> DataFrame:
        e = self._entry(name)
        fields = T._parse_datatype_string(e["schema"])
        rows = [(i, f.name, f.dataType.simpleString(), int(f.name in e["not_null"]), e["key"].index(f.name) + 1 if f.name in e["key"] else 0) for i, f in enumerate(fields)]
        return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, pk int")

    def vacuum(self, keep: int = 1, compact: bool = True) -> int:
        """Keeps the newest generations, compacts tables of many files, removes files no kept generation names; returns files removed."""
        if compact:
            for n, e in self.manifest()["tables"].items():
                if len(e["paths"]) > 4:
                    df = self._load(e)
                    parts = e["options"].get("partition")
                    with self._transaction(f"compact {n}") as staged:
                        staged[n] = e | {"paths": [self._write(df, [parts] if parts else None)]}
        known = self.generations()
        for g in known[: max(0, len(known) - keep)]:
            self._fs.delete(self._path(f"{self.root}/_manifest/{g:012d}.json"), False)
        used = {p.rsplit("/", 1)[1] for g in self.generations() for e in self.manifest(g)["tables"].values() for p in e["paths"]}
        removed = 0
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)
                removed += 1
        return removed
