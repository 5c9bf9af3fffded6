"""Key-value stores with expiry on the versioned store: an ordered map of bytes to bytes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions.dates import duration_ns
from sediment.runtime import small_or_not
from sediment.sources.lake import Lake, Table


class KeyValue:
    def __init__(self, lake: Lake, name: str, ttl: str | None = None):
        self.lake, self.name = lake, name
        if name not in lake.tables():
            lake.create(name, Table("key binary, value binary, expires bigint", key=("key",), kind="kv", options={"ttl": ttl}))
        self.ttl = lake._entry(name)["options"].get("ttl")

    def _live(self, now_ms: int | None = None, generation: int | None = None) -> DataFrame:
        now = F.lit(now_ms if now_ms is not None else time.time_ns() // 1_000_000)
        return self.lake.read(self.name, generation).filter(F.col("expires").isNull() | (F.col("expires") > now))

    def put(self, rows: DataFrame, ttl: str | None = None, now_ms: int | None = None) -> int:
        """Rows (key, value[, expires]) in one generation; a key there is overwritten. expires is in milliseconds; without that column
        the entries live for ttl, else the store's own, else for ever."""
        if "expires" in rows.columns:
            return self.lake.insert(self.name, rows, conflict="replace")
        life = ttl or self.ttl
        at = now_ms if now_ms is not None else time.time_ns() // 1_000_000
        expires = F.lit(at + duration_ns(life) // 1_000_000) if life else F.lit(None)
        return self.lake.insert(self.name, rows.withColumn("expires", expires.cast("bigint")), conflict="replace")

    def delete(self, keys: DataFrame) -> int:
        with self.lake._transaction(f"delete from {self.name}"):
            old = self.lake.read(self.name)
            gone = small_or_not(keys.select("key").distinct())
            n = old.join(gone, "key", "left_semi").count()
            if n:
                self.lake._replace(self.name, self.lake._entry(self.name), old.join(gone, "key", "left_anti"), "", None)
        return n

    def drop(self) -> None:
        """DROP KV STORE."""
        self.lake.drop(self.name)

    def get(self, key: bytes, now_ms: int | None = None) -> bytes | None:
        row = self._live(now_ms).filter(F.col("key") == F.lit(key)).select("value").first()
        return None if row is None else bytes(row[0])

    def scan(self, prefix: bytes | None = None, start: bytes | None = None, end: bytes | None = None, reverse: bool = False, limit: int | None = None, now_ms: int | None = None, generation: int | None = None) -> DataFrame:
        """Live entries with start <= key < end and the prefix, in order of key; prefixes reach the scan as a range."""
        df = self._live(now_ms, generation)
        if prefix:
            after = prefix.rstrip(b"\xff")
            start = max(prefix, start) if start else prefix
            if after:
                stop = after[:-1] + bytes([after[-1] + 1])
                end = min(stop, end) if end else stop
        if start:
            df = df.filter(F.col("key") >= F.lit(start))
        if end:
            df = df.filter(F.col("key") < F.lit(end))
        df = df.orderBy(F.desc("key") if reverse else F.asc("key"))
        return df if limit is None else df.limit(limit)

    def purge(self, now_ms: int | None = None) -> int:
        """Drops expired entries for good."""
        now = now_ms if now_ms is not None else time.time_ns() // 1_000_000
        return self._purged(now)

    def _purged(self, now: int) -> int:
        self.lake.delete(self.name, f"expires <= {now}")
        return self.lake.changes

    def watch(self, prefix: bytes, since: int) -> DataFrame:
        """Changes of keys with the prefix after a generation: (generation, op, key, value)."""
        events = self.lake.history(self.name).filter(F.col("generation") > since)
        return events.filter(F.col("key").substr(1, len(prefix)) == F.lit(prefix)).select("generation", "op", "key", "value")


def as_table(df: DataFrame) -> DataFrame:
    """Entries with keys and values as text where they are UTF-8, else as hex."""
    text = lambda c: F.when(F.is_valid_utf8(F.col(c).cast("string")), F.col(c).cast("string")).otherwise(F.hex(c)).alias(c)
    return df.select(text("key"), text("value"), "expires")
