"""What changed between consecutive full snapshots of a keyed table.

Rows are range-partitioned by (group, key), so every snapshot of one key range meets in one partition, whatever the size
of a group. There the key-sorted rows are cut into content-defined chunks: a key whose hash ends in zeros starts one.
A chunk whose digest is the same in two consecutive snapshots is discarded unread; only the rows of unmatched chunks
go on to the join that classifies them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.runtime import cut, small_or_not

#: A chunk has this many keys on average.
CHUNK_KEYS = 32
#: Rows that the chunker gathers before it looks for a boundary.
BLOCK_ROWS = 60_000


def consecutive(df: DataFrame, group: str, version: str) -> DataFrame:
    """(group, version, before, after): the versions that really hold rows, each with its neighbours."""
    w = Window.partitionBy(group).orderBy(version)
    return df.select(group, version).distinct().withColumns({"before": F.lag(version).over(w), "after": F.lead(version).over(w)})


def unmatched_chunks(rows: DataFrame, values: str) -> DataFrame:
    """Of (group, key, version, before, after, loaded, h1, h2, anchor, *values): rows of chunks that differ from a neighbour.

    One shuffle, by range. The result's `version` is the later snapshot of the pair and `late` tells the side.
    """
    names = [n.split()[0] for n in values.split(", ")]
    order = [F.col("group"), F.col("key"), F.col("version"), F.col("loaded").desc_nulls_last(), F.col("h1"), F.col("h2")]
    placed = rows.repartitionByRange(F.col("group"), F.col("key")).sortWithinPartitions(*order)
    out = pa.schema([("group", pa.string()), ("key", pa.string()), ("version", pa.int64()), ("late", pa.bool_()), *((n, rows_type(rows, n)) for n in names)])

    def codes(column: pa.ChunkedArray) -> np.ndarray:
        """Where a sorted column's value differs from the row before."""
        a = column.combine_chunks()
        return np.concatenate([[True], pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)]) if len(a) else np.zeros(0, bool)

    def differ(t: pa.Table) -> Iterator[pa.RecordBatch]:
        new_group = codes(t["group"])
        new_key = new_group | codes(t["key"])
        version, before, after = (t[c].fill_null(-1).to_numpy() if c != "version" else t[c].to_numpy() for c in ("version", "before", "after"))
        first = new_key | np.concatenate([[True], version[1:] != version[:-1]])  # the latest delivery of a key in a version
        chunk = np.cumsum(new_group | (new_key & t["anchor"].to_numpy(zero_copy_only=False)))
        keep = np.flatnonzero(first)
        chunk, version, before, after = chunk[keep], version[keep], before[keep], after[keep]
        digests = {}
        order = np.lexsort((version, chunk))
        c, v = chunk[order], version[order]
        starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (v[1:] != v[:-1])]))
        with np.errstate(over="ignore"):
            sums = [np.add.reduceat(t[h].to_numpy()[keep][order].view(np.uint64), starts) for h in ("h1", "h2")]
        digests = dict(zip(zip(c[starts].tolist(), v[starts].tolist(), strict=True), zip(*(s.tolist() for s in sums), strict=True), strict=True))
        of = np.zeros(len(keep), np.int64)
        of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keep))))
        heads = order[starts]
        for late, other in ((False, after), (True, before)):
            # one comparison for each chunk and version, not for each row
            differs = np.fromiter(
                (o >= 0 and digests.get((int(a), int(o))) != digests[int(a), int(b)] for a, b, o in zip(c[starts], v[starts], other[heads], strict=True)),
                bool,
                len(starts),
            )
            at = np.flatnonzero(differs[of])
            if len(at):
                part = t.take(pa.array(keep[at]))
                pair = version[at] if late else after[at]
                columns = [part["group"], part["key"], pa.array(pair, pa.int64()), pa.array(np.full(len(at), late)), *(part[n] for n in names)]
                yield from pa.table(dict(zip(out.names, columns, strict=True)), schema=out).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < BLOCK_ROWS:
                continue
            t = pa.Table.from_batches(held)
            starts = np.flatnonzero(codes(t["group"]) | (codes(t["key"]) & t["anchor"].to_numpy(zero_copy_only=False)))
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                yield from differ(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                n = t.num_rows - cut
        if n:
            yield from differ(pa.Table.from_batches(held))

    return placed.mapInArrow(run, f"group string, key string, version bigint, late boolean, {values}")


def rows_type(df: DataFrame, name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[dict(df.dtypes)[name]]


def snapshot_changes(df: DataFrame, group: str, version: str, key: str, loaded: str, size: str, digest: str, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """(group, version, key, op) of every key added, removed or changed since the group's previous snapshot.

    op 'changed': both digests are known and differ, or one is missing and both sizes are known and differ. Of several
    rows with one (group, version, key) the one with the latest loaded counts (null loaded last; ties: any, the same
    each time). Rows with a null group, version or key belong to no snapshot. The first snapshot of a group gives no rows; a missing
    version number doesn't count as a snapshot. Keys are compared byte by byte. An empty table gives no rows.
    """
    rows = df.select(
        F.col(group).cast("string").alias("group"), F.col(key).cast("string").alias("key"), F.col(version).cast("bigint").alias("version"),
        F.unix_micros(F.col(loaded).cast("timestamp")).alias("loaded"), F.col(size).cast("bigint").alias("size"), F.col(digest).cast("binary").alias("digest"),
    ).filter("group is not null and key is not null and version is not null")
    versions = small_or_not(cut(consecutive(rows, "group", "version")))  # one row a snapshot, found once
    hashed = rows.join(versions, ["group", "version"]).withColumns(
        {
            "h1": F.xxhash64("key", F.coalesce("digest", F.lit(b"")), F.coalesce("size", F.lit(-1).cast("bigint"))),
            "h2": F.xxhash64(F.lit(7), "size", "digest", "key"),
            "anchor": F.pmod(F.xxhash64("key"), F.lit(chunk_keys)) == 0,
        }
    )
    rest = unmatched_chunks(hashed, "size bigint, digest binary")
    side = lambda late, c: F.first(F.when(F.col("late") == late, F.col(c)), ignorenulls=True)
    joined = rest.groupBy("group", "version", "key").agg(
        F.max((~F.col("late")).cast("int")).alias("old"), F.max(F.col("late").cast("int")).alias("new"),
        side(False, "size").alias("s0"), side(True, "size").alias("s1"), side(False, "digest").alias("d0"), side(True, "digest").alias("d1"),
    )
    op = (
        F.when(F.col("old") == 0, "added").when(F.col("new") == 0, "removed")
        .when(F.col("d0").isNotNull() & F.col("d1").isNotNull(), F.when(F.col("d0") != F.col("d1"), "changed"))
        .when(F.col("s0") != F.col("s1"), "changed")
    )
    return joined.select(F.col("group").alias(group), F.col("version").cast("int").alias(version), F.col("key").alias(key), op.alias("op")).filter("op is not null")
