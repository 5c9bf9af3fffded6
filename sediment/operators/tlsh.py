"""Locality-sensitive digests: distance, band index with multi-probe, nearest digests, and digests of bytes.

Digests are hex texts with or without a T1 mark: checksum, length and quartile bytes, then 128 two-bit buckets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.runtime import cut, spread

BANDS = 16


def _pair_table() -> np.ndarray:
    """Distance of two bytes of four two-bit buckets: 0, 1, 2 a bucket, 6 for the extremes."""
    two = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    d = np.abs(two[:, None, :] - two[None, :, :])
    return np.where(d == 3, 6, d).sum(axis=2).astype(np.int32)


PAIRS = _pair_table()


def body_of(digest: Column) -> Column:
    """The 35 bytes of a digest text; NULL if it isn't one."""
    d = F.upper(F.trim(digest))
    d = F.when(d.startswith("T1"), F.substring(d, 3, 70)).otherwise(d)
    return F.when(d.rlike("^[0-9A-F]{70}$"), F.unhex(d))


def _swapped(x: np.ndarray) -> np.ndarray:
    return ((x & 15) << 4) | (x >> 4)


def _ring(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    d = np.abs(a.astype(np.int32) - b.astype(np.int32))
    return np.minimum(d, size - d)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of digests of 35 bytes, broadcast over the leading axes."""
    a, b = np.asarray(a), np.asarray(b)
    head_a, head_b = _swapped(a[..., :3]), _swapped(b[..., :3])
    length = _ring(head_a[..., 1], head_b[..., 1], 256)
    out = np.where(length <= 1, length, length * 12)
    # the quartile byte keeps the first ratio in its low half, the second in its high half
    for shift in (0, 4):
        q = _ring((head_a[..., 2] >> shift) & 15, (head_b[..., 2] >> shift) & 15, 16)
        out = out + np.where(q <= 1, q, (q - 1) * 12)
    out = out + (head_a[..., 0] != head_b[..., 0])
    return out + PAIRS[a[..., 3:], b[..., 3:]].sum(axis=-1)


def distance(a: Column, b: Column) -> Column:
    """Distance of two digest texts; NULL if either isn't one."""

    @F.pandas_udf(T.IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype="Int32")
        ok = (x.notna() & y.notna()).to_numpy()
        if ok.any():
            one = np.frombuffer(b"".join(x[ok]), np.uint8).reshape(-1, 35)
            two = np.frombuffer(b"".join(y[ok]), np.uint8).reshape(-1, 35)
            out[ok] = distances(one, two)
        return out

    return run(body_of(a), body_of(b))


def bands(body: Column) -> Column:
    """The 16 band keys: band number and its two bytes."""
    return F.array(*[F.concat(F.lit(f"{i:02d}"), F.hex(F.substring(body, 4 + 2 * i, 2))) for i in range(BANDS)])


def probes(body: Column, level: int = 0) -> Column:
    """Band keys to look up: the digest's own, at level 1 also those with one bucket changed by one step."""
    if level == 0:
        return bands(body)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(xs: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return []
            out = []
            for i in range(BANDS):
                v = b[3 + 2 * i] << 8 | b[4 + 2 * i]
                near = {v}
                for s in range(0, 16, 2):
                    c = (v >> s) & 3
                    near |= {v & ~(3 << s) | n << s for n in (c - 1, c + 1) if 0 <= n <= 3}
                out += [f"{i:02d}{n:04X}" for n in near]
            return out

        return xs.map(one)

    return run(body)


def nearest(queries: DataFrame, queries_key: str, items: DataFrame, items_key: str, digest: str, n: int = 10, level: int = 1, most: int | None = None, ask_digest: str | None = None) -> DataFrame:
    """(query, item, distance): each query's n nearest items among those that share a band, ties by key, itself left out.

    Equal digests are one row until the end; candidates meet in an equi-join on band keys. most: largest distance.
    """
    d = items.select(F.col(items_key).alias("item"), body_of(F.col(digest)).alias("body")).filter("body is not null")
    once = d.select("body").distinct()
    q = queries.select(F.col(queries_key).alias("query"), body_of(F.col(ask_digest or digest)).alias("qbody")).filter("qbody is not null")
    asked = q.select("qbody").distinct()
    index = once.select("body", F.explode(bands(F.col("body"))).alias("band"))
    pairs = asked.select("qbody", F.explode(probes(F.col("qbody"), level)).alias("band")).join(index, "band").select("qbody", "body").distinct()

    @F.pandas_udf(T.IntegerType())
    def between(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(distances(np.frombuffer(b"".join(x), np.uint8).reshape(-1, 35), np.frombuffer(b"".join(y), np.uint8).reshape(-1, 35)))

    scored = pairs.withColumn("distance", between("qbody", "body"))
    if most is not None:
        scored = scored.filter(F.col("distance") <= most)
    return _top(scored, q, d, n)


#: Distance of two-bit buckets, and of the length and quartile bytes; in floats, whose sums are exact at this size.
_BUCKETS = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.float32)
_BYTES = np.arange(256)
_LENGTHS = np.where((_r := _ring(_BYTES[:, None], _BYTES, 256)) <= 1, _r, _r * 12).astype(np.float32)
_RATIOS = sum(np.where((_q := _ring((_BYTES[:, None] >> s) & 15, (_BYTES >> s) & 15, 16)) <= 1, _q, (_q - 1) * 12) for s in (0, 4)).astype(np.float32)
#: Queries compared at once.
CHUNK = 256


def _codes(body: np.ndarray) -> np.ndarray:
    return ((body[:, 3:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(len(body), 128)


def _steps(body: np.ndarray) -> np.ndarray:
    """The distances of each bucket to the four values, a column per digest, for `_between`."""
    return _BUCKETS[_codes(body)].reshape(len(body), 512).T


def _between(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Distances of all pairs of two lists of digests; the buckets' part is a matrix product."""
    out = np.eye(4, dtype=np.float32)[_codes(a)].reshape(len(a), 512) @ steps
    x, y = _swapped(a[:, :3]), _swapped(b[:, :3])
    out += _LENGTHS[x[:, 1]][:, y[:, 1]]
    out += _RATIOS[x[:, 2]][:, y[:, 2]]
    out += x[:, :1] != y[:, 0]
    return out


class _Nearest:
    """The digests met so far that are as near as the (n + 1)-th of each query or nearer, so that ties are settled by key later."""

    def __init__(self, ask: np.ndarray, n: int):
        self.ask, self.n = ask, n
        self.edge = np.full(len(ask), np.inf, np.float32)
        self.who, self.far, self.body = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, 35), np.uint8)

    def add(self, body: np.ndarray, steps: np.ndarray) -> None:
        far = _between(self.ask, body, steps)
        new = np.isinf(self.edge)
        if new.any() and len(body) > self.n:
            self.edge[new] = np.partition(far[new], self.n, axis=1)[:, self.n]
        who, at = np.nonzero(far <= self.edge[:, None])
        if not len(who):
            return
        who, far, body = np.concatenate([self.who, who]), np.concatenate([self.far, far[who, at]]), np.concatenate([self.body, body[at]])
        order = np.lexsort((far, who))
        who, far, body = who[order], far[order], body[order]
        start = np.searchsorted(who, np.arange(len(self.ask) + 1))
        full = np.flatnonzero(np.diff(start) > self.n)
        self.edge[full] = far[start[full] + self.n]
        keep = far <= self.edge[who]
        self.who, self.far, self.body = who[keep], far[keep], body[keep]


def nearest_exact(queries: DataFrame, queries_key: str, items: DataFrame, items_key: str, digest: str, n: int = 10, block: int = 2_000_000, ask_digest: str | None = None) -> DataFrame:
    """As nearest, against all items: each task keeps the best of its own items for a block of the queries.

    The queries' distinct digests go to the tasks in blocks of about `block` bytes, one pass over the items for each; the work is queries times items.
    """
    d = items.select(F.col(items_key).alias("item"), body_of(F.col(digest)).alias("body")).filter("body is not null")
    q = queries.select(F.col(queries_key).alias("query"), body_of(F.col(ask_digest or digest)).alias("qbody")).filter("qbody is not null")
    asked = cut(q.select("qbody").distinct())
    blocks = max(1, -(-asked.count() * 35 // block))
    once = d.select("body").distinct()
    once = spread(once if blocks == 1 else cut(once))

    def scan(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ask = shared.value
            best = [_Nearest(ask[i : i + CHUNK], n) for i in range(0, len(ask), CHUNK)]
            for batch in batches:
                if batch.num_rows and best:
                    body = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 35)
                    steps = _steps(body)
                    for b in best:
                        b.add(body, steps)
            for b in best:
                yield pa.RecordBatch.from_arrays([pa.array([b.ask[i].tobytes() for i in b.who], pa.binary()), pa.array([x.tobytes() for x in b.body], pa.binary()), pa.array(b.far.astype(np.int32))], names=["qbody", "body", "distance"])

        return once.mapInArrow(run, "qbody binary, body binary, distance int")

    scored = None
    for i in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("qbody"), F.lit(blocks)) == i).collect()
        table = np.frombuffer(b"".join(bytes(r[0]) for r in mine), np.uint8).reshape(-1, 35)
        part = scan(items.sparkSession.sparkContext.broadcast(table))
        scored = part if scored is None else scored.unionByName(part)
    return _top(scored, q, d, n)


def similar(files: DataFrame, query: str, n: int = 20, mode: str = "exact", path: str = "path", sha256: str = "sha256", digest: str = "tlsh") -> DataFrame:
    """(path, sha256, distance) of the n files nearest to a digest text, a path or a SHA-256 in hex, nearest first, ties by path.

    A path or content isn't similar to itself. mode: exact compares with all, near looks at digests that share a band or one a step off.
    A path or digest that isn't there gives no rows.
    """
    hexed = F.lower(F.hex(sha256)) if dict(files.dtypes)[sha256] == "binary" else F.lower(F.col(sha256))
    rows = files.select(F.col(path).alias("path"), hexed.alias("sha256"), F.col(digest).alias("tlsh"))
    if re.fullmatch("(?:T1)?[0-9A-Fa-f]{70}", query.strip()):
        asked = [query.strip()]
        rest = rows
    else:
        mine = F.col("sha256") == query.lower() if re.fullmatch("[0-9A-Fa-f]{64}", query) else F.col("path") == query
        asked = [r[0] for r in rows.filter(mine & F.col("tlsh").isNotNull()).select("tlsh").distinct().limit(1).collect()]
        rest = rows.filter(~F.coalesce(mine, F.lit(False)))
    ask = files.sparkSession.createDataFrame([("\0query", x) for x in asked], "q string, d string")
    keyed = rest.groupBy("path", "sha256").agg(F.min("tlsh").alias("tlsh")).withColumn("k", F.concat_ws("\0", "path", "sha256"))
    if mode == "exact":
        found = nearest_exact(ask, "q", keyed, "k", "tlsh", n, ask_digest="d")
    elif mode == "near":
        found = nearest(ask, "q", keyed, "k", "tlsh", n, 1, ask_digest="d")
    else:
        raise ValueError(f"no such mode: {mode}")
    parts = F.split("item", "\0")
    return found.select(F.get(parts, 0).alias("path"), F.get(parts, 1).alias("sha256"), "distance").orderBy("distance", "path")


def _top(scored: DataFrame, q: DataFrame, d: DataFrame, n: int) -> DataFrame:
    from pyspark.sql.window import Window

    # at most n + 1 digests a query digest and the n + 1 first items of each can matter: the query itself may be one
    near = scored.withColumn("r", F.dense_rank().over(Window.partitionBy("qbody").orderBy("distance"))).filter(F.col("r") <= n + 1).drop("r")
    few = d.withColumn("r", F.row_number().over(Window.partitionBy("body").orderBy("item"))).filter(F.col("r") <= n + 1).drop("r")
    pairs = near.join(few, "body").join(q, "qbody").filter("query <> item")
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", "item"))).filter(F.col("r") <= n).select("query", "item", "distance")


def permutation_of(path: str) -> np.ndarray:
    """A permutation of the bytes from a file of 256 numbers, such as the format's public one, parted by anything."""
    with open(path, encoding="ascii") as f:
        out = np.array(re.findall(r"\d+", f.read()), int)
    if sorted(out.tolist()) != list(range(256)):
        raise ValueError(f"{path} holds no permutation of 256 bytes")
    return out.astype(np.uint8)


def default_permutation() -> np.ndarray:
    """A permutation of the bytes from a rule: ranked by SHA-256. Standard digests need the public permutation (permutation_of)."""
    return np.argsort([hashlib.sha256(bytes([i])).digest()[:8] for i in range(256)]).astype(np.uint8)


#: Texts up to this length have their checksums worked out side by side, byte by byte.
SIDE_BY_SIDE = 65_536


def checksums(texts: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """The checksum byte of each text of at least five bytes: a chain over its bytes, each step for all texts at once."""
    out = np.zeros(len(texts), np.uint8)
    steps = [p[p[p[0] ^ x[4:]] ^ x[3:-1]] for x in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(steps[i]))
    long = [i for i in order if len(steps[i]) > SIDE_BY_SIDE]
    for i in long:
        check, table = 0, p.tolist()
        for k in steps[i].tolist():
            check = table[k ^ check]
        out[i] = check
    rest = order[len(long) :]
    if rest:
        sizes = np.array([len(steps[i]) for i in rest])
        check = np.zeros(len(rest), np.uint8)
        # blocks of positions, so that padding stays small
        for at in range(0, int(sizes[0]), 512):
            live = int(np.searchsorted(-sizes, -at, side="left"))
            block = np.zeros((512, live), np.uint8)
            for j in range(live):
                part = steps[rest[j]][at : at + 512]
                block[: len(part), j] = part
            for k in range(min(512, int(sizes[0]) - at)):
                n = int(np.searchsorted(-sizes, -(at + k), side="left"))
                check[:n] = p[block[k, :n] ^ check[:n]]
        out[rest] = check
    return out


def digest_bytes(data: bytes | None, permutation: np.ndarray, check: int | None = None) -> str | None:
    """Digest of bytes: windows of five, six triplets a window into 128 buckets, quartiles, two bits a bucket.

    None under 50 bytes, where the third quartile is 0, and where at most half of the buckets are filled. check: its checksum, if known.
    """
    if data is None or len(data) < 50:
        return None
    x = np.frombuffer(data, np.uint8)
    w = [x[4 - k : len(x) - k] for k in range(5)]
    p = permutation
    buckets = np.zeros(256, np.int64)
    for salt, i, j in ((2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4)):  # fixed values of the format
        buckets += np.bincount(p[p[p[p[salt] ^ w[0]] ^ w[i]] ^ w[j]], minlength=256)
    check = int(checksums([x], p)[0]) if check is None else check
    b = buckets[:128]
    if (b > 0).sum() <= 64:
        return None
    q1, q2, q3 = np.sort(b)[[31, 63, 95]]
    if q3 == 0:
        return None
    n = len(data)
    length = int(np.log(n) / np.log(1.5)) if n <= 656 else int(np.log(n) / np.log(1.3) - 8.72777) if n <= 3199 else int(np.log(n) / np.log(1.1) - 62.5472)
    ratios = int(q1 * 100 // q3) % 16 | (int(q2 * 100 // q3) % 16) << 4
    code = (b > q1).astype(int) + (b > q2) + (b > q3)
    body = [int(code[4 * i] | code[4 * i + 1] << 2 | code[4 * i + 2] << 4 | code[4 * i + 3] << 6) for i in range(32)][::-1]
    swap = lambda v: (v & 15) << 4 | v >> 4
    return "T1" + bytes([swap(check), swap(length & 255), swap(ratios), *body]).hex().upper()


def digest_udf(permutation: np.ndarray | None = None):
    p = default_permutation() if permutation is None else permutation

    @F.pandas_udf(T.StringType())
    def run(xs: pd.Series) -> pd.Series:
        data = [None if t is None else t.encode() if isinstance(t, str) else bytes(t) for t in xs]
        held = [i for i, t in enumerate(data) if t is not None and len(t) >= 50]
        known = dict(zip(held, checksums([np.frombuffer(data[i], np.uint8) for i in held], p).tolist(), strict=True)) if held else {}
        return pd.Series([digest_bytes(t, p, known.get(i)) for i, t in enumerate(data)], dtype=object)

    return run
