"""Has this key been seen before? An Elias-Fano coded set of fingerprints per hash partition.

A fingerprint of BITS bits is cut from a 64-bit hash of the whole key. The partition is its rest modulo the number of
partitions, so a partition holds a fixed share of the distinct keys. Within it the sorted fingerprints are kept with their low
bits packed and their high bits in unary; a probe is a successor search in its bucket. New batches are merged one after
another, in the order of the records. Equal keys are reduced to their first record before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.runtime import cut, small_or_not

#: Width of a fingerprint; a probe of one of n distinct keys is wrong with probability below n / 2**BITS.
BITS = 48
#: Rows of history and records for one partition, so that it holds at most about as many keys.
PARTITION_KEYS = 150_000
#: Batches that the records are cut into, by equal steps of their order.
BATCHES = 32


class EliasFano:
    """An immutable sorted set of integers below 2**bits: low bits packed, high bits in unary (bucket ends are zeros)."""

    def __init__(self, n: int, bits: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.bits, self.low_bits, self.low, self.high = int(n), int(bits), int(low_bits), low, high
        self._starts: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, bits: int = BITS) -> EliasFano:
        """values: sorted, distinct uint64."""
        n = len(values)
        low_bits = max(0, bits - max(1, n).bit_length())
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        ones = np.zeros(n + (1 << (bits - low_bits)), np.uint8)
        ones[high + np.arange(n)] = 1
        if low_bits:
            low = values & np.uint64((1 << low_bits) - 1)
            spread = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(spread.ravel(), bitorder="little").tobytes() + bytes(16)
        else:
            packed = bytes(16)
        return cls(n, bits, low_bits, packed, np.packbits(ones, bitorder="little").tobytes())

    def starts(self) -> np.ndarray:
        """Where each bucket of equal high bits starts, by select of the zeros."""
        if self._starts is None:
            buckets = 1 << (self.bits - self.low_bits)
            bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")[: self.n + buckets]
            zeros = np.flatnonzero(bits == 0)
            self._starts = np.concatenate([[0], zeros - np.arange(buckets)])
        return self._starts

    def low_at(self, i: np.ndarray) -> np.ndarray:
        """The packed low bits at positions i: a window of eight bytes and the byte behind it."""
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        raw = np.frombuffer(self.low, np.uint8)
        out = np.zeros(len(i), np.uint64)
        for k in range(8):
            out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
        out >>= shift
        over = shift > 0
        out[over] |= raw[byte[over] + 8].astype(np.uint64) << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def successor(self, probes: np.ndarray) -> np.ndarray:
        """Position of the first value that isn't below each probe; n if there is none. Bisects within the bucket."""
        high = (probes >> np.uint64(self.low_bits)).astype(np.int64)
        low = probes & np.uint64((1 << self.low_bits) - 1)
        starts = self.starts()
        lo, hi = starts[high].copy(), starts[high + 1].copy()
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) >> 1
            below = self.low_at(mid) < low[live]
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
        return lo

    def contains(self, probes: np.ndarray) -> np.ndarray:
        if not self.n or not len(probes):
            return np.zeros(len(probes), bool)
        at = self.successor(probes)
        high = (probes >> np.uint64(self.low_bits)).astype(np.int64)
        low = probes & np.uint64((1 << self.low_bits) - 1)
        out = at < self.starts()[high + 1]
        out[out] = self.low_at(at[out]) == low[out]
        return out

    def values(self) -> np.ndarray:
        high = np.repeat(np.arange(1 << (self.bits - self.low_bits), dtype=np.uint64), np.diff(self.starts()))
        return high << np.uint64(self.low_bits) | self.low_at(np.arange(self.n))

    def merged(self, more: np.ndarray) -> EliasFano:
        """With more values, sorted and distinct: one sequential merge."""
        mine = self.values()
        both = np.insert(mine, np.searchsorted(mine, more), more)
        return EliasFano.of(both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both, self.bits)


def digest_key(text: Column) -> Column:
    """The 32 bytes that a digest text means, or null: hex of either case, alone or in groups parted by one kind of space, colon or
    hyphen, after sha256: or \\x or 0x, or base64 after sha256-; surrounding white space doesn't count."""
    t = F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")
    bare = F.regexp_replace(t, r"^(?i:sha-?256\s*[:=]\s*|\\x|0x)", "")
    one = F.when(bare.rlike(r"^[0-9A-Fa-f]{64}$"), bare).when(
        bare.rlike(r"^[0-9A-Fa-f]{2,32}([ :\-_.])(?:[0-9A-Fa-f]{2,32}\1)*[0-9A-Fa-f]{2,32}$"), F.regexp_replace(bare, r"[ :\-_.]", "")
    )
    from_hex = F.when(F.length(one) == 64, F.unhex(one))
    b64 = F.regexp_extract(t, r"^(?i:sha-?256[-:=])?([A-Za-z0-9+/]{43}=)$", 1)
    urlsafe = F.translate(F.regexp_extract(t, r"^(?i:sha-?256[-:=])([A-Za-z0-9_-]{43}=?)$", 1), "-_", "+/")
    from_b64 = F.when(F.length(b64) == 44, F.try_to_binary(b64, F.lit("base64"))).when(
        F.length(urlsafe) >= 43, F.try_to_binary(F.rpad(urlsafe, 44, "="), F.lit("base64"))
    )
    key = F.coalesce(from_hex, from_b64)
    return F.when(F.octet_length(key) == 32, key)


def fingerprint(key: Column, bits: int = BITS) -> Column:
    """The low bits of a 64-bit hash of the whole key."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))


def partition_of(key: Column, partitions: int) -> Column:
    """From another hash, so that it tells nothing of the fingerprint."""
    return F.pmod(F.xxhash64(F.lit(31), key), F.lit(partitions)).cast("int")


def build_filter(keys: DataFrame, key: str, partitions: int, bits: int = BITS) -> DataFrame:
    """(part, n, bits, low_bits, low, high): the coded set of the distinct non-null keys, one row a partition.

    Distinct first, with partial aggregation, so a key that holds a third of the rows is one row before the shuffle.
    An empty table gives no rows.
    """
    prints = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().select(partition_of(F.col("key"), partitions).alias("part"), fingerprint(F.col("key"), bits).alias("fp"))

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        ef = EliasFano.of(np.unique(pdf["fp"].to_numpy().astype(np.uint64)), bits)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n": [ef.n], "bits": [bits], "low_bits": [ef.low_bits], "low": [ef.low], "high": [ef.high]})

    return prints.groupBy("part").applyInPandas(code, "part int, n bigint, bits int, low_bits int, low binary, high binary")


class Layers:
    """Coded sets of growing size. A new batch becomes a set of its own and is merged with the sets before it that aren't larger, so
    each value is merged a logarithmic number of times."""

    def __init__(self, first: EliasFano):
        self.sets = [first]

    def contains(self, probes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(probes), bool)
        for s in self.sets:
            out |= s.contains(probes)
        return out

    def add(self, values: np.ndarray) -> None:
        """values: sorted, distinct."""
        if not len(values):
            return
        bits = self.sets[0].bits
        while len(self.sets) > 1 and self.sets[-1].n <= 2 * len(values):
            values = np.union1d(values, self.sets.pop().values())
        self.sets.append(EliasFano.of(values, bits))


def batch_firsts(records: DataFrame, key: str, order: str, batches: int = BATCHES) -> DataFrame:
    """(key, batch, first): the first record of each non-null key in each batch of the order."""
    rows = records.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("o"))
    lo, hi = records.agg(F.min(order).cast("bigint"), F.max(order).cast("bigint")).first()  # of all records, so that no key is worked out for it
    # in doubles, so that no difference overflows; batches keep the order all the same
    step = F.floor((F.col("o").cast("double") - float(lo or 0)) / max(1.0, float(hi or 0) - float(lo or 0) + 1) * batches).cast("int")
    return rows.groupBy("key", step.alias("batch")).agg(F.min("o").alias("first"))


def probe(coded: DataFrame, first: DataFrame, partitions: int, bits: int = BITS) -> DataFrame:
    """(key, first, fresh, seen) of each key's first record in each batch: whether its fingerprint was in the coded set or came in with an
    earlier batch; fresh tells a key's very first record.

    The batches of a partition are taken in order: each is probed against the coded sets, then merged into them.
    """
    probes = first.select(partition_of(F.col("key"), partitions).alias("part"), "key", "batch", "first", fingerprint(F.col("key"), bits).alias("fp"))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sets = Layers(EliasFano(int(left["n"].iloc[0]), int(left["bits"].iloc[0]), int(left["low_bits"].iloc[0]), left["low"].iloc[0], left["high"].iloc[0]) if len(left) else EliasFano.of(np.zeros(0, np.uint64), bits))
        right = right.sort_values("first", kind="stable")
        fp, batch = right["fp"].to_numpy().astype(np.uint64), right["batch"].to_numpy()
        seen = np.zeros(len(fp), bool)
        edges = np.flatnonzero(np.diff(batch, prepend=-1, append=-1)) if len(batch) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            values, once = np.unique(fp[a:b], return_index=True)
            again = np.ones(b - a, bool)
            again[once] = False
            seen[a:b] = sets.contains(fp[a:b]) | again
            sets.add(values)
        return pd.DataFrame({"key": right["key"], "first": right["first"], "fresh": ~right["key"].duplicated(), "seen": seen})

    return coded.groupBy("part").cogroup(probes.groupBy("part")).applyInPandas(answer, "key binary, first bigint, fresh boolean, seen boolean")


def partitions_for(history: DataFrame, history_key: str, records: DataFrame, key: str) -> int:
    """From the rows of both sides, an upper bound of their keys."""
    return max(8, -(-(history.select(history_key).count() + records.select(key).count()) // PARTITION_KEYS))


def seen_before(history: DataFrame, history_key: str, records: DataFrame, key: str, order: str, bits: int = BITS, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(found, answers): the order numbers of records whose key is in history or belongs to an earlier record; and of each key's first
    record in each batch (key, first, fresh, seen, held): the coded set's answer and, with exact, whether the key truly occurred before.

    keys are binary; order is unique. Null keys and orders are no case. Only a false yes is possible; the exact check takes the
    fresh keys answered yes to the history once more and so removes it: where they are few, the history is only scanned. Within
    a batch a key's later records are a yes by its first one there.
    """
    parts = partitions_for(history, history_key, records, key)
    coded = build_filter(history, history_key, parts, bits)
    answers = cut(probe(coded, batch_firsts(records, key, order), parts, bits))
    if exact:
        asked = small_or_not(answers.filter("seen and fresh").select("key"))
        known = history.filter(F.col(history_key).isNotNull()).select(F.col(history_key).alias("key")).join(asked, "key", "left_semi").distinct().withColumn("held", F.lit(True))
        yes = answers.filter("seen and fresh").join(known, "key", "left").select("key", "first", "fresh", "seen", F.coalesce("held", F.lit(False)).alias("held"))
        new = answers.filter("not seen").select("first").unionByName(yes.filter("not held").select("first"))
        answers = answers.filter("not (seen and fresh)").withColumn("held", ~F.col("fresh")).unionByName(yes)
    else:
        new = answers.filter("not seen").select("first")
    rows = records.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(order).alias("__order"))
    found = rows.join(new, rows["__order"] == new["first"], "left_anti").select(F.col("__order").alias(order))
    return found, answers


def wrong_answers(answers: DataFrame, history_keys: int, bits: int = BITS) -> DataFrame:
    """(probes, yes, wrong, wrong_rate, bound): measured rate of false yes among keys that hadn't occurred, and its bound: the keys of
    history and those merged on the way, over 2**bits."""
    wrong, new = F.count_if(F.col("seen") & ~F.col("held")), F.count_if(~F.col("held"))
    return answers.agg(
        F.count("*").alias("probes"),
        F.count_if("seen").alias("yes"),
        wrong.alias("wrong"),
        F.coalesce(F.try_divide(wrong.cast("double"), new.cast("double")), F.lit(0.0)).alias("wrong_rate"),
        ((F.lit(history_keys) + F.count_if("fresh")) / 2.0**bits).alias("bound"),
    )


def merge_batch(coded: DataFrame, keys: DataFrame, key: str, partitions: int, bits: int = BITS) -> DataFrame:
    """The coded set with one more batch of keys, for a filter kept as a table between deliveries."""
    fresh = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().select(partition_of(F.col("key"), partitions).alias("part"), fingerprint(F.col("key"), bits).alias("fp"))

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        more = np.unique(right["fp"].to_numpy().astype(np.uint64))
        ef = EliasFano(*left[["n", "bits", "low_bits", "low", "high"]].iloc[0]).merged(more) if len(left) else EliasFano.of(more, bits)
        part = (left if len(left) else right)["part"].iloc[0]
        return pd.DataFrame({"part": [part], "n": [ef.n], "bits": [bits], "low_bits": [ef.low_bits], "low": [ef.low], "high": [ef.high]})

    return coded.groupBy("part").cogroup(fresh.groupBy("part")).applyInPandas(merge, "part int, n bigint, bits int, low_bits int, low binary, high binary")
