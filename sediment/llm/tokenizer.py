"""Encoding and decoding with a public byte-level BPE tokenizer, as a deterministic automaton.

Compilation. The automaton over token arcs starts with one state that loops on the 256 bytes. Each merge (u, v) -> w is
a gadget: the state that u leads to is split, its copy loses the arc v, every state that has the arc u gets the arc w,
and w leads where v led. A state differs from its parent by one removed arc, so states aren't copied: the gadget keeps
only (u, v) and its time, and an arc t leaves the state behind u iff no gadget older than its parents joins the right
edge of u with the left edge of t.

Encoding. Token arcs spelled out as bytes give an unambiguous automaton whose subset construction is made as texts ask
for it: a state holds the suffix of the word that may still grow into a token and the arc label at each place where such
a token would start. Words run through the table (state, byte) -> state; a word's ids are the labels read backwards.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.runtime import spread

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Words and table entries that a worker keeps; beyond them it starts afresh, results are the same.
KEEP_WORDS, KEEP_ENTRIES = 400_000, 2_000_000
#: Only words of at most so many characters are kept.
KEEP_LENGTH = 40


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, and the merges as (left id, right id, merged id) in order of rank."""

    name: str
    tokens: list[bytes]
    merges: list[tuple[int, int, int]]
    #: Checksum of its file, so that files of one name in two folders aren't taken for each other.
    stamp: int = 0


def _byte_letters() -> dict[str, int]:
    """The public byte-to-letter rule: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> Vocabulary:
    """From a tokenizers JSON file with a byte-level BPE model, or a file of base64 tokens and ranks."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        raw = [tuple(bytes(letters[c] for c in x) for x in m) for m in pairs]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in raw]
    else:
        import base64

        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        merges = list(_merges_of_ranks(ids))
    tokens = [b""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        tokens[i] = t
    with open(path, "rb") as f:
        return Vocabulary(os.path.basename(path), tokens, merges, zlib.crc32(f.read()))


def _merges_of_ranks(ids: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """The last merge inside each token, found by merging its bytes with the tokens of lower rank."""
    for t, rank in sorted(ids.items(), key=lambda x: x[1]):
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ids.get(parts[i] + parts[i + 1], rank))
            if ids.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            yield ids[parts[0]], ids[parts[1]], rank


class Automaton:
    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self._compile(vocabulary.merges)
        self._spell()
        self._split = regex.compile(PATTERN).findall
        self._words: dict[str, tuple[int, ...]] = {}
        self._forget()

    # -- token arcs ------------------------------------------------------------------------------------------------

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        """One gadget after another. born: when a token's arc came to be; a byte's was there at the start."""
        n = len(self.tokens)
        self._left, self._right, self._born = [-1] * n, [-1] * n, [-1] * n
        self._gadgets: dict[tuple[int, int], int] = {}
        self._arcs: dict[tuple[int, int], bool] = {}
        for time, (u, v, w) in enumerate(merges):
            if self._has_arc(u, v):
                self._gadgets[u, v] = time
            if self._born[w] < 0 and len(self.tokens[w]) > 1:
                self._left[w], self._right[w], self._born[w] = u, v, time
        self._arcs.clear()

    def _has_arc(self, u: int, t: int) -> bool:
        """Whether the state behind u has the arc t. An edge token counts only for gadgets older than its parent.

        On t's side also for its parent's own gadget: where u == v, the copy lacks u and so never gets the arc w.
        """
        gadgets, a, until_a = self._gadgets, u, 1 << 60
        while a >= 0:
            b, until_b = t, 1 << 60
            while b >= 0:
                time = gadgets.get((a, b))
                if time is not None and time < until_a and time <= until_b:
                    return False
                until_b = self._born[b]
                b = self._left[b]
            until_a = self._born[a]
            a = self._right[a]
        return True

    def arc(self, u: int, t: int) -> bool:
        if (known := self._arcs.get((u, t))) is None:
            if len(self._arcs) > KEEP_ENTRIES:
                self._arcs.clear()
            known = self._arcs[u, t] = self._has_arc(u, t)
        return known

    # -- bytes -----------------------------------------------------------------------------------------------------

    def _spell(self) -> None:
        """The tree of all token spellings, with the longest proper suffix that is again a node of it."""
        goto: dict[int, int] = {}
        depth, ends = [0], [-1]
        for i, t in enumerate(self.tokens):
            if not t or (len(t) > 1 and self._born[i] < 0):
                continue
            node = 0
            for b in t:
                at = node << 8 | b
                if at not in goto:
                    goto[at] = len(depth)
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                node = goto[at]
            ends[node] = i
        by_depth = sorted(goto.items(), key=lambda x: depth[x[1]])
        fail = [0] * len(depth)
        for at, node in by_depth:
            up, b = at >> 8, at & 255
            if up:
                f = fail[up]
                while f and (f << 8 | b) not in goto:
                    f = fail[f]
                fail[node] = goto.get(f << 8 | b, 0)
        self._goto, self._depth, self._ends, self._fail = goto, depth, ends, fail

    def _forget(self) -> None:
        #: A state: tree node, and the labels at the starts of its suffixes; label -1 is the word's start.
        self._ids: dict[tuple, int] = {(0, (-1,)): 0}
        self._states: list[tuple] = [(0, (-1,))]
        self._labels: list[int] = [-1]
        self._table: dict[int, int] = {}

    def _suffixes(self, node: int) -> Iterator[int]:
        while node:
            yield node
            node = self._fail[node]

    def _step(self, state: int, b: int) -> int:
        """Makes the transition of a state by a byte, by subset construction."""
        node, starts = self._states[state]
        # the labels by depth of the suffix that starts there; depth 0 starts behind the last byte
        at = dict(zip([*(self._depth[x] for x in self._suffixes(node)), 0], starts, strict=True))
        while node and (node << 8 | b) not in self._goto:
            node = self._fail[node]
        node = self._goto.get(node << 8 | b, 0)
        label = None
        kept = []
        for x in self._suffixes(node):
            before = at[self._depth[x] - 1]
            kept.append(before)
            t = self._ends[x]
            if label is None and t >= 0 and (before == -1 or self.arc(before, t)):
                label = t
        if label is None:
            raise ValueError(f"byte {b} isn't in the vocabulary")
        key = (node, (*kept, label))
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
            self._labels.append(label)
        self._table[state << 8 | b] = to
        return to

    def _word(self, word: bytes) -> tuple[int, ...]:
        if len(self._table) > KEEP_ENTRIES:
            self._forget()
        table, labels, state, path = self._table, self._labels, 0, []
        for b in word:
            to = table.get(state << 8 | b)
            state = self._step(state, b) if to is None else to
            path.append(labels[state])
        out, i = [], len(path)
        while i:
            out.append(path[i - 1])
            i -= len(self.tokens[path[i - 1]])
        return tuple(reversed(out))

    def encode_into(self, text: str, out: array) -> None:
        words = self._words
        for w in self._split(text):
            ids = words.get(w)
            if ids is None:
                ids = self._word(w.encode())
                if len(w) <= KEEP_LENGTH:
                    if len(words) >= KEEP_WORDS:
                        words.clear()
                    words[w] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        """The ids; an empty list for null and for empty text."""
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_compiled: dict[tuple[str, int], Automaton] = {}


def automaton_of(vocabulary: Vocabulary) -> Automaton:
    """One compiled automaton a process and vocabulary."""
    key = vocabulary.name, vocabulary.stamp
    if key not in _compiled:
        _compiled[key] = Automaton(vocabulary)
    return _compiled[key]


def shared_vocabulary(spark: SparkSession, name: str = "byte_bpe_50k.json", folder: str | None = None):
    """The vocabulary read once on the driver and broadcast; its size is that of the file, about a megabyte."""
    return spark.sparkContext.broadcast(load_vocabulary(os.path.join(folder or TOKENIZERS, name)))


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None, counts_only: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids array<int>), or with counts_only (key, *carry, n_tokens bigint), one row per row of df, whole texts.

    Null and empty texts give an empty list (count 0); a null key stays null, equal keys and texts each keep their row;
    an empty table gives none. Special tokens' strings are plain text. Other columns don't matter. No shuffle.
    """
    shared = shared_vocabulary(df.sparkSession, tokenizer, folder)
    rows = df.select(F.col(text).cast("string").alias("__text"), F.col(key).alias(key), *carry)
    rows = spread(rows)
    kind = dict(df.dtypes)[key]
    passed = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in (key, *carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for text_ in batch.column(0):
                t = text_.as_py()
                if t:
                    automaton.encode_into(t, flat)
                offsets.append(len(flat))
            others = [batch.column(i) for i in range(1, batch.num_columns)]
            ends = pa.array(offsets, pa.int32())
            if counts_only:
                n = pa.compute.subtract(ends.slice(1), ends.slice(0, len(ends) - 1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*others, n], names=[key, *carry, "n_tokens"])
            else:
                ids = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([others[0], ids], names=[key, "ids"])

    return rows.mapInArrow(run, f"{passed}, n_tokens bigint" if counts_only else f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """(key, text): the text of each list of ids; null ids give null."""
    shared = shared_vocabulary(df.sparkSession, tokenizer, folder)
    rows = df.select(F.col(key).alias(key), F.col(ids).cast("array<int>").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for batch in batches:
            texts = [None if x is None else b"".join(tokens[i] for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")
