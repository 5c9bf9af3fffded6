"""Nested JSON records into related flat tables.

Each record is parsed alone into path-value-ordinal triples; paths that share a repeated ancestor form a group, and
each group pivots into one table whose rows name their parent. No record is ever gathered with another before the
pivot, so a hot source doesn't matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLES = "record bigint, kind string, node string, parent string, entity string, field string, ordinal int, value string"
_ARROW = pa.schema([("record", pa.int64()), ("kind", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("entity", pa.string()), ("field", pa.string()), ("ordinal", pa.int32()), ("value", pa.string())])
#: Ends the kind of an object that only holds a nested list of that kind; the list's things stand below its node.
GROUP = " group"
#: Triples in one Arrow batch, and characters of their places and values.
BATCH, BATCH_CHARS = 20_000, 16_000_000


@dataclass(frozen=True)
class Kind:
    """What may stand at a repeated place.

    children: key -> kind of the things in that list (a value alone counts as a list of one).
    text: key of an object that holds its text; the object is a case only if that text isn't empty. None: the object itself is a case.
    splits: characters that part several texts in one. group: key that holds a nested list of the same kind.
    keyed: a map's values are the things, at their keys.
    encloses: things below name it as their parent.
    """

    children: dict[str, str] = field(default_factory=dict)
    text: str | None = None
    splits: str = ""
    group: str | None = None
    keyed: bool = False
    encloses: bool = False


#: The shape of a media manifest: `anchor` is the key whose object is the root.
MANIFEST = {
    "root": Kind(children={"description": "description", "tags": "tag", "layers": "layer"}),
    "description": Kind(text="", keyed=True),
    "tag": Kind(text="name", splits=",;", group="items"),
    "layer": Kind(children={"tags": "tag", "segments": "segment", "derived": "layer"}, encloses=True),
    "segment": Kind(children={"words": "word"}, encloses=True),
    "word": Kind(text="w"),
}


class Number(str):
    """A number as it is written, so that no digit is lost and no length refused."""


def _refuse(name: str) -> float:
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_refuse, parse_int=Number, parse_float=Number).decode
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_PIECE = re.compile(rf"[ \t\r\n]*(?:([{{}}\[\],:])|({_STRING})|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|$)")
_NAMED = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """As parse, piece by piece with a stack of its own, so that no depth is too deep; many times slower. ValueError if it is no JSON."""
    stack: list[tuple] = []
    at, wants, out, key = 0, "value", None, None
    while True:
        m = _PIECE.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        sign, string, number, name = m.groups()
        if m.end() == len(text) and not m[0].strip():
            if wants != "end":
                raise ValueError("no JSON: it ends early")
            return out
        at = m.end()
        if sign is None or sign in "{[":
            if wants == "key" or wants == "first key":
                if string is None:
                    raise ValueError(f"no JSON: no key at {at}")
                key, wants = json.loads(string), "colon"
                continue
            if wants not in ("value", "first value"):
                raise ValueError(f"no JSON at {at}")
            value = {} if sign == "{" else [] if sign == "[" else json.loads(string) if string is not None else Number(number) if number is not None else _NAMED[name]
            if not stack:
                out = value
            elif isinstance(stack[-1][0], dict):
                stack[-1][0][key] = value
            else:
                stack[-1][0].append(value)
            if sign:
                stack.append((value,))
                wants = "first key" if sign == "{" else "first value"
            else:
                wants = "next" if stack else "end"
        elif sign == ":" and wants == "colon":
            wants = "value"
        elif sign == "," and wants == "next":
            wants = "key" if isinstance(stack[-1][0], dict) else "value"
        elif sign in "}]" and stack and wants in ("next", "first key" if sign == "}" else "first value") and isinstance(stack[-1][0], dict) == (sign == "}"):
            stack.pop()
            wants = "next" if stack else "end"
        else:
            raise ValueError(f"no JSON at {at}")


def parse(text: str | None):
    """The value of a JSON text with its numbers as written, or None if it isn't one."""
    if not text:
        return None
    try:
        return _decode(text)
    except RecursionError:
        try:
            return parse_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


def written(value) -> str:
    """A value as text: a text or number as it is, else as JSON."""
    if isinstance(value, str):
        return value
    try:
        return json.dumps(_plain(value), ensure_ascii=False)
    except RecursionError:
        return _written_deep(value)


def _plain(value):
    """With numbers that JSON writes as numbers; integers of many digits and exact decimals stay texts."""
    if isinstance(value, Number):
        return int(value) if len(value) < 18 and value.lstrip("-").isdigit() else float(value) if len(value) < 16 else str(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _written_deep(value) -> str:
    out: list[str] = []
    stack: list = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, dict):
            inner = [y for i, (k, v) in enumerate(x.items()) for y in ((", " * bool(i) + json.dumps(k, ensure_ascii=False) + ": ",), v)]
            stack += reversed([("{",), *inner, ("}",)])
        elif isinstance(x, list):
            stack += reversed([("[",), *[y for i, v in enumerate(x) for y in ((", ",), v)[not i :]], ("]",)])
        else:
            out.append(json.dumps(_plain(x), ensure_ascii=False))
    return "".join(out)


def unwrapped(value):
    """A text that is itself a JSON object, list or text counts as what it holds."""
    while isinstance(value, str) and (head := value[:1] if value[:1] > " " else value.lstrip()[:1]) and head in '{["':
        inner = parse(value)
        if not isinstance(inner, (dict, list, str)):
            break
        value = inner
    return value


def anchored(value, anchor: str, kinds: dict[str, Kind]) -> dict | None:
    """The shallowest object that holds `anchor`, outside the lists of the root; else the outermost object."""
    level, first = [unwrapped(value)], None
    while level:
        below = []
        for x in level:
            if isinstance(x, dict):
                if anchor in x:
                    return x
                first = first or x
                below += [unwrapped(v) for k, v in x.items() if k not in kinds["root"].children]
            elif isinstance(x, list):
                below += [unwrapped(v) for v in x]
        level = below
    return first


def triples_of(root: dict, kinds: dict[str, Kind]) -> Iterator[tuple]:
    """(kind, node, parent, entity, field, ordinal, value) of one record, in document order; field '' is the thing itself.

    Walks with a stack of its own, so depth isn't bounded by Python's recursion.
    """
    stack = [("object", "root", "", "", "", 0, root)]
    while stack:
        what, kind, node, parent, entity, ordinal, value = stack.pop()
        k = kinds[kind]
        value = unwrapped(value)
        if what == "list":
            if value is None:
                continue
            if k.keyed and isinstance(value, dict):
                things = [(f"{node}/{key}", i, x) for i, (key, x) in enumerate(value.items())]
            elif isinstance(value, list):
                things = [(f"{node}/{i}", i, x) for i, x in enumerate(value)]
            elif k.splits and isinstance(value, str) and any(c in value for c in k.splits):
                for c in k.splits[1:]:
                    value = value.replace(c, k.splits[0])
                things = [(f"{node}/{i}", i, x) for i, x in enumerate(value.split(k.splits[0]))]
            else:
                things = [(f"{node}/0", 0, value)]
            stack += [("object", kind, at, parent, entity, i, x) for at, i, x in reversed(things)]
            continue
        if isinstance(value, list) or (k.splits and isinstance(value, str) and any(c in value for c in k.splits)):
            stack.append(("list", kind, node, parent, entity, 0, value))
            continue
        if value is None:
            continue
        if not isinstance(value, dict):
            if k.text is None or isinstance(value, bool):
                if isinstance(value, str) and value.strip() and kind != "root":
                    yield kind, node, parent, entity, "", ordinal, value
                continue
            text = written(value)
            if text.strip():
                yield kind, node, parent, entity, "", ordinal, text
            continue
        if k.group and k.group in value and k.text not in value:
            yield kind + GROUP, node, parent, entity, "", ordinal, None
            for key, x in value.items():
                if key != k.group and x is not None and x != "":
                    yield kind + GROUP, node, parent, entity, key, ordinal, written(x)
            stack.append(("list", kind, f"{node}/{k.group}", parent, entity, 0, value[k.group]))
            continue
        if k.text is not None:
            text = value.get(k.text)
            if text is None or (isinstance(text, str) and not text.strip()):
                continue
            yield kind, node, parent, entity, "", ordinal, written(text)
        else:
            yield kind, node, parent, entity, "", ordinal, None
        for key, x in value.items():
            if key not in k.children and key != k.text and x is not None and x != "":
                yield kind, node, parent, entity, key, ordinal, written(x)
        up = node if k.encloses else parent
        prefix = f"{node}/" if node else ""
        stack += [("list", below, prefix + key, up, node, 0, value[key]) for key, below in reversed(k.children.items()) if key in value]


def triples(df: DataFrame, record: str, body: str, kinds: dict[str, Kind] | None = None, anchor: str = "file", things_only: bool = False) -> DataFrame:
    """One row per leaf and per repeated thing of each record: (record, kind, node, parent, entity, field, ordinal, value).

    node is the thing's place in keys and positions from 0, parent the nearest enclosing thing, field '' the thing itself.
    things_only leaves out the other fields. A body that is null, empty or no JSON gives no rows; nulls and empty texts
    are no things but keep their position; keys the shape doesn't know are fields of their object and aren't entered;
    several rows with one record id give their rows once each. Other columns of df are ignored, whatever their names.
    """
    kinds = kinds or MANIFEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = anchored(parse(text), anchor, kinds)
                if root is None:
                    continue
                for t in triples_of(root, kinds):
                    if things_only and t[4]:
                        continue
                    rows.append((rec, *t))
                    chars += len(t[1]) + len(t[6] or "")
                    if len(rows) >= BATCH or chars >= BATCH_CHARS:
                        yield full()
                        rows, chars = [], 0
        if rows:
            yield full()

    return df.select(F.col(record).cast("bigint"), F.col(body).cast("string")).mapInArrow(run, TRIPLES)


def pivoted(triples_df: DataFrame, fields: tuple[str, ...] = (), other: bool = False) -> DataFrame:
    """One row per thing of any kind: (record, kind, node, parent, ordinal, value, one column per field[, other]).

    One shuffle on the thing, pre-aggregated; a record delivered twice with one id gives one row per node.
    """
    return triples_df.groupBy("record", "kind", "node", "parent").agg(
        F.min("ordinal").alias("ordinal"),
        F.min(F.when(F.col("field") == "", F.col("value"))).alias("value"),
        *[F.min(F.when(F.col("field") == f, F.col("value"))).alias(f"f_{f}") for f in fields],
        *[F.array_sort(F.collect_set(F.when(~F.col("field").isin("", *fields), F.struct("field", "value")))).alias("other")] * other,
    )


def flat_table(triples_df: DataFrame, kind: str, fields: list[str], other: bool = False) -> DataFrame:
    """The table of one kind: record, node, parent, ordinal, value and one column per field; other: also a list of all other fields."""
    return pivoted(triples_df.filter(F.col("kind") == kind), tuple(fields), other).drop("kind")


def nodes(triples_df: DataFrame) -> DataFrame:
    """(record, node, parent) of every row of the tables below the root; groups are none."""
    tables = pivoted(triples_df.filter((F.col("kind") != "root") & ~F.col("kind").endswith(GROUP)))
    return tables.select("record", "node", "parent")
