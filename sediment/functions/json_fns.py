"""JSON functions on JSON text; reading stays in the JVM, edits run in Arrow batches and keep the order of keys."""

from __future__ import annotations

import json as _json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r'\.(?:"([^"]+)"|([^.\[]+))|\[(#?(?:-?\d+)?)\]')


class _NONE:
    """Marks a path that leads nowhere; a class, so that it stays one thing in the workers."""



def steps(path: str) -> list:
    """The steps of $.a."b"[0][#-1][#]: keys as text, positions as numbers, ('#', n) from the end."""
    if not path.startswith("$"):
        raise ValueError(f"JSON path error near '{path}'")
    out: list = []
    at = 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"JSON path error near '{path[at:]}'")
        key = m[1] if m[1] is not None else m[2]
        out.append(key if key is not None else ("#", int(m[3][1:] or 0)) if m[3].startswith("#") else int(m[3]))
        at = m.end()
    return out


def _dumps(x) -> str:
    return _json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _loads(text: str | None):
    try:
        return _NONE if text is None else _json.loads(text)
    except ValueError:
        return _NONE


def _find(x, path: list):
    for s in path:
        if isinstance(s, str) and isinstance(x, dict) and s in x:
            x = x[s]
        elif not isinstance(s, str) and isinstance(x, list):
            i = s if isinstance(s, int) else len(x) + s[1]
            if not (0 <= i < len(x)) or (not isinstance(s, int) and s[1] == 0):
                return _NONE
            x = x[i]
        else:
            return _NONE
    return x


def _native(p: list) -> str | None:
    """The path as the JVM's functions take it; None if it counts from an end."""
    return "$" + "".join(f"['{s}']" if isinstance(s, str) else f"[{s}]" for s in p) if all(isinstance(s, (str, int)) and "'" not in str(s) for s in p) else None


def _kind(doc: Column, path: str) -> Column:
    """Type of the value at a native path, such as BOOLEAN or ARRAY<...>; NULL if there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant"))


def extract(doc: Column, path: str, *more: str) -> Column:
    """The value at a path as text: scalars bare, true and false as 1 and 0, objects and arrays as JSON; NULL if there is none or it is
    null. Of several paths the JSON array of their values, null where there is none."""
    if more:
        return F.when(valid(doc) == 1, F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(arrow(doc, x), F.lit("null")) for x in (path, *more)]), F.lit("]")))
    p = steps(path)
    native = _native(p)
    if native is not None:
        kind = _kind(doc, native)
        raw = F.get_json_object(doc, native) if p else F.when(kind == "STRING", F.get_json_object(F.concat(F.lit('{"v":'), doc, F.lit("}")), "$.v")).otherwise(json(doc))
        return F.when(kind == "BOOLEAN", F.when(raw == "true", "1").otherwise("0")).when((kind != "VOID") | (kind.isNull() & F.lit(bool(p))), raw)
    return _edit(lambda x: (lambda v: None if v is _NONE or v is None else ("1" if v else "0") if isinstance(v, bool) else v if isinstance(v, str) else _dumps(v))(_find(x, p)), doc)


def place(key: str | int) -> str:
    """The path that -> and ->> take: a path, a key, or a position, negative from the end."""
    if isinstance(key, int):
        return f"$[{key}]" if key >= 0 else f"$[#{key}]"
    return key if key.startswith("$") else f'$."{key}"'


def arrow(doc: Column, key: str | int) -> Column:
    """doc -> key: the value there as JSON; NULL if there is none."""
    p = steps(place(key))
    return _edit(lambda x: (lambda v: None if v is _NONE else _dumps(v))(_find(x, p)), doc)


def arrow_text(doc: Column, key: str | int) -> Column:
    """doc ->> key: the value there as extract gives it."""
    return extract(doc, place(key))


def valid(doc: Column) -> Column:
    return F.when(doc.isNotNull(), F.try_parse_json(doc).isNotNull().cast("int"))


def array_length(doc: Column, path: str = "$") -> Column:
    """0 for what isn't an array, NULL if the path leads nowhere."""
    v = doc if path == "$" else F.get_json_object(doc, path)
    return F.when(v.isNotNull(), F.coalesce(F.json_array_length(v), F.lit(0)))


def type_at(doc: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; NULL if the path leads nowhere."""
    p = steps(path)
    native = _native(p)
    if native is not None:
        kind = _kind(doc, native)
        truth = F.when(F.try_variant_get(F.try_parse_json(doc), native, "boolean"), "true").otherwise("false")
        named = {"BIGINT": "integer", "STRING": "text", "VOID": "null"}
        out = F.when(kind == "BOOLEAN", truth).when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
        for k, v in named.items():
            out = out.when(kind == k, v)
        return out.when(kind.isNotNull(), "real")

    def name(x):
        v = _find(x, p)
        return None if v is _NONE else type_name(v)

    return _edit(name, doc)


def type_name(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return {type(None): "null", int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(v)]


def _edit(change, doc: Column, *values: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series, *more: pd.Series) -> pd.Series:
        out = []
        for i, t in enumerate(docs):
            x = _loads(t)
            out.append(None if x is _NONE else change(x, *(None if pd.isna(m.iloc[i]) else m.iloc[i] for m in more)))
        return pd.Series(out, dtype=object)

    return run(doc, *values)


def json(doc: Column) -> Column:
    """Minified, keys in their order; NULL if it isn't JSON."""
    return _edit(_dumps, doc)


def pretty(doc: Column, indent: str = "    ") -> Column:
    return _edit(lambda x: _json.dumps(x, ensure_ascii=False, indent=indent), doc)


def _put(x, path: list, value, insert: bool, over: bool):
    if not path:
        return value if over else x
    s = path[0]
    if isinstance(s, str) and isinstance(x, dict):
        if s in x:
            x[s] = _put(x[s], path[1:], value, insert, over)
        elif insert:
            x[s] = value if len(path) == 1 else _put({} if isinstance(path[1], str) else [], path[1:], value, True, True)
    elif not isinstance(s, str) and isinstance(x, list):
        i = s if isinstance(s, int) else len(x) + s[1]
        if 0 <= i < len(x):
            x[i] = _put(x[i], path[1:], value, insert, over)
        elif i == len(x) and insert:
            x.append(value if len(path) == 1 else _put({} if isinstance(path[1], str) else [], path[1:], value, True, True))
    return x


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def set_(doc: Column, path: str, value: Column) -> Column:
    p = steps(path)
    return _edit(lambda x, v: _dumps(_put(x, p, _plain(v), True, True)), doc, value)


def insert(doc: Column, path: str, value: Column) -> Column:
    p = steps(path)
    return _edit(lambda x, v: _dumps(_put(x, p, _plain(v), True, False)), doc, value)


def replace(doc: Column, path: str, value: Column) -> Column:
    p = steps(path)
    return _edit(lambda x, v: _dumps(_put(x, p, _plain(v), False, True)), doc, value)


def remove(doc: Column, path: str) -> Column:
    p = steps(path)

    def change(x):
        v = removed(x, p)
        return None if v is _NONE else _dumps(v)

    return _edit(change, doc)


def removed(x, path: list):
    """x without what stands at the path; nothing of it without a path."""
    if not path:
        return _NONE
    at, s = _find(x, path[:-1]), path[-1]
    if isinstance(at, dict) and isinstance(s, str):
        at.pop(s, None)
    elif isinstance(at, list) and not isinstance(s, str):
        i = s if isinstance(s, int) else len(at) + s[1]
        if 0 <= i < len(at):
            del at[i]
    return x


def merged(a, b):
    """a under the merge patch b: null removes a key, objects merge, all else replaces."""
    if not isinstance(b, dict):
        return b
    a = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            a.pop(k, None)
        else:
            a[k] = merged(a.get(k), v)
    return a


def patch(doc: Column, change: Column) -> Column:
    """Merge patch: null removes a key, objects merge, all else replaces."""

    def run(x, p):
        y = _loads(p)
        return None if y is _NONE else _dumps(merged(x, y))

    return _edit(run, doc, change)


def array(*xs: Column) -> Column:
    """JSON array text; NULLs stay."""
    return F.concat(F.lit("["), F.concat_ws(",", *[quote(x) for x in xs]), F.lit("]"))


def object_(**fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(_json.dumps(k) + ":"), quote(x)) for k, x in fields.items()]), F.lit("}"))


def quote(x: Column) -> Column:
    """JSON text of a value; null for NULL."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null"))


def each(df: DataFrame, doc: str, path: str = "$") -> DataFrame:
    """df with key, value, type, atom, fullkey and path of each member of the object or array at path: one row a member, none for scalars."""
    return _walk(df, doc, path, deep=False)


def tree(df: DataFrame, doc: str, path: str = "$") -> DataFrame:
    """As each, for the value itself and everything below it, depth first; id counts from 0, parent is the id above."""
    return _walk(df, doc, path, deep=True)


_ROW = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("key", T.StringType()), ("value", T.StringType()), ("type", T.StringType()), ("atom", T.StringType()), ("id", T.IntegerType()), ("parent", T.IntegerType()), ("fullkey", T.StringType()), ("path", T.StringType()))]))


def members(text: str | None, path: str, deep: bool) -> list[tuple]:
    """The rows of each and tree for one document."""
    x = _loads(text)
    x = _NONE if x is _NONE else _find(x, steps(path))
    if x is _NONE:
        return []
    out: list = []

    def add(key, v, parent, full, holder):
        nested = isinstance(v, (dict, list))
        value = None if v is None else ("1" if v else "0") if isinstance(v, bool) else v if isinstance(v, str) else _dumps(v)
        me = len(out)
        out.append((key, value, type_name(v), None if nested else value, me, parent, full, holder))
        if nested and deep:
            below(v, me, full)

    def below(v, me, full):
        for k, y in v.items() if isinstance(v, dict) else enumerate(v):
            add(str(k), y, me, f"{full}.{k}" if isinstance(v, dict) else f"{full}[{k}]", full)

    if deep or not isinstance(x, (dict, list)):
        add(None, x, None, path, path)
    else:
        below(x, None, path)
    return out


def _walk(df: DataFrame, doc: str, path: str, deep: bool) -> DataFrame:
    steps(path)

    @F.pandas_udf(_ROW)
    def run(docs: pd.Series) -> pd.Series:
        return pd.Series([members(t, path, deep) for t in docs])

    return df.withColumn("__m", F.explode(run(F.col(doc)))).select(*df.columns, "__m.*")
