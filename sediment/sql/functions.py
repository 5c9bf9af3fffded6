"""Functions of the dialect in Spark SQL: those with other semantics are SQL functions of the session, inlined by the optimizer."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions import dates as D
from sediment.functions import json_fns as J
from sediment.functions import scalar as S

#: name -> (parameters, result type, body): SQL functions made once a session.
SQL = {
    "sed_lower": ("x STRING", "STRING", f"translate(x, '{S._UPPER}', '{S._LOWER}')"),
    "sed_upper": ("x STRING", "STRING", f"translate(x, '{S._LOWER}', '{S._UPPER}')"),
    "sed_number": ("x STRING", "DOUBLE", r"coalesce(try_cast(regexp_extract(x, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE), CASE WHEN x IS NOT NULL THEN 0D END)"),
    "sed_integer": (
        "x STRING", "BIGINT",
        r"CASE WHEN x IS NULL THEN NULL WHEN regexp_extract(x, '^\\s*([+-]?\\d+)', 1) = '' THEN 0L ELSE coalesce(try_cast(regexp_extract(x, '^\\s*([+-]?\\d+)', 1) AS BIGINT), CASE WHEN x RLIKE '^\\s*-' THEN -9223372036854775807L - 1L ELSE 9223372036854775807L END) END",
    ),
    "sed_cut": ("x DOUBLE", "BIGINT", "CASE WHEN x >= 9.223372036854775807E18D THEN 9223372036854775807L WHEN x <= -9.223372036854775808E18D THEN -9223372036854775807L - 1L ELSE CAST(x AS BIGINT) END"),
    "sed_real_text": ("x DOUBLE", "STRING", "CASE WHEN abs(x) >= 1e15D OR (abs(x) < 1e-4D AND x <> 0D) THEN regexp_replace(lower(CAST(x AS STRING)), 'e(-?)(\\\\d)$', 'e$10$2') ELSE CASE WHEN CAST(x AS STRING) LIKE '%E%' THEN CAST(CAST(x AS DECIMAL(38, 10)) AS STRING) ELSE CAST(x AS STRING) END END"),
    "sed_shift": (
        "a BIGINT, n BIGINT", "BIGINT",
        "CASE WHEN n >= 64 THEN 0L WHEN n >= 0 THEN shiftleft(a, CAST(n AS INT)) WHEN n <= -64 THEN CASE WHEN a < 0 THEN -1L ELSE 0L END ELSE shiftright(a, CAST(-n AS INT)) END",
    ),
    "sed_place": ("k STRING", "STRING", "CASE WHEN k LIKE '$%' THEN k ELSE concat('$.\"', k, '\"') END"),
    "sed_substr3": (
        "x STRING, p BIGINT, n BIGINT", "STRING",
        "CASE WHEN x IS NULL OR p IS NULL OR n IS NULL THEN NULL ELSE sed_part(x, CASE WHEN p > 0 THEN p - 1 WHEN p < 0 THEN length(x) + p ELSE -1L END, n) END",
    ),
    "sed_substr2": ("x STRING, p BIGINT", "STRING", "CASE WHEN x IS NULL OR p IS NULL THEN NULL WHEN p > 0 THEN substring(x, CAST(p AS INT)) WHEN p = 0 THEN x ELSE substring(x, CAST(greatest(length(x) + p, 0L) AS INT) + 1) END"),
    "sed_part": ("x STRING, b BIGINT, n BIGINT", "STRING", "substring(x, CAST(greatest(least(b, b + n), 0L) AS INT) + 1, CAST(greatest(least(greatest(b, b + n), length(x)) - greatest(least(b, b + n), 0L), 0L) AS INT))"),
}
ORDER = ["sed_part", *[n for n in SQL if n != "sed_part"]]


def register(spark: SparkSession) -> None:
    """Makes the session's functions, once a session."""
    if spark.conf.get("sediment.sql.registered", None):
        return
    for n in ORDER:
        params, kind, body = SQL[n]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {n}({params}) RETURNS {kind} RETURN {body}")

    def texts(f):
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([f(*[None if (v is None or v is pd.NA) else v for v in row]) for row in zip(*columns, strict=True)], dtype=object)

        return run

    def register_pandas(name: str, f, kind: T.DataType = T.StringType()) -> None:
        run = texts(f)
        if f.__code__.co_argcount == 1:
            spark.udf.register(name, _one(run, kind))
        elif f.__code__.co_argcount == 2:
            spark.udf.register(name, _two(run, kind))
        else:
            spark.udf.register(name, _three(run, kind))

    register_pandas("sed_char", lambda c: None if c is None else chr(int(c)) if 0 <= c <= 0x10FFFF else "\ufffd")
    register_pandas("sed_glob", lambda p: None if p is None else S.glob_regex(p))
    register_pandas("sed_like", _like, T.BooleanType())
    register_pandas("sed_json_arrow", lambda d, p: _found(d, p, J._dumps))
    register_pandas("sed_json_value", lambda d, p: _found(d, p, _bare))
    register_pandas("sed_json_each", lambda d, p: J.members(d, p, False), J._ROW)
    register_pandas("sed_json_tree", lambda d, p: J.members(d, p, True), J._ROW)
    register_pandas("sed_json_edit", _edit)
    register_pandas("sed_json_type", lambda d, p: _found(d, p, J.type_name))
    spark.conf.set("sediment.sql.registered", "true")


def _one(run, kind):
    @F.pandas_udf(kind)
    def f(a: pd.Series) -> pd.Series:
        return run(a)

    return f


def _two(run, kind):
    @F.pandas_udf(kind)
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return f


def _three(run, kind):
    @F.pandas_udf(kind)
    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return f


def _like(x, pattern, escape):
    import re

    if x is None or pattern is None:
        return None
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        i += 1
    return re.fullmatch("".join(out), x, re.S | re.I | re.A) is not None if x.isascii() and pattern.isascii() else re.fullmatch("".join(out).translate(_DOWN), x.translate(_DOWN), re.S) is not None


_DOWN = str.maketrans(S._UPPER, S._LOWER)


def _found(doc, path, shape):
    x = J._loads(doc)
    v = x if x is J._NONE else J._find(x, J.steps(path))
    return None if v is J._NONE else shape(v)


def _bare(v):
    return None if v is None else str(int(v)) if isinstance(v, bool) else v if isinstance(v, str) else J._dumps(v)


def _edit(doc, how, changes):
    """changes: JSON list of path and value pairs, or of paths for remove."""
    x = J._loads(doc)
    if x is J._NONE or changes is None:
        return None
    items = json.loads(changes)
    if how == "patch":
        return J._dumps(J.merged(x, items))
    if how == "json":
        return J._dumps(x)
    if how == "remove":
        for p in items:
            x = J.removed(x, J.steps(p))
            if x is J._NONE:
                return None
        return J._dumps(x)
    for p, v in zip(items[::2], items[1::2], strict=True):
        x = J._put(x, J.steps(p), v, how in ("set", "insert"), how in ("set", "replace"))
    return J._dumps(x)


#: Functions that take and give doubles and are Spark's own.
MATH = set("sqrt exp ln log10 log2 sin cos tan asin acos atan atan2 sinh cosh tanh asinh acosh atanh degrees radians".split())
SCALAR = MATH | set(
    """length octet_length lower upper substr substring instr replace trim ltrim rtrim concat concat_ws char unicode hex unhex quote printf format typeof coalesce ifnull nullif iif if abs sign round max min
    ceil ceiling floor trunc log pow power mod pi likely unlikely likelihood zeroblob randomblob random sqlite_version date time datetime julianday unixepoch strftime sha256 like glob json json_valid json_type
    json_extract json_array json_object json_array_length json_quote json_set json_insert json_replace json_remove json_patch""".split()
)


def _json(t, e) -> str:
    """An argument as JSON text: JSON functions' results stay as they are."""
    e = t.value(e)
    if e.type == "null":
        return "'null'"
    if e.type == "int":
        return f"coalesce(CAST({e.sql} AS STRING), 'null')"
    if e.type == "real":
        return f"coalesce(sed_real_text({e.sql}), 'null')"
    if e.sql.startswith(("sed_json_edit(", "json_made(", "concat('[',", "concat('{',", "sed_json_arrow(")):
        return f"coalesce({e.sql}, 'null')"
    return f"coalesce(regexp_extract(to_json(named_struct('v', {t.text(e)})), '(?s)^\\\\{{\"v\":(.*)\\\\}}$', 1), 'null')"


def call(t, name: str, args: list, star: bool = False, distinct: bool = False, where: str | None = None, order: str = ""):
    from sediment.sql.dialect import AGGREGATES, E, SyntaxError_, literal

    n = len(args)
    if name in AGGREGATES and (star or n == 1 or name not in ("min", "max")):
        tail = f" FILTER (WHERE {where})" if where else ""
        if name == "count":
            return E(f"count({'1' if star or not args else ('DISTINCT ' * distinct) + t.keyed(t.value(args[0]))}){tail}", "int")
        x = t.value(args[0])
        if name in ("min", "max"):
            if x.collation:
                return E(f"{name}_by({x.sql}, {t.keyed(x)}){tail}", x.type)
            return E(f"{name}({x.sql}){tail}", x.type)
        if name in ("group_concat", "string_agg"):
            sep = t.text(args[1]) if n > 1 else "','"
            within = f" WITHIN GROUP (ORDER BY {order or t.text(x)})"  # without an order of its own, by value
            return E(f"listagg({'DISTINCT ' * distinct}{t.text(x)}, {sep}){within}{tail}", "text")
        if name == "json_group_array":
            return E(f"concat('[', array_join(array_sort(collect_list({_json(t, x)}){tail}), ','), ']')", "text")
        if name == "json_group_object":
            return E(f"concat('{{', array_join(array_sort(collect_list(concat({_json(t, E(t.text(x), 'text'))}, ':', {_json(t, args[1])})){tail}), ','), '}}')", "text")
        y = t.number(x)
        body = f"{'DISTINCT ' * distinct}{y.sql}"
        if name == "total":
            return E(f"coalesce(sum({'DISTINCT ' * distinct}CAST({y.sql} AS DOUBLE)){tail}, 0D)", "real")
        return E(f"{name}({body}){tail}", "real" if name == "avg" else y.type)
    a = [t.value(x) for x in args]
    s = lambda i: t.text(a[i])
    d = lambda i: f"CAST({t.number(a[i]).sql} AS DOUBLE)"
    i_ = lambda i: f"CAST({t.number(a[i]).sql} AS BIGINT)"
    if name in MATH:
        return E(f"nullif({name}({', '.join(d(i) for i in range(n))}), CAST('NaN' AS DOUBLE))", "real")
    if name == "length":
        return E(f"CAST({f'octet_length({a[0].sql})' if a[0].type == 'blob' else f'length(substring_index({s(0)}, chr(0), 1))'} AS BIGINT)", "int")
    if name == "octet_length":
        return E(f"CAST(octet_length({a[0].sql if a[0].type == 'blob' else s(0)}) AS BIGINT)", "int")
    if name in ("lower", "upper"):
        return E(f"sed_{name}({s(0)})", "text")
    if name in ("substr", "substring"):
        if a[0].type == "blob":
            return E(f"unhex(sed_substr3(hex({a[0].sql}), CASE WHEN {i_(1)} > 0 THEN {i_(1)} * 2 - 1 ELSE {i_(1)} * 2 END, {i_(2)} * 2))" if n > 2 else f"unhex(sed_substr2(hex({a[0].sql}), CASE WHEN {i_(1)} > 0 THEN {i_(1)} * 2 - 1 ELSE {i_(1)} * 2 END))", "blob")
        return E(f"sed_substr3({s(0)}, {i_(1)}, {i_(2)})" if n > 2 else f"sed_substr2({s(0)}, {i_(1)})", "text")
    if name == "instr":
        return E(f"CAST(CASE WHEN {s(1)} = '' THEN 1 ELSE instr({s(0)}, {s(1)}) END AS BIGINT)", "int")
    if name == "replace":
        return E(f"CASE WHEN {s(1)} = '' THEN {s(0)} ELSE replace({s(0)}, {s(1)}, {s(2)}) END", "text")
    if name in ("trim", "ltrim", "rtrim"):
        return E(f"{'btrim' if name == 'trim' else name}({', '.join([s(0), *([s(1)] if n > 1 else [])][:: -1] if name != 'trim' and n > 1 else [s(0), *([s(1)] if n > 1 else [])])})", "text")
    if name == "concat":
        return E(f"concat_ws('', {', '.join(t.text(x) for x in a if x.type != 'null') or literal('')})", "text")
    if name == "concat_ws":
        return E(f"concat_ws({s(0)}, {', '.join(t.text(x) for x in a[1:] if x.type != 'null') or literal('')})", "text")
    if name == "char":
        return E(f"concat_ws('', {', '.join(f'sed_char({i_(k)})' for k in range(n)) or literal('')})", "text")
    if name == "unicode":
        return E(f"CASE WHEN length({s(0)}) > 0 THEN CAST(ascii({s(0)}) AS BIGINT) END", "int")
    if name == "hex":
        return E(f"coalesce(hex({a[0].sql if a[0].type == 'blob' else s(0)}), '')", "text") if a[0].type != "null" else E("''", "text")
    if name == "unhex":
        return E(f"CASE WHEN {s(0)} RLIKE '^(?:[0-9A-Fa-f]{{2}})*$' THEN unhex({s(0)}) END", "blob")
    if name == "quote":
        k = a[0].type
        body = f"concat(\"'\", replace({s(0)}, \"'\", \"''\"), \"'\")" if k == "text" else f"concat(\"X'\", hex({a[0].sql}), \"'\")" if k == "blob" else s(0)
        return E("'NULL'" if k == "null" else f"coalesce({body}, 'NULL')", "text")
    if name == "typeof":
        k = {"int": "integer"}.get(a[0].type, a[0].type)
        return E("'null'" if k == "null" else f"CASE WHEN {a[0].sql} IS NULL THEN 'null' ELSE '{k}' END", "text")
    if name in ("coalesce", "ifnull"):
        kind = t.common({x.type for x in a})
        return E(f"coalesce({', '.join(t.text(x) if kind == 'text' and x.type != 'null' else x.sql for x in a)})", kind)
    if name == "nullif":
        return E(f"CASE WHEN {t.compare('=', a[0], a[1]).sql} THEN NULL ELSE {a[0].sql} END", a[0].type)
    if name in ("iif", "if"):
        other = a[2] if n > 2 else E("NULL", "null")
        return E(f"CASE WHEN {t.truth(args[0])} THEN {a[1].sql} ELSE {other.sql} END", t.common({a[1].type, other.type}))
    if name == "abs":
        x = t.number(a[0])
        return E(f"abs({x.sql})", x.type)
    if name == "sign":
        return E("NULL", "null") if a[0].type == "null" else E(f"CAST(signum({'try_cast(trim(' + a[0].sql + ') AS DOUBLE)' if a[0].type == 'text' else d(0)}) AS BIGINT)", "int")
    if name == "round":
        places = a[1].sql.strip("()L") if n > 1 else "0"
        if n > 1 and not places.lstrip("-").isdigit():
            raise SyntaxError_("round() to a number of places that isn't constant")
        return E(f"CAST(round({d(0)}, {min(max(int(places), 0), 30)}) AS DOUBLE)", "real")
    if name in ("max", "min"):
        kind = t.common({x.type for x in a})
        missing = " OR ".join(f"{x.sql} IS NULL" for x in a)
        return E(f"CASE WHEN {missing} THEN NULL ELSE {'greatest' if name == 'max' else 'least'}({', '.join(x.sql for x in a)}) END", kind)
    if name in ("ceil", "ceiling", "floor", "trunc"):
        x = t.number(a[0])
        if x.type == "int":
            return x
        f = {"ceiling": "ceil"}.get(name, name)
        return E(f"CAST(CASE WHEN {x.sql} < 0 THEN ceil({x.sql}) ELSE floor({x.sql}) END AS DOUBLE)" if f == "trunc" else f"CAST({f}({x.sql}) AS DOUBLE)", "real")
    if name == "log":
        return E(f"log10({d(0)})" if n == 1 else f"try_divide(ln({d(1)}), ln({d(0)}))", "real")
    if name in ("pow", "power"):
        return E(f"power({d(0)}, {d(1)})", "real")
    if name == "mod":
        return E(f"try_mod({d(0)}, {d(1)})", "real")
    if name == "pi":
        return E("pi()", "real")
    if name in ("likely", "unlikely", "likelihood"):
        return a[0]
    if name == "zeroblob":
        return E(f"unhex(repeat('00', CAST(greatest({i_(0)}, 0L) AS INT)))", "blob")
    if name == "randomblob":
        return E(f"substring(unhex(array_join(transform(sequence(1L, greatest({i_(0)}, 1L)), x -> sha2(uuid(), 256)), '')), 1, CAST(greatest({i_(0)}, 1L) AS INT))", "blob")
    if name == "random":
        return E("xxhash64(uuid())", "int")
    if name == "sqlite_version":
        return E("'3.46.1'", "text")
    if name == "sha256":
        return E(f"unhex(sha2({a[0].sql if a[0].type == 'blob' else s(0)}, 256))", "blob")
    if name == "like":
        return E(f"sed_like({s(1)}, {s(0)}, {s(2) if n > 2 else literal('')})", "bool")
    if name == "glob":
        return E(f"rlike({s(1)}, sed_glob({s(0)}))", "bool")
    if name in ("printf", "format"):
        return _printf(t, a)
    if name in ("date", "time", "datetime", "julianday", "unixepoch", "strftime"):
        return _time(t, name, a)
    return _json_call(t, name, a, s)


def _constant(t, e) -> str:
    from sediment.sources.lake import UnsupportedError

    if not e.sql.startswith("'"):
        raise UnsupportedError("a modifier or format that isn't constant")
    return e.sql[1:-1].replace("\\'", "'").replace("\\\\", "\\")


def _printf(t, a):
    from sediment.sql.dialect import E

    template = _constant(t, a[0])
    name = f"sed_printf_{abs(hash(template)) % 10**12}"
    t.extra.append(("printf", name, template, len(a) - 1))
    return E(f"{name}({', '.join(t.value(x).sql if x.type != 'null' else 'CAST(NULL AS STRING)' for x in a[1:]) or '0'})", "text")


def _time(t, name, a):
    from sediment.sql.dialect import E

    letters = _constant(t, a.pop(0)) if name == "strftime" else None
    modifiers = tuple(_constant(t, x) for x in a[1:])
    x = t.text(a[0]) if a else "date_format(current_timestamp(), \"yyyy-MM-dd HH:mm:ss\")"
    x = f"regexp_replace(CAST({x} AS STRING), '^now$', date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss'))"
    fn = f"sed_time_{abs(hash((name, letters, modifiers))) % 10**12}"
    t.extra.append(("time", fn, (name, letters, modifiers), 1))
    return E(f"{fn}({x})", {"julianday": "real", "unixepoch": "int"}.get(name, "text"))


def _json_call(t, name, a, s):
    from sediment.sql.dialect import E

    if name == "json":
        return E(f"sed_json_edit({s(0)}, 'json', '[]')", "text")
    if name == "json_valid":
        return E(f"CAST(CASE WHEN {s(0)} IS NOT NULL THEN try_parse_json({s(0)}) IS NOT NULL END AS BIGINT)", "int")
    if name == "json_type":
        return E(f"sed_json_type({s(0)}, {s(1) if len(a) > 1 else chr(39) + '$' + chr(39)})", "text")
    if name == "json_extract":
        if len(a) == 2:
            return E(f"sed_json_value({s(0)}, {s(1)})", "text")
        parts = ", ".join(f"coalesce(sed_json_arrow({s(0)}, {t.text(p)}), 'null')" for p in a[1:])
        return E(f"concat('[', concat_ws(',', {parts}), ']')", "text")
    if name == "json_array":
        return E(f"concat('[', concat_ws(',', {', '.join(_json(t, x) for x in a) or chr(39) * 2}), ']')", "text")
    if name == "json_object":
        pairs = ", ".join(f"concat({_json(t, E(t.text(k), 'text'))}, ':', {_json(t, v)})" for k, v in zip(a[::2], a[1::2], strict=True))
        return E(f"concat('{{', concat_ws(',', {pairs or chr(39) * 2}), '}}')", "text")
    if name == "json_array_length":
        v = f"sed_json_arrow({s(0)}, {s(1)})" if len(a) > 1 else s(0)
        return E(f"CASE WHEN {v} IS NOT NULL THEN CAST(coalesce(json_array_length({v}), 0) AS BIGINT) END", "int")
    if name == "json_quote":
        return E(_json(t, a[0]), "text")
    if name in ("json_set", "json_insert", "json_replace"):
        parts = ", ".join(_json(t, E(t.text(x), "text") if k % 2 == 0 else x) for k, x in enumerate(a[1:]))
        return E(f"sed_json_edit({s(0)}, '{name[5:]}', concat('[', concat_ws(',', {parts}), ']'))", "text")
    if name == "json_remove":
        parts = ", ".join(_json(t, E(t.text(x), "text")) for x in a[1:]) or "''"
        return E(f"sed_json_edit({s(0)}, 'remove', concat('[', concat_ws(',', {parts}), ']'))", "text")
    if name == "json_patch":
        return E(f"sed_json_edit({s(0)}, 'patch', {s(1)})", "text")
    return None


def make(spark: SparkSession, extra: list[tuple]) -> None:
    """Functions that depend on constants of the statement: formats and time modifiers."""
    for kind, name, what, n in extra:
        if spark.catalog.functionExists(name):
            continue
        if kind == "printf":
            template = what
            run = S.printf_udf(template)
            spark.udf.register(name, run)
        else:
            which, letters, modifiers = what
            x = F.col("x")
            us = D.time_value(x, *modifiers)
            fine = tuple(m for m in modifiers if m.strip().lower() in ("subsec", "subsecond"))
            out = {"julianday": D.julianday, "unixepoch": D.unixepoch, "date": D.date, "time": D.time, "datetime": D.datetime}[which](us, *fine) if which != "strftime" else D.strftime(letters, us)
            result = {"julianday": "DOUBLE", "unixepoch": "BIGINT"}.get(which, "STRING")
            text = spark.range(1).select(F.lit("").alias("x")).select(out.alias("r"))._jdf.queryExecution().analyzed().expressions().head().child().sql()
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {result} RETURN {text}")
