"""Scalar functions with embedded-database semantics as column expressions, all inside the JVM but for printf.

Each takes and gives columns. NULL in gives NULL out unless the docstring says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The longest numeric prefix of a text.
NUMERIC_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
INTEGER_PREFIX = r"^\s*([+-]?\d+)"


def lower(x: Column) -> Column:
    """ASCII letters only."""
    return F.translate(x, _UPPER, _LOWER)


def upper(x: Column) -> Column:
    return F.translate(x, _LOWER, _UPPER)


nocase = lower


def rtrim_key(x: Column) -> Column:
    """Key of the collation that ignores trailing spaces."""
    return F.rtrim(x)


def number_of(text: Column) -> Column:
    """Text as a number: its longest numeric prefix, else 0."""
    return F.coalesce(F.regexp_extract(text, NUMERIC_PREFIX, 1).try_cast("double"), F.when(text.isNotNull(), F.lit(0.0)))


def integer_of(text: Column) -> Column:
    """Text as an integer by its prefix, saturating at 64 bits."""
    digits = F.regexp_extract(text, INTEGER_PREFIX, 1)
    most = F.when(digits.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(text.isNull(), None).when(digits == "", F.lit(0).cast("bigint")).otherwise(F.coalesce(digits.try_cast("bigint"), most))


def divide(a: Column, b: Column, integers: bool = False) -> Column:
    """Integers truncate; division by zero is NULL."""
    if not integers:
        return F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(b != 0, F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0))))


def modulo(a: Column, b: Column) -> Column:
    """Operands cut to integers first; zero divisor gives NULL."""
    return F.try_mod(a.cast("bigint"), b.cast("bigint"))


def add_promoting(a: Column, b: Column) -> Column:
    """Sum of integers as double where it overflows 64 bits; the column is double throughout."""
    return F.coalesce(F.try_add(a, b).cast("double"), a.cast("double") + b.cast("double"))


def shift_left(a: Column, n: Column) -> Column:
    """Shift by 64 or more gives 0, by a negative number shifts right."""
    a = a.cast("bigint")
    return F.when(n < 0, _right(a, -n)).when(n >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", a, n.cast("int")))


def shift_right(a: Column, n: Column) -> Column:
    a = a.cast("bigint")
    return F.when(n < 0, F.when(n <= -64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", a, (-n).cast("int")))).otherwise(_right(a, n))


def _right(a: Column, n: Column) -> Column:
    return F.when(n >= 64, F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).otherwise(F.call_function("shiftright", a, n.cast("int")))


def like(text: Column, pattern: str, escape: str | None = None) -> Column:
    """Case-insensitive for ASCII letters only; the pattern is a constant."""
    low = "".join(c.lower() if c.isascii() else c for c in pattern)
    return F.like(lower(text), F.lit(low), F.lit(escape)) if escape else F.like(lower(text), F.lit(low.replace("\\", "\\\\")))


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a glob with *, ?, [a-z] and [^...]."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            negated, inner = inner[:1] == "^", inner.lstrip("^") if inner[:1] == "^" else inner
            body = "".join(x if x == "-" or x.isalnum() else "\\" + x for x in inner)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append(c if c.isalnum() or c == "_" else "\\" + c)
        i += 1
    return f"(?s)^{''.join(out)}$"


def glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_regex(pattern))


def regexp(text: Column, pattern: str) -> Column:
    """Unanchored find."""
    return text.rlike(pattern)


def length(x: Column) -> Column:
    """Characters before the first NUL; bytes of a BLOB; characters of a number's text."""
    return F.when(F.typeof(x) == "binary", F.octet_length(x.cast("string"))).otherwise(F.length(F.substring_index(x.cast("string"), "\0", 1)))


def octet_length(x: Column) -> Column:
    """Bytes of a BLOB or of the UTF-8 of a value's text."""
    return F.octet_length(x.cast("string"))


def substr(x: Column, start: int | Column, n: int | Column | None = None) -> Column:
    """Positions from 1; 0 stands before the first character and uses up length; negative start counts from the end; negative
    length takes the characters before start."""
    size = F.length(x)
    p = start if isinstance(start, Column) else F.lit(start)
    begin = F.when(p > 0, p - 1).when(p < 0, size + p).otherwise(F.lit(-1))
    if n is None:
        first, last = F.when(p == 0, F.lit(0)).otherwise(begin), size
    else:
        k = n if isinstance(n, Column) else F.lit(n)
        first, last = F.least(begin, begin + k), F.greatest(begin, begin + k)
    first, last = F.greatest(first, F.lit(0)), F.least(last, size)
    return F.when(x.isNull() | p.isNull(), None).when(last <= first, F.lit("")).otherwise(F.substring(x, first + 1, last - first))


def instr(x: Column, y: Column) -> Column:
    return F.when(y == "", F.lit(1)).otherwise(F.call_function("instr", x, y))


def replace(x: Column, old: Column, new: Column) -> Column:
    return F.when(old == "", x).otherwise(F.replace(x, old, new))


def trim(x: Column, chars: str = " ") -> Column:
    return F.btrim(x, F.lit(chars))


def ltrim(x: Column, chars: str = " ") -> Column:
    return F.ltrim(x, F.lit(chars))


def rtrim(x: Column, chars: str = " ") -> Column:
    return F.rtrim(x, F.lit(chars))


def zeroblob(n: Column) -> Column:
    """n zero bytes; none for a negative n."""
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n.cast("int"), F.lit(0))))


def randomblob(n: Column) -> Column:
    """n random bytes, at least one."""
    return F.substring(F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda _: F.sha2(F.uuid(), 256)), "")), 1, F.greatest(n.cast("int"), F.lit(1)))


def random() -> Column:
    """A random 64-bit integer."""
    return F.xxhash64(F.uuid())


def iif(condition: Column, yes: Column, no: Column | None = None) -> Column:
    """no, by default NULL, where the condition is false or NULL."""
    return F.when(condition, yes).otherwise(no) if no is not None else F.when(condition, yes)


def absolute(x: Column, text: bool = False) -> Column:
    """abs; with text, x counts by its numeric prefix, as a double."""
    return F.abs(number_of(x) if text else x)


def likely(x: Column) -> Column:
    """A hint to a planner, without effect: also unlikely and likelihood."""
    return x


def concat(*xs: Column) -> Column:
    """Skips NULLs."""
    return F.concat_ws("", *[x.cast("string") for x in xs])


def concat_ws(sep: str, *xs: Column) -> Column:
    return F.concat_ws(sep, *[x.cast("string") for x in xs])


def char(*codes: Column) -> Column:
    """The text of Unicode code points, by their UTF-8 bytes."""

    def one(c: Column) -> Column:
        c = c.cast("bigint")
        b = lambda base, shift: F.lpad(F.hex(F.lit(base) + F.call_function("shiftright", c, F.lit(shift)).bitwiseAND(F.lit(63))), 2, "0")
        lead = lambda base, shift: F.hex(F.lit(base) + F.call_function("shiftright", c, F.lit(shift)))
        return (
            F.when(c.isNull() | (c < 0) | (c > 0x10FFFF), F.lit("EFBFBD"))
            .when(c < 0x80, F.lpad(F.hex(c), 2, "0"))
            .when(c < 0x800, F.concat(lead(0xC0, 6), b(0x80, 0)))
            .when(c < 0x10000, F.concat(lead(0xE0, 12), b(0x80, 6), b(0x80, 0)))
            .otherwise(F.concat(lead(0xF0, 18), b(0x80, 12), b(0x80, 6), b(0x80, 0)))
        )

    return F.decode(F.unhex(F.concat(*[one(c) for c in codes])), "UTF-8") if codes else F.lit("")


def unicode(x: Column) -> Column:
    """Code point of the first character; NULL for an empty text."""
    return F.when(F.length(x) > 0, F.ascii(x).cast("bigint"))


def hex_text(x: Column) -> Column:
    """Hex of a BLOB's bytes or of the UTF-8 of a value's text."""
    return F.hex(x.cast("string"))


def unhex(x: Column, ignore: str = "") -> Column:
    """Bytes of hex digits; NULL if a character isn't a digit or their number is odd."""
    digits = F.translate(x, ignore, "") if ignore else x
    return F.when(digits.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(digits))


def quote(x: Column, kind: str) -> Column:
    """SQL literal of a value of the given Spark type name; NULL gives the text NULL."""
    if kind in ("string", "varchar"):
        body = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "binary":
        body = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    else:
        body = x.cast("string")
    return F.coalesce(body, F.lit("NULL"))


def sign(x: Column) -> Column:
    """NULL for a text that is no number."""
    return F.signum(x.try_cast("double")).cast("int")


def round_half(x: Column, n: int = 0) -> Column:
    """Halves away from zero, always a double; negative n acts as 0, beyond 30 as 30."""
    return F.round(x.cast("double"), min(max(n, 0), 30)).cast("double")


def scalar_max(*xs: Column) -> Column:
    """NULL if any argument is NULL."""
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, F.greatest(*xs))


def scalar_min(*xs: Column) -> Column:
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, F.least(*xs))


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def math(name: str, *xs: Column, integers: bool = False) -> Column:
    """sqrt, exp, ln, log10, log2, log (base 10), pow, mod, trigonometry and the like; NaN is NULL, mod of 0 is NULL. integers: the
    argument is an integer, which ceil, floor and trunc leave as it is."""
    if integers and name in ("ceil", "ceiling", "floor", "trunc"):
        return xs[0].cast("bigint")
    xs = tuple(x.cast("double") for x in xs)
    if name == "log":
        return _finite(F.log10(xs[0])) if len(xs) == 1 else _finite(F.try_divide(F.ln(xs[1]), F.ln(xs[0])))
    if name == "mod":
        return F.try_mod(*xs)
    if name == "pi":
        return F.pi()
    if name == "trunc":
        return F.when(xs[0] < 0, F.ceil(xs[0])).otherwise(F.floor(xs[0])).cast("double")
    if name in ("ceil", "ceiling", "floor"):
        return (F.floor if name == "floor" else F.ceil)(xs[0]).cast("double")
    return _finite(F.call_function({"power": "pow", "ln": "ln"}.get(name, name), *xs))


def type_of(kind: str) -> str:
    """Storage class of a Spark type name: a constant of the plan."""
    return {"string": "text", "double": "real", "float": "real", "binary": "blob", "void": "null"}.get(kind, "integer")


def storage_class(x: Column) -> Column:
    """typeof of each value: null, integer, real, text or blob."""
    kind = F.typeof(x)
    known = F.when(kind == "string", "text").when(kind.isin("double", "float") | kind.startswith("decimal"), "real").when(kind == "binary", "blob").otherwise("integer")
    return F.when(x.isNull(), "null").otherwise(known)


def sha256(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def crc64_udf():
    """CRC-64/XZ of bytes, in Arrow batches; the 256-entry table follows from the polynomial."""
    poly = 0xC96C5795D7870F42  # fixed value of the format
    step = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (poly if b & 1 else 0)
        step.append(b)

    @F.pandas_udf(T.StringType())
    def crc64(xs: pd.Series) -> pd.Series:
        def one(data):
            if data is None:
                return None
            c = 2**64 - 1
            for b in data:
                c = step[(c ^ b) & 255] ^ (c >> 8)
            return f"{c ^ (2**64 - 1):016x}"

        return xs.map(one)

    return crc64


def printf(template: str, *xs: Column) -> Column:
    """printf_udf(template) of xs."""
    return printf_udf(template)(*(xs or (F.lit(0),)))


def printf_udf(template: str):
    """%d %i %f %e %g %s %x %X %o %c %q %Q %w %% with flags - + 0 space , and ! # and widths; in Arrow batches.

    A missing or NULL number prints as 0, a NULL text as empty, under %Q as NULL.
    """
    import re as _re

    spec = _re.compile(r"%([-+ 0,!#]*)(\*|\d+)?(?:\.(\d+))?(?:ll|l)?([diufeEgGsxXoczqQw%])")

    def render(row: tuple) -> str:
        at = iter(row)

        def sub(m) -> str:
            flags, width, digits, kind = m[1], m[2], m[3], m[4]
            if kind == "%":
                return "%"
            w = int(next(at, 0) or 0) if width == "*" else int(width or 0)
            v = next(at, None)
            if kind in "diu":
                n = int(float(v or 0))
                s = f"{abs(n):,}" if "," in flags else str(abs(n))
                s = s.zfill(int(digits)) if digits else s
                head = "-" if n < 0 else "+" if "+" in flags else " " if " " in flags else ""
                if "0" in flags and "-" not in flags:
                    s = s.zfill(w - len(head))
                s = head + s
            elif kind in "feEgG":
                s = f"%{''.join(c for c in flags if c in '+ 0#-')}{w or ''}.{digits or 6}{kind}" % float(v or 0)
            elif kind in "xXo":
                s = f"%{''.join(c for c in flags if c in '0#-')}{w or ''}{kind}" % (int(float(v or 0)) & (2**64 - 1))
            elif kind == "c":
                s = str(v or "")[:1]
            elif kind == "Q":
                s = "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
            elif kind == "q":
                s = str(v if v is not None else "(NULL)").replace("'", "''")
            elif kind == "w":
                s = str(v if v is not None else "(NULL)").replace('"', '""')
            else:
                s = "" if v is None else str(v)
                s = s[: int(digits)] if digits else s
            return s.ljust(w) if "-" in flags else s.rjust(w)

        return spec.sub(sub, template)

    @F.pandas_udf(T.StringType())
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([render(tuple(None if pd.isna(v) else v for v in row)) for row in zip(*columns, strict=True)])

    return run
