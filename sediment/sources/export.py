"""Writers: CSV, JSON and JSON lines, an SQLite file, and text formats for a shell."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hexed(df: DataFrame) -> DataFrame:
    return df.select(*[F.hex(c).alias(c) if k == "binary" else F.col(c) for c, k in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, quotes doubled, CRLF line ends, binary as hex."""
    _hexed(df).write.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue='""', nullValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    _hexed(df).write.option("ignoreNullFields", False).json(path)


def write_database(tables: dict[str, DataFrame], path: str) -> int:
    """An SQLite file of tables, streamed to the driver partition by partition; for results that fit one file."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    n = 0
    with sqlite3.connect(path) as c:
        for name, df in tables.items():
            columns = ", ".join(f'"{x}" {kinds.get(k, "TEXT")}' for x, k in df.dtypes)
            c.execute(f'CREATE TABLE "{name}" ({columns})')
            plain = df.select(*[F.col(x).cast("string") if k not in kinds else F.col(x) for x, k in df.dtypes])
            mark = ", ".join("?" * len(df.columns))
            rows = (tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in plain.toLocalIterator(prefetchPartitions=True))
            n += c.executemany(f'INSERT INTO "{name}" VALUES ({mark})', rows).rowcount
    return n


def lines(df: DataFrame, mode: str = "list", sep: str = "|") -> Iterator[str]:
    """Rows as text, streamed: list, csv, tabs, json, line, markdown, quote or table."""
    names = df.columns

    def text(v) -> str:
        return "" if v is None else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)

    def quoted(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else f"X'{bytes(v).hex()}'" if isinstance(v, (bytes, bytearray)) else "'" + str(v).replace("'", "''") + "'"

    rows = df.toLocalIterator(prefetchPartitions=True)
    if mode == "json":
        for i, r in enumerate(rows):
            yield ("[" if not i else ",\n") + json.dumps(dict(zip(names, map(lambda v: text(v) if isinstance(v, (bytes, bytearray)) else v, r), strict=True)), ensure_ascii=False, default=str)
        yield "]"
    elif mode == "line":
        width = max(map(len, names))
        for r in rows:
            yield "\n".join(f"{n:>{width}} = {text(v)}" for n, v in zip(names, r, strict=True)) + "\n"
    elif mode in ("markdown", "table"):
        held = [[text(v) for v in r] for r in rows]
        wide = [max(len(n), *(len(r[i]) for r in held)) if held else len(n) for i, n in enumerate(names)]
        line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)) + " |"
        yield line(names)
        yield "|" + "|".join("-" * (w + 2) for w in wide) + "|"
        yield from map(line, held)
    else:
        for r in rows:
            if mode == "csv":
                yield ",".join(f'"{t.replace(chr(34), chr(34) * 2)}"' if any(x in t for x in ',"\n\r') else t for t in map(text, r))
            elif mode == "quote":
                yield ",".join(map(quoted, r))
            else:
                yield ("\t" if mode == "tabs" else sep).join(map(text, r))
