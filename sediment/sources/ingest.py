"""Readers: CSV, JSON lines, syslog, journal JSON, records into known columns, database files, archives, manifests."""

from __future__ import annotations

import io
import sqlite3
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names of the syslog facilities and severities by number.
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
LEVELS = "emerg alert crit err warning notice info debug".split()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180 with a header; every column is text, an empty field stays an empty text."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False, emptyValue="", nullValue="\0")


def read_jsonl(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Columns are the union of the keys; nested values become JSON text, booleans 1 and 0."""
    df = spark.read.json(path, multiLine=multi_line)
    kinds = dict(df.dtypes)
    return df.select(*[F.to_json(c).alias(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(c).cast("int").alias(c) if kinds[c] == "boolean" else F.col(c) for c in df.columns])


def parse_syslog(lines: DataFrame, column: str = "value", year: int = 1970) -> DataFrame:
    """Syslog lines of either format: ts, host, app, pid, level, facility (its number, named by FACILITIES), message, msgid, sd. The old
    format has no year: it's given."""
    x = F.col(column)
    new = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[[^\]]*\])+) ?(.*)$"
    old = r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (\S+) ([^\[:\s]+)(?:\[(\d+)\])?: ?(.*)$"
    is_new = x.rlike(new)
    n = lambda i: F.nullif(F.regexp_extract(x, new, i), F.lit("-"))
    o = lambda i: F.nullif(F.regexp_extract(x, old, i), F.lit(""))
    pick = lambda a, b: F.when(is_new, n(a)).otherwise(o(b))
    pri = pick(1, 1).cast("int")
    names = lambda values, at: F.try_element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    old_ts = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(o(2), "  ", " 0"), F.lit("Z")), F.lit("yyyy MMM dd HH:mm:ssX"))
    return lines.filter(is_new | x.rlike(old)).select(
        F.when(is_new, n(2).try_cast("timestamp")).otherwise(old_ts).alias("ts"), pick(3, 3).alias("host"), pick(4, 4).alias("app"), pick(5, 5).alias("pid"),
        names(LEVELS, F.pmod(pri, F.lit(8))).alias("level"), F.call_function("div", pri, F.lit(8)).cast("int").alias("facility"),
        pick(8, 6).alias("message"), F.when(is_new, n(6)).alias("msgid"), F.when(is_new, n(7)).alias("sd"),
    )


def parse_journal(lines: DataFrame, column: str = "value") -> DataFrame:
    """Journal JSON lines: ts in nanoseconds, level, host, app, pid, message, and the other fields as JSON."""
    m = F.from_json(column, "map<string,string>")
    known = ("__REALTIME_TIMESTAMP", "PRIORITY", "_HOSTNAME", "SYSLOG_IDENTIFIER", "_PID", "MESSAGE")
    rest = F.map_filter(F.col("m"), lambda k, v: ~k.isin(*known))
    return lines.withColumn("m", m).filter("m is not null").select(
        (F.col("m")["__REALTIME_TIMESTAMP"].try_cast("bigint") * 1000).alias("ts"), F.try_element_at(F.array(*[F.lit(v) for v in LEVELS]), F.col("m")["PRIORITY"].try_cast("int") + 1).alias("level"),
        F.col("m")["_HOSTNAME"].alias("host"), F.col("m")["SYSLOG_IDENTIFIER"].alias("app"), F.col("m")["_PID"].alias("pid"), F.col("m")["MESSAGE"].alias("message"), F.to_json(rest).alias("fields"),
    )


def records(df: DataFrame, columns: list[str], ts: str = "ts", default_ts: int | None = None) -> DataFrame:
    """Known columns by name, whatever their case; all others into the JSON column fields; without a time: the default, else skipped."""
    have = {c.lower(): c for c in df.columns}
    known = [(c, have.get(c.lower())) for c in columns]
    rest = [c for c in df.columns if c.lower() not in {x.lower() for x in columns}]
    out = df.select(*[(F.col(f"`{s}`") if s else F.lit(None).cast("string")).alias(c) for c, s in known], (F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit(None).cast("string")).alias("fields"))
    if ts in columns:
        out = out.withColumn(ts, F.coalesce(F.col(ts), F.lit(default_ts))) if default_ts is not None else out.filter(F.col(ts).isNotNull())
    return out


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class DatabaseFileReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 4))
        self.names = [f.name for f in schema]
        self.kinds = [f.dataType.simpleString() for f in schema]

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            try:
                low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:
                return [_Range(None, None)]
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        where = "" if partition.low is None else f" WHERE rowid BETWEEN {partition.low} AND {partition.high}"
        columns = ", ".join(f'"{n}"' for n in self.names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(f'SELECT {columns} FROM "{self.table}"{where}'):
                yield tuple(v if v is None or k not in ("string", "double") else str(v) if k == "string" else float(v) for v, k in zip(row, self.kinds, strict=True))


class DatabaseFile(DataSource):
    """A table of an SQLite file on a path all executors see, read in ranges of rowid; types by the affinity of the declaration."""

    @classmethod
    def name(cls) -> str:
        return "database_file"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            rows = c.execute(f"PRAGMA table_info(\"{self.options['table']}\")").fetchall()

        def kind(declared: str) -> str:
            t = declared.upper()
            if "INT" in t:
                return "bigint"
            if any(x in t for x in ("CHAR", "CLOB", "TEXT")):
                return "string"
            return "binary" if not t or "BLOB" in t else "double"

        return ", ".join(f"`{r[1]}` {kind(r[2])}" for r in rows)

    def reader(self, schema) -> DatabaseFileReader:
        return DatabaseFileReader(self.options, schema)


def read_database(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(DatabaseFile)
    return spark.read.format("database_file").options(path=path, table=table, partitions=str(partitions)).load()


def database_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY 1")]


def archive_listing(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, size, packed, mtime, sha256) of the members of zip and tar files, plain or compressed, and of gz, bz2 and xz files
    of one member, named without the ending; broken ones give no rows."""
    import bz2
    import gzip
    import hashlib
    import lzma

    alone = {b"\x1f\x8b": gzip.decompress, b"BZ": bz2.decompress, b"\xfd7": lzma.decompress}

    def plain(content: bytes) -> bool:
        try:
            with tarfile.open(fileobj=io.BytesIO(content)):
                return False
        except tarfile.TarError:
            return content[:2] in alone

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    if zipfile.is_zipfile(io.BytesIO(content)):
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            rows = [(name, i.filename, i.file_size, i.compress_size, pd.Timestamp(*i.date_time), hashlib.sha256(z.read(i)).digest()) for i in z.infolist() if not i.is_dir()]
                    elif plain(content):
                        data = alone[content[:2]](content)
                        rows = [(name, name.rsplit("/", 1)[-1].rsplit(".", 1)[0], len(data), len(content), None, hashlib.sha256(data).digest())]
                    else:
                        with tarfile.open(fileobj=io.BytesIO(content)) as t:
                            rows = [(name, m.name, m.size, m.size, pd.Timestamp(m.mtime, unit="s"), hashlib.sha256(t.extractfile(m).read()).digest()) for m in t if m.isfile()]
                except (tarfile.TarError, zipfile.BadZipFile, ValueError, EOFError, OSError, lzma.LZMAError):
                    continue
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "path", "size", "packed", "mtime", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, path string, size bigint, packed bigint, mtime timestamp, sha256 binary")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of sidecar files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
