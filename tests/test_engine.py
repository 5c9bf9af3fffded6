"""The versioned store, key-value stores, series, search, similarity and functions."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.functions import aggregates as A
from sediment.functions import dates as D
from sediment.functions import json_fns as J
from sediment.functions import scalar as S
from sediment.operators import fts, relational, tlsh
from sediment.operators.history import row_history
from sediment.sources import export, ingest
from sediment.sources.kv import KeyValue
from sediment.sources.lake import BusyError, ConstraintError, Lake, NotFoundError, Table, UnsupportedError
from sediment.streaming.series import Rollup, Series, partition_start, start_of

DAY = 86_400 * 10**9


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_scalars_against_sqlite(spark):
    c = sqlite3.connect(":memory:")
    for start in range(-7, 8):
        for n in (None, -3, -1, 0, 1, 2, 9):
            want = c.execute("select substr('hello', ?, ?)" if n is not None else "select substr('hello', ?)", (start, n) if n is not None else (start,)).fetchone()[0]
            assert one(spark, S.substr(F.lit("hello"), start, n))[0] == want, (start, n)
    for t in ("12abc", "-3.5e2x", "abc", " 7", "", ".5"):
        assert one(spark, S.number_of(F.lit(t)))[0] == c.execute("select ? + 0.0", (t,)).fetchone()[0]
    for a, b in ((7, 2), (-7, 2), (7, -2), (5, 0)):
        assert one(spark, S.divide(F.lit(a), F.lit(b), integers=True), S.modulo(F.lit(a), F.lit(b))) == c.execute("select ? / ?, ? % ?", (a, b, a, b)).fetchone()
    for a, n in ((1, 3), (1, 64), (-1, 70), (8, -2), (-8, 1)):
        assert one(spark, S.shift_left(F.lit(a), F.lit(n)), S.shift_right(F.lit(a), F.lit(n))) == c.execute("select ? << ?, ? >> ?", (a, n, a, n)).fetchone()
    for v in ("a'b", None):
        assert one(spark, S.quote(F.lit(v).cast("string"), "string"))[0] == c.execute("select quote(?)", (v,)).fetchone()[0]
    for f, x in (("%5d|%-4d|%05d", (42, 7, -3)), ("%.2f %s %q", (2.5, "a", "b'c")), ("%x %c%%", (255, "z"))):
        assert one(spark, S.printf(f, *map(F.lit, x)))[0] == c.execute(f"select printf(?{', ?' * len(x)})", (f, *x)).fetchone()[0]
    assert one(spark, S.char(F.lit(960), F.lit(65), F.lit(0x1F600)), S.unicode(F.lit("é")), S.unhex(F.lit("4a4")), S.sign(F.lit(-3.5)), S.round_half(F.lit(-2.5))) == ("πA😀", 233, None, -1, -3.0)


def test_more_scalars_against_sqlite(spark):
    c = sqlite3.connect(":memory:")
    blob = F.unhex(F.lit("410042"))
    cases = [
        ("length(x'410042')", S.length(blob)), ("length('ab' || char(0) || 'c')", S.length(F.lit("ab\0c"))), ("length(1234)", S.length(F.lit(1234))), ("octet_length('é')", S.octet_length(F.lit("é"))),
        ("hex(12)", S.hex_text(F.lit(12))), ("hex(x'00ff')", S.hex_text(F.unhex(F.lit("00ff")))), ("ltrim('xxaxx', 'x')", S.ltrim(F.lit("xxaxx"), "x")), ("rtrim('xxaxx', 'x')", S.rtrim(F.lit("xxaxx"), "x")),
        ("abs('-3.5x')", S.absolute(F.lit("-3.5x"), text=True)), ("abs('abc')", S.absolute(F.lit("abc"), text=True)), ("abs(-2)", S.absolute(F.lit(-2))), ("sign('abc')", S.sign(F.lit("abc"))), ("sign('-2')", S.sign(F.lit("-2"))),
        ("iif(null, 1, 2)", S.iif(F.lit(None).cast("boolean"), F.lit(1), F.lit(2))), ("ceil(3)", S.math("ceil", F.lit(3), integers=True)), ("floor(-2.5)", S.math("floor", F.lit(-2.5))), ("trunc(7)", S.math("trunc", F.lit(7), integers=True)),
        ("typeof('a')", S.storage_class(F.lit("a"))), ("typeof(1.5)", S.storage_class(F.lit(1.5))), ("typeof(2)", S.storage_class(F.lit(2))), ("typeof(x'00')", S.storage_class(blob)), ("typeof(null)", S.storage_class(F.lit(None).cast("int"))),
        ("zeroblob(3)", S.zeroblob(F.lit(3))), ("zeroblob(-1)", S.zeroblob(F.lit(-1))), ("length(randomblob(40))", S.length(S.randomblob(F.lit(40)))), ("typeof(random())", S.storage_class(S.random())),
    ]
    got = one(spark, *[x for _, x in cases])
    for (sql, _), g in zip(cases, got, strict=True):
        try:
            want = c.execute(f"select {sql}").fetchone()[0]
        except sqlite3.OperationalError:
            continue
        assert (bytes(g) if isinstance(g, bytearray) else g) == want and (isinstance(g, bytearray) or type(g) is type(want)), (sql, g, want)


def test_times_in_any_zone(spark):
    c = sqlite3.connect(":memory:")
    cases = [
        ("datetime('2024-03-10 02:30:00')", D.datetime(D.micros_of_text(F.lit("2024-03-10 02:30:00")))), ("datetime('2024-07-01T10:00:00+02:00')", D.datetime(D.micros_of_text(F.lit("2024-07-01T10:00:00+02:00")))),
        ("date('2024-07-01')", D.date(D.micros_of_text(F.lit("2024-07-01")))), ("datetime(1700000000, 'unixepoch')", D.datetime(D.time_value(F.lit(1700000000), "unixepoch"))), ("datetime(2460000.5)", D.datetime(D.time_value(F.lit(2460000.5)))),
        ("datetime(2460000.5, 'auto')", D.datetime(D.time_value(F.lit(2460000.5), "auto"))), ("datetime(1700000000, 'auto', '+1 day')", D.datetime(D.time_value(F.lit(1700000000), "auto", "+1 day"))), ("time('10:20:30')", D.time(D.micros_of_text(F.lit("10:20:30")))),
        ("'2024-01-01 00:00:01.250'", D.datetime(D.micros_of_text(F.lit("2024-01-01 00:00:01.25")), "subsec")), ("unixepoch('2024-03-10 02:30:00')", D.unixepoch(D.micros_of_text(F.lit("2024-03-10 02:30:00")))),
    ]
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = one(spark, *[x for _, x in cases])
            assert list(got) == [c.execute(f"select {sql}").fetchone()[0] for sql, _ in cases], zone
            clock = F.lit("2024-03-10 02:30:00.000001").cast("timestamp_ntz")  # a time that New York skips
            assert one(spark, D.micros_of(clock), D.micros_of(F.lit("1969-12-31 23:59:59").cast("timestamp_ntz"))) == (1710037800000001, -1000000), zone
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert one(spark, D.datetime(D.micros_of_text(F.lit("2024-07-01 10:00:00")), "localtime"), D.datetime(D.micros_of_text(F.lit("2024-07-01 12:00:00")), "utc")) == ("2024-07-01 12:00:00", "2024-07-01 10:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_json_values_against_sqlite(spark):
    c = sqlite3.connect(":memory:")
    docs = ['{"a": true, "b": [false, null, 1, 1.0, "true", {"c": []}], "n": null, "s": "true"}', "[1,2]", "true", '"x"', "null", "3", "nope", None]
    paths = ["$", "$.a", "$.b", "$.b[0]", "$.b[1]", "$.b[3]", "$.b[4]", "$.b[5].c", "$.n", "$.s", "$.b[#-1]", "$.zz", "$[1]"]
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    got = df.select(*[J.extract(F.col("d"), p).alias(f"e{i}") for i, p in enumerate(paths)], *[J.type_at(F.col("d"), p).alias(f"t{i}") for i, p in enumerate(paths)], J.extract(F.col("d"), "$.a", "$.zz", "$.b[2]").alias("many")).collect()
    text = lambda v: v if v is None or isinstance(v, str) else str(v)
    for d, r in zip(docs, got, strict=True):
        if d == "nope":
            assert set(r) == {None}
            continue
        for i, p in enumerate(paths):
            assert (r[f"e{i}"], r[f"t{i}"]) == tuple(map(text, c.execute("select json_extract(?1, ?2), json_type(?1, ?2)", (d, p)).fetchone())), (d, p)
        assert r["many"] == c.execute("select json_extract(?, '$.a', '$.zz', '$.b[2]')", (d,)).fetchone()[0]
    doc = F.lit(docs[0])
    got = one(spark, J.arrow(doc, "a"), J.arrow_text(doc, "a"), J.arrow(doc, "s"), J.arrow(F.lit("[1,2]"), 1), J.arrow_text(F.lit("[1,2]"), 0), J.arrow(doc, "$.b[5]"))
    sql = [(docs[0], "->'a'"), (docs[0], "->>'a'"), (docs[0], "->'s'"), ("[1,2]", "->1"), ("[1,2]", "->>0"), (docs[0], "->'$.b[5]'")]
    assert list(got) == [text(c.execute(f"select ? {x}", (d,)).fetchone()[0]) for d, x in sql]


def test_like_and_glob(spark):
    assert one(spark, S.like(F.lit("HeLLo"), "hell_"), S.like(F.lit("É"), "é"), S.glob(F.lit("ab.c"), "a[a-c].?"), S.glob(F.lit("abxc"), "a[^b]*")) == (True, False, True, False)


def test_dates_against_sqlite(spark):
    c = sqlite3.connect(":memory:")
    for t in ("2024-01-31 10:20:30", "1969-12-28 23:59:59", "2000-02-29 00:00:00", "2023-12-31 12:00:00"):
        us = D.micros_of_text(F.lit(t))
        for mods in ((), ("+1 month",), ("-1 year", "start of month"), ("weekday 0",), ("weekday 3", "+90 minutes"), ("start of year", "-1 day"), ("-02:30",)):
            assert one(spark, D.datetime(us, *mods))[0] == c.execute(f"select datetime(?{', ?' * len(mods)})", (t, *mods)).fetchone()[0], (t, mods)
        for f in ("%Y|%m|%d|%H|%M|%S|%f", "%j %w %W %s"):
            assert one(spark, D.strftime(f, us))[0] == c.execute("select strftime(?, ?)", (f, t)).fetchone()[0]
        assert abs(one(spark, D.julianday(us))[0] - c.execute("select julianday(?)", (t,)).fetchone()[0]) < 1e-7
    assert one(spark, D.date(D.micros_of_text(F.lit("nope"))), D.strftime("%Q", F.lit(0)), D.ns_of_text(F.lit("1970-01-01 00:00:01.123456789"))) == (None, None, 1_123_456_789)


def test_json_against_sqlite(spark):
    c = sqlite3.connect(":memory:")
    doc = '{"a": {"b": [1, 2.5, "x", null, true]}, "z": "t"}'
    for sql, f in (("json_set", J.set_), ("json_insert", J.insert), ("json_replace", J.replace)):
        for p in ("$.a.b[0]", "$.a.b[#]", "$.n", "$.z"):
            assert one(spark, f(F.lit(doc), p, F.lit(9)))[0] == c.execute(f"select {sql}(?, ?, 9)", (doc, p)).fetchone()[0], (sql, p)
    for p in ("$.a.b[1]", "$.z", "$.q", "$.a.b[#-1]"):
        assert one(spark, J.remove(F.lit(doc), p))[0] == c.execute("select json_remove(?, ?)", (doc, p)).fetchone()[0]
        assert one(spark, J.type_at(F.lit(doc), p))[0] == c.execute("select json_type(?, ?)", (doc, p)).fetchone()[0]
    assert one(spark, J.json(F.lit(doc)))[0] == c.execute("select json(?)", (doc,)).fetchone()[0]
    assert one(spark, J.patch(F.lit(doc), F.lit('{"a": null, "k": {"v": 1}}')))[0] == c.execute("select json_patch(?, ?)", (doc, '{"a": null, "k": {"v": 1}}')).fetchone()[0]
    assert one(spark, J.array_length(F.lit("[1,2]")), J.array_length(F.lit("{}")), J.valid(F.lit("{")), J.extract(F.lit(doc), "$.a.b[#-3]")) == (2, 0, 0, "x")
    got = J.tree(spark.createDataFrame([(doc,)], "d string"), "d").select("fullkey", "type").collect()
    assert [tuple(r) for r in got] == c.execute("select fullkey, type from json_tree(?)", (doc,)).fetchall()
    got = J.each(spark.createDataFrame([(doc,), (None,), ("x",)], "d string"), "d").select("key", "type").collect()
    assert [tuple(r) for r in got] == [("a", "object"), ("z", "text")]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 5.0), (3, "b", 5.0)], "id int, t string, v double")
    row = df.agg(A.total(F.lit(None).cast("int")), A.group_concat(F.col("t"), "-", F.col("id")), A.bare_at_max(F.col("v"), F.col("id"), tie=F.col("id"))["id"], A.json_group_array(F.col("t"), F.col("id")), A.json_group_object(F.lit("k"), F.col("v"), F.col("id"))).first()
    assert tuple(row) == (0.0, "a-b", 2, '["a",null,"b"]', '{"k":5.0}')


def test_relational(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 1, 2], [2, 3], [3]))
    got = relational.compound(a, ("union", b), ("except", c)).collect()
    assert sorted(r.k for r in got) == [1, 2]
    found = relational.recursive(spark.createDataFrame([(0,), (None,)], "k int"), lambda x: x.select(((F.col("k") + 2) % 6).alias("k")))
    assert sorted((r.k is None, r.k or 0) for r in found.collect()) == [(False, 0), (False, 2), (False, 4), (True, 0)]
    numbered = relational.number_rows(spark.range(100).select((F.col("id") * 7 % 100).alias("x")), ["x"])
    assert [(r.x, r.rowid) for r in numbered.orderBy("x").collect()] == [(i, i + 1) for i in range(100)]
    assert relational.limit_offset(a, -1, -5).count() == 3
    empty = spark.createDataFrame([], "v int")
    assert {r.o for r in relational.not_in_value(spark.createDataFrame([(None,), (1,)], "k int"), "k", empty, "v", "o").collect()} == {1}


def test_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.create("t", Table("id bigint, v string", key=("id",), checks=("v <> 'bad'",)), time_ns=1)
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, v string")
    lake.insert("t", rows((1, "a"), (2, "b")), time_ns=10)
    for bad in (rows((1, "z")), rows((3, "bad")), rows((None, "n"))):
        with pytest.raises(ConstraintError):
            lake.insert("t", bad)
    assert lake.insert("t", rows((1, "z"), (3, "c")), conflict="ignore", time_ns=20) == 1
    lake.insert("t", rows((1, "r")), conflict="replace", time_ns=30)
    assert lake.update("t", {"v": "concat(v, '!')"}, "id = 2", time_ns=40).collect()[0].v == "b!"
    assert lake.delete("t", "id = 3", time_ns=50).count() == 1
    lake.upsert("t", rows((1, "q"), (9, "n")), {"v": "concat(t.v, excluded.v)"}, time_ns=60)
    now = {tuple(r) for r in lake.read("t").collect()}
    assert now == {(1, "rq"), (2, "b!"), (9, "n")}
    assert {tuple(r) for r in lake.read("t", time_ns=25).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    with pytest.raises(NotFoundError):
        lake.read("t", time_ns=0)
    got = {(r.generation, r.op, r.id, r.v) for r in lake.history("t").collect()}
    assert {(4, "update", 1, "r"), (5, "update", 2, "b!"), (6, "delete", 3, "c"), (7, "insert", 9, "n")} <= got
    before = lake.generations()
    lake.begin()
    assert lake.commit() == before[-1]
    lake.begin()
    lake.delete("t")
    lake.rollback()
    assert lake.read("t").count() == 3
    lake.alter("t", add="w int")
    assert lake.read("t").columns == ["id", "v", "w"]
    assert lake.vacuum(keep=1) > 0
    assert lake.read("t").count() == 3


def test_lake_two_writers(spark, tmp_path):
    a, b = Lake(spark, str(tmp_path / "lake")), Lake(spark, str(tmp_path / "lake"))
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, v string")
    a.create("t", Table("id bigint, v string", key=("id",)))
    a.create("u", Table("id bigint, v string"))
    a.begin()
    a.insert("t", rows((1, "a")))
    b.insert("t", rows((2, "b")))
    assert [r.id for r in a.read("t").collect()] == [1]  # what it began with, and its own
    with pytest.raises(BusyError):
        a.commit()
    assert [r.id for r in a.read("t").collect()] == [2] and not [x for x in (tmp_path / "lake/_manifest").iterdir() if x.name.startswith("_")]
    a.begin()
    a.insert("t", rows((3, "c")))
    b.insert("u", rows((9, "z")))  # another table is no conflict
    a.commit()
    assert sorted(r.id for r in b.read("t").collect()) == [2, 3] and b.read("u").count() == 1
    a.begin()
    a.drop("u")
    b.insert("u", rows((8, "y")))
    with pytest.raises(BusyError):
        a.commit()


def test_lake_history(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.create("t", Table("id bigint, a int, b int", key=("id",)))
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, a int, b int")
    lake.insert("t", rows((1, 1, None), (2, 5, 5)))  # generation 2
    lake.update("t", {"a": "b", "b": "a"}, "id = 1")  # 3
    lake.insert("t", rows((3, None, None)))  # 4
    lake.delete("t")  # 5
    lake.insert("t", rows((1, 7, 7)))  # 6
    lake.drop("t")  # 7
    lake.create("t", Table("id bigint, a int, b int", key=("id",)))  # 8
    want = {(2, "insert", 1, 1, None), (2, "insert", 2, 5, 5), (3, "update", 1, None, 1), (4, "insert", 3, None, None), (5, "delete", 1, None, 1), (5, "delete", 2, 5, 5), (5, "delete", 3, None, None), (6, "insert", 1, 7, 7), (7, "delete", 1, 7, 7)}
    assert {(r.generation, r.op, r.id, r.a, r.b) for r in lake.history("t").collect()} == want
    frame = spark.createDataFrame([(1, 1, None, 1), (1, None, 1, 2), (2, 0, 0, 4)], "id int, a int, b int, generation int")
    got = {(r.generation, r.op, r.id) for r in row_history(frame, ["id"], known=[1, 2, 3, 4]).collect()}
    assert got == {(1, "insert", 1), (2, "update", 1), (3, "delete", 1), (4, "insert", 2)}


def test_lake_statements(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.create("t", Table("id bigint, v string, n int", key=("id",), unique=(("v",),), defaults={"n": "40 + 2"}))
    two = lambda *x: spark.createDataFrame(list(x), "id bigint, v string")
    lake.insert("t", two((1, "a"), (2, None), (3, None)))
    assert {r.n for r in lake.returned.collect()} == {42} and lake.changes == 3
    with pytest.raises(ConstraintError):
        lake.insert("t", two((4, "a")))
    assert lake.upsert("t", two((1, "x"), (5, "e")), None) == 1
    assert lake.upsert("t", two((1, "x"), (5, "y")), {"v": "excluded.v"}, "t.id = 1") == 1
    source = spark.createDataFrame([(1, 7), (1, 6), (5, 8)], "k bigint, m int")
    assert {(r.id, r.n) for r in lake.update("t", {"n": "s.m"}, "t.id = s.k", source=source, alias="s").collect()} == {(1, 6), (5, 8)}
    for bad in (lambda: lake.alter("t", drop="v"), lambda: lake.alter("t", drop="id"), lambda: lake.alter("t", drop="nope")):
        with pytest.raises((ConstraintError, NotFoundError)):
            bad()
    lake.begin()
    lake.insert("t", two((10, "j")))
    with pytest.raises(ConstraintError):
        lake.insert("t", two((10, "k")))
    lake.commit()  # the statement that failed is undone, not the transaction
    assert {r.id for r in lake.read("t").collect()} == {1, 2, 3, 5, 10}


def test_kv(spark, tmp_path):
    kv = KeyValue(Lake(spark, str(tmp_path / "kv")), "s", ttl="1s")
    rows = lambda *x: spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in x], "key binary, value binary")
    kv.put(rows((b"a1", b"x"), (b"a2", b"y"), (b"b", b"z")), now_ms=1000)
    kv.put(rows((b"a1", b"w")), ttl="1h", now_ms=1500)
    assert kv.get(b"a1", now_ms=1600) == b"w" and kv.get(b"a2", now_ms=2500) is None
    assert [bytes(r.key) for r in kv.scan(prefix=b"a", reverse=True, now_ms=1600).collect()] == [b"a2", b"a1"]
    assert kv.purge(now_ms=5000) == 2
    assert {r.op for r in kv.watch(b"a", 0).collect()} >= {"insert", "update"}


def test_series(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "ts"))
    s = Series(lake, "m", "ts bigint, host string, v double", "day", "10d", ("host",))
    r = Rollup("hr", "6h", ("host",), {"n": ("count", "*"), "s": ("sum", "v"), "a": ("avg", "v"), "f": ("first", "v"), "l": ("last", "v")}, "v >= 0")
    rnd = np.random.default_rng(1)
    make = lambda lo, n: spark.createDataFrame([(int(t), f"h{i % 2}", float(v)) for i, (t, v) in enumerate(zip(rnd.integers(lo, lo + 3 * DAY, n), rnd.integers(-2, 9, n), strict=True))], "ts bigint, host string, v double")
    s.append(make(0, 200))
    s.create_rollup(r)
    s.seal(now_ns=5 * DAY)
    s.append(make(DAY, 100))
    plain = lambda: sorted(map(tuple, r.of(s.rows()).collect()))
    assert sorted(map(tuple, s.rollup("hr", now_ns=5 * DAY).collect())) == plain()
    s.seal(now_ns=5 * DAY)
    assert sorted(map(tuple, s.rollup("hr").collect())) == plain()
    assert s.rows(start=DAY, end=2 * DAY, descending=True).agg(F.min("ts"), F.max("ts")).first()[0] >= DAY
    n = s.rows().count()
    s.append(make(12 * DAY, 10))
    s.seal(now_ns=12 * DAY)  # the first two days end at or before the cutoff
    assert s.rows(end=2 * DAY).count() == 0 and s.rows().count() < n + 10
    assert s.rollup("hr").agg(F.min("bucket")).first()[0] < 2 * DAY
    small = Series(lake, "k", "ts bigint, msg string", "month", None, (), seal_rows=3)
    small.append(spark.createDataFrame([(1, "the Größe"), (2, None)], "ts bigint, msg string"))
    assert lake.read("k.sealed").count() == 0
    small.append(spark.createDataFrame([(40 * DAY, "grosses")], "ts bigint, msg string"))
    assert lake.read("k.sealed").count() == 3 and lake.read("k.buffer").count() == 0
    assert [r.ts for r in small.search("msg", "gross*", start=0, end=2 * DAY).collect()] == [1] and small.search("msg", "THE gros*").count() == 1
    assert {(r.op, r.ts) for r in small.history().collect()} == {("insert", 1), ("insert", 2), ("insert", 40 * DAY)}
    for unit in ("hour", "day", "week", "month"):
        for t in (0, -1, DAY * 45 + 7, -DAY * 400, 1_700_000_000 * 10**9):
            assert start_of(t, unit) == one(spark, partition_start(F.lit(t), unit))[0]
    small.drop()
    assert not [n for n in lake.tables() if n.startswith("k.")]
    with pytest.raises(UnsupportedError):
        s.update()
    with pytest.raises(ConstraintError):
        s.append(spark.createDataFrame([(None, "h", 1.0)], "ts bigint, host string, v double"))


WORDS = "hello world the first note news again there Olá mundo ação rápida straße größe münchen quick brown fox łódź și τάξη ế worldwide wording".split()


def fts_docs(n=60):
    rnd = random.Random(11)
    return [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 14))) or None, ", ".join(rnd.choices(WORDS[:9], k=rnd.randint(0, 3)))) for i in range(n)]


QUERIES = [
    "hello", "HELLO world", '"hello" "wor"*', "hello OR world", "hello NOT world", "content:hello", "meta:hello", "^hello", '"the first"', "the + first", '"brown quick"', "acao", "Ação OR OLÁ", "munchen", "munchen*", "news NOT hello world",
    "(hello OR news) AND NOT_IN OR quick", "{content meta}: hello", "-meta: world", "content: (hello OR note) AND fox", '"quick brown" OR "first note"', "hello AND (world OR news NOT the)", '"hello hello"', 'wor* NOT "world"', "content: ^ the",
]


def test_fts_against_fts5(spark, tmp_path):
    docs = fts_docs()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(content, meta, tokenize = 'unicode61')")
    con.executemany("insert into t(rowid, content, meta) values(?,?,?)", docs)
    df = spark.createDataFrame(docs, "id bigint, content string, meta string").repartition(3)
    lake = Lake(spark, f"{tmp_path}/lake")
    index = fts.TextIndex(lake, "docs", "id", ["content", "meta"], buckets=4)
    index.add(df.filter("id < 25"))
    index.add(df.filter("id >= 25"))
    for q in QUERIES:
        want = sorted((i, round(s, 9)) for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (q,)))
        for out in (fts.search(df, "id", ["content", "meta"], q), index.search(q)) if QUERIES.index(q) % 4 == 0 else (index.search(q),):
            got = sorted((r.id, round(r.score, 9)) for r in out.collect())
            # below NOT, phrases that don't decide count as everywhere else
            assert (got == want) if "NOT" not in q else [i for i, _ in got] == [i for i, _ in want], q
    plan = index.search("hello")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan  # no text is tokenized again


def test_fts_words_and_errors(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(["Łódź jest", "și aici", "ǎ b", "xế y", "τάξη", None, "", "x y z " * 100_000])], "id bigint, t string")
    ids = lambda q: sorted(r.id for r in fts.search(df, "id", ["t"], q).collect())
    assert [ids(q) for q in ("łódź", "lodz", "SI", "ǎ", "xế", "ταξη", '"z x y z x"', '""', "", '"" lodz')] == [[0], [0], [1], [2], [3], [4], [7], [], [], [0]]
    for q, error in (("a NEAR(b c)", UnsupportedError), ("NEAR(b c)", UnsupportedError), ("nope: a", ValueError), ("(a", ValueError), ("a AND", ValueError), ("a)", ValueError), ("OR a", ValueError), ("a ; b", ValueError)):
        with pytest.raises(error):
            fts.search(df, "id", ["t"], q)
    assert fts.search(df.filter("false"), "id", ["t"], "a").count() == 0
    stems = spark.createDataFrame([(w,) for w in ("berries", "ties", "glasses", "gas", "cats", "bus", "iris", "glass", "is")], "w string")
    assert [r[0] for r in stems.select(fts.plural_stem(F.col("w"))).collect()] == ["berry", "tie", "glass", "gas", "cat", "bus", "iris", "glass", "is"]


def test_fts_kept_columns(spark, tmp_path):
    index = fts.TextIndex(Lake(spark, f"{tmp_path}/lake"), "docs", "id", ["t"], unindexed=("sha",), buckets=2)
    index.add(spark.createDataFrame([(1, "a b", "x"), (2, "a", "y"), (3, None, "x")], "id bigint, t string, sha string"))
    assert [r.id for r in index.search("a", equal={"sha": "x"}).collect()] == [1] and [r.id for r in index.search("a", n=1).collect()] == [2]
    with pytest.raises(ValueError):
        index.search("a", equal={"t": "a"})


def test_tlsh(spark):
    rnd = np.random.default_rng(2)
    p = tlsh.default_permutation()
    base = [bytes(rnd.integers(32, 120, 800).astype(np.uint8)) for _ in range(40)]
    near = [b[:400] + b"changed here" + b[412:] for b in base]
    rows = [(i, tlsh.digest_bytes(b, p)) for i, b in enumerate(base + near)] + [(99, None), (98, "junk")]
    assert tlsh.digest_bytes(b"short", p) is None and tlsh.digest_bytes(b"a" * 500, p) is None
    df = spark.createDataFrame(rows, "id int, t string")
    q = df.filter("id < 5")
    exact = {(r.query, r.item, r.distance) for r in tlsh.nearest_exact(q, "id", df, "id", "t", 1).collect()}
    found = {(r.query, r.item, r.distance) for r in tlsh.nearest(q, "id", df, "id", "t", 1).collect()}
    assert exact == found and {x[1] for x in exact} == {40, 41, 42, 43, 44}
    assert df.select(tlsh.distance(F.col("t"), F.col("t")).alias("d")).filter("d <> 0").count() == 0


def test_tlsh_checksums_and_similar(spark, tmp_path):
    rnd = np.random.default_rng(6)
    p = tlsh.default_permutation()
    texts = [rnd.integers(0, 256, n).astype(np.uint8) for n in (5, 700, 50, 513, 1024, 50, 70_000)]
    want = []
    for x in texts:
        check = 0
        for i in range(4, len(x)):
            check = p[p[p[p[0] ^ x[i]] ^ x[i - 1]] ^ check]
        want.append(int(check))
    assert tlsh.checksums(texts, p).tolist() == want
    data = [(i, x.tobytes()) for i, x in enumerate(texts)] + [(90, None), (91, b"")]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in data], "id int, d binary").select("id", tlsh.digest_udf()(F.col("d")).alias("t"))
    assert {r.id: r.t for r in df.collect()} == {i: tlsh.digest_bytes(d, p) for i, d in data}
    np.savetxt(tmp_path / "p.txt", p, fmt="%d")
    assert (tlsh.permutation_of(str(tmp_path / "p.txt")) == p).all()
    bodies = [bytes(rnd.integers(0, 256, 35).astype(np.uint8)) for _ in range(60)]
    bodies[1] = bodies[0][:-1] + bytes([bodies[0][-1] ^ 1])
    files = spark.createDataFrame([(f"f{i}", bytearray([i] * 32), "T1" + b.hex().upper(), "x") for i, b in enumerate(bodies)] + [("none", bytearray(b"z" * 32), None, "x")], "path string, sha256 binary, tlsh string, item string")
    for mode in ("exact", "near"):
        for q in ("f0", bytes([0] * 32).hex()):
            assert tlsh.similar(files, q, 1, mode).first().path == "f1", (mode, q)
    assert tlsh.similar(files, bodies[0].hex(), 2).first().path == "f0" and tlsh.similar(files, "f0", 200).count() == 59
    assert tlsh.similar(files, "nope", 5).count() == 0 and tlsh.similar(files, "none", 5).count() == 0


def test_tlsh_recall_of_bands(spark):
    """Near copies are found by the bands: 200 planted pairs with up to three of their buckets a step off."""
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 256, (200, 35)).astype(np.uint8)
    near = base.copy()
    for row in near:
        for at in rnd.choice(np.arange(3, 35), 3, replace=False):
            row[at] ^= 1 << (2 * int(rnd.integers(0, 4)))
    rows = [(i, "T1" + b.tobytes().hex().upper()) for i, b in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "id int, t string")
    found = {(r.query, r.item) for r in tlsh.nearest(df.filter("id < 200"), "id", df, "id", "t", 1).collect()}
    assert len({(i, i + 200) for i in range(200)} & found) >= 0.98 * 200


def test_tlsh_nearest_of_all(spark, tmp_path):
    from sediment.plans import reference

    rnd = np.random.default_rng(4)
    bodies = rnd.integers(0, 256, (900, 35)).astype(np.uint8)
    spark.createDataFrame([("a", f"p{i}", "T1" + b.tobytes().hex().upper()) for i, b in enumerate(bodies)], "archive string, path string, tlsh string").write.parquet(f"{tmp_path}/zx_files.parquet")
    rows = {r.id: np.frombuffer(bytes.fromhex(r.tlsh[2:]), np.uint8) for r in reference._digests(spark, str(tmp_path)).collect()}
    keys = sorted(rows)
    table = np.stack([rows[k] for k in keys])

    def brute(asked, n):
        return {(q, k, d) for q in asked for d, k in sorted((int(d), k) for d, k in zip(tlsh.distances(rows[q], table), keys, strict=True) if k != q)[:n]}

    got = {(r.query, r.item, r.distance) for r in reference.QUERIES["tlsh_nearest"](spark, str(tmp_path)).collect()}
    assert len(got) >= 50 and got == brute([k for k in keys if k % 50 == 0], 10)
    x = reference._digests(spark, str(tmp_path))
    some = tlsh.nearest_exact(x.filter("id % 3 = 0"), "id", x, "id", "tlsh", 4, block=35 * 40)  # several blocks of queries
    assert {(r.query, r.item, r.distance) for r in some.collect()} == brute([k for k in keys if k % 3 == 0], 4)
    assert tlsh.nearest_exact(x.filter("false"), "id", x, "id", "tlsh", 4).count() == 0


def test_ingest_export(spark, tmp_path):
    lines = spark.createDataFrame([("<34>1 2003-10-11T22:14:15.003Z mach su - ID47 [x y=\"1\"] it failed",), ("<13>Feb  5 17:32:18 host app[12]: hello",), ("junk",)], "value string")
    got = ingest.parse_syslog(lines, year=2024).collect()
    assert [(r.host, r.app, r.pid, r.level, r.facility, r.message) for r in got] == [("mach", "su", None, "crit", 4, "it failed"), ("host", "app", "12", "notice", 1, "hello")]
    j = ingest.parse_journal(spark.createDataFrame([('{"__REALTIME_TIMESTAMP":"5","PRIORITY":"3","MESSAGE":"m","X":"1"}',)], "value string")).first()
    assert (j.ts, j.level, j.message, j.fields) == (5000, "err", "m", '{"X":"1"}')
    df = spark.createDataFrame([(1, 'a"b,\nc', 1.5), (2, None, None)], "id bigint, t string, v double")
    export.write_csv(df, str(tmp_path / "csv"))
    assert sorted((r.id, r.t) for r in ingest.read_csv(spark, str(tmp_path / "csv")).collect() if r.t) == [("1", 'a"b,\nc')]
    export.write_jsonl(df, str(tmp_path / "json"))
    assert ingest.read_jsonl(spark, str(tmp_path / "json")).count() == 2
    path = str(tmp_path / "x.db")
    assert export.write_database({"t": df}, path) == 2
    assert sorted(map(tuple, ingest.read_database(spark, path, "t").collect())) == [(1, 'a"b,\nc', 1.5), (2, None, None)]
    assert list(export.lines(df, "quote")) == ["1,'a\"b,\nc',1.5", "2,NULL,NULL"]
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m/one.txt", "hello")
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    import bz2
    import gzip
    import lzma

    for name, pack in (("x.txt.gz", gzip.compress), ("y.txt.bz2", bz2.compress), ("z.txt.xz", lzma.compress)):
        (tmp_path / name).write_bytes(pack(b"alone"))
    (tmp_path / "broken.gz").write_bytes(gzip.compress(b"alone")[:-6])
    got = {(r.path, r.size) for r in ingest.archive_listing(spark, str(tmp_path / "*.{zip,gz,bz2,xz}")).collect()}
    assert got == {("m/one.txt", 5), ("x.txt", 5), ("y.txt", 5), ("z.txt", 5)}
    assert str(ingest.parse_syslog(lines, year=2024).filter("host = 'host'").select(F.unix_seconds("ts")).first()[0]) == "1707154338"


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"hash_agg", "p3_found", "p5_found"} <= names and set(e.oracle_sql()) <= names
    assert e.entry(spark).count() > 0
