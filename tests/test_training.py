"""Snapshot changes and nested records: edge cases and brute force."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sediment.operators import snapshot_diff
from sediment.operators.nested import flat_table, nodes, parse, parse_deep, triples
from sediment.operators.snapshot_diff import snapshot_changes

SCHEMA = "archive string, generation int, path string, loaded_at timestamp, size bigint, sha256 binary, version int, late boolean, `key` string"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, 1, True, "x") for r in rows], SCHEMA)
    out = snapshot_changes(df, "archive", "generation", "path", "loaded_at", "size", "sha256")
    return sorted(tuple(r) for r in out.collect())


def at(n):
    return datetime(2027, 1, 1, 0, 0, n)


def test_changes_cases(spark):
    a, b = b"a" * 32, b"b" * 32
    rows = [
        ("x", 1, "same", at(0), 1, a), ("x", 3, "same", at(0), 2, a),
        ("x", 1, "sha", at(0), 1, a), ("x", 3, "sha", at(0), 1, b),
        ("x", 1, "size", at(0), 1, None), ("x", 3, "size", at(0), 2, a),
        ("x", 1, "sizenull", at(0), None, None), ("x", 3, "sizenull", at(0), 2, a),
        ("x", 1, "gone", at(0), 1, a), ("x", 3, "new", at(0), 1, a), ("x", 3, "new", at(0), 1, a),
        ("x", 1, "twice", at(0), 1, a), ("x", 3, "twice", at(5), 1, a), ("x", 3, "twice", at(1), 1, b), ("x", 3, "twice", None, 9, b),
        ("x", 1, "é", at(0), 1, a), ("x", 3, "é", at(0), 1, a),
        ("y", 2, "first", at(0), 1, a), (None, 2, "p", at(0), 1, a), ("x", None, "p", at(0), 1, a), ("x", 3, None, at(0), 1, a),
    ]
    assert changes(spark, rows) == sorted([("x", 3, "sha", "changed"), ("x", 3, "size", "changed"), ("x", 3, "gone", "removed"), ("x", 3, "new", "added"), ("x", 3, "é", "removed"), ("x", 3, "é", "added")])


def test_changes_empty(spark):
    assert changes(spark, []) == []


def test_changes_brute_force(spark, monkeypatch):
    monkeypatch.setattr(snapshot_diff, "BLOCK_ROWS", 50)
    rnd = random.Random(3)
    rows = []
    for arc in "abc":
        held = {}
        for g in sorted(rnd.sample(range(1, 12), 5)):
            for _ in range(30):
                p = f"p{rnd.randrange(120)}"
                if rnd.random() < 0.3:
                    held.pop(p, None)
                else:
                    held[p] = (rnd.choice([None, 1, 2]), rnd.choice([None, b"1" * 32, b"2" * 32]))
            rows += [(arc, g, p, at(1), *v) for p, v in held.items()]
            rows += [(arc, g, p, at(0), 77, b"old" * 8) for p in list(held)[:3]]
    want = []
    for arc in "abc":
        by = {}
        for a, g, p, t, s, h in rows:
            if a == arc and t == at(1):
                by.setdefault(g, {})[p] = (s, h)
        for g0, g1 in zip(sorted(by), sorted(by)[1:], strict=False):
            for p in by[g0].keys() | by[g1].keys():
                o, n = by[g0].get(p), by[g1].get(p)
                if o is None or n is None:
                    want.append((arc, g1, p, "added" if o is None else "removed"))
                elif o[1] and n[1]:
                    if o[1] != n[1]:
                        want.append((arc, g1, p, "changed"))
                elif None not in (o[0], n[0]) and o[0] != n[0]:
                    want.append((arc, g1, p, "changed"))
    assert changes(spark, rows) == sorted(want)


def found(spark, *bodies):
    df = spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b), "n") for i, b in enumerate(bodies)], "manifest_id bigint, body string, node string")
    return sorted(tuple(r) for r in nodes(triples(df, "manifest_id", "body", things_only=True)).collect())


def test_nested_places(spark):
    body = {
        "file": "f", "description": {"pt": "a", "en": None, "fr": ""}, "tags": ["x", None, "", {"group": "g", "items": ["a", "b"]}, {"name": "n"}], "x_other": {"tags": ["no"]},
        "layers": [None, {"tags": "a; b", "segments": {"text": "t", "words": [{"w": "w"}, {"w": ""}]}, "derived": [{"segments": [None, {"text": "u"}]}]}],
    }
    assert found(spark, body) == sorted([
        (0, "description/pt", ""), (0, "tags/0", ""), (0, "tags/3/items/0", ""), (0, "tags/3/items/1", ""), (0, "tags/4", ""), (0, "layers/1", ""), (0, "layers/1/tags/0", "layers/1"),
        (0, "layers/1/tags/1", "layers/1"), (0, "layers/1/segments/0", "layers/1"), (0, "layers/1/segments/0/words/0", "layers/1/segments/0"), (0, "layers/1/derived/0", "layers/1"),
        (0, "layers/1/derived/0/segments/1", "layers/1/derived/0"),
    ])


def test_nested_shapes(spark):
    inner = {"file": "f", "description": "d", "layers": json.dumps([{"type": "ocr"}])}
    assert found(spark, json.dumps({"manifest": inner}), json.dumps(json.dumps(inner)), None, "", "nope", '{"a": NaN}', '{"file": 1,}') == sorted((i, n, "") for i in (0, 1) for n in ("description/0", "layers/0"))


def test_nested_deep_and_long(spark):
    layer = {"type": "x"}
    for _ in range(150):
        layer = {"derived": [layer]}
    got = found(spark, {"file": "f", "layers": [layer], "description": "y" * 500_000})
    assert len(got) == 152


def test_parse_piece_by_piece():
    good = ['{"a": [1, -2.50, 1e5, true, null, "x\\u00e9\\"\\n"], "b": {}, "c": [[], {"d": ""}], "a": 0}', " [] ", '"x"', "12", "null"]
    bad = ["", "[1,]", "[1", "{,}", '{"a" 1}', '{"a":}', "01", "[1]]", "1 2", "{1:2}", "nul", '"\n"', "[}", '{"a":1,}', "]", "[,1]"]
    for t in good:
        assert parse_deep(t) == parse(t) == json.loads(t, parse_int=str, parse_float=str)
    for t in bad:
        with pytest.raises(ValueError):
            parse_deep(t)
        assert parse(t) is None


def test_nested_without_bound(spark):
    n, m = 30_000, 1_500
    body = '{"file": "f", "x": ' + "[" * n + "1" * 6000 + "]" * n + ', "description": "d", "layers": ' + '[{"derived": ' * m + "[]" + "}]" * m + "}"
    df = spark.createDataFrame([(1, body)], "manifest_id bigint, body string")
    got = triples(df, "manifest_id", "body")
    assert got.filter("kind = 'layer' and field = ''").count() == m
    assert got.filter("field = 'x'").select(F.length("value")).first()[0] in (2 * n + 6000, 2 * n + 6002)


def test_flat_table_twice(spark):
    body = json.dumps({"file": "f", "layers": [{"type": "ocr", "file": "a"}, {"type": "ocr", "file": "a"}]})
    df = spark.createDataFrame([(1, body), (1, body)], "manifest_id bigint, body string")
    rows = flat_table(triples(df, "manifest_id", "body"), "layer", ["type", "file"]).orderBy("node").collect()
    assert [(r.node, r.ordinal, r.f_type, r.f_file) for r in rows] == [("layers/0", 0, "ocr", "a"), ("layers/1", 1, "ocr", "a")]
    assert flat_table(triples(df.filter(F.lit(False)), "manifest_id", "body"), "layer", ["type"]).count() == 0


def test_manifests_descriptions_and_groups(spark, tmp_path):
    from sediment.plans import training

    body = {"file": "f", "title": "T", "mime": "m", "size": 7, "sha256": "ab", "x_own": [1], "description": {"pt": "a", "en": "b"}, "tags": [{"group": "g", "items": ["a", {"group": "h", "items": ["b"]}]}, "c"], "layers": [{"type": "ocr"}]}
    rows = [(1, json.dumps(body)), (2, json.dumps({"file": "g", "tags": "t"})), (3, None)]
    spark.createDataFrame(rows, "manifest_id bigint, body string").write.parquet(f"{tmp_path}/arca_manifests.parquet")
    rows_of = lambda q: {r.asDict()["node"]: r for r in training.QUERIES[q](spark, str(tmp_path)).collect()}
    assert {n: (r.manifest_id, r.value) for n, r in rows_of("p5_descriptions").items()} == {"description/pt": (1, "a"), "description/en": (1, "b")}
    assert {n: r.f_group for n, r in rows_of("p5_tag_groups").items()} == {"tags/0": "g", "tags/0/items/1": "h"}
    assert set(rows_of("p5_tags")) == {"tags/0/items/0", "tags/0/items/1/items/0", "tags/1", "tags/0"}  # the last is manifest 2's
    got = {r.manifest_id: r for r in training.QUERIES["p5_manifests"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and (got[1].f_title, got[1].f_mime, got[1].f_size, got[1].f_sha256, got[2].f_title) == ("T", "m", "7", "ab", None)
    assert [tuple(x) for x in got[1].other] == [("x_own", "[1]")] and got[2].other == []
    assert len(rows_of("p5_found")) == 7
