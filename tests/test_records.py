"""Nested records against a brute-force walk, and the edge cases of the operator."""

import json

from postmill.operators import records

DEEP = {"id": 1, "allegati": [{"nome": "a", "archivio": {"membri": [None, "x", {"n": 1, "archivio": {"membri": {"n": 2}}}]}}, [{"in": 1}, [{"deep": 2}]]], "destinatari": ["a@x"], "daticert": {"destinatari": [{"t": 1}]}, "o'k": [{"q": 1}]}
LONE = {"allegati": {"nome": "solo"}, "altro": {"x": {"y": [1, {"z": 2}]}}}


def walk(value, path, out):
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, dict) and k in records.LONE_ARRAYS:
                out.add("/".join([*path, k, "1"]))
                walk(v, [*path, k, "1"], out)
            else:
                walk(v, [*path, k], out)
    elif isinstance(value, list):
        for i, v in enumerate(value, 1):
            if isinstance(v, dict):
                out.add("/".join([*path, str(i)]))
            walk(v, [*path, str(i)], out)
    return out


ROWS = [
    ("1", json.dumps(DEEP)), ("1", json.dumps(DEEP, indent=1)), ("2", json.dumps(LONE)), ("3", "﻿ " + json.dumps(LONE)), ("4", json.dumps(json.dumps(DEEP))), ("5", json.dumps(DEEP)[:-9]), ("6", None), ("7", ""), ("8", "[1,2]"), ("9", "{}"),
    ("10", '"no"'), ("11", json.dumps({"allegati": [{"n": i} for i in range(2000)]})),
]


def test_nodes(spark):
    df = spark.createDataFrame([(*r, "p") for r in ROWS], "id string, record string, node_path string")
    got = {(r.id, r.node_path) for r in records.found(df).collect()}
    want = set()
    for i, text in ROWS:
        value = records._load(text)
        want |= {(i, p) for p in walk(value, [], set())} if value is not None else set()
    assert got == want and {i for i, _ in got} == {"1", "2", "3", "4", "11"}
    assert records.found(df.limit(0)).count() == 0


def test_child_tables(spark):
    df = spark.createDataFrame(ROWS[:1] + ROWS[2:3], "id string, record string")
    tables = records.child_tables(df)
    assert {"record", "allegati", "allegati_archivio_membri", "allegati_archivio_membri_archivio_membri", "daticert_destinatari"} <= set(tables)
    rows = {(r.id, r.parent_path, r.node_path, r.ordinal) for r in tables["allegati_archivio_membri"].collect()}
    assert rows == {("1", "allegati/1", "allegati/1/archivio/membri/3", 3)}
    assert sorted(r.f_nome for r in tables["allegati"].collect() if r.f_nome) == ["a", "solo"]
    assert tables["record"].count() == 2


def test_children_query_has_every_level(spark, tmp_path):
    from postmill.plans import records as plans

    spark.createDataFrame(ROWS[:3], "id string, record string").write.parquet(f"{tmp_path}/messages.parquet")
    rows = plans.QUERIES["p4_children"](spark, str(tmp_path)).collect()
    got = {(r.id, r.table, r.parent_path, r.node_path, r.ordinal): json.loads(r.element) for r in rows}
    assert {(i, path) for i, _, _, path, _ in got} == {(i, p) for i, v in (("1", DEEP), ("2", LONE)) for p in walk(v, [], set())}
    assert len(rows) == len(got)
    assert got["1", "allegati_archivio_membri_archivio_membri", "allegati/1/archivio/membri/3", "allegati/1/archivio/membri/3/archivio/membri/1", 1] == {"n": 2}
    assert got["1", "daticert_destinatari", "", "daticert/destinatari/1", 1] == {"t": 1}
