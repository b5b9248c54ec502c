"""Ingestion, archive, history, rules, sources and streaming on small tables with hot keys and nulls."""

import os
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import archive, history, ingest, register, rules
from postmill.sources import queue
from postmill.sources.mailbox import MailboxSource
from postmill.streaming import ingest as streaming


def test_prior_counts_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "hot" if i % 2 else r.choice("abc"), f"2024-01-{r.randint(1, 9):02d}T{r.randint(0, 3):02d}:00:00") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, who string, d string")
    got = {x.id: x.n for x in history.prior_counts(df, ["who"], "d", "n").collect()}
    assert got == {i: sum(w2 == w and d2 < d for _, w2, d2 in rows) for i, w, d in rows}
    assert history.prior_counts(df.limit(0), ["who"], "d", "n").count() == 0


def test_ingest(spark):
    df = spark.createDataFrame([("a", 1, 1, "h", "done"), ("a", 1, 2, "h", "new"), ("b", 1, 1, "h", "new"), ("a", 1, 3, None, "new"), ("a", 2, 1, None, "new")], "account string, uidvalidity long, uid long, content_hash string, status string")
    assert {(r.account, r.uidvalidity, r.uid) for r in ingest.twins(df).where("duplicate").collect()} == {("a", 1, 2)}
    assert ingest.pending(df, df).count() == 4
    assert ingest.budget(df, 2).groupBy("account").count().where("count > 2").count() == 0
    cursor = spark.createDataFrame([("a", 1, 2)], "account string, uidvalidity long, last_uid long")
    assert {(r.account, r.uidvalidity, r.uid) for r in ingest.beyond(df, cursor).collect()} == {("a", 1, 3), ("a", 2, 1), ("b", 1, 1)}
    assert ingest.reconcile(spark.createDataFrame([("x", "nuovo"), ("y", "nuovo")], "id string, status string"), spark.createDataFrame([("y",), ("z",)], "id string")).where("status = 'done'").count() == 2


@pytest.mark.parametrize("declared,receipt,transport,subject,kind", [("accettazione", "", "", "", "accettazione"), ("", "mancata-consegna", "", "", "errore_consegna"), ("", "", "errore", "", "busta_anomalia"), ("", "", "", "Anomalia messaggio: x", "busta_anomalia"), ("", None, None, "CONSEGNA: y", "avvenuta_consegna"), (None, None, None, None, "generico"), ("posta-certificata", "accettazione", "", "", "posta_certificata")])
def test_classify(spark, declared, receipt, transport, subject, kind):
    df = spark.createDataFrame([(declared, receipt, transport, subject)], "a string, b string, c string, d string")
    assert df.select(ingest.classify(*map(F.col, "abcd"))).first()[0] == kind


def test_archive(spark, tmp_path):
    cols = "id string, fetched_at string, date_certified string, date_sent string, from_addr string, from_domain string, account string, client string, msg_type string, subject string"
    rows = [("1", "2024-01-02", None, None, "A@x.it", "x.it", "m", None, "t", "uno"), ("1", "2024-01-03", None, "", "A@x.it", "x.it", "m", None, "t", "due"), ("2", "2024-02-01T00:01", "2024-01-31T23:59:00+01:00", None, None, None, "m", "c", "u", None)]
    df = archive.newest(spark.createDataFrame(rows, cols))
    assert {(r.id, r.subject) for r in df.collect()} == {("1", "due"), ("2", None)}
    assert [r.id for r in archive.search(df, until="2024-01-31").collect()] == ["2", "1"]
    assert [r.id for r in archive.search(df, sender="a@X").collect()] == ["1"] and archive.search(df, client="m", limit=1).count() == 1
    archive.write_index(df, str(tmp_path / "indice"))
    assert sorted(p for p in os.listdir(tmp_path / "indice") if p.startswith("giorno")) == ["giorno=2024-01-03", "giorno=2024-01-31"]
    assert archive.last_days(archive.with_day(df), 1).count() == 1


def test_match_grammar(spark):
    cols = "rowid_fts long, subject string, sender string, recipients string, body string, attachments string"
    df = spark.createDataFrame([(1, "Sollecito pagamento", "", "", "Perché no, nulla osta", None), (2, "altro", "x@y.it", "", "nulla di nuovo osta", ""), (3, None, None, None, None, None)], cols)
    hits = lambda q: {r.rowid_fts for r in df.where(archive.matches(q)).collect()}
    assert hits('"nulla osta"') == {1} and hits("nulla osta") == {1, 2} and hits("perche") == {1} and hits("soll*") == {1} and hits("subject:nulla") == set() and hits("nulla NOT pagamento") == {2} and hits("pagamento OR altro") == {1, 2}
    for bad in ('"a', "", "NOT", "a OR", "zz:b"):
        with pytest.raises(ValueError):
            archive.parse_match(bad)
    words = {(r.token, r.rowid_fts) for r in archive.token_index(df).collect()}
    assert ("perche", 1) in words and all(k != 3 for _, k in words)
    assert "osta" in df.select(archive.snippet(F.col("body"), "osta")).first()[0]


def test_rules_and_register(spark):
    df = spark.createDataFrame([("1", "A@p.x.it", "p.x.it", ["a.PDF"], "Sollecito"), ("2", None, None, None, None)], "id string, from_addr string, from_domain string, attachment_names array<string>, subject string")
    got = {r.id: r.m for r in df.select("id", rules.matched([{"id": "all", "priorita": 1}, {"id": "dom", "priorita": 9, "quando": {"mittente_dominio": "x.it", "allegato_estensione": [".pdf"], "mittente": "a@P.x.it"}}, {"id": "re", "priorita": 5, "quando": {"oggetto_regex": "(?i)^soll"}}]).alias("m")).collect()}
    assert got == {"1": ["dom", "re", "all"], "2": ["all"]}
    out = register.register(spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "id int, k string"), spark.createDataFrame([(1,), (1,), (9,)], "id int"), ["k"]).collect()
    assert {(r.dimension, r.value, r.total, r.corrected, r.rate) for r in out} == {("k", "a", 2, 1, 0.5), ("k", "—", 2, 0, 0.0), ("tutti", "", 4, 1, 0.25)}


def test_sources(spark, tmp_path):
    for name, body in (("a", '{"id": "1", "acquisito_il": "2024-01-02T00:00:00Z", "schema": "x/1"}'), ("b", '{"id": "2", "data": {"certificata": "2024-01-01T00:00:00+01:00"}}'), ("c", "{broken"), ("d", '{"oggetto": "senza id"}')):
        (tmp_path / "coda" / name).mkdir(parents=True)
        (tmp_path / "coda" / name / "messaggio.json").write_text(body)
    items, problems = queue.read_queue(spark, str(tmp_path / "coda" / "*" / "messaggio.json"))
    assert [r.id for r in items.collect()] == ["2", "1"] and problems.count() == 2
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2\n[3]\n{"a": 4}\n')
    assert sorted(r.a for r in queue.read_lines(spark, str(tmp_path / "l.jsonl"), "a INT").collect()) == [1, 4]
    df = spark.createDataFrame([("a/b",), ("../x",), ("/x",), ("",)], "p string")
    assert [r[0] for r in df.select(queue.safe_path(F.lit("base"), F.col("p"))).collect()] == ["base/a/b", None, None, None]


def test_mailbox_stream(spark, tmp_path):
    spark.dataSource.register(MailboxSource)

    def put(account, epoch, uid, raw):
        folder = tmp_path / "box" / account / str(epoch)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{uid}.eml").write_bytes(raw)

    for u in (1, 2, 3):
        put("rossi", 1000, u, b"m%d" % u)
    put("alba", 7, 1, b"m1")
    put("alba", 7, 2, b"m1")
    assert spark.read.format("mailbox").load(str(tmp_path / "box")).count() == 5

    def go():
        stream = streaming.identified(spark.readStream.format("mailbox").option("path", str(tmp_path / "box")).option("limit", "2").load())
        q = streaming.run(stream, str(tmp_path / "out"), str(tmp_path / "at"))
        q.awaitTermination()
        return {(r.account, bytes(r.raw)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert {("rossi", b"m1"), ("rossi", b"m2"), ("alba", b"m1")} <= go()
    put("rossi", 1001, 1, b"m3")
    put("rossi", 1001, 2, b"m4")
    got = go() | go()
    assert ("rossi", b"m4") in got
    assert len(spark.read.parquet(str(tmp_path / "out")).collect()) == len(got)


def test_write_once_replay(spark, tmp_path):
    b = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y")], "id string, v string")
    for n in (0, 0, 1):
        streaming.write_once(b, n, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
