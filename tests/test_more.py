"""Full-text grammar against brute force, the work queue, outcomes, settings, and raw mail with hostile parts."""

import base64
import io
import itertools
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from postmill.functions import archives, extract, files, mime, text, times
from postmill.operators import archive, fulltext, lifecycle, outcomes, pipeline
from postmill.sources import settings
from postmill.sources.mailbox import MailboxSource, list_folders


def _texts(spark, bodies):
    rows = [(i, None, "", None, b, "") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "rowid_fts long, subject string, sender string, recipients string, body string, attachments string")


def test_index_and_scan_agree_with_brute_force(spark, tmp_path):
    rng = random.Random(5)
    bodies = [" ".join(rng.choice("ab cd à ef ab".split()) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "x" * 50_000]
    df = _texts(spark, bodies)
    fulltext.build_index(df, str(tmp_path / "i"))
    split = [(b or "").replace("à", "a").split() for b in bodies]

    def near(w, n):
        at = [[i for i, x in enumerate(w) if x == y] for y in ("ab", "ef")]
        return any(abs(i - j) - 1 <= n for i, j in itertools.product(*at))

    cases = {
        "ab": lambda w: "ab" in w, "a": lambda w: "a" in w, "À*": lambda w: any(x.startswith("a") for x in w), '"ab cd"': lambda w: any(w[i : i + 2] == ["ab", "cd"] for i in range(len(w))), "ab + c*": lambda w: any(x == "ab" and y.startswith("c") for x, y in zip(w, w[1:], strict=False)),
        "(ab OR ef) NOT cd": lambda w: ("ab" in w or "ef" in w) and "cd" not in w, "ab OR ef NOT cd": lambda w: "ab" in w or ("ef" in w and "cd" not in w), "body: ^ab": lambda w: w[:1] == ["ab"], "-body: ab": lambda w: False,
        "{subject body}: (ab cd)": lambda w: "ab" in w and "cd" in w, "NEAR(ab ef, 1)": lambda w: near(w, 1), "NEAR(ab ef)": lambda w: near(w, 10),
    }
    for q, holds in cases.items():
        want = {i for i, w in enumerate(split) if holds(w)}
        assert {r.rowid_fts for r in df.where(fulltext.matches(q)).collect()} == want, q
        assert {r.key for r in fulltext.search_index(spark, str(tmp_path / "i"), q).collect()} == want, q
    for bad in ("", "(ab", "ab)", "NOT", "ab OR", "zz:ab", '"ab', "NEAR()", "ab NOT", "- ab"):
        with pytest.raises(ValueError):
            fulltext.parse_match(bad)


def test_snippets(spark):
    df = _texts(spark, ["uno " * 30 + "Perizia giurata " + "due " * 30, "niente", None])
    got = fulltext.with_snippets(df.select("rowid_fts"), df, "body:perizia OR giurata").collect()
    assert [r.snippet for r in sorted(got, key=lambda r: r.rowid_fts)][1:] == [None, None]
    assert any("Perizia giurata" in (r.snippet or "") and r.snippet.startswith(" … ") and r.snippet.endswith(" … ") for r in got)


def test_lifecycle(spark):
    log = [("a", 1, "preso", None), ("a", 2, "fallito", "x" * 600), ("b", 1, "preso", None), ("b", 2, "fallito", "1"), ("b", 3, "preso", None), ("b", 4, "preso", None), ("b", 5, "fallito", "fine"), ("c", 1, "preso", None), ("c", 2, "classificato", None), ("c", 3, "archiviato", None)]
    log += [("d", k, "preso", None) for k in range(1, 5)] + [("d", 5, "riprova", None), ("e", 1, "preso", None), ("e", 2, "classificato", None)]
    s = lifecycle.fold(spark.createDataFrame(log, "id string, seq int, event string, error string"))
    got = {r.id: (r.state, r.attempts, r.last_error) for r in s.collect()}
    assert got == {"a": ("nuovo", 1, "x" * 500), "b": ("sospeso", 3, "fine"), "c": ("archiviato", 1, None), "d": ("nuovo", 0, None), "e": ("classificato", 1, None)}
    granted = {r.id: r.c.granted for r in s.select("id", lifecycle.claim(F.col("state"), F.col("attempts")).alias("c")).collect()}
    assert granted == {"a": True, "b": False, "c": False, "d": True, "e": False}
    queue = spark.createDataFrame([("a", 2), ("b", 1), ("z", None)], "id string, ts int")
    left = {r.id: r.reason for r in lifecycle.unworked(queue, s.where("id = 'a'"), s).collect()}
    assert left == {"b": "fine", "z": "ancora in coda, non classificato"}
    assert [(r.id, r.todo) for r in lifecycle.to_move(s, queue).collect()] == [("e", "archivia")]
    taken, rest = lifecycle.triage_budget(queue, 1)
    assert [r.id for r in taken.collect()] == ["b"] and {r.id for r in rest.collect()} == {"a", "z"}
    assert lifecycle.moved(queue, s, F.lit("2024-01-01")).count() == 2 and lifecycle.fold(spark.createDataFrame([], "id string, seq int, event string, error string")).count() == 0
    b = lifecycle.Breaker(2)
    assert [b.seen(x) for x in (False, True, False, False)] == [True, True, True, False]


def test_outcomes(spark, tmp_path):
    path = str(tmp_path / "esiti")
    rows = spark.createDataFrame([("1", "2024-01-01", "ordinario"), ("2", "2024-01-02", None)], "id string, day string, classe string")
    outcomes.append(rows, path, F.col("day"))
    (tmp_path / "esiti" / "giorno=2024-01-01" / "torn.json").write_text('{"id": "torn')
    outcomes.append(spark.createDataFrame([("3", "x")], "id string, classe string"), path, F.lit("2024-01-01"))
    read = outcomes.read(spark, path, outcomes.OUTCOME)
    assert {(r.id, str(r.giorno)) for r in read.collect()} == {("1", "2024-01-01"), ("2", "2024-01-02"), ("3", "2024-01-01")}
    assert {r.id for r in outcomes.read(spark, path, outcomes.OUTCOME, since="2024-01-02").collect()} == {"2"} == {r.id for r in outcomes.read(spark, path, outcomes.OUTCOME, days=1).collect()}
    fixes = spark.createDataFrame([("1", "b", "classe", "x", "y"), ("1", "a", "classe", "x", "z")], "id string, corretto_il string, campo string, proposto string, corretto string")
    assert {r.id: [c.corretto for c in r.correzioni] for r in outcomes.explain(read, fixes).collect()} == {"1": ["z", "y"], "2": [], "3": []}
    table = {(r.dimension, r.value): (r.total, r.corrected) for r in outcomes.report(read, fixes).collect()}
    assert table["per_classe", "ordinario"] == (1, 1) and table["per_classe", "—"] == (1, 0) and table["tutti", ""] == (3, 1) and table["per_regola", "—"][0] == 3
    assert [r.version for r in outcomes.versions(read).collect()] == ["? (?)"] and outcomes.tokens_used(read).first().token_in == 0
    assert [r[0] for r in spark.createDataFrame([("A",), ("x",), (None,)], "a string").select(outcomes.recipient(F.col("a"), {"a": "a@x.it"})).collect()] == ["a@x.it", "", ""]


def test_settings(spark, tmp_path):
    (tmp_path / "a.toml").write_text('password = "p"\n[rete]\nporta = 1\napi_key = "k"\n[[caselle]]\nid = "rossi"\nindirizzo = "A@X.it"\n[[caselle]]\nid = "verdi"\nattiva = false\n')
    (tmp_path / "b.toml").write_text("[rete]\nporta = 2\n")
    c = settings.load(str(tmp_path / "a.toml"), str(tmp_path / "b.toml"), str(tmp_path / "none.toml"))
    assert c["rete"] == {"porta": 2, "api_key": "k"} and settings.shown(c)["rete"] == {"porta": 2, "api_key": "***"} and settings.shown(c)["password"] == "***"
    from postmill.operators import ingest

    accounts = settings.accounts(spark, c)
    assert [r.address for r in ingest.selected_accounts(accounts).collect()] == ["a@x.it"] and ingest.selected_accounts(accounts, ["verdi"]).count() == 0
    with pytest.raises(ValueError):
        ingest.selected_accounts(accounts, ["bianchi"])
    good = 'versione = "3"\n[destinatari]\nStudio = "s@x.it"\n[[regola]]\nid = "r"\n[regola.quando]\noggetto_regex = ["a+"]\n[regola.allora]\na = "studio"\n'
    (tmp_path / "d.toml").write_text(good)
    d = settings.directives(str(tmp_path / "d.toml"), str(tmp_path / "a.toml"))
    assert d["version"] == "3" and d["recipients"] == {"studio": "s@x.it"} and len(d["fingerprints"]["regole"]) == 16
    for wrong in (("oggetto_regex", "colore"), ('"a+"', '"a("'), ('"studio"', '"nessuno"')):
        (tmp_path / "w.toml").write_text(good.replace(*wrong))
        with pytest.raises(ValueError):
            settings.directives(str(tmp_path / "w.toml"))
    assert settings.room([str(tmp_path)], 1) == "" and settings.room([str(tmp_path)], 1 << 60) and settings.mailbox_name('Posta & "à"') == '"Posta &- \\"&AOA-\\""'
    (tmp_path / "s" / "x").mkdir(parents=True)
    os.utime(tmp_path / "s" / "x", (0, 0))
    assert settings.clean_staging(str(tmp_path / "s")) == 1 and settings.clean_staging(str(tmp_path / "none")) == 0
    with settings.single_writer(str(tmp_path / "lock")), pytest.raises(RuntimeError), settings.single_writer(str(tmp_path / "lock")):
        pass
    run = settings.journal(spark, str(tmp_path / "j"), "run", spark.createDataFrame([("a", 2, 1, None), ("b", 0, 0, "e")], "account string, written int, skipped int, error string"), "s", "f").first()
    assert (run.accounts_ok, run.accounts_err, run.written, run.exit_code) == (1, 1, 2, 1)


def _envelope(parts, head=b""):
    out = head + b"MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n"
    for name, kind, data in parts:
        out += b"--b\r\nContent-Type: %s; name=%s\r\nContent-Transfer-Encoding: base64\r\n\r\n%s\r\n" % (kind, name, base64.b64encode(data))
    return out + b"--b--\r\n"


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_pipeline(spark, tmp_path):
    xml = b'<postacert tipo="posta-certificata" errore="nessuno"><intestazione><mittente>M@X.it</mittente></intestazione><dati><gestore-emittente>G &amp; F</gestore-emittente><data zona="+0200"><giorno>05/07/2024</giorno><ora>10:00:01</ora></data><identificativo>i1</identificativo></dati></postacert>'
    inner = _envelope([(b"a.zip", b"application/zip", _zip(nota__txt="ciao", prog__exe="MZ"))], b"Subject: S\r\nFrom: M <M@X.it>\r\n")
    certified = _envelope([(b"postacert.eml", b"application/octet-stream", inner), (b"daticert.xml", b"application/xml", xml)], b"X-Trasporto: posta-certificata\r\n")
    receipt = _envelope([], b"X-Ricevuta: accettazione\r\nX-Riferimento-Message-ID: <r>\r\nSubject: ACCETTAZIONE: S\r\n")
    evil = b"Content-Type: multipart/mixed; boundary=\r\n\r\n\xff\x00--"
    rows = [("m", 1, u, None, r, n) for u, r, n in ((1, certified, 0), (2, certified, 0), (3, receipt, 0), (4, evil, 0), (5, b"", 9), (6, inner, 4))]
    raw = spark.createDataFrame([(a, e, u, i, bytearray(r), n) for a, e, u, i, r, n in rows], "account string, uidvalidity long, uid long, internaldate timestamp, raw binary, attempts int")
    state = spark.createDataFrame([], "account string, uidvalidity long, uid long, content_hash string, status string")
    got = {r.uid: r for r in pipeline.parsed(raw).collect()}
    assert got[1].msg_type == "posta_certificata" and got[1].certified and got[1].gestore == "G & F" and got[1].date_certified == "2024-07-05T10:00:01+02:00" and got[1].from_addr == "m@x.it"
    assert got[3].msg_type == "accettazione" and got[3].ref_message_id == "<r>" and got[4].msg_type == "generico" and not got[6].certified and got[6].degraded
    read = {r.id: r for r in pipeline.texts_of(pipeline.parsed(raw)).collect()}
    assert read[got[1].id].text == "=== nota.txt ===\nciao\n\n=== prog.exe === [non trattato: blocked_type]" and read[got[6].id].status == "disabled"
    done = {r.uid: r.status for r in pipeline.run(raw, state, str(tmp_path / "a"), F.lit("t"), buckets=2).collect()}
    assert done == {1: "done", 2: "duplicate", 3: "skipped", 4: "done", 5: "done", 6: "done"}
    table = lambda n: spark.read.parquet(str(tmp_path / "a" / n))
    before = [table(n).count() for n in ("messages", "messages_fts", "attachments", "receipts")]
    assert before == [4, 4, 2, 1]
    pipeline.run(raw, state, str(tmp_path / "a"), F.lit("t"), buckets=2).count()
    assert [table(n).count() for n in ("messages", "messages_fts", "attachments", "receipts")] == before
    again = spark.createDataFrame([("m", 1, 1, got[1].content_hash, "done")], "account string, uidvalidity long, uid long, content_hash string, status string")
    fresh, twins = pipeline.new_messages(raw, again)
    assert {r.uid for r in fresh.collect()} == {3, 4, 5, 6} and {r.uid for r in twins.collect()} == {2}


def test_certificate_and_damage():
    assert mime.certificate(b"<!DOCTYPE x><postacert tipo='a'/>") is None and mime.certificate(b"") is None and mime.certificate(b"<postacert/>") is None
    cut = mime.certificate(b"<postacert tipo='errore' errore='altro'><msgid>&lt;1&gt;</msgid><data zona='+0100'><giorno>1/2/2024</giorno>")
    assert cut["msgid"] == "<1>" and cut["zona"] == "+0100" and cut["giorno"] == "1/2/2024"
    for junk in (b"", b"\x00" * 5000, b"From: =?x?q?\xff", b"Content-Type: message/rfc822\r\n\r\n", b"x" * 200_000):
        assert mime.parse(junk)["attachments"] is not None
    bomb = _zip(**{"a__txt": "0" * 60_000})
    assert [m["status"] for m in archives.members("b.zip", bomb)] == ["ratio"]  # small archives have no exemption
    assert extract.text_of("x.zip", None, bomb)["status"] == "archive_limit"


def test_dates_and_sizes(spark):
    df = spark.createDataFrame([("scade il 5/3/24", 0), ("30 settembre", 1500), ("2024-01-02", 5 << 20), (None, -1), ("boh", None)], "d string, n long")
    key = times.deadline_key(F.col("d"), F.lit("f"))
    assert [(r[0].rank, r[0].day) for r in df.select(key).collect()] == [(0, "2024-03-05"), (0, "9999-09-30"), (0, "2024-01-02"), (1, "f"), (1, "f")]
    assert [r[0] for r in df.select(text.bytes_text(F.col("n"))).collect()] == ["0 B", "1.5 KiB", "5.0 MiB", "?", None]
    c = spark.createDataFrame([("5/7/2024", "10:00", "+0200"), ("31/12/2023", "23:59:59", None), ("x", "10:00", ""), ("31/02/2024", "10:00", "")], "d string, h string, z string")
    got = c.select(F.date_format(times.certificate_date(F.col("d"), F.col("h"), F.col("z")), "yyyy-MM-dd HH:mm:ss")).collect()
    assert [r[0] for r in got] == ["2024-07-05 08:00:00", "2023-12-31 23:59:59", None, None]
    assert spark.createDataFrame([(b"%PD%PDF-1",), (b"5" + bytes.fromhex("025504446D2550444 62D".replace(" ", "")),)], "d binary").select(files.sniff(F.col("d"))).first()[0] == "pdf"


def test_mailbox_without_bodies(spark, tmp_path):
    spark.dataSource.register(MailboxSource)
    for u in range(1, 4):
        (tmp_path / "a" / "7").mkdir(parents=True, exist_ok=True)
        (tmp_path / "a" / "7" / f"{u}.eml").write_bytes(b"x" * u)
    rows = spark.read.format("mailbox").option("bodies", "false").load(str(tmp_path)).collect()
    assert sorted((r.uid, r.size, r.raw) for r in rows) == [(1, 1, None), (2, 2, None), (3, 3, None)]
    assert list_folders(spark, str(tmp_path)).first().asDict() == {"account": "a", "uidvalidity": 7, "messages": 3, "last_uid": 3}


def test_archive_upsert(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2024", "x"), ("1", "2025", "y"), ("2", "2024", "z")], "id string, fetched_at string, subject string")
    for _ in range(2):
        archive.upsert(rows, str(tmp_path / "t"), buckets=2)
    held = spark.read.parquet(str(tmp_path / "t"))
    assert held.count() == 3 and {(r.id, r.subject) for r in archive.newest(held).collect()} == {("1", "y"), ("2", "z")}
    assert json.dumps(sorted(p for p in os.listdir(tmp_path / "t") if p.startswith("bucket")))
