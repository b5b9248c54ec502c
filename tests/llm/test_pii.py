"""The tagger on held-out rows, its decoding against brute force, and the operators on edge cases."""

import itertools

import numpy as np
import pytest

from postmill.llm import pii, pii_labels


@pytest.fixture(scope="module")
def tagger():
    return pii.default_tagger()


def test_held_out(tagger):
    rows = pii_labels.sentences(3, seed=77)
    hit = wrong = missed = 0
    for (_, want), got in zip(rows, tagger.mentions([t for t, _ in rows]), strict=True):
        a, b = {(k, s + 1, e) for k, s, e in want}, set(got)
        hit, wrong, missed = hit + len(a & b), wrong + len(b - a), missed + len(a - b)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_viterbi_against_brute_force(tagger):
    rng = np.random.default_rng(1)
    small = pii.Tagger({}, np.zeros((5, 1, 11), np.float32), tagger.moves)
    e = rng.normal(0, 3, (14, 11)).astype(np.float32)
    starts, sizes = np.array([0, 5, 10, 13]), np.array([4, 4, 2, 1])
    out = np.zeros(14, np.int8)
    small._viterbi(e, starts, sizes, out)
    for a, n in zip(starts, sizes, strict=True):

        def score(path, part=e[a : a + n]):
            s = tagger.moves[0, path[0]] + tagger.moves[path[-1], 0] + sum(part[t, y] for t, y in enumerate(path))
            return s + sum(tagger.moves[x, y] for x, y in itertools.pairwise(path))

        best = max(itertools.product(range(11), repeat=int(n)), key=score)
        assert abs(score(best) - score(out[a : a + n].tolist())) < 1e-3


def test_tokens_join_to_text():
    for text, _ in pii_labels.sentences(1, seed=3):
        assert "".join(pii.split(text)) == text
    for text in ("", " ", "\n\n", "> > x\n>> y", "a\x00b", "🎉 è", "x" * 5000, "1" * 900):
        assert "".join(pii.split(text)) == text


def test_redact_and_find(spark, tagger):
    text = "Il referente è Mario Rossetti, raggiungibile a m.rossetti@pec.x.example oppure al numero 303 4521347.\nIl riferimento interno è il n. 3086210632."
    rows = [(1, text, "R: Delega di Anna Belletti (BLLNNA80A41Y123X)"), (2, None, None), (3, "", " "), (1, text, None), (4, "parola " * 20000, "x")]
    df = spark.createDataFrame(rows, "id long, body string, subject string").withColumn("kind", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = pii.find(df, "id", {"body": "body", "subject": "subject"}).collect()
    body = sorted((r.kind, text[r.start_pos - 1 : r.end_pos]) for r in got if r.id == 1 and r.field == "body")
    assert body == sorted([("email", "m.rossetti@pec.x.example"), ("name", "Mario Rossetti"), ("phone", "303 4521347")] * 2)
    assert {r.kind for r in got if r.field == "subject"} == {"name", "id_number"}
    assert {r.id for r in got} == {1}
    red = {(r.id, r.field): r.text for r in pii.redact(df, "id", {"body": "body", "subject": "subject"}).collect()}
    assert red[(1, "body")].startswith("Il referente è [NAME], raggiungibile a [EMAIL] oppure al numero [PHONE].\nIl rif")
    assert red[(2, "body")] is None and red[(3, "body")] == ""
    assert pii.find(df.limit(0), "id", {"body": "body"}).count() == 0


def test_redacted_query_has_every_field(spark, tmp_path):
    from postmill.llm import queries

    subject = "Delega di Anna Belletti (BLLNNA80A41Y123X)"
    tables = {
        "messages": ([("m1", subject), ("m1", subject), ("m2", None), ("m3", "Avviso")], "id string, subject string"),
        "messages_fts": ([(1, "Il referente è Mario Rossetti.", "x.pdf"), (2, None, "")], "rowid_fts long, body string, attachments string"),
        "fts_map": ([("m1", 1)], "msg_id string, rowid_fts long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = queries.p1_redacted(spark, str(tmp_path)).collect()
    got = {(r.id, r.rowid_fts, r.field): r.text for r in rows}
    assert len(rows) == len(got) == 7
    assert got["m1", None, "subject"] == "Delega di [NAME] ([ID])"
    assert got["m2", None, "subject"] is None and got["m3", None, "subject"] == "Avviso"
    assert got["m1", 1, "body"] == "Il referente è [NAME]."
    assert got[None, 2, "body"] is None and got[None, 2, "attachments"] == ""


def test_open_tokens_lose_nothing(tagger):
    """Decoding only what may be a mention gives the best path of the whole text."""
    for text, _ in pii_labels.sentences(1, seed=5)[:120]:
        rows = np.array(tagger.rows_of(pii.split(text)), np.int64)
        e = tagger.emissions(rows)
        out = np.zeros(len(rows), np.int8)
        tagger._viterbi(e, np.array([0]), np.array([len(rows)]), out)

        def score(path, e=e):
            return tagger.moves[0, path[0]] + tagger.moves[path[-1], 0] + sum(e[t, y] for t, y in enumerate(path)) + sum(tagger.moves[x, y] for x, y in itertools.pairwise(path))

        assert abs(score(out.tolist()) - score(tagger.labels(rows).tolist())) < 1e-2, text


def test_held_out_templates():
    rows = list(pii_labels.ROWS)
    model = pii.train(pii_labels.sentences(rows=[r for i, r in enumerate(rows) if i % 5]))
    hit = wrong = missed = 0
    test = pii_labels.sentences(4, 77, rows[::5])
    for (_, want), got in zip(test, model.mentions([t for t, _ in test]), strict=True):
        a, b = {(k, s + 1, e) for k, s, e in want}, set(got)
        hit, wrong, missed = hit + len(a & b), wrong + len(b - a), missed + len(a - b)
    assert hit / (hit + wrong) > 0.93 and hit / (hit + missed) > 0.97, (hit, wrong, missed)


def test_names_that_no_list_holds(tagger):
    people = "Noemi Ferrero;Wolfgang Müller;Kevin Smith;Giada Colombo;Nikolai Petrov;Ines Halloway;Tariq Mansour;Ewa Kowalska".split(";")
    around = ["Il referente è {}, raggiungibile al numero 303 4521347.", "Ho sentito {} ieri pomeriggio.", "Per ogni chiarimento può chiamare {} al 303 4521347.", "Avv. {}\nVia dei Tigli 4"]
    found = 0
    for c in around:
        at = c.index("{}") + 1
        found += sum(("name", at, at + len(p) - 1) in got for p, got in zip(people, tagger.mentions([c.format(p) for p in people]), strict=True))
    assert found >= 0.9 * len(people) * len(around)
