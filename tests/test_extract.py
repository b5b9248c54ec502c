"""Extraction by kind with its statuses, and names of files."""

import io
import zipfile

from postmill.functions import extract, naming


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, data in entries:
            z.writestr(n, data)
    return out.getvalue()


def test_statuses(spark):
    docx = zipped([("word/document.xml", "<w:p>Ciao</w:p>")])
    rows = [
        ("a.txt", "", "però".encode("cp1252"), "ok", "però"), ("a.html", "", b"<p>x</p>", "ok", "x"), ("a.docx", "", docx, "ok", "Ciao"), ("a.docm", "", docx, "ok", "Ciao"), ("a.pdf", "", b"%PDF-1", "tool_missing", ""), ("a.pdf.exe", "", b"x", "blocked_type", ""),
        ("b.pdf", "", b"MZ", "blocked_type", ""), ("a.zip", "", zipped([("i.txt", b"1")]), "ok", "=== i.txt ===\n1"), ("a.rar", "", b"Rar!x", "unsupported_archive", ""), ("z.zip", "", zipped([("z", b"\0" * (9 << 20))]), "archive_limit", "=== z === [non trattato: ratio]"), ("a.rtf", "", b"{\\rtf1 citt\\'e0}", "ok", "citt\u00e0"),
        ("a.doc", "", b"\xd0\xcf\x11\xe0", "unsupported", ""), ("a.txt", "", b"", "empty", ""), ("a.txt", None, None, "empty", ""), (None, None, b"x", "unsupported", ""), ("a.eml", "", b"From: a@b.it\r\nSubject: s\r\n\r\ncorpo", "ok", "Da: a@b.it\nOggetto: s\n\ncorpo"), ("a.zip", "", b"PK\x03\x04x", "failed", ""), ("x.jpg", "", b"\xff\xd8", "tool_missing", ""),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id int, name string, content_type string, payload binary")
    got = {r.id: r for r in extract.extract(df).collect()}
    for i, r in enumerate(rows):
        assert (got[i].status, got[i].text) == r[3:], (i, r[0], got[i])
    small = extract.Limits(max_bytes=3, max_chars=2)
    assert extract.text_of("a.txt", "", b"abcd", small)["status"] == "skipped_too_large"
    assert extract.text_of("a.txt", "", b"abc", small)["truncated"] and set(extract.STATUSES) >= {r.status for r in got.values()}


def test_names():
    assert "/" not in naming.safe("../../etc/passwd") and naming.safe("CON.txt") == "_CON.txt" and naming.safe(" . ") == "allegato" and naming.safe(None) == "allegato"
    assert naming.safe("Fattura 1/2026.pdf") == "Fattura 1_2026.pdf" and len(naming.safe("x" * 300 + ".pdf")) == 96
    assert naming.unique(["a.pdf", "A.pdf", "a.pdf", None, None]) == ["a.pdf", "A-1.pdf", "a-2.pdf", "allegato", "allegato-1"]
