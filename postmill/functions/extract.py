"""Text of an attachment by its kind, with a status instead of an error; an Arrow function over rows."""

from __future__ import annotations

import mimetypes
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from postmill.functions import archives, files, mime

#: Statuses of an extraction. Fixed values.
STATUSES = ("ok", "empty", "failed", "skipped_too_large", "unsupported", "tool_missing", "disabled", "blocked_type", "archive_limit", "encrypted", "unsupported_archive")


@dataclass(frozen=True)
class Limits:
    """What a single attachment may take. ``pdf`` and ``ocr`` plug in tools that are not here."""

    max_bytes: int = 25 << 20
    max_chars: int = 200_000
    pdf: Callable[[bytes], str] | None = None
    ocr: Callable[[bytes], str] | None = None


def _runs(name: str, content_type: str, data: bytes) -> bool:
    endings = [p.strip().lower() for p in name.replace("\\", "/").rpartition("/")[2].split(".")[1:]]
    signs = (b"MZ", b"\x7fELF", b"#!", b"\xca\xfe\xba\xbe", b"\xfe\xed\xfa", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe")
    return any(e in files.ACTIVE for e in endings) or data.startswith(signs) or content_type in files.EXECUTABLE_TYPES


def _rtf(data: bytes) -> str:
    plain = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), mime.decode(data))
    return re.sub(r"[{}]", " ", re.sub(r"\\[A-Za-z]+-?\d* ?|\\[^A-Za-z]", " ", plain))


def _mail(data: bytes) -> str:
    m = mime.parse(data)
    head = [f"{k}: {v}" for k, v in (("Da", (m["from"] or {}).get("address")), ("Oggetto", m["subject"]), ("Data", m["date"])) if v]
    return "\n".join([*head, "", m["body"]])


def _archive(name: str, data: bytes, limits: Limits) -> tuple[str, str]:
    """Each member's text under its declared name, with a note where it gives none; the status tells what stopped the reading."""
    leaves = list(archives.members(name, data))
    states = {m["status"].split(":")[0] for m in leaves}
    if states <= {"opaque"} and len(leaves) == 1:
        return "", "unsupported_archive"
    sections, read = [], False
    for m in leaves:
        label, why = m["declared"] or m["path"], m["status"]
        if why.startswith("corrupt"):
            continue
        if why == "ok":
            got = text_of(m["declared"], mimetypes.guess_type(m["declared"] or "")[0], m["data"], limits)
            read, why = read or bool(got["text"]), got["status"]
            if got["text"]:
                sections.append(f"=== {label} ===\n{got['text']}")
                continue
        sections.append(f"=== {label} === [non trattato: {why}]")
    if states & {"ratio", "total", "entries", "depth", "member_limit"}:
        status = "archive_limit"
    elif "encrypted" in states and not read:
        status = "encrypted"
    else:
        status = "failed" if "corrupt" in states and not read else "ok"
    return "\n\n".join(sections), status


#: endings and content type parts by the method that reads them. Fixed values.
_METHODS = (
    ("office", (".docx", ".docm", ".xlsx", ".xlsm", ".pptx", ".pptm", ".odt", ".ods", ".odp"), ("officedocument", "vnd.oasis")),
    ("html", (".html", ".htm", ".xhtml"), ("text/html", "xhtml")),
    ("plain", (".txt", ".csv", ".tsv", ".log", ".md", ".asc", ".json", ".ini", ".cfg", ".dat", ".xml", ".xsd", ".xsl"), ("text/", "application/xml", "application/json", "application/csv")),
    ("eml", (".eml",), ("message/rfc822",)), ("rtf", (".rtf",), ()),
    ("image_ocr", (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp"), ("image/",)),
)


def text_of(name: str | None, content_type: str | None, data: bytes | None, limits: Limits = Limits()) -> dict:
    """{text, method, status, truncated, chars}; never raises. Null data counts as empty."""
    name, kind, data = name or "", (content_type or "").lower(), data or b""

    def out(text: str, method: str, status: str) -> dict:
        text = mime.tidy(text)
        if status == "ok" and not text:
            status = "empty"
        return {"text": text[: limits.max_chars], "method": method, "status": status, "truncated": len(text) > limits.max_chars, "chars": min(len(text), limits.max_chars)}

    if not data:
        return out("", "none", "empty")
    if len(data) > limits.max_bytes:
        return out("", "none", "skipped_too_large")
    if _runs(name, kind, data):
        return out("", "none", "blocked_type")
    low = name.lower()
    try:
        if low.endswith(".p7m") or "pkcs7-mime" in kind:
            return out("", "p7m", "tool_missing")
        if low.endswith(".pdf") or data.startswith(b"%PDF-") or kind == "application/pdf":
            tools = [t for t in (limits.pdf, limits.ocr) if t]
            text = next((x for t in tools if len((x := t(data)).strip()) >= 32), "")
            return out(text, "pdf", "ok" if tools else "tool_missing")
        method = next((m for m, ends, types in _METHODS if low.endswith(ends) or any(t in kind for t in types)), None)
        if method == "office" and data.startswith(b"PK"):
            return out(archives.office_text(name, data), "office_xml", "ok")
        if archives.kind_of(name, data):
            return out(*(lambda t, s: (t, "archive", s))(*_archive(name, data, limits)))
        if method == "html":
            return out(mime.html_text(mime.decode(data)), method, "ok")
        if method == "plain":
            return out(mime.decode(data), method, "ok")
        if method == "eml":
            return out(_mail(data), method, "ok")
        if method == "rtf":
            return out(_rtf(data), method, "ok")
        if method == "image_ocr":
            return out(limits.ocr(data), method, "ok") if limits.ocr else out("", method, "tool_missing")
        return out("", "none", "unsupported")
    except Exception:  # an attachment must not stop the others of its task
        return out("", "none", "failed")


def extract(df: DataFrame, name: str = "name", content_type: str = "content_type", data: str = "payload", limits: Limits = Limits()) -> DataFrame:
    """Adds text, method, status, truncated and chars to attachment rows and drops the bytes."""
    kept = [c for c in df.columns if c != data and c not in ("text", "method", "status", "truncated", "chars")]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for b in batches:
            got = pd.DataFrame([text_of(n, t, d, limits) for n, t, d in zip(b[name], b[content_type], b[data], strict=True)], columns=["text", "method", "status", "truncated", "chars"], index=b.index)
            yield pd.concat([b[kept], got], axis=1)

    return df.select(*dict.fromkeys([*kept, name, content_type, data])).mapInPandas(run, f"{fields}, text string, method string, status string, truncated boolean, chars int")
