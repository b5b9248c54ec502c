"""Mail bytes to text: charset repair, encoded headers, HTML to text, message parsing, as Arrow UDFs."""

from __future__ import annotations

import codecs
import email
import email.header
import email.policy
import email.utils
import hashlib
import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

# Declared charsets that mean nothing, those that are often UTF-8 in truth, and fallbacks.
MEANINGLESS = frozenset("unknown unknown-8bit x-unknown x-user-defined us-ascii ansi_x3.110-1983 default none null 8bit binary".split())
LATIN = frozenset("iso-8859-1 iso8859-1 latin-1 latin1 iso-8859-15 windows-1252 cp1252".split())
FALLBACKS = ("utf-8", "cp1252", "iso-8859-15", "latin-1")


def decode(data: bytes | None, charset: str | None = None) -> str:
    """Text of bytes in a declared charset that may be wrong; never raises, null gives an empty text.

    Valid multibyte UTF-8 outranks a declared Latin charset.
    """
    if not data:
        return ""
    named = (charset or "").strip(" \"'").lower().removeprefix("3d")
    order = [named] if named and named not in MEANINGLESS else []
    if named in LATIN and not data.isascii():
        order.insert(0, "utf-8")
    for name in (*order, *FALLBACKS):
        try:
            return codecs.decode(data, name)
        except (UnicodeDecodeError, LookupError, TypeError, ValueError):
            continue
    return data.decode("latin-1")


def header_text(raw) -> str:
    """A header's text: encoded words decoded, unfolded, composed, blanks closed up."""
    if raw is None:
        return ""
    line = " ".join(str(raw).splitlines())
    try:
        line = "".join(decode(part, charset) if isinstance(part, bytes) else part for part, charset in email.header.decode_header(line))
    except (email.errors.HeaderParseError, ValueError):
        pass
    return " ".join(unicodedata.normalize("NFC", line.replace("\0", "")).split())


def addresses(raw) -> list[dict[str, str]]:
    """[{name, address, domain}] of an address header, each address once, lower case."""
    found: dict[str, dict[str, str]] = {}
    for name, address in email.utils.getaddresses([header_text(raw)]):
        address, name = address.strip().lower(), name.strip()
        if address or name:
            found.setdefault(address or name.lower(), {"name": name, "address": address, "domain": address.rpartition("@")[2] if "@" in address else ""})
    return list(found.values())


def tidy(text: str) -> str:
    """Line ends to LF, blanks closed up, at most one empty line, composed characters."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate({0: None, 0xA0: " ", 0x200B: None})
    text = "\n".join(re.sub(r"[ \t\f\v]+", " ", line).rstrip() for line in text.split("\n"))
    return unicodedata.normalize("NFC", re.sub(r"\n{3,}", "\n\n", text)).strip()


# Elements without readable content, and those that begin or end a line.
HIDDEN = frozenset("script style head title noscript".split())
LINES = frozenset("p div br tr table ul ol h1 h2 h3 h4 h5 h6 blockquote section article header footer pre hr form fieldset dl dt dd".split())
#: element to the text (before, after) its content; links are the one thing that depends on an attribute
AROUND = {**dict.fromkeys(LINES, ("\n", "\n")), "li": ("\n- ", ""), "td": ("\t", ""), "th": ("\t", "")}
#: beginnings of targets that say nothing to a reader. Fixed values.
EMPTY_TARGETS = ("javascript:", "#", "cid:")


class _Reader(HTMLParser):
    """Writes the text of a page; ``muted`` holds the open elements whose content is not read."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.muted: list[str] = []
        self.targets: list[str] = []

    def _write(self, text: str) -> None:
        if not self.muted:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "body":  # an unclosed head ends here
            self.muted = []
        if tag in HIDDEN:
            self.muted.append(tag)
        self._write(AROUND.get(tag, ("", ""))[0])
        if tag == "a" and not self.muted:
            self.targets.append(dict(attrs).get("href") or "")

    def handle_startendtag(self, tag, attrs):
        self._write("\n" if tag in LINES else "")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.muted = self.muted[: self.muted.index(tag)] if tag in self.muted else self.muted
            return
        if tag == "a" and self.targets and not self.muted:
            target = self.targets.pop()
            self._write(f" <{target}>" if target and not target.lower().startswith(EMPTY_TARGETS) else "")
        self._write(AROUND.get(tag, ("", ""))[1])

    def handle_data(self, data):
        self._write(data)


def html_text(page: str | None) -> str:
    """Readable text of an HTML page; null and empty give an empty text."""
    if not page:
        return ""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return tidy("".join(reader.out))


# Names that a message without one gets by its type, and parts that are no attachments.
ENDINGS = {"application/pdf": ".pdf", "text/plain": ".txt", "text/html": ".html", "message/rfc822": ".eml", "image/jpeg": ".jpg", "image/png": ".png"}
ENVELOPE = ("daticert.xml", "postacert.eml")
SIGNATURES = ("application/pkcs7-signature", "application/x-pkcs7-signature")

_ADDRESS = StructType([StructField("name", StringType()), StructField("address", StringType()), StructField("domain", StringType())])
MESSAGE = StructType([
    StructField("message_id", StringType()), StructField("subject", StringType()), StructField("date", StringType()), StructField("from", _ADDRESS), StructField("to", ArrayType(_ADDRESS)), StructField("cc", ArrayType(_ADDRESS)),
    StructField("transport", StringType()), StructField("receipt", StringType()), StructField("declared", StringType()), StructField("ref_message_id", StringType()), StructField("body", StringType()), StructField("body_source", StringType()),
    StructField("attachments", ArrayType(StructType([StructField("name", StringType()), StructField("content_type", StringType()), StructField("size", LongType()), StructField("sha256", StringType()), StructField("inline", BooleanType()), StructField("payload", BinaryType())]))),
    StructField("enveloped", BooleanType()), StructField("sent_at", LongType()), StructField("envelope_subject", StringType()), StructField("reply_to", ArrayType(_ADDRESS)),
    StructField("certificate", StructType([StructField(k, StringType()) for k in ("tipo", "errore", "mittente", "oggetto", "gestore", "giorno", "ora", "zona", "identificativo", "msgid", "errore_esteso")])),
    StructField("flags", ArrayType(StringType())),
])


def _payload(part) -> bytes:
    if part.get_content_type() == "message/rfc822" and part.is_multipart():
        return part.get_payload(0).as_bytes()
    return part.get_payload(decode=True) or b""


#: fields of the certificate by where they stand: an attribute of an element, or an element's text. Fixed values.
CERTIFICATE = {
    "tipo": ("postacert", "tipo"), "errore": ("postacert", "errore"), "mittente": ("mittente", None), "oggetto": ("oggetto", None), "gestore": ("gestore-emittente", None), "giorno": ("giorno", None), "ora": ("ora", None),
    "zona": ("data", "zona"), "identificativo": ("identificativo", None), "msgid": ("msgid", None), "errore_esteso": ("errore-esteso", None),
}


def certificate(xml: bytes) -> dict[str, str] | None:
    """The fields of the certificate part; null where it cannot be read or declares a document type or entity.

    A damaged certificate is searched for the same fields by pattern.
    """
    if not xml or len(xml) > 16 << 20 or re.search(rb"<!(?:DOCTYPE|ENTITY)", xml, re.I):
        return None
    import xml.etree.ElementTree as tree

    found = dict.fromkeys(CERTIFICATE, "")
    try:
        elements: dict[str, tree.Element] = {}
        for e in tree.fromstring(xml).iter():
            elements.setdefault(e.tag, e)
        for name, (tag, attribute) in CERTIFICATE.items():
            if (e := elements.get(tag)) is not None:
                found[name] = (e.get(attribute) if attribute else e.text) or ""
    except tree.ParseError:
        text = decode(xml)
        for name, (tag, attribute) in CERTIFICATE.items():
            m = re.search(rf"<{tag}\b[^>]*?\b{attribute}\s*=\s*[\"']([^\"']*)" if attribute else rf"<{tag}\b[^>]*>([^<]*)", text)
            found[name] = html.unescape(m[1]) if m else ""
    found = {k: v.strip() for k, v in found.items()}
    return found if found["tipo"] else None


def _empty(flags: list[str]) -> dict:
    """A message of which nothing could be read."""
    lists = {"to", "cc", "reply_to", "attachments"}
    out = {f.name: [] if f.name in lists else None for f in MESSAGE.fields}
    return out | {"body": "", "body_source": "", "enveloped": False, "flags": flags}


def parse(raw: bytes | None) -> dict | None:
    """The message in an envelope, or the message itself; null for null, and flags instead of errors."""
    if raw is None:
        return None
    try:
        return _parse(raw)
    except Exception as e:  # one malformed message must not end its task
        return _empty(["illeggibile:" + type(e).__name__])


def _parse(raw: bytes) -> dict:
    flags: list[str] = []
    outer = email.message_from_bytes(raw, policy=email.policy.compat32)
    parts = list(outer.walk())
    name = lambda p: header_text(p.get_filename()).lower()
    xml = next((_payload(p) for p in parts if name(p) == "daticert.xml"), b"") or next((x for p in parts if p.get_content_type() in ("application/xml", "text/xml") and b"<postacert" in (x := _payload(p))[:4096]), b"")
    inside = next((_payload(p) for p in parts if p is not outer and (name(p) == "postacert.eml" or p.get_content_type() == "message/rfc822")), b"")
    certified = certificate(xml)
    if xml and certified is None:
        flags.append("certificato_illeggibile")
    message = email.message_from_bytes(inside, policy=email.policy.compat32) if inside else outer
    plain, pages, attachments = [], [], []
    for p in message.walk():
        if p.is_multipart() and p.get_content_type() != "message/rfc822":
            continue
        kind, label, how = p.get_content_type(), header_text(p.get_filename()), p.get_content_disposition()
        if kind in ("text/plain", "text/html") and how != "attachment" and not label:
            (plain if kind == "text/plain" else pages).append(decode(_payload(p), p.get_content_charset()))
        elif p is not message and kind not in SIGNATURES and label.lower() not in ENVELOPE:
            data = _payload(p)
            attachments.append({"name": label or f"allegato-{len(attachments) + 1}{ENDINGS.get(kind, '.bin')}", "content_type": kind, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "inline": how == "inline", "payload": data})
    body, source = tidy("\n\n".join(plain)), "text"
    if not body:
        body, source = html_text("\n".join(pages)), "html" if pages else ""
    if not body:
        flags.append("corpo_vuoto")
    said = certified or {}
    sender = addresses(message.get("From")) or addresses(said.get("mittente"))
    when = email.utils.parsedate_tz(header_text(message.get("Date")))
    sent = email.utils.mktime_tz(when) if when else None
    return {
        "message_id": header_text(message.get("Message-ID")) or header_text(outer.get("Message-ID")), "subject": header_text(message.get("Subject")) or said.get("oggetto", ""), "date": email.utils.formatdate(sent) if sent is not None else None, "sent_at": sent, "from": sender[0] if sender else None,
        "to": addresses(message.get("To")), "cc": addresses(message.get("Cc")), "reply_to": addresses(message.get("Reply-To")), "transport": header_text(outer.get("X-Trasporto")), "receipt": header_text(outer.get("X-Ricevuta")), "declared": said.get("tipo", ""),
        "ref_message_id": header_text(outer.get("X-Riferimento-Message-ID")) or said.get("msgid", ""), "body": body, "body_source": source if body else "", "attachments": attachments, "enveloped": bool(inside), "envelope_subject": header_text(outer.get("Subject")), "certificate": certified, "flags": flags,
    }


@F.pandas_udf(StringType())
def html_to_text(page: pd.Series) -> pd.Series:
    """html_text as an Arrow UDF."""
    return page.map(html_text, na_action="ignore")


@F.pandas_udf(StringType())
def decode_text(data: pd.Series, charset: pd.Series) -> pd.Series:
    """decode as an Arrow UDF; null bytes stay null."""
    return pd.Series([None if d is None else decode(d, c) for d, c in zip(data, charset, strict=True)])


@F.pandas_udf(StringType())
def decode_header(raw: pd.Series) -> pd.Series:
    """header_text as an Arrow UDF."""
    return raw.map(header_text, na_action="ignore")


@F.pandas_udf(ArrayType(_ADDRESS))
def parse_addresses(raw: pd.Series) -> pd.Series:
    """addresses as an Arrow UDF."""
    return raw.map(addresses, na_action="ignore")


def parse_messages(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``parsed``, the struct MESSAGE of each message; carried columns stay in Arrow."""
    kept = [c for c in df.columns]

    def run(batches):
        for b in batches:
            yield b.assign(parsed=[parse(x) for x in b[raw]])

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("parsed", MESSAGE)])).select(*kept, "parsed")


def excerpt_of(text: str | None, keywords: list[str], budget: int = 1200, head: int = 700, window: int = 300, windows: int = 4) -> dict | None:
    """The head of a text and windows around the first later hit of each keyword, cut gaps counted."""
    if text is None:
        return None
    if len(text) <= budget:
        return {"text": text, "sent": len(text), "total": len(text), "windows": 0}
    head, half, low = min(head, budget), max(window // 2, 40), text.lower()
    spans: list[list[int]] = []
    for start in sorted(i for w in keywords if (i := low.find(w, head)) >= 0):
        word = next(len(w) for w in keywords if low.startswith(w, start))
        a, b = max(start - half, head), min(start + word + half, len(text))
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    left, used, pieces = budget - head, 0, [[0, head]]
    for a, b in spans[:windows]:
        b = min(b, a + left)
        if b > a:
            used, left = used + 1, left - (b - a)
            if a == pieces[-1][1]:
                pieces[-1][1] = b
            else:
                pieces.append([a, b])
    out, at = [], 0
    for a, b in pieces:
        out += [f"\n[… {a - at} caratteri omessi …]\n"] if a > at else []
        out.append(text[a:b])
        at = b
    if at < len(text):
        out.append(f"\n[… {len(text) - at} caratteri omessi …]")
    return {"text": "".join(out), "sent": sum(b - a for a, b in pieces), "total": len(text), "windows": used}


def excerpt(c: Column, keywords: tuple[str, ...], budget: int = 1200) -> Column:
    """excerpt_of as an Arrow UDF: STRUCT text, sent, total, windows."""

    @F.pandas_udf("text string, sent int, total int, windows int")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [excerpt_of(t, list(keywords), budget) or {"text": None, "sent": None, "total": None, "windows": None} for t in texts]
        return pd.DataFrame(rows, columns=["text", "sent", "total", "windows"]).astype({"sent": "Int32", "total": "Int32", "windows": "Int32"})

    return run(c)
