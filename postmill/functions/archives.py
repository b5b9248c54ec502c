"""Hostile archives: members of zip, tar, gz, bz2 and xz under one budget for the whole tree."""

from __future__ import annotations

import bz2
import gzip
import html
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import functions as F

from postmill.functions.mime import decode

_MAGIC = ((b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"Rar!", "opaque"), (b"7z\xbc\xaf\x27\x1c", "opaque"))
_PACKED = re.compile(r"\.(?:gz|bz2|xz|t(?P<tar>gz|bz2|b2|xz))$", re.I)


@dataclass
class Budget:
    """What a whole tree may take; ``stop`` says which limit ended the reading."""

    packed: int
    ratio: float = 120.0
    total: int = 64 << 20
    entries: int = 500
    depth: int = 3
    member: int = 32 << 20
    seen: int = 0
    size: int = 0
    stop: str = ""

    def take(self, n: int) -> bool:
        self.size += n
        if self.size > self.total:
            self.stop = "total"
        elif self.size / max(1, self.packed) > self.ratio:
            self.stop = "ratio"
        return not self.stop

    def enter(self) -> bool:
        self.seen += 1
        if self.seen > self.entries:
            self.stop = "entries"
        return not self.stop


def kind_of(name: str, data: bytes) -> str:
    """zip, tar, gz, bz2, xz, opaque or empty, by content before name."""
    for magic, kind in _MAGIC:
        if data.startswith(magic):
            return kind
    if data[257:262] == b"ustar":
        return "tar"
    ending = name.lower().rpartition(".")[2]
    if ending in ("rar", "7z", "arj", "ace", "lzh", "lha", "cab"):
        return "opaque"
    return {"zip": "zip", "tar": "tar", "gz": "gz", "tgz": "gz", "bz2": "bz2", "tbz2": "bz2", "xz": "xz", "txz": "xz"}.get(ending, "")


def _read(stream, budget: Budget) -> tuple[bytes, str]:
    """A member's bytes, read in blocks: declared sizes are not trusted."""
    out = bytearray()
    while block := stream.read(65536):
        if len(out) + len(block) > budget.member:
            return b"", "member_limit"
        if not budget.take(len(block)):
            return b"", budget.stop
        out += block
    return bytes(out), ""


def _entries(name: str, data: bytes, kind: str, budget: Budget) -> Iterator[tuple[str, bytes, str]]:
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                if not budget.enter():
                    return
                if info.flag_bits & 1:
                    yield info.filename, b"", "encrypted"
                    continue
                with z.open(info) as stream:
                    yield info.filename, *_read(stream, budget)
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for info in t:
                if info.isdir():
                    continue
                if not budget.enter():
                    return
                if not info.isreg():
                    yield info.name, b"", "not_regular"
                else:
                    yield info.name, *_read(t.extractfile(info), budget)
    elif budget.enter():
        opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[kind]
        with opener(io.BytesIO(data)) as stream:
            base = name.replace("\\", "/").rpartition("/")[2]
            yield (_PACKED.sub(lambda m: ".tar" if m["tar"] else "", base) or "contenuto"), *_read(stream, budget)


def members(name: str | None, data: bytes | None, budget: Budget | None = None, level: int = 0, path: str = "") -> Iterator[dict]:
    """One dict for each leaf of the tree: path, declared, size, status, depth, data; containers are opened, not listed.

    ``declared`` is data and never used as a path. Never raises: a broken archive is one row ``corrupt``.
    """
    data = data or b""
    kind = kind_of(name or "", data)
    budget = budget or Budget(len(data))
    if kind in ("", "opaque"):
        yield {"path": path or "1", "declared": name, "size": len(data), "status": "opaque" if kind else "ok", "depth": level, "data": data}
        return
    if level >= budget.depth:
        yield {"path": path or "1", "declared": name, "size": len(data), "status": "depth", "depth": level}
        return
    try:
        for n, (inner, payload, why) in enumerate(_entries(name or "", data, kind, budget), 1):
            at = f"{path}/{n}" if path else str(n)
            if why:
                yield {"path": at, "declared": inner, "size": len(payload), "status": why, "depth": level + 1}
            elif kind_of(inner, payload) not in ("", "opaque") and not inner.lower().endswith(OFFICE):
                yield from members(inner, payload, budget, level + 1, at)
            else:
                yield {"path": at, "declared": inner, "size": len(payload), "status": "opaque" if kind_of(inner, payload) == "opaque" else "ok", "depth": level + 1, "data": payload}
            if budget.stop:
                return
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError, RuntimeError, NotImplementedError, ValueError) as e:
        yield {"path": path or "0", "declared": name, "size": len(data), "status": f"corrupt: {type(e).__name__}", "depth": level}


OFFICE = (".docx", ".docm", ".xlsx", ".xlsm", ".pptx", ".pptm", ".odt", ".ods", ".odp")
#: (ending, members, tags that end a line). Fixed values.
_OFFICE_TEXT = (((".docx", ".docm"), r"word/document\.xml", "w:p|w:br|w:tr"), ((".pptx", ".pptm"), r"ppt/slides/slide\d+\.xml", "a:p|a:br"), ((".odt", ".ods", ".odp"), r"content\.xml", "text:p|text:h|table:table-row"), ((".xlsx", ".xlsm"), r"xl/sharedStrings\.xml", "si"))


def office_text(name: str, data: bytes) -> str:
    """Text of an office file under the archive budget; macros are never looked at."""
    low = (name or "").lower()
    rule = next(((m, t) for ends, m, t in _OFFICE_TEXT if low.endswith(ends)), None)
    if rule is None:
        return ""
    wanted, tags = rule
    out = []
    for inner, payload, why in sorted(_entries(name, data, "zip", Budget(len(data)))):
        if not why and re.fullmatch(wanted, inner):
            text = re.sub(rf"</(?:{tags})>|<(?:{tags})\s*/>", "\n", decode(payload, "utf-8"))
            out.append(html.unescape(re.sub(r"<[^>]+>", "", text)))
    return "\n".join(out).strip()


@F.udtf(returnType="path string, declared string, size long, status string, depth int")
class ArchiveMembers:
    """Table function: the leaves of one archive, e.g. ``LATERAL archive_members(name, payload)``."""

    def eval(self, name: str, data: bytes):
        for m in members(name, data):
            yield m["path"], m["declared"], m["size"], m["status"], m["depth"]
