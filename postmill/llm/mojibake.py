"""Texts read with the wrong character encoding: finding them and restoring what can be restored.

Three kinds of damage are handled, in this order, until nothing changes:

1. UTF-8 bytes shown through a one-byte code page. Characters are mapped back to the page's bytes, a
   byte automaton finds the maximal well-formed multibyte spans, and only those spans are decoded.
   Text damaged twice is undone by running again.
2. One-byte text shown through another one-byte code page. No multibyte structure is left, so the
   method above cannot see it; the document's non-ASCII characters are mapped back through each pair
   of pages, and the pair that turns implausible placements (a symbol glued into a word, an upper
   case accent inside a lower case word) into plausible letters wins.
3. Replacement characters, question marks and C1 controls inside words: affected, not restorable.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages through which UTF-8 may have been shown, most frequent first. Fixed values.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "iso8859-15", "cp1254", "cp1253", "iso8859-2", "koi8-r", "cp866")

#: (written in, read as) pairs of one-byte pages. Fixed values.
PAIRS = tuple((a, b) for a in ("cp1252", "cp850", "cp437", "mac_roman", "cp1250") for b in ("cp1252", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "cp1253", "latin-1") if a != b and {a, b} != {"cp1252", "latin-1"})

#: Letters of the western languages in the archive, by how much their presence supports a reading.
#: Fixed values.
USUAL = {**dict.fromkeys("àèéìòù", 3.0), **dict.fromkeys("äöüß", 2.0), **dict.fromkeys("ÀÈÉÌÒÙ", 1.5), **dict.fromkeys("áâãçêëîïíñóôõúœ", 1.0), **dict.fromkeys("ÄÖÜÁÂÃÇÊÍÑÓÔÕÚ", 0.8)}
MARKS = {**dict.fromkeys("€«»–“”‘’„", 1.5), **dict.fromkeys("•…°ªº§£", 0.8), **dict.fromkeys("©®™±¼½¾¿¡¶—·\xa0", 0.3)}

_HIGH = re.compile(r"[^\x00-\x7f]+")
_LOST = re.compile(r"(?<![\w/?&=.])[A-Za-zÀ-ÿ']*[A-Za-zÀ-ÿ]\?[a-zà-ÿ][A-Za-zÀ-ÿ]*(?![\w=&/])")


@lru_cache(maxsize=64)
def to_bytes(page: str) -> dict[str, int]:
    """Character to byte of a code page; bytes that a page leaves undefined keep their own number."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    table.setdefault("\xa0", 0xA0)
    return table


def well_formed(data: list[int]) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of well-formed multibyte UTF-8 sequences in bytes; -1 stands for none."""
    out: list[tuple[int, int]] = []
    i, n = 0, len(data)
    while i < n:
        lead = data[i]
        low, high = 0x80, 0xBF
        if 0xC2 <= lead <= 0xDF:
            need = 1
        elif 0xE0 <= lead <= 0xEF:
            need = 2
            low = 0xA0 if lead == 0xE0 else 0x80
            high = 0x9F if lead == 0xED else 0xBF
        elif 0xF0 <= lead <= 0xF4:
            need = 3
            low = 0x90 if lead == 0xF0 else 0x80
            high = 0x8F if lead == 0xF4 else 0xBF
        else:
            i += 1
            continue
        k = i + 1
        while need and k < n and low <= data[k] <= high:
            low, high, need, k = 0x80, 0xBF, need - 1, k + 1
        if need:
            i += 1
            continue
        if out and out[-1][1] == i:
            out[-1] = (out[-1][0], k)
        else:
            out.append((i, k))
        i = k
    return out


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ")[0]


def _worth(ch: str) -> float:
    """How much a decoded character supports the reading that gave it; 0 rules it out."""
    if ch in USUAL or ch in MARKS:
        return 1.0
    o = ord(ch)
    if 0x370 <= o < 0x530 or 0x2500 <= o < 0x2580:
        return 0.9
    if 0xA0 <= o < 0x100 or ch in "‚ƒ†‡ˆ‰Š‹ŒŽ™š›œžŸ˜":  # what a text damaged twice shows on the way
        return 0.8
    if 0x80 <= o < 0xA0:
        return 0.6
    if 0x100 <= o < 0x180 or 0x2010 <= o < 0x2040 or 0x20A0 <= o < 0x2270:
        return 0.5
    return 0.0


#: Lower-cased lead characters and what they were. Fixed values.
_RAISED = tuple(str.maketrans(a, b) for a, b in (("ã", "Ã"), ("â", "Â"), ("ãâ", "ÃÂ"), ("ă", "Ă"), ("ãå", "ÃÅ"), ("абвгдежзийклмнопрстуфхцчшщъыьэюяёђѓєѕіїјљњћќўџґ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁЂЃЄЅІЇЈЉЊЋЌЎЏҐ")))
#: A lead byte shown as a letter whose second byte, a no-break space, was turned into a blank.
_BLANKED = re.compile(r"(?<=[a-z])(?:[ÃĂã]|Г|├)[ \xa0](?=[\s.,;:!?)»\"']|$)")


def _spans(text: str) -> str:
    """Step 1 once: in each run of non-ASCII characters the well-formed spans are decoded in the
    code page that accounts for most of it."""

    def decode(m: re.Match) -> str:
        run = m.group()
        if len(run) < 2:
            return run
        best, gain = run, 0.0
        variants = [run] + [v for r in _RAISED if (v := run.translate(r)) != run]
        for variant in variants:
            for page in PAGES:
                table = to_bytes(page)
                data = [table.get(ch, -1) for ch in variant]
                out, at, won = [], 0, 0.0
                for a, b in well_formed(data):
                    got = bytes(data[a:b]).decode("utf-8")
                    worth = [_worth(c) for c in got]
                    if not all(worth) or (variant is not run and min(worth) < 0.8):
                        continue
                    out += (run[at:a], got)
                    at = b
                    won += (b - a) * sum(worth) / len(worth)
                if variant is not run:
                    won *= 0.75  # what stands there needs no raising
                if won > gain:
                    best, gain = "".join((*out, run[at:])), won
        return best

    return _BLANKED.sub("à", _HIGH.sub(decode, text))


def _place(prev: str, ch: str, nxt: str) -> float:
    """How plausible one non-ASCII character is between its neighbours."""
    o = ord(ch)
    if 0x80 <= o < 0xA0 or ch == "�":
        return -4.0
    inside = prev.isalpha() and prev.isascii() or nxt.isalpha() and nxt.isascii()
    kind = unicodedata.category(ch)
    if kind[0] == "L":
        script = _script(ch)
        if script in ("CYRILLIC", "GREEK"):
            alone = not (prev.isalpha() or nxt.isalpha())
            return -3.0 if inside else -0.5 if alone else 0.0
        if kind in ("Lo",):  # ª º
            return MARKS.get(ch, 0.0) if prev.isdigit() or prev in ".n" else -2.0
        if ch.isupper():
            if prev.isalpha() and prev.islower() or nxt.isalpha() and prev.isalpha() and nxt.islower():
                return -3.0
            if not prev.isalpha() and not nxt.isalpha():
                return 1.0 if ch in "ÈÀÉÒO" else -1.5
            return USUAL.get(ch, -0.7)
        if not prev.isalpha() and not nxt.isalpha():
            return USUAL[ch] if ch in "èàéòóáùì" else -1.5
        if ch in "ýþðøæåëûÿ" and not nxt.isalpha():
            return -1.5
        return USUAL.get(ch, -0.3)
    if ch in "–•€—" and prev.isalpha() and ch != "—":
        return -2.0
    if ch == "—" and prev.isalpha() and nxt == " ":
        return -1.0
    if ch == "…" and prev.isalpha():
        return 0.1
    if ch in "°º" and prev in "nN.":
        return 0.8
    if ch in "£§±°½¼¾³²¹¦¬¯´¨¸÷×¤¥¢∞░" and inside:
        return -3.0
    if ch in "«“‘„¿¡" and prev.isalpha() or ch in "»”" and nxt.isalpha() and prev == " ":
        return -1.5
    if ch in MARKS:
        return MARKS[ch]
    return -3.0 if inside else -0.6


def _score(text: str) -> float:
    n, total = len(text), 0.0
    for m in _HIGH.finditer(text):
        for i in range(m.start(), m.end()):
            total += _place(text[i - 1] if i else " ", text[i], text[i + 1] if i + 1 < n else " ")
    return total


@lru_cache(maxsize=128)
def _swap(pair: tuple[str, str]) -> dict[int, str]:
    """Characters as shown to the ones meant, for text written in pair[0] and read as pair[1]."""
    meant, table = pair[0], {}
    for ch, b in to_bytes(pair[1]).items():
        try:
            table[ord(ch)] = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            pass
    return table


def _bad(text: str) -> int:
    """Number of characters that are implausible where they stand."""
    n = len(text)
    return sum(
        _place(text[i - 1] if i else " ", text[i], text[i + 1] if i + 1 < n else " ") <= -1.0
        for m in _HIGH.finditer(text)
        for i in range(m.start(), m.end())
        if text[i] != "\ufffd"
    )


def _exchange(line: str, table: dict[int, str]) -> str:
    """The line read through another pair of pages; a character that stands better as it is stays."""
    other = line.translate(table)
    out, n = list(line), len(line)
    for m in _HIGH.finditer(line):
        for i in range(m.start(), m.end()):
            prev, nxt = other[i - 1] if i else " ", other[i + 1] if i + 1 < n else " "
            best = _place(line[i - 1] if i else " ", line[i], line[i + 1] if i + 1 < n else " ")
            raised = line[i].upper()
            for new in (other[i], raised.translate(table).lower() if len(raised) == 1 and raised != line[i] else line[i]):
                if new != line[i] and len(new) == 1 and (p := _place(prev, new, nxt)) > best:
                    out[i], best = new, p
    return "".join(out)


def _one_byte(text: str) -> str:
    """Step 2: implausible lines read through the pair of pages that makes their characters plausible."""
    lines = text.split("\n")
    bad = {k: n for k, line in enumerate(lines) if not line.isascii() and (n := _bad(line))}
    if not bad:
        return text
    high = [k for k, line in enumerate(lines) if not line.isascii()]
    base = {k: _score(lines[k]) for k in high}
    best, gain = text, 2.0
    for pair in PAIRS:
        table = _swap(pair)
        new, won = list(lines), 0.0
        for k in bad:
            other = _exchange(lines[k], table)
            if other != lines[k] and 3 * _bad(other) <= bad[k] and (better := _score(other) - base[k]) > 1.5:
                new[k] = other
                won += better
        if won > gain:
            best, gain, used = "\n".join(new), won, table
    if best is not text:  # the other lines of the damaged text, where that reads no worse
        new = best.split("\n")
        for k in high:
            if k not in bad:
                other = _exchange(lines[k], used)
                if not _bad(other) and _score(other) > base[k] + 1.0:
                    new[k] = other
        best = "\n".join(new)
    return best


def restore(text: str | None) -> tuple[str | None, bool]:
    """(restored text, affected). A text that is only partly restorable comes back as far as it goes."""
    if not text:
        return text, False
    if text.isascii():
        return text, bool(_LOST.search(text))
    now = text
    for _ in range(4):
        new = _spans(now)
        if new == now:
            break
        now = new
    now = _one_byte(now)
    affected = now != text or "�" in text or bool(re.search(r"[\x80-\x84\x86-\x9f]", text)) or bool(_LOST.search(text))
    return now, affected


def repair(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored) of the affected rows only.

    Rows of ASCII text without a question mark inside a word never leave the JVM. Null, empty and
    unaffected texts have no row; repeated rows stay repeated. Very long texts are read whole.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            got = [restore(t) for t in b["_text"]]
            out = b[[key]].assign(restored=[g[0] for g in got])
            yield out[[g[1] for g in got]]

    suspect = F.col("_text").rlike(r"[^\x00-\x7F]|[A-Za-z]\?[a-z]")
    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).where(suspect).mapInPandas(run, f"`{key}` {kind}, restored string")
