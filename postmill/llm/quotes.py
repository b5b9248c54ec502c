"""Reducing an e-mail body to the text that its sender newly wrote.

Three steps:

1. Structure: quote marks, lines that introduce earlier mail, forwarded headers and all that hangs on
   them. What is left are passages of lines that the sender may have written.
2. Suffix automata. Messages that share a fingerprint of such passages form a thread; the earliest
   holders are its sources, and a generalised suffix automaton over them marks long matches of letters
   and digits wherever the lines break. A thread is either a conversation (most holders of the
   fingerprint share their subject without reply marks; matches anywhere are inherited text) or a
   recurring ending (most holders have it below their closing formula; matches are notes and
   disclaimers, and count at the end of a passage).
3. Endings: lines that recur at the end of the sender's or of many senders' messages, what the automata
   marked, and lines made like a signature are stripped from the end of each passage.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.arrow import fan_out
from postmill.session import in_tasks, stored

# Words of the archive's languages around quoted mail.
_REPLY = r"^(?:(?:r|re|i|fw|fwd|aw|wg|tr|rif|posta certificata|anomalia messaggio)\s*:\s*)+"
_MONTH = r"(?:gen|feb|mar|apr|mag|giu|lug|ago|set|ott|nov|dic|jan|may|jun|jul|aug|sep|oct|okt|dez|dec|mär|mai|janv|févr|avr|juin|juil|août|déc)\w*"
_DATE = rf"(?:\d{{1,4}}[./-]\d{{1,2}}[./-]\d{{1,4}}|\d{{1,2}}\.?\s+(?:{_MONTH})\s+\d{{2,4}}|(?:{_MONTH})\s+\d{{1,2}},?\s+\d{{2,4}})"
_SAID = r"(?:ha\s+scritto|scriveva|scrive|wrote|writes|schrieb|a\s+écrit|escribió|escreveu)"
_INTRO = re.compile(rf"^(?:(?:il(?:\s+giorno)?|in\s+data|on|am|le|el|em)\s+(?:\w+[,.]?\s+)?{_DATE}.*\b{_SAID}\b[^:]{{0,90}}:?|citando\s+.+[)>]\s*:|{_DATE}.*\b{_SAID}\b.{{0,90}}:)\s*$", re.I)
_OPENS = re.compile(rf"^(?:il(?:\s+giorno)?|in\s+data|on|am|le|el|em)\s+(?:\w+[,.]?\s+)?{_DATE}|^citando\s+\S", re.I)
_CUT = re.compile(
    r"^[-_=*\s]{2,}\s*(?:messaggio\s+(?:originale|inoltrato)|original\s+message|forwarded\s+message|begin\s+forwarded\s+message|ursprüngliche\s+nachricht|weitergeleitete\s+nachricht"
    r"|message\s+(?:d'origine|d’origine|transféré|original)|mensagem\s+original|mensaje\s+original)\s*[-_=*\s]*$",
    re.I,
)
_FROM = re.compile(r"^\*?(?:da|from|von|de|mittente)\s*:\*?\s*\S", re.I)
_HEAD = re.compile(r"^\*?(?:inviato|data|sent|date|gesendet|datum|envoyé|enviado|a|to|an|à|para|cc|oggetto|subject|betreff|objet|assunto|destinatari)\s*:\*?", re.I)
_CLOSE = re.compile(
    r"^(?:(?:(?:cordiali|distinti|cari|i\s+migliori|migliori|i\s+più\s+cordiali|affettuosi|tanti)\s+)?saluti|cordialità|cordialmente|grazie(?:\s+(?:mille|e\s+buon\s+lavoro|e\s+cordiali\s+saluti|e\s+saluti|in\s+anticipo))?|buon\s+lavoro|a\s+presto"
    r"|(?:in\s+attesa|restando|rimanendo|ringraziando|nell'attesa).{0,60}saluti|(?:porgo|porgiamo|si\s+porgono).{0,30}saluti|con\s+osservanza|(?:mit\s+)?(?:freundliche[nr]?|beste[nr]?|viele|herzliche)\s+grüße[n]?|hochachtungsvoll"
    r"|(?:kind|best|warm)?\s*regards|best(?:\s+wishes)?|(?:many\s+)?thanks(?:\s+and\s+regards)?|yours\s+(?:sincerely|faithfully)|sincerely|cordialement|bien\s+(?:à\s+vous|cordialement)|salutations.{0,30}|atenciosamente|cumprimentos|(?:un\s+)?saludos?)\s*[,.!]*\s*$",
    re.I,
)
_RULE = re.compile(r"^\s*(?:--\s*|[-_=*~#·•]{3,}|(?:[-_=*] ){3,}[-_=*]?)\s*$")
_CONTACT = re.compile(
    r"^\W*(?:(?:tel|fax|cell|cel|mob|mobile|phone|t|m|f|tel/fax|tel\.\s*e\s*fax)\s*[.:/]*\s*(?:fax\s*[.:]?\s*)?[+(\d][\d\s()./+-]{5,}|[☎✆☏📞]\s*[+(\d]|(?:pec|mail|e-?mail|posta|web|sito)\s*:?\s*\S*(?:@|\[at\]|\(at\)|www|\s(?:\[at\]|\(at\)|chiocciola)\s)"
    r"|(?:https?://|www\.)\S+\s*$|p\.?\s?iva\b|c\.?f\.?\s*(?:e\s*p\.?\s?iva)?[\s:]+\w{8,}\s*$|part\w*\s+iva|vat\b|[\w.+-]+(?:@|\s?[\[(]at[\])]\s?|\schiocciola\s)[\w.-]+(?:\spunto\s[\w.-]+)*\s*$|[+(]?\d[\d\s()./+-]{7,}$)",
    re.I,
)
_STREET = re.compile(r"^(?:via|viale|v\.le|piazza|p\.zza|piazzale|p\.le|corso|c\.so|vicolo|v\.lo|largo|l\.go|strada|contrada|c\.da|salita|borgo|loc\.|località|fraz\.|rione|lungo\w*|rue|\w+(?:straße|strasse|str\.|weg|gasse|platz|allee))(?!\w).*\d", re.I)
_STREET2 = re.compile(r"^[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm)\s+\d", re.I)
_ORG = re.compile(r"\b(?:s\.\s?r\.\s?l|s\.\s?p\.\s?a|s\.\s?n\.\s?c|s\.\s?a\.\s?s|studio|impresa|farmacia|immobiliare|officine|cooperativa|consorzio|caseificio|laboratorio|autotrasporti|azienda|comune\s+di|tribunale|istituto|camera\s+arbitrale|unione\s+dei\s+comuni)\b", re.I)
_TITLE = re.compile(r"^(?:avv|dott|dr|dr\.ssa|dott\.ssa|ing|arch|geom|rag|sig|sig\.ra|prof|prof\.ssa|notaio)\b\.?(?:ssa|ra)?\.?\s+", re.I)
_NAME = re.compile(r"^(?:[A-ZÀ-Þ][\w'’.-]*\s*,?\s*){1,4}$")
_ROLE = re.compile(r"^(?:area|ufficio|uff\.|settore|servizio|segretari\w+|segreteria|responsabile|legale\s+rappresentante|praticante|consulente|direttor\w+|direttrice|amministrator\w+|amministrazione|collaborator\w+|assistente|titolare|presidente|funzionari\w+|impiegat\w+|tirocinante|addett\w+|protocollo|commercialista|revisore|procuratore)\b(?!.*[.!?]$).{0,50}$", re.I)
_MARK = re.compile(r"^\s{0,3}(?:[>|»]\s?)+")
_SENTENCE = re.compile(r"[.!?:;,]\s*$")


def reply_key(subject):
    """The subject without reply and forward marks, as a Column; null where nothing is left."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(subject)), _REPLY, ""))
    return F.when(bare != "", bare)


class SuffixAutomaton:
    """Generalised suffix automaton over several strings; states are kept in flat lists."""

    def __init__(self, texts: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        for text in texts:
            last = 0
            for ch in text:
                last = self._extend(last, ch)

    def _extend(self, last: int, ch: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (q := nxt[last].get(ch)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, ch, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, ch, q)
        return cur

    def _clone(self, p: int, ch: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p >= 0 and nxt[p].get(ch) == q:
            nxt[p][ch] = c
            p = link[p]
        return c

    def matches(self, text: str, least: int) -> list[tuple[int, int]]:
        """Maximal [start, end) of text that occur in one of the strings and have ``least`` characters."""
        nxt, link, length = self.next, self.link, self.len
        state = n = 0
        out: list[tuple[int, int]] = []
        for i, ch in enumerate(text):
            while state and ch not in nxt[state]:
                state = link[state]
                n = length[state]
            if ch in nxt[state]:
                state, n = nxt[state][ch], n + 1
            if n >= least:
                if out and i + 1 - n <= out[-1][1]:
                    out[-1] = (min(out[-1][0], i + 1 - n), i + 1)
                else:
                    out.append((i + 1 - n, i + 1))
        return out


_LETTERS = re.compile(r"[^\W_]+")


def letters(body: str) -> tuple[str, np.ndarray]:
    """Letters and digits of the body, lower case, and the line (from 0) of each of them."""
    text, lines = [], []
    for k, line in enumerate(body.split("\n")):
        bare = "".join(_LETTERS.findall(line)).lower()
        text.append(bare)
        lines.append(np.full(len(bare), k, np.int32))
    return "".join(text), np.concatenate(lines) if lines else np.zeros(0, np.int32)


def fingerprint_places(text: str, k: int = 48, window: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of the text's k-grams and where they start: every shared run of k + window - 1 characters shares one."""
    data = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(data) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base, h, power = np.uint64(1099511628211), np.zeros(n, np.uint64), data.copy()
    with np.errstate(over="ignore"):
        # doubling: hashes of runs of length 1, 2, 4, ... combined to length k
        size, at, mult = 1, 0, base
        todo = k
        while todo:
            if todo & 1:
                h = h * mult + power[at : at + n]
                at += size
            todo >>= 1
            if todo:
                m = len(power) - size
                power = power[:m] * mult + power[size : size + m]
                size, mult = size * 2, mult * mult
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    if n <= window:
        places = np.array([int(h.argmin())])
    else:
        places = np.unique(np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1) + np.arange(n - window + 1))
    return h[places].view(np.int64), places


def fingerprints(text: str, k: int = 48, window: int = 32) -> list[int]:
    """The distinct hashes of ``fingerprint_places``."""
    return np.unique(fingerprint_places(text, k, window)[0]).tolist()


def _like_ending(line: str, names: frozenset[str]) -> bool:
    s = line.strip()
    if not s or _RULE.match(s) or _CONTACT.match(s) or _ROLE.match(s):
        return True
    if (_STREET.match(s) or _STREET2.match(s)) and not _SENTENCE.search(s):
        return True
    if " | " in s and (parts := [x.strip() for x in s.split(" | ")]) and sum(_like_ending(x, names) for x in parts) * 2 >= len(parts):
        return True
    if len(s) > 90 or s[-1] in "!?:;,":
        return False
    bare = _TITLE.sub("", s)
    words = re.findall(r"[^\W\d_]+", bare.lower())
    if words and len(words) <= 4 and names.issuperset(w for w in words if len(w) > 1) and any(len(w) > 1 for w in words):
        return True
    if _ORG.search(s) and s[0].isupper() and len(words) <= 9 and (s[-1] != "." or re.search(r"\.\s?[alc]\.?s?\.$", s, re.I)):
        return True
    return bool(_NAME.match(bare)) and len(words) <= 4 and s[-1] != "." and not any(ch.isdigit() for ch in s) and not _CLOSE.match(s)


def structure(body: str) -> tuple[list[str], list[bool]]:
    """The body's lines, and which of them no quote mark, introduction or forwarded header takes from the sender."""
    lines = body.split("\n")
    n = len(lines)
    own = [True] * n
    marked = [bool(_MARK.match(line)) for line in lines]
    k = 0
    while k < n:
        s = lines[k].strip()
        if marked[k]:
            alone = not (k and marked[k - 1]) and not (k + 1 < n and marked[k + 1])
            before = next((j for j in range(k - 1, -1, -1) if lines[j].strip()), -1)
            own[k] = alone and (before < 0 or own[before]) and _trap(lines[k])
            k += 1
            continue
        if not s:
            k += 1
            continue
        if _CUT.match(s) or (_FROM.match(s) and any(_HEAD.match(lines[j].strip()) for j in range(k + 1, min(n, k + 3)))):
            own[k:] = [False] * (n - k)
            break
        size = 0
        if _INTRO.match(s):
            size = 1
        elif _OPENS.match(s):
            joined = s
            for more in (1, 2):
                if k + more < n and lines[k + more].strip() and not marked[k + more]:
                    joined += " " + lines[k + more].strip()
                    if _INTRO.match(joined):
                        size = more + 1
                        break
                else:
                    break
        if size:
            follow = next((j for j in range(k + size, n) if lines[j].strip()), n)
            if follow == n or marked[follow]:
                own[k : k + size] = [False] * size
                k += size
                continue
            own[k:] = [False] * (n - k)
            break
        k += 1
    return lines, own


def _passages(own: Iterable[bool]) -> list[tuple[int, int]]:
    """[start, end) of each run of own lines."""
    out: list[tuple[int, int]] = []
    for k, mine in enumerate(own):
        if mine and out and out[-1][1] == k:
            out[-1] = (out[-1][0], k + 1)
        elif mine:
            out.append((k, k + 1))
    return out


def _closing(line: str) -> bool:
    s = line.strip()
    return len(s) <= 70 and bool(_CLOSE.match(s))


def zones(lines: list[str], a: int, b: int) -> list[int]:
    """For each line of a passage: 2 below its closing formula, or else its first separator, and 0 above
    it; if it has neither, 1 in its last paragraph and -1 above that."""
    end = next((k for k in range(b - 1, a - 1, -1) if lines[k].strip() and not _RULE.match(lines[k])), a)
    last = max((k for k in range(a, b) if _closing(lines[k])), default=-1)
    if last < 0:
        last = next((k for k in range(a, end) if _RULE.match(lines[k])), -1)
    if last >= 0:
        return [2 if k > last else 0 for k in range(a, b)]
    last = next((k for k in range(end, a - 1, -1) if not lines[k].strip()), a - 1)
    return [1 if k > last else -1 for k in range(a, b)]


def new_lines(body: str | None, sender: str | None = None, endings: frozenset[int] = frozenset(), inherited: frozenset[int] = frozenset(), noted: frozenset[int] = frozenset()) -> list[int]:
    """Numbers (from 1) of the lines, not blank, that the sender newly wrote.

    ``sender`` is the display name and address; ``endings`` are hashed forms of lines (see ``form``) that
    recur at the end of messages; ``inherited`` and ``noted`` are line indexes (from 0) marked by the
    automata: inherited text, and recurring notes, which count at the end of a passage only.
    """
    if not body or not body.strip():
        return []
    lines, own = structure(body)
    return _finish(lines, own, sender, endings, inherited, noted)


def _finish(lines: list[str], own: list[bool], sender: str | None, endings: frozenset[int], inherited: frozenset[int], noted: frozenset[int]) -> list[int]:
    n = len(lines)
    for j in inherited:
        if 0 <= j < n:
            own[j] = False
    names = frozenset(w for w in re.findall(r"[^\W\d_]+", (sender or "").lower()) if len(w) > 1)
    for a, b in _passages(own):
        _strip_ending(lines, own, a, b, names, [k in noted or (bool(endings) and form(lines[k]) in endings) for k in range(a, b)])
    return [k + 1 for k in range(n) if own[k] and lines[k].strip()]


def _trap(line: str) -> bool:
    """A lone line that starts with a sign but is no quotation: a comparison or a rule of a table."""
    return bool(re.match(r"^\s*>\s?\d+\s[^\W\d_]", line))


def _strip_ending(lines: list[str], own: list[bool], a: int, b: int, names: frozenset[str], recurs: list[bool]) -> None:
    """Take the ending of the passage [a, b) from its sender; ``recurs`` says which lines are known to recur at ends."""
    ends = lambda k: recurs[k - a] or _like_ending(lines[k], names)
    closes = [k for k in range(a, b) if _closing(lines[k])]
    start = b
    # upward: while lines are blank, made like an ending, or recur at ends
    while start > a and (not lines[start - 1].strip() or ends(start - 1)):
        start -= 1
    # a separator right below a closing formula opens the signature
    for c in closes[-1:]:
        below = next((k for k in range(c + 1, b) if lines[k].strip()), b)
        if below < b and _RULE.match(lines[below]):
            start = min(start, below)
    # a signature separator with little below it, half of it like an ending, opens the ending
    for k in range(max(a, start - 12), start):
        if _RULE.match(lines[k]):
            below = [j for j in range(k + 1, start) if lines[j].strip()]
            if below and len(below) <= 9 and 2 * sum(ends(j) for j in below) >= len(below) and all(len(lines[j]) <= 110 for j in below):
                start = k
                break
    # a greeting alone above the ending, or text of one line made like a name, is no ending
    stop = start
    if closes and all(k >= start or ends(k) for k in range(closes[-1] + 1, b) if lines[k].strip()):
        stop = min(stop, closes[-1] + 1)
    for k in range(stop, b):
        if lines[k].strip() and not (_closing(lines[k]) and k < start):
            own[k] = False
    # what has no closing formula: the first line of a passage stays if it is a greeting
    first = next((k for k in range(a, b) if lines[k].strip()), b)
    if first < b and not own[first] and re.match(r"^(?:ciao|salve|buon\w+|gentil\w+|spett|egregi\w+|dear|hello|guten|sehr|bonjour|madame|per\s+conoscenza|alla\s+cortese)", lines[first].strip(), re.I):
        own[first] = True


def form(line: str) -> int:
    """A line as it is compared between messages, hashed: spaces closed up, digits as 0, lower case."""
    bare = re.sub(r"\d", "0", " ".join(line.split())).lower()
    return int.from_bytes(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


K, WINDOW = 24, 25  # every shared run of 48 letters is met; shorter lines are compared by their forms


def reduced(df: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row for each body: its own lines by structure with their zones and forms, and their fingerprints.

    ``df`` has key, subject, sender, body. Columns: key, sender, who (address), thread (hash of the
    subject without reply marks), n (all lines), at_line, own, zone and forms (of each own line, blank
    ones too), fp and fp_zone.
    """

    def make(body: str) -> list[tuple]:
        lines, mine = structure(body)
        at, zone = [], []
        for a, b in _passages(mine):
            at += range(a, b)
            zone += zones(lines, a, b)
        kept = [lines[i] for i in at]
        text, where = letters("\n".join(kept)) if kept else ("", np.zeros(0, np.int32))
        fps, places = fingerprint_places(text, k, window)
        fps, first = np.unique(fps, return_index=True)
        of = np.asarray(zone, np.int32)[where[places[first]]] if len(fps) else np.zeros(0, np.int32)
        size = np.bincount(where, minlength=len(kept))
        # a longer line is for the automata
        forms = [form(x) if x.strip() and not _closing(x) and size[i] < k + window - 1 else None for i, x in enumerate(kept)]
        return [(len(lines), at, kept, zone, forms, fps.tolist(), of.tolist())]

    who = F.regexp_extract(F.lower(F.col("sender")), r"(\S+@\S+)\s*$", 1)
    heads = df.select("key", "sender", F.when(who != "", who).alias("who"), F.xxhash64(reply_key(F.col("subject"))).alias("h"), reply_key(F.col("subject")).isNotNull().alias("replied"), "body")
    heads = heads.withColumn("thread", F.when(F.col("replied"), F.col("h"))).drop("h", "replied")
    outputs = {"n": "int", "at_line": "array<int>", "own": "array<string>", "zone": "array<int>", "forms": "array<long>", "fp": "array<long>", "fp_zone": "array<int>"}
    return fan_out(heads, ["body"], ["key", "sender", "who", "thread"], outputs, make)


_ENDS = 0.8  # share of a line's or run's messages that must have it below their closing formula


def recurring_endings(texts: DataFrame, salts: int = 16) -> DataFrame:
    """(key, endings): forms of a message's lines, too short for a fingerprint, that recur at the end of messages.

    For the sender: in two of its messages or more, mostly at the end. For all mail: in three or more
    messages of two or more senders, mostly below the closing formula.
    """
    lines = texts.select("key", "who", F.explode(F.arrays_zip("forms", "zone")).alias("x")).select("key", "who", F.col("x.forms").alias("form"), F.col("x.zone").alias("zone")).where(F.col("form").isNotNull())
    lines = lines.groupBy("key", "who", "form").agg(F.max("zone").alias("zone"))
    low, high = F.count_if(F.col("zone") == 0), F.count_if(F.col("zone") == 2)
    by = lines.groupBy("who", "form").agg(low.alias("low"), high.alias("high"), F.count_if(F.col("zone") > 0).alias("ended"), F.count(F.lit(1)).alias("n"))
    ended = F.col("ended")
    sender = by.where(F.col("who").isNotNull() & (ended >= 2) & (ended >= _ENDS * F.col("n"))).select("who", "form")
    everyone = by.groupBy("form").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.count(F.lit(1)).alias("senders"))
    everyone = everyone.where((F.col("high") >= 3) & (F.col("senders") >= 2) & (F.col("high") >= _ENDS * (F.col("low") + F.col("high")))).select("form")
    # a sender with a third of all mail, or a note in a third of it: the salt spreads them over the tasks
    salted = lines.where(F.col("zone") != 0).select("key", "who", "form").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    met = salted.join(sender.select("who", "form", spread), ["who", "form", "salt"]).select("key", "form")
    met = met.union(salted.join(everyone.select("form", spread), ["form", "salt"]).select("key", "form"))
    return met.groupBy("key").agg(F.collect_set("form").alias("endings"))


def meetings(texts: DataFrame, times: DataFrame, salts: int = 8) -> DataFrame:
    """(kind, part, source, key): which messages meet which sources in one automaton.

    ``times`` has key and at. A fingerprint belongs to the conversation that holds more than half of its
    messages, or is an ending where most holders have it below their closing formula. The earliest holder
    is the source; the last one is the source of the earliest where it is an ending. A conversation with
    many sources is cut into parts of about 16.
    """
    hits = texts.select("key", "thread", F.explode(F.arrays_zip("fp", "fp_zone")).alias("x")).select("key", "thread", F.col("x.fp").alias("fp"), F.col("x.fp_zone").alias("zone"))
    by = hits.groupBy("fp", "thread").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("zone") == 0).alias("low"), F.count_if(F.col("zone") == 2).alias("high"))
    most = F.max_by(F.when(F.col("thread").isNotNull(), F.struct("thread", "n")), F.when(F.col("thread").isNotNull(), F.col("n"))).alias("most")
    all_of = by.groupBy("fp").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), most)
    ending = (F.col("high") >= 2) & (F.col("high") >= _ENDS * (F.col("low") + F.col("high")))
    talk = ~ending & (F.col("most.n") >= 2) & (2 * F.col("most.n") > F.col("n"))
    kinds = all_of.where((F.col("n") > 1) & (ending | talk)).select("fp", F.when(ending, "note").otherwise("talk").alias("kind"), F.when(talk, F.col("most.thread")).alias("of"))
    # a note in a third of all mail is one fingerprint: the salt spreads it over the tasks
    kinds = kinds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = hits.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(kinds, ["fp", "salt"])
    held = held.where(F.when(F.col("kind") == "note", F.col("zone") != 0).otherwise(F.col("thread") == F.col("of")))
    held = held.select("kind", "of", "fp", "zone", "key").join(times, "key", "left").withColumn("when", F.struct(F.coalesce("at", F.lit("")).alias("at"), "key"))
    held = stored(held.select("kind", "of", "fp", "zone", "key", "when"))
    sound = F.when((F.col("kind") == "talk") | (F.col("zone") == 2), F.col("when"))
    ends = held.groupBy("fp").agg(F.min(sound).alias("first"), F.max(sound).alias("last"))
    ends = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = held.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(ends, ["fp", "salt"])
    later = F.col("when.at") > F.col("first.at")
    source = F.when(F.col("kind") == "talk", F.when(later, F.col("first.key"))).otherwise(F.when(F.col("first.key") != F.col("key"), F.col("first.key")).otherwise(F.col("last.key")))
    pairs = both.select("kind", "of", source.alias("source"), "key").where(F.col("source").isNotNull() & (F.col("source") != F.col("key"))).distinct()
    notes = pairs.where(F.col("kind") == "note").select("kind", F.xxhash64("source").alias("part"), "source", "key")
    talks = pairs.where(F.col("kind") == "talk")
    sizes = talks.groupBy("of").agg(F.ceil(F.approx_count_distinct("source") / 16).alias("parts"))
    talks = _salted(talks, sizes, ["of"], salts).select("kind", F.xxhash64("of", F.pmod(F.xxhash64("source"), "parts")).alias("part"), "source", "key")
    return notes.union(talks)


def _salted(many: DataFrame, few: DataFrame, on: list[str], salts: int) -> DataFrame:
    """Inner join of rows that have a key with one row for each value of ``on``: a value of a third of all rows is spread over the tasks."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(spread, [*on, "_salt"]).drop("_salt")


def marked_lines(texts: DataFrame, met: DataFrame, least: int = 60, least_note: int = 40, members: int = 256, salts: int = 8) -> DataFrame:
    """(key, inherited, noted): line indexes (from 0) that the automata mark.

    One generalised suffix automaton for each part of a thread, over its sources; about ``members``
    messages are matched beside it at once, so that a part held by a third of all mail is many groups. ``least`` and ``least_note`` are the letters from which a match counts.
    """
    met = stored(met)
    sources = met.select("kind", "part", F.col("source").alias("key")).distinct()
    readers = met.select("kind", "part", "key").distinct()
    sizes = readers.groupBy("kind", "part").agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("groups"))
    readers = _salted(readers, sizes, ["kind", "part"], salts).select("kind", "part", "groups", "key", F.pmod(F.xxhash64("key"), F.col("groups")).cast("int").alias("salt"), F.lit(False).alias("source"))
    sources = sources.join(sizes, ["kind", "part"]).select("kind", "part", "groups", "key", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(True).alias("source"))
    # parts that few messages meet share a cell, as many cells as there are rows for: a group of its own for each would cost more than its matches
    cells = max(1, met.count() // (4 * members))
    cell = F.when(F.col("groups") == 1, F.pmod("part", F.lit(cells))).otherwise(F.xxhash64("part", "salt"))
    full = sources.union(readers).withColumn("cell", cell).join(texts.select("key", "at_line", "own", "zone"), "key")

    def match(note: bool, rows: list[tuple]) -> Iterator[tuple]:
        strings, todo = [], []
        for key, source, at, own, zone in rows:
            # a source of notes gives what is below its closing formula, a reader what may be an ending
            use = [i for i in range(len(own)) if not note or (zone[i] == 2 if source else zone[i] != 0)]
            text, where = letters("\n".join(own[i] for i in use))
            if source:
                strings.append(text)
            else:
                todo.append((key, text, where, [int(at[i]) for i in use]))
        automaton = SuffixAutomaton(strings)
        for key, text, where, at in todo:
            full = np.bincount(where, minlength=1)
            for s, e in automaton.matches(text, least_note if note else least):
                ids, counts = np.unique(where[s:e], return_counts=True)
                yield from ((key, note, at[i]) for i, c in zip(ids.tolist(), counts.tolist(), strict=True) if c >= 0.8 * full[i])

    def run(group):
        import pandas as pd

        parts: dict[tuple, list[tuple]] = {}
        for kind, part, salt, *row in zip(*(group[c] for c in ("kind", "part", "salt", "key", "source", "at_line", "own", "zone")), strict=True):
            parts.setdefault((kind, part, salt), []).append(tuple(row))
        return pd.DataFrame([x for (kind, _, _), rows in parts.items() for x in match(kind == "note", rows)], columns=["key", "note", "line"])

    kind = texts.schema["key"].dataType.simpleString()
    lines = in_tasks(full, "cell").groupBy("cell").applyInPandas(run, f"key {kind}, note boolean, line int")
    return lines.groupBy("key").agg(F.collect_set(F.when(~F.col("note"), F.col("line"))).alias("inherited"), F.collect_set(F.when(F.col("note"), F.col("line"))).alias("noted"))


def _judged(df: DataFrame, key: str, dates: DataFrame | None, automata: bool, recurrence: bool) -> DataFrame:
    """One row for each body: what structure leaves to the sender, and what the automata and recurrence say of it."""
    named = df.select(F.col(key).alias("key"), *[F.col(c).cast("string").alias(c) for c in ("subject", "sender", "body")])
    texts = stored(reduced(named.where(F.length("body") > 0)))
    times = (df if dates is None else dates).select(F.col(key).alias("key"), F.col("at").cast("string").alias("at"))
    full = in_tasks(texts.select("key", "sender", "n", "at_line", "own"), "key")
    if recurrence:
        full = full.join(recurring_endings(texts), "key", "left")
    if automata:
        full = full.join(marked_lines(texts, meetings(texts, times)), "key", "left")
    for c, kind in (("endings", "array<bigint>"), ("inherited", "array<int>"), ("noted", "array<int>")):
        full = full if c in full.columns else full.withColumn(c, F.lit(None).cast(kind))
    return full


_PARTS = ["n", "at_line", "own", "sender", "endings", "inherited", "noted"]


def _own_of(n: int, at: list[int], kept: list[str], sender: str | None, endings: list[int] | None, inherited: list[int] | None, noted: list[int] | None) -> list[int]:
    lines, own = [""] * n, [False] * n
    for i, line in zip(at, kept, strict=True):
        lines[i], own[i] = line, True
    return _finish(lines, own, sender, frozenset(endings or ()), frozenset(inherited or ()), frozenset(noted or ()))


def own_lines(df: DataFrame, key: str = "rowid_fts", dates: DataFrame | None = None, automata: bool = True, recurrence: bool = True) -> DataFrame:
    """(key, line_no) of each line, not blank, that the message's sender newly wrote.

    ``df`` has the key (unique), subject, sender and body; ``dates`` has the key and ``at``, or ``df``
    has ``at`` itself. Bodies are read once; what is kept of them are the lines that structure leaves to
    the sender. Null and blank bodies have no line; null subjects, senders and dates only lose what these
    would tell. ``automata`` and ``recurrence`` switch the steps off, to measure what they do.
    """
    full = _judged(df, key, dates, automata, recurrence)
    lines = fan_out(full, _PARTS, ["key"], {"line_no": "int"}, lambda *parts: [(k,) for k in _own_of(*parts)])
    return lines.select(F.col("key").alias(key), "line_no")


def new_text(df: DataFrame, key: str = "rowid_fts", dates: DataFrame | None = None) -> DataFrame:
    """(key, text) of every row: the lines its sender newly wrote, empty where there are none, null for a null body."""

    def run(*parts) -> list[tuple[str]]:
        at = dict(zip(parts[1], parts[2], strict=True))
        return [("\n".join(at[k - 1] for k in _own_of(*parts)),)]

    texts = fan_out(_judged(df, key, dates, True, True), _PARTS, ["key"], {"text": "string"}, run)
    every = df.select(F.col(key).alias("key"), F.when(F.col("body").isNotNull(), "").alias("_empty"))
    return every.join(texts, "key", "left").select(F.col("key").alias(key), F.coalesce("text", "_empty").alias("text"))
