"""Noise in text from scanned pages: page furniture, cut words and misread characters.

Lines: a boosted classifier over a line and its neighbours finds page numbers and running heads, a
second one over a line and the next line of running text finds cut words. Words: those of scanned
texts that no clean text holds, and all that have signs no word has, are compared with words that clean
texts hold; candidates come from an inverted join on character q-grams, and boosted ranking over the pair
chooses a replacement or none. What the signs must have been (``plain_form``) is a feature of the pair and
a second spelling to look for; it is taken as it is only where no clean word is chosen, as with names.
All three classifiers are trained on pages built from a small table of sentences (``training_page``).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import pii_labels
from postmill.llm.arrow import fan_out
from postmill.llm.boost import Boost
from postmill.llm.names import lcs_ratio
from postmill.session import checkpoint, in_tasks, stored

HYPHENS = "-‐‑­¬"
# Ways of writing a page number, and what a scanner makes of letters (page, scan).
_PAGE = (
    re.compile(r"^pag(?:ina|\.)?\s*(\d+)$", re.I), re.compile(r"^pag(?:ina|\.)?\s*(\d+)\s*(?:di|/)\s*\d+$", re.I), re.compile(r"^[-–—]\s*(\d+)\s*[-–—]$"), re.compile(r"^\[(\d+)\]$"),
    re.compile(r"^(\d{1,4})$"), re.compile(r"^(\d{1,3})/\d{1,3}$"), re.compile(r"^([IVXLC]{1,6})$"), re.compile(r"^(?:page|seite|p\.|s\.)\s*(\d+)$", re.I),
)
CONFUSIONS = (
    ("o", "0"), ("o", "()"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("l", "I"), ("I", "l"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("v", "y"), ("v", "\\/"), ("m", "rn"), ("rn", "m"), ("n", "ri"), ("n", "r1"), ("u", "ii"),
    ("in", "m"), ("m", "in"), ("a", "o"), ("s", "5"), ("b", "h"), ("h", "b"), ("cl", "d"), ("d", "cl"), ("à", "a`"), ("è", "e`"), ("ì", "i`"), ("ò", "o`"), ("ù", "u`"), ("à", "a'"), ("g", "q"), ("q", "g"), ("z", "2"), ("nn", "m"), ("li", "h"), ("ii", "u"), ("n", "u"), ("u", "n"), ("é", "è"), ("r", "i"), ("b", "6"), ("g", "9"), ("vv", "w"), ("fi", "fl"), ("fi", "ﬁ"), ("l", "|"), ("i", "|"), ("S", "5"), ("B", "8"), ("O", "0"),
)
_SPECKS = "~^¦|"
_EDGE = " \t.,;:!?«»\"“”‘’()[]{}<>…–—*•'’"
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
_AMOUNT = re.compile(r"^[\d.]+,\d\d$")
_HEADING = re.compile(r"^(?:art\.?\s*\d+|allegato\b|capo\b|titolo\b|oggetto\b|tabella\b)", re.I)


def _roman(s: str) -> int:
    n = 0
    for a, b in zip(s, s[1:] + " ", strict=True):
        n += -_ROMAN[a] if b in _ROMAN and _ROMAN[b] > _ROMAN[a] else _ROMAN[a]
    return n


def page_mark(line: str) -> tuple[int, int]:
    """(way of writing from 1, number) of a line that can be a page number, else (0, 0)."""
    for k, form in enumerate(_PAGE, 1):
        if m := form.match(line):
            return k, _roman(m.group(1)) if m.group(1)[0] in _ROMAN else int(m.group(1))
    return 0, 0


_RANGE = re.compile(r"\d[/-]\d|n\. \d")
# what single characters tell of a line; every way of writing a page number begins and ends with some of them
_DIGIT, _UPPER, _LOWER, _END, _MARK_FIRST, _MARK_LAST, _HEADING_FIRST, _HYPHEN, _UNSEEN = (1 << k for k in range(9))


def _kind(ch: str) -> int:
    mark_first, mark_last = ch in "pPsSſ-–—[IVXLC" or ch.isdecimal(), ch in "-–—]IVXLC" or ch.isdecimal()
    return _DIGIT * ch.isdigit() | _UPPER * ch.isupper() | _LOWER * ch.islower() | _END * (ch in ".!?:;,") | _MARK_FIRST * mark_first | _MARK_LAST * mark_last | _HEADING_FIRST * (ch in "actoACTO") | _HYPHEN * (ch in HYPHENS)


class _Signs:
    """Kinds of the characters of many lines at once; each character is looked at once for each process."""

    kinds = np.full(0x110000, _UNSEEN, np.uint16)

    def __init__(self, lines: list[str]):
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[codes]
        if (kinds & _UNSEEN).any():
            for c in np.unique(codes[kinds == _UNSEEN]).tolist():
                self.kinds[c] = _kind(chr(c))
            kinds = self.kinds[codes]
        self.sizes = np.fromiter(map(len, lines), int, len(lines))
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        self.first, self.last = kinds[starts], kinds[ends - 1]
        self.digits, self.capitals = (np.add.reduceat(kinds & bit != 0, starts, dtype=int) if lines else starts for bit in (_DIGIT, _UPPER))


def _bare(tokens: list[str], specks: list[str]) -> str:
    line = " ".join(tokens)
    for speck in specks:
        line = line.replace(speck, "")
    return line.lower()


def _near_titles(bare: list[str], titled: list[int]) -> Callable[[int], int]:
    """How many other titled lines (5 at most) are like one of them; those that begin or end alike are compared, found by that and their length."""
    starts: dict[str, dict[int, list[int]]] = {}
    ends: dict[str, dict[int, list[int]]] = {}
    for j in titled:
        b = bare[j]
        starts.setdefault(b[:3], {}).setdefault(len(b), []).append(j)
        ends.setdefault(b[-5:], {}).setdefault(len(b), []).append(j)

    def count(i: int) -> int:
        b, n = bare[i], 0
        for found, other in ((starts[b[:3]], None), (ends[b[-5:]], b[:3])):
            if len(found) == 1 and len(found[len(b)]) == 1:
                continue
            for size in range(len(b) - 3, len(b) + 4):
                for j in found.get(size, ()):
                    n += j != i and bare[j][:3] != other and lcs_ratio(b, bare[j]) > 0.9
                    if n == 5:
                        return n
        return n

    return count


class _Lines:
    """The lines of many texts that are not blank, stripped, and a row of features for each."""

    def __init__(self, texts: list[list[str]], pages: list[int | None]):
        self.at: list[list[int]] = []
        self.text: list[str] = []
        for lines in texts:
            stripped = [line.strip() for line in lines]
            self.at.append([k for k, t in enumerate(stripped) if t])
            self.text += filter(None, stripped)
        self.tokens = [t.split() for t in self.text]
        self.signs = signs = _Signs(self.text)
        self.starts = np.cumsum([0, *map(len, self.at)]).tolist()
        self.x = np.zeros((len(self.text), 18))
        if not self.text:
            return
        first, last = signs.first, signs.last
        marked = {i: mark for i in np.flatnonzero((first & _MARK_FIRST > 0) & (last & _MARK_LAST > 0)).tolist() if (mark := page_mark(self.text[i]))[0]}
        amount = {i for i in np.flatnonzero(last & _DIGIT > 0).tolist() if self.text[i][-3:-2] == "," and _AMOUNT.match(self.text[i])}
        heading = {i for i in np.flatnonzero(first & _HEADING_FIRST > 0).tolist() if _HEADING.match(self.text[i])}
        ranges = [i for i in np.flatnonzero(signs.digits).tolist() if _RANGE.search(self.text[i])] + [i for i, t in enumerate(self.text) if " - " in t or "   " in t]
        sizes, ended, lower = signs.sizes.tolist(), last & _END > 0, first & _LOWER > 0
        # lines that can be titles, but for what their text tells
        titled = (signs.sizes >= 8) & (signs.sizes <= 90) & ~ended
        titled[[*marked, *heading, *amount]] = False
        open_title = (titled & ~lower).tolist()
        titled = titled.tolist()
        x = self.x
        for k, n in enumerate(pages):
            a, b = self.starts[k], self.starts[k + 1]
            if a < b:
                self._fill(a, b, n, {i: marked[i] for i in range(a, b) if i in marked} if marked else {}, amount, sizes, titled, open_title)
                x[a, 5] = x[a, 15] = x[b - 1, 4] = 1.0
        x[[*heading], 16] = 1.0
        x[[*amount], 16] += 2.0
        x[ranges, 17] = 2.0
        x[:-1, 17] += lower[1:] & (x[1:, 5] == 0)
        x[:, 10], x[:, 11] = first & _UPPER > 0, ended
        x[:, 12] = signs.sizes / x[:, 12]
        x[:, 13], x[:, 14] = signs.digits / signs.sizes, signs.capitals / signs.sizes
        x[1:, 15] = np.maximum(x[1:, 15], ended[:-1])

    def _fill(self, a: int, b: int, pages: int | None, marks: dict[int, tuple[int, int]], amount: set[int], sizes: list[int], titled: list[bool], open_title: list[bool]) -> None:
        """What the lines from a to b, those of one text, tell of each other."""
        x = self.x
        # the way of writing whose numbers run on best is the text's page numbering
        runs = {}
        for form in {f for f, _ in marks.values()}:
            want, good = 1, 0
            for f, v in marks.values():
                if f == form and v >= want:
                    good, want = good + (v == want), v + 1
            runs[form] = good
        total = pages if pages and pages > 0 else max(runs.values(), default=0)
        anchors, want = [], {}
        for i, (f, v) in marks.items():
            # numbers of lost lines may be missing; bare figures must go on and stay within the pages
            in_order = want.get(f, 1) <= v <= max(total, want.get(f, 1))
            if in_order:
                want[f] = v + 1
            if in_order or f not in (5, 7):
                anchors.append(i)
            x[i, :3] = f, in_order, runs[f] / max(total, 1)
        x[a:b, 3] = min(total, 9)
        anchor_set = set(anchors)
        starts = [a] + [i + 1 for i in anchors if i + 1 < b] + [i - 1 for i in anchors if i > a] + [i + 2 for i in anchors if i + 2 < b and i + 1 in anchor_set]
        edge = {i for i in starts if i not in marks}
        x[[*edge], 7] = 1.0
        x[[i + 1 for i in anchors if i + 1 < b], 8] = 1.0
        x[[i - 1 for i in anchors if i > a], 9] = 1.0
        own = self.text[a:b]
        x[a:b, 12] = max(sizes[a:b])
        specks = [c for c in _SPECKS if any(c in t for t in own)]
        bare = [_bare(w, specks) if n <= 90 else "" for w, n in zip(self.tokens[a:b], sizes[a:b], strict=True)]
        same = Counter([w for i, w in enumerate(bare, a) if sizes[i] <= 90 and i not in amount])
        titles = [i - a for i in range(a, b) if open_title[i] or (titled[i] and i in edge)]
        repeats = [same[w] - 1 if n <= 90 else 0 for w, n in zip(bare, sizes[a:b], strict=True)]
        if len(titles) > 1:
            like = _near_titles(bare, titles)
            for i in titles:
                repeats[i] = repeats[i] or like(i)
        x[a:b, 6] = np.minimum(repeats, 5)


def line_features(lines: list[str], pages: int | None) -> tuple[list[int], np.ndarray]:
    """(indexes of the lines that are not blank, a row of features for each)."""
    one = _Lines([lines], [pages])
    return one.at[0], one.x


def next_running(lines: list[str], furniture: set[int], k: int) -> int | None:
    """The next line of running text after line k."""
    for j in range(k + 1, len(lines)):
        if lines[j].strip() and j not in furniture:
            return j
    return None


_CUT = re.compile(rf"([^\s]*[^\W\d_][{re.escape(_SPECKS)}]?)([{HYPHENS}])\s*$")


def cut_end(line: str) -> re.Match | None:
    """The part of a word and the hyphen that end a line which is not blank, or None."""
    return _CUT.match(line.rsplit(None, 1)[-1])


def pair_features(line: str, nxt: str, widest: int) -> list[float] | None:
    """Features of a line's end and the next line's start; None where the line does not end in a hyphen."""
    m = cut_end(line)
    if not m or not nxt.strip():
        return None
    left, right = m.group(1), nxt.strip().split()[0]
    core = right.strip(_EDGE)
    return [
        float(HYPHENS.index(m.group(2)) > 0), len(left), len(core), float(right[0].islower()), float(right[0].isupper()), float(left.isupper()), len(line.rstrip()) / max(widest, 1),
        float(right[0].isdigit()), float(any(ch.isdigit() for ch in left)), float("@" in left or "/" in left), float(left[:1].isupper()),
    ]


@lru_cache(maxsize=1)
def _clean_sentences() -> tuple[str, ...]:
    plain = []
    for text, _ in pii_labels.sentences(1, seed=5):
        if "\n" not in text and len(text) > 45 and text[0].isupper():
            plain.append(text)
    return tuple(plain)


def scan_word(word: str, r: random.Random) -> str:
    """The word as a bad scan shows it: one confusion or speck."""
    spots = [(word.index(a), a, b) for a, b in CONFUSIONS if a in word]
    if r.random() < 0.4 or not spots:
        k = r.randint(1, max(1, len(word) - 1))
        return word[:k] + r.choice(_SPECKS[:3]) + word[k:]
    k, a, b = r.choice(spots)
    return word[:k] + b + word[k + len(a) :]


def training_page(seed: int) -> tuple[list[str], list[str], int]:
    """(lines, fault of each line or '', pages) of an invented scan."""
    r = random.Random(seed)
    fill = pii_labels.Filler(seed)
    pages, width = r.choice([1, 1, 2, 2, 3, 4, 5]), r.randint(50, 80)
    style, hyphen = r.randint(0, 8), r.choice(HYPHENS)
    number = lambda p: ["pagina %d", "Pag.%d", "Pag. %d di " + str(pages), "- %d -", "— %d —", "[%d]", "%d", "%d/" + str(pages), "R"][style] % p if style < 8 else ["I", "II", "III", "IV", "V", "VI"][p - 1]
    head = r.choice([None, f"Deliberazione n. {fill.digits(3)} del {fill.slot('X')}", f"Fascicolo {fill.slot('J')}", f"{r.choice(pii_labels._TOWNS).upper()}   REGISTRO ATTI", f"{fill.organisation().split(' S.')[0]} - {r.choice(['Amministrazione', 'Ufficio Gare', 'Segreteria', 'Settore Personale'])}"]) if pages > 1 else None
    first = r.random() < 0.5
    with_number = r.random() < 0.8
    top = r.random() < 0.25
    body: list[tuple[str, str]] = []
    for _ in range(pages * r.randint(2, 4)):
        kind = r.random()
        if kind < 0.12:
            body.append((r.choice([f"Art. {r.randint(1, 40)}", f"ALLEGATO {r.choice(['I', 'II', 'III', 'IV'])}"]), ""))
        elif kind < 0.2:
            body += [(f"{r.randint(10, 2000)},{r.randint(10, 99)}", "") for _ in range(3)]
        words = " ".join(r.choice(_clean_sentences()) for _ in range(r.randint(1, 4))).split()
        line, k = "", 0
        while k < len(words):
            w = words[k]
            room = width - len(line) - (1 if line else 0)
            if len(w) <= room:
                line = f"{line} {w}" if line else w
            elif room >= 4 and len(w) > 6 and w[:room - 1].isalpha() and w[room - 1 :].strip(".,;:").isalpha() and len(w) - room + 1 >= 2:
                body.append((f"{line} {w[: room - 1]}{hyphen}".strip(), "split_word"))
                line = w[room - 1 :]
            else:
                body.append((line, ""))
                line = w
            k += 1
        if line:
            body.append((line, ""))
        if r.random() < 0.5:
            body.append(("", ""))
    per = -(-len(body) // pages)
    out: list[tuple[str, str]] = []
    order = r.random()
    for p in range(1, pages + 1):
        shown = [((scan_word(head, r) if r.random() < 0.12 else head), "page_furniture")] if head and (p > 1 or first) else []
        count = [(number(p), "page_furniture")] if with_number and r.random() < 0.9 else []
        page = body[(p - 1) * per : p * per]
        if top:
            out += (count + shown if order < 0.5 else shown + count) + page
        elif order < 0.8:
            out += shown + page + count
        else:
            out += page + (shown + count if order < 0.95 else count + shown)
    return [x for x, _ in out], [y for _, y in out], pages


class Models:
    """The trained classifiers."""

    def __init__(self, pages: int = 900, words: int = 1500):
        xs, ys, px, py = [], [], [], []
        for seed in range(pages):
            lines, faults, n = training_page(seed)
            at, x = line_features(lines, n if seed % 4 else None)
            xs.append(x)
            ys += [faults[k] == "page_furniture" for k in at]
            furniture = {k for k in at if faults[k] == "page_furniture"}
            widest = max(map(len, lines))
            for k in at:
                if k not in furniture and (j := next_running(lines, furniture, k)) is not None and (f := pair_features(lines[k], lines[j], widest)):
                    px.append(f)
                    py.append(faults[k] == "split_word")
        # dashes that end a line without cutting a word
        for k in range(0, len(px), 6):
            px.append([0.0, px[k][1], px[k][2], 0.0, 1.0, *px[k][5:7], 0.0, 0.0, 0.0, px[k][10]])
            py.append(False)
        self.furniture = Boost(50).fit(np.concatenate(xs), np.array(ys))
        self.cut = Boost(20).fit(np.array(px), np.array(py))
        r = random.Random(9)
        vocabulary = sorted({w.strip(_EDGE).lower() for s in _clean_sentences() for w in s.split() if w.strip(_EDGE).isalpha() and len(w) > 4})
        fill = pii_labels.Filler(4)
        wx, wy = [], []
        for _ in range(words):
            w = r.choice(vocabulary)
            bad = scan_word(w, r)
            df = int(10 ** r.uniform(0.7, 4))
            wx.append(word_features(bad, w, df, max(1, int(df * r.uniform(0, 0.02)))))
            wy.append(True)
            other = r.choice(vocabulary)
            wx.append(word_features(bad, other, df, 1))
            wy.append(False)
            name = fill.surname().lower()
            close = min(r.sample(vocabulary, 60), key=lambda v: -lcs_ratio(v, name))
            wx.append(word_features(name, close, df, r.randint(1, 6)))
            wy.append(False)
            ending = w[:-1] + r.choice("aeio")
            if ending != w:
                wx.append(word_features(ending, w, df, max(1, int(df * r.uniform(0.01, 0.8)))))
                wy.append(False)
        self.rank = Boost(50).fit(np.array(wx), np.array(wy))


@lru_cache(maxsize=200_000)
def scan_distance(scan: str, page: str) -> float:
    """Least cost of turning the page's word into the scan's: confusions 0.3, specks 0.2, other edits 1."""
    n, m = len(page), len(scan)
    best = [[math.inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        row = best[i]
        for j in range(m + 1):
            c = row[j]
            if c == math.inf or c > 2.5:
                continue
            if i < n and j < m and page[i] == scan[j]:
                best[i + 1][j + 1] = min(best[i + 1][j + 1], c)
            if j < m:
                row[j + 1] = min(row[j + 1], c + (0.2 if scan[j] in _SPECKS else 1.0))
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], c + 1.0)
                if j < m:
                    best[i + 1][j + 1] = min(best[i + 1][j + 1], c + 1.0)
                for a, b in CONFUSIONS:
                    if page.startswith(a, i) and scan.startswith(b, j):
                        best[i + len(a)][j + len(b)] = min(best[i + len(a)][j + len(b)], c + 0.3)
    return min(best[n][m], 3.0)


_CONFUSED: dict[tuple[str, str], list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _CONFUSED.setdefault((_a[0], _b[0]), []).append((_a, _b))


def near_distance(scan: str, page: str) -> float:
    """``scan_distance`` where it is 1 at most and the page's word has no speck, else infinite.

    Then letters that are the same are never better read otherwise, and one edit leaves no room for more.
    """
    i, n, m = 0, len(page), len(scan)
    for a, b in zip(page, scan, strict=False):
        if a != b:
            break
        i += 1
    if i == n == m:
        return 0.0
    edited = page[i + 1 :] == scan[i + 1 :] if n == m else page[i:] == scan[i + 1 :] if n + 1 == m else page[i + 1 :] == scan[i:] if n == m + 1 else False
    best = 1.0 if edited else math.inf
    if i == m or (scan[i] not in _SPECKS and (i == n or (page[i], scan[i]) not in _CONFUSED)):
        return best
    todo = [(i, i, 0.0)]
    while todo:
        i, j, c = todo.pop()
        while i < n and j < m and page[i] == scan[j]:
            i, j = i + 1, j + 1
        if i == n and j == m:
            best = min(best, c)
        elif j < m:
            if scan[j] in _SPECKS and c + 0.2 <= 1.0:
                todo.append((i, j + 1, c + 0.2))
            if i < n and c + 0.3 <= 1.0:
                for a, b in _CONFUSED.get((page[i], scan[j]), ()):
                    if page.startswith(a, i) and scan.startswith(b, j):
                        todo.append((i + len(a), j + len(b), c + 0.3))
    return best


def word_features(word: str, other: str, df_other: int, df_word: int, d: float | None = None) -> list[float]:
    """Features of a scanned word and a word it may stand for; ``d`` is their distance where it is known."""
    d = scan_distance(word, other) if d is None else d
    odd = sum(not ch.isalpha() for ch in word)
    return [d, lcs_ratio(word, other), len(word), abs(len(word) - len(other)), float(odd), math.log10(df_other + 1), math.log10((df_word + 0.5) / (df_other + 0.5)), d / max(len(other), 1), float(any(c in _SPECKS for c in word)), float(word[-1:] != other[-1:]), float(plain_form(word) == other)]


_CODE = re.compile(r"@|://|www\.|\d.*\d|^[A-Z]{2,}[\dA-Z-]*\d|\.\w+\.|^<|chiocciola")

_ODD = re.compile(rf"[{re.escape(_SPECKS)}`015I]|\\/|\(\)")  # the signs that plain_form reads otherwise


@lru_cache(maxsize=100_000)
def plain_form(token: str) -> str | None:
    """What an odd token must have been, without any lexicon, or None where nothing about it is odd."""
    if not _ODD.search(token) or _CODE.search(token) or len(token) < 2:
        return None
    new = token
    if re.search(rf"[^\W\d_][{re.escape(_SPECKS)}]|[{re.escape(_SPECKS)}][^\W\d_]", new):
        new = re.sub(rf"[{re.escape(_SPECKS)}]", "", new)
    new = new.replace("\\/", "v")
    if re.search(r"[^\W\d_]\(\)|\(\)[^\W\d_]", new):
        new = new.replace("()", "o")
    new = re.sub(r"([aeiou])`", lambda m: "àèìòù"["aeiou".index(m.group(1))], new)
    new = re.sub(r"(?<=[^\W\d_])0(?=[a-zà-ÿ])|(?<=[a-zà-ÿ])0(?=[^\W\d_]|$)|^0(?=[a-zà-ÿ]{2})", "o", new)
    new = re.sub(r"(?<=[a-zà-ÿ])1(?=[a-zà-ÿ])|(?<=[a-zà-ÿ])1$|^1(?=[a-zà-ÿ]{2})", "l", new)
    new = re.sub(r"(?<=[a-zà-ÿ])5(?=[a-zà-ÿ])", "s", new)
    new = re.sub(r"(?<=[a-zà-ÿ])I(?=[a-zà-ÿ]|$)", "l", new)
    return new if new != token else None


def scanned(df: DataFrame):
    """Rows that come from a scan: said so, read by OCR, or of unknown origin."""
    method = F.coalesce(F.col("method"), F.lit(""))
    return F.coalesce(F.col("is_ocr"), F.lit(False)) | F.lower(method).contains("ocr") | (F.col("is_ocr").isNull() & (method == ""))


class Reader:
    """Reads one scanned text: furniture, cuts and words by line."""

    def __init__(self, furniture: Boost, cut: Boost):
        self.furniture, self.cut = furniture, cut

    def lines(self, texts: list[str], pages: list[int | None]) -> list[tuple[list[str], set[int], dict[int, tuple[int, str, str]], list[tuple[int, list[str]]]]]:
        """For each text (lines, furniture, cuts, tokens): cuts map a line to (next line, joined word, word with hyphen);
        tokens are (line, its tokens) of running text, without the parts of cut words. Texts are classified together."""
        parts = [text.split("\n") for text in texts]
        every = _Lines(parts, pages)
        hit = self.furniture.predict(every.x) > 0.5
        hyphen = (every.signs.last & _HYPHEN > 0) & ~hit
        pairs, feats = [], []
        furnitures: list[set[int]] = []
        for t, (lines, at, first) in enumerate(zip(parts, every.at, every.starts, strict=False)):
            furniture = {at[i] for i in np.flatnonzero(hit[first : first + len(at)]).tolist()}
            furnitures.append(furniture)
            widest = None
            for k in [at[i] for i in np.flatnonzero(hyphen[first : first + len(at)]).tolist()]:
                widest = max(map(len, lines)) if widest is None else widest
                j = next_running(lines, furniture, k)
                if j is not None and (f := pair_features(lines[k], lines[j], widest)):
                    pairs.append((t, k, j))
                    feats.append(f)
        cuts: list[dict[int, tuple[int, str, str]]] = [{} for _ in parts]
        if pairs:
            for (t, k, j), p in zip(pairs, self.cut.predict(np.array(feats)), strict=True):
                if p > 0.5:
                    lines = parts[t]
                    left, right = cut_end(lines[k]).group(1), lines[j].strip().split()[0]
                    cuts[t][k] = (j, (left + right).strip(_EDGE), f"{left}-{right}".strip(_EDGE))
        out = []
        for lines, at, first, furniture, cut in zip(parts, every.at, every.starts, furnitures, cuts, strict=False):
            joined_into = {j for j, _, _ in cut.values()}
            tokens = every.tokens[first : first + len(at)]
            running = [(k, w[k in joined_into : -1 if k in cut else None] if k in cut or k in joined_into else w) for k, w in zip(at, tokens, strict=True) if k not in furniture]
            out.append((lines, furniture, cut, running))
        return out

    def read(self, text: str, pages: int | None) -> tuple[list[str], set[int], dict[int, tuple[int, str, str]], list[tuple[int, int, int, str]]]:
        """(lines, furniture, cuts, words): cuts map a line to (next line, joined word, word with hyphen);
        words are (line, line of the rest, characters before the border, token)."""
        [(lines, furniture, cuts, running)] = self.lines([text], [pages])
        words: list[tuple[int, int, int, str]] = []
        for k, tokens in running:
            if k in cuts:
                words.append(cut_word(lines, k, cuts[k]))
            words += [(k, k, 0, trimmed(t)) for t in tokens]
        return lines, furniture, cuts, [w for w in words if w[3]]


def trimmed(token: str) -> str:
    """The token without marks at its ends; an o read as () stays."""
    bare = token.rstrip(".,;:")
    return bare.lstrip(_EDGE) if bare.endswith("()") else token.strip(_EDGE)


def cut_word(lines: list[str], k: int, cut: tuple[int, str, str]) -> tuple[int, int, int, str]:
    """(line, line of the rest, characters before the border, word) of a word cut at the end of line k."""
    return k, cut[0], len(cut_end(lines[k]).group(1).lstrip(_EDGE)), cut[1]


class _Kept(dict):
    """What a function gives for each token, kept for as many as ``most`` tokens; ``dull`` are those it gives nothing for."""

    def __init__(self, make: Callable, most: int = 100_000):
        super().__init__()
        self.make, self.most = make, most
        self.dull: set[str] = set()

    def __missing__(self, token: str):
        if len(self) >= self.most:
            self.clear()
            self.dull.clear()
        value = self[token] = self.make(token)
        if not value:
            self.dull.add(token)
        return value


def _clean_word(token: str) -> str:
    """The word of a token as it is counted in clean texts, empty where it does not count."""
    w = token.strip(_EDGE).lower()
    return w if 2 <= len(w) <= 40 and not _CODE.search(w) else ""


_MODELS: list[Models] = []


def default_models() -> Models:
    """The classifiers, trained once for each driver process on the invented pages."""
    if not _MODELS:
        _MODELS.append(Models())
    return _MODELS[0]


def clean_words(df: DataFrame) -> DataFrame:
    """(word, n_clean): in how many clean texts each word stands, and their number for the empty word; summed within each batch before the shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        word = _Kept(_clean_word)
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0).to_pylist():
                seen.update({word[w] for w in set(t.split())})
            seen[""] = batch.num_rows
            words = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n_clean"])

    texts = df.where(~scanned(df) & (F.length("text") > 0)).select("text")
    return texts.mapInArrow(run, "word string, n_clean long").groupBy("word").agg(F.sum("n_clean").alias("n_clean"))


def _grams(word, near: bool, q: int):
    """Distinct q-grams of a word between its borders as a Column; short words share no longer q-gram with what they stand for."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (k - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(k)))
    none = F.array().cast("array<string>")
    size = F.length(word)
    return F.array_distinct(F.concat(F.when(size > (2 if near else 4), cut(q)).otherwise(none), F.when(size <= (6 if near else 4), cut(q - 1)).otherwise(none)))


def share_grams(form: str, page: str, q: int, earlier: list[str]) -> bool:
    """Whether a candidate shares as many q-grams with a form as ``corrections`` wants, and none of the earlier ones."""

    def grams(word: str, near: bool) -> set[str]:
        padded, n = f"^{word}$", len(word)
        cut = lambda k: {padded[i : i + k] for i in range(max(len(padded) - k + 1, 1))}
        return (cut(q) if n > (2 if near else 4) else set()) | (cut(q - 1) if n <= (6 if near else 4) else set())

    held = grams(page, True)
    return len(grams(form, False) & held) >= max(1, (len(form) + 2) // 3 - 1) and held.isdisjoint(earlier)


def _can_be_near(word, page):
    """What ``near_distance`` of 1 at most needs, as a Column: first and last letters are the same, confused or a speck, or one edit is all."""
    ends = {1: {a[0] + b[0] for a, b in CONFUSIONS}, -1: {a[-1] + b[-1] for a, b in CONFUSIONS}}
    same, like = {}, {}
    for at, confused in ends.items():
        w, p = F.substring(word, at, 1), F.substring(page, at, 1)
        same[at] = w == p
        like[at] = same[at] | w.isin(*_SPECKS) | F.concat(p, w).isin(*sorted(confused))
    return (like[1] & like[-1]) | ((same[1] | same[-1]) & (F.levenshtein(word, page, 1) >= 0))


def corrections(odd: DataFrame, counts: DataFrame, rank: Boost, q: int = 3, least_clean: int = 3) -> DataFrame:
    """(word, page): scanned words and what the page had.

    ``odd`` has (word, n_scan, plain): words that no clean text holds, or that have signs no word has, then
    with their plain form. ``counts`` are those of clean texts. Candidates are clean words of nearly the
    same length that share enough q-grams with the word or its plain form; the inverted join is on
    (q-gram, length). Of n q-grams of which m must be shared, n - m + 1 meet any candidate: the rarest are
    taken, so that a frequent q-gram is joined only for words that have nothing rarer. Most pairs are told
    apart by their first and last letters where they meet (``_can_be_near``); the few that are near enough are then counted out, each by the first q-gram that it meets by, so that pairs need no shuffle.
    Few bytes are many comparisons here, so the number of tasks is fixed.
    """
    odd = odd.where((F.length("word") >= 2) & (F.col("plain").isNotNull() | ~F.col("word").rlike(r"\d.*\d")))
    good = counts.where((F.col("n_clean") >= least_clean) & F.col("word").rlike(r"^[\p{L}'’-]+$") & (F.length("word") >= 2))
    b = good.select(F.col("word").alias("page"), "n_clean", F.explode(_grams(F.col("word"), True, q)).alias("gram"))
    held = b.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    b = b.withColumn("size", F.explode(F.array(*[F.length("page") + k for k in (-2, -1, 0, 1, 2)])))
    forms = odd.select("word", "n_scan", F.explode(F.array_distinct(F.array_compact(F.array("word", F.lower("plain"))))).alias("form")).where(F.length("form") >= 2)
    least = F.greatest(F.lit(1), F.floor((F.length("form") + 2) / 3).cast("int") - 1)
    own = _grams(F.col("form"), False, q)
    a = in_tasks(forms.select("word", "n_scan", "form", F.explode(own).alias("gram")).join(held, "gram"), "word", "form")
    # q-grams that no clean word has are shared with none and count among those left out: the others are ordered by rarity
    ranked = a.groupBy("word", "form").agg(F.max("n_scan").alias("n_scan"), F.array_sort(F.collect_list(F.struct("held", "gram"))).alias("g"))
    rarest = F.slice("g", 1, F.greatest(F.size("g") - least + 1, F.lit(0)))["gram"]
    taken = ranked.select("word", "form", "n_scan", F.array_join(rarest, " ").alias("taken")).where(F.col("taken") != "")
    a = taken.select("word", "form", "n_scan", "taken", F.posexplode(F.split("taken", " ")).alias("place", "gram"), F.length("form").alias("size"))
    near = in_tasks(a, "gram", "size").join(b, ["gram", "size"]).where(_can_be_near(F.col("word"), F.col("page"))).select("word", "form", "n_scan", "page", "n_clean", "taken", "place")

    def choose(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words, pages = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            d = [near_distance(w, p) for w, p in zip(words, pages, strict=True)]
            at = [i for i, (w, c) in enumerate(zip(words, d, strict=True)) if c <= (0.35 if len(w) < 4 else 1.0)]
            forms, n_scan, n_clean, taken, place = (batch.column(k).take(pa.array(at, pa.int64())).to_pylist() for k in (1, 2, 4, 5, 6))
            kept = [(words[i], pages[i], n, s, d[i]) for i, f, s, n, t, k in zip(at, forms, n_scan, n_clean, taken, place, strict=True) if share_grams(f, pages[i], q, t.split(" ")[:k])]
            if kept:
                good = [(w, p, c) for (w, p, *_), c in zip(kept, rank.predict(np.array([word_features(*k) for k in kept])).tolist(), strict=True) if c > 0.5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*good, strict=True) if good else ([], [], []), (pa.string(), pa.string(), pa.float64()), strict=True)], ["word", "page", "score"])

    scored = near.mapInArrow(choose, "word string, page string, score double")
    return scored.groupBy("word").agg(F.max_by("page", F.struct("score", "page")).alias("page"))


class _Seen:
    """What a reader sees in texts, as rows (line_no, fault, line_to, word, page, border, plain): furniture, cuts
    that are judged by the words of clean texts, words with impossible signs (odd) and words outside ``common``."""

    def __init__(self, reader: Reader, common):
        self.reader, self.common, self.kept = reader, common, None

    def judged(self, token: str) -> tuple | None:
        """(fault, word, token as written, plain form) of a trimmed token that clean texts may not hold, else None."""
        low = token.lower()
        if not low or low in self.common.value:
            return None
        new = plain_form(token)
        if new is not None:
            return "odd", low, token, new
        if len(token) >= 2 and not _CODE.search(token) and any(ch.isalpha() for ch in token):
            return "word", low, token, None
        return None

    def __call__(self, bodies: list[str], pages: list[int | None]) -> list[list[tuple]]:
        if self.kept is None:
            self.kept = _Kept(lambda token: self.judged(trimmed(token)))
        known, every = self.kept, []
        for lines, furniture, cuts, running in self.reader.lines(bodies, pages):
            out: list[tuple] = [(k + 1, "page_furniture", None, None, None, 0, None) for k in furniture]
            for k, cut in cuts.items():
                j, joined, whole = cut
                out.append((k + 1, "cut", j + 1, joined.lower(), whole.lower(), 0, None))
                _, _, n, word = cut_word(lines, k, cut)
                if found := self.judged(word):
                    fault, low, token, new = found
                    if new is None:
                        out.append((k + 1, fault, j + 1, low, token, n, None))
                    else:
                        at = next((i for i, (a, b) in enumerate(zip(token, new + " " * len(token), strict=False)) if a != b), 0)
                        out.append(((j if n and at >= n else k) + 1, fault, None, low, token, 0, new))
            for k, tokens in running:
                if known.dull.issuperset(tokens):
                    continue
                for t in tokens:
                    if found := known[t]:
                        fault, low, token, new = found
                        out.append((k + 1, fault, k + 1 if new is None else None, low, token, 0, new))
            every.append(out)
        return every


def faults(df: DataFrame, key: str = "extraction_id", text: str = "text", common_share: int = 500, models: Models | None = None) -> DataFrame:
    """(key, line_no, fault, line_to, word, page): faults of each line of the scanned texts, repeated
    where a line has several misread words. ``line_to`` is where a cut word goes on, ``page`` what
    the page had; both are null where they mean nothing.

    ``df`` has key, text, is_ocr, method, pages. Null and empty texts have no row; clean texts only
    lend their words. Words that stand in more than one of ``common_share`` clean texts are broadcast
    to keep right words out of the join; there are at most ``common_share`` times the mean number of
    words of a text of them, however many texts there are.
    """
    models = models or default_models()
    reader = Reader(models.furniture, models.cut)  # small, travels with the task
    base = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), "is_ocr", "method", F.col("pages").cast("int").alias("pages"))
    counts = checkpoint(clean_words(base))
    n_clean = sum(r.n_clean for r in counts.where(F.col("word") == "").collect())
    counts = counts.where(F.col("word") != "")
    least = max(3, -(-n_clean // common_share))
    common = base.sparkSession.sparkContext.broadcast(frozenset(r.word for r in counts.where(F.col("n_clean") >= least).select("word").collect()))

    texts = base.where(scanned(base) & (F.length("text") > 0))
    # the name of a person is written as it is: inside a sentence only lower case words are compared
    seen = fan_out(texts, ["text", "pages"], ["key"], {"line_no": "int", "fault": "string", "line_to": "int", "word": "string", "page": "string", "border": "int", "plain": "string"}, _Seen(reader, common), rows=256, together=True)
    seen = stored(seen, "fault")  # each fault is read on its own
    sure = seen.where(F.col("fault") == "page_furniture").select("key", "line_no", "fault", F.lit(None).cast("int").alias("line_to"), "word", "page")
    cuts = seen.where(F.col("fault") == "cut")
    joined = counts.select("word", (F.col("n_clean") + F.lit(0)).alias("n_joined"))
    whole = counts.select(F.col("word").alias("page"), F.col("n_clean").alias("n_whole"))
    cuts = cuts.join(joined, "word", "left").join(whole, "page", "left").where(F.coalesce("n_whole", F.lit(0)) <= F.coalesce("n_joined", F.lit(0)))
    cuts = cuts.select("key", "line_no", F.lit("split_word").alias("fault"), "line_to", "word", F.lit(None).cast("string").alias("page"))
    rare, signs = seen.where(F.col("fault") == "word"), seen.where(F.col("fault") == "odd")
    unheld = rare.groupBy("word").agg(F.countDistinct("key").alias("n_scan")).join(counts, "word", "left_anti").withColumn("plain", F.lit(None).cast("string"))
    odd = unheld.unionByName(signs.groupBy("word").agg(F.countDistinct("key").alias("n_scan"), F.max("plain").alias("plain")))
    fixes = checkpoint(corrections(odd, counts, models.rank))
    # the clean word that ranking chose; where the plain form is the same, with the letter case it has
    signs = signs.join(fixes.withColumnRenamed("page", "fixed"), "word", "left")
    chosen = F.when(F.lower("plain") == F.col("fixed"), F.col("plain")).otherwise(F.coalesce("fixed", "plain"))
    signs = signs.select("key", "line_no", F.lit("misread").alias("fault"), F.lit(None).cast("int").alias("line_to"), F.col("page").alias("word"), chosen.alias("page"))
    words = rare.join(fixes.withColumnRenamed("page", "fixed"), "word")
    # the first character that differs says on which line of a cut word the misread part stands
    same = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)) == F.substring("fixed", i, F.lit(1)))
    late = (F.col("border") > 0) & (F.array_position(same, False) > F.col("border"))
    words = words.select("key", F.when(late, F.col("line_to")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("fault"), F.lit(None).cast("int").alias("line_to"), F.col("page").alias("word"), F.col("fixed").alias("page"))
    return sure.unionByName(cuts).unionByName(signs).unionByName(words).withColumnRenamed("key", key)


def repair(df: DataFrame, key: str = "extraction_id", text: str = "text", models: Models | None = None) -> DataFrame:
    """(key, text): each scanned text as continuous paragraphs, without furniture, words whole and read right.

    Keys must be unique. Texts without a fault are joined into paragraphs as well; clean, null and
    empty texts come out as they are.
    """
    found = faults(df, key, text, models=models)
    listed = found.groupBy(key).agg(F.collect_set(F.struct("line_no", "fault", "line_to", "word", "page")).alias("found"))
    full = df.select(F.col(key), F.col(text).cast("string").alias("body"), scanned(df).alias("scan")).join(listed, key, "left")
    return fan_out(full, ["body", "scan", "found"], [key], {"text": "string"}, lambda body, scan, found: [(paragraphs(body, found or []) if scan and body else body,)], rows=256)


def _mended(text: str, word: str, page: str) -> str | None:
    """The text with the first whole occurrence of a misread word put right, or None where it has none."""
    new = page[:1].upper() + page[1:] if word[:1].isupper() and page[:1].islower() else page
    out, n = re.subn(rf"(?<!\w){re.escape(word)}(?!\w)", lambda m: new, text, count=1)
    return out if n else None


def paragraphs(body: str, found: list[dict]) -> str:
    """The text with its faults mended and its lines joined; blank lines part paragraphs.

    A misread word is put right on the line where it was found; one that was cut, after its parts are joined.
    """
    lines = body.split("\n")
    furniture = {f["line_no"] - 1 for f in found if f["fault"] == "page_furniture"}
    cuts = {f["line_no"] - 1 for f in found if f["fault"] == "split_word"}
    fixes: dict[int, list[tuple[str, str]]] = {}
    for f in found:
        if f["fault"] == "misread" and f["page"] and f["page"] != f["word"]:
            fixes.setdefault(f["line_no"] - 1, []).append((f["word"], f["page"]))
    out, now, glue = [], "", False
    waiting: list[tuple[str, str]] = []
    for k, line in enumerate(lines):
        if k in furniture:
            continue
        s = line.strip()
        if not s:
            if now and not glue:
                out.append(now)
                now, waiting = "", []
            continue
        for fix in fixes.get(k, ()):
            mended = _mended(s, *fix)
            if mended is None:
                waiting.append(fix)
            else:
                s = mended
        now = now + s if glue else f"{now} {s}" if now else s
        glue = k in cuts
        if glue:
            now = now[:-1]
        left = []
        for fix in waiting:
            mended = _mended(now, *fix)
            if mended is None:
                left.append(fix)
            else:
                now = mended
        waiting = left
    if now:
        out.append(now)
    return "\n\n".join(out)


def found(df: DataFrame, key: str = "extraction_id") -> DataFrame:
    """(key, line_no, fault), each once; a line of page furniture has no other fault."""
    every = faults(df, key).select(key, "line_no", "fault").distinct()
    furniture = every.where(F.col("fault") == "page_furniture").select(key, "line_no", F.lit(1).alias("_f"))
    return every.join(furniture, [key, "line_no"], "left").where(F.col("_f").isNull() | (F.col("fault") == "page_furniture")).drop("_f")
