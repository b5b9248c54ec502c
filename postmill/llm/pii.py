"""Personal information inside free text: a linear-chain conditional random field over word shapes.

Texts are cut into tokens by one pattern; a token's features depend only on its own spelling, so they
are computed once for each distinct token and become one row of weights for each place around it.
Scores of a whole batch are then sums of table rows, and labels come from Viterbi in numpy, run for
all stretches of equal length at once. A token is set to none beforehand where the transitions, and what
the next token would lose by beginning a mention instead of going on with one, prove that no best path
labels it otherwise (``Tagger.open``); such tokens cut the text into these stretches. In a part of the
training rows a listed given name is no such feature, so that names are learned from their shape and
surroundings too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import pii_labels
from postmill.llm.names import GIVEN, SHORT, TITLES

KINDS = ("name", "email", "phone", "id_number", "address")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
NONE = 0
OFFSETS = (-2, -1, 0, 1, 2)
UNLISTED = 4  # in each fourth training row given names are not known as such
#: Placeholders by kind. Fixed values.
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]"}

# Word lists behind the features.
_FULL = frozenset(GIVEN)
#: Short forms that are also common words or beginnings of words.
_WORDS = frozenset("vale rico mari gen tom pat ste gu dana alex".split())
_GIVEN = (_FULL | frozenset(SHORT)) - _WORDS
_ROADS = frozenset("via viale v.le piazza p.zza p.za piazzale p.le corso c.so vicolo v.lo largo l.go strada contrada c.da loc località salita lungomare rue calle borgo rione".split())
_GERMAN_ROAD = re.compile(r"(?:straße|strasse|str|weg|gasse|platz|allee|ring|damm|ufer)$")
_TITLES = frozenset(TITLES) | frozenset("dott.ssa dr.ssa sig.ra prof.ssa gent.ma gent.mo egregio egregia gentile avvocato signor signora dear herr frau".split())
_TRADES = frozenset("impresa farmacia studio officine caseificio cooperativa immobiliare autotrasporti azienda laboratorio comune tribunale consorzio istituto camera unione associato edile meccaniche sociale agricola vinicola analisi comuni bonifica arbitrale comprensivo".split())

#: Prior means of a token's own feature weights (label, weight): forms that hardly ever mean anything
#: else. The likelihood moves them, the regulariser pulls towards them. Fixed values.
PRIOR = {
    "k=code": ("B-id_number", 4.5), "k=doc": ("B-id_number", 4.5), "k=email": ("B-email", 3.0), "id": ("B-email", -4.0), "first=+": ("B-phone", 3.0),
    "first=(": ("B-phone", 2.0), "givennl": ("B-name I-name", 3.0), "groad": ("B-address", 2.0), "roadCap": ("B-address", 2.5), "roadUP": ("B-address", 2.5),
}

_SP = r"[ \t]*(?:\n[ \t>|]*)*"
_TOKEN = re.compile(
    r"(?:[\w+-]+(?:\.[\w+-]+)*(?= (?:chiocciola|\[at\]) )"
    r"|[a-zàèéìòùäöüß]+(?=[ \n,;:)])"
    r"|[\w.+%-]+(?:@|\(at\))[\w-]+(?:\.[\w-]+)+"
    r"|(?:https?://|www\.)[^\s<>,;]+"
    r"|\d{1,2}[./-]\d{1,2}[./-]\d{4}(?!\d)|\d{1,2}:\d{2}(?!\d)"
    r"|\d{1,3}(?:\.\d{3})*,\d{2}(?!\d)"
    r"|[A-Za-z]{3} ?[A-Za-z]{3} ?\d\d[A-Za-z]\d\d ?[A-Za-z]\d{3}[A-Za-z](?!\w)"
    r"|[A-Z]{2} ?\d{7}(?!\w)|[A-Z]{2}\d{5}[A-Z]{2}(?!\w)"
    r"|(?:\+\d{1,3}|\(0\d{1,4}\)|\d{2,5})(?:[ ./-]?\d{2,9}){1,5}(?![\w])"
    r"|\d+(?:/[A-Za-z]{1,3}|[A-Za-z]{1,3})?(?!\w)"
    r"|(?:[CcVvPpLl]\.(?:so|le|zza|za|go|da|lo|iva)|[Dd]ott\.ssa|[Dd]r\.ssa|[Ss]ig\.ra|[Pp]rof\.ssa|[Gg]ent\.m[ao]|[CcPp]\.\s?[Ff]\.|[PpSs]\.\s?[A-Za-z]\.\s?[A-Za-z]\.|P\.IVA)(?!\w)"
    r"|[^\W\d_]+(?=[\W\d_]|$)|\w|[^\w\s]|\s)" + _SP
)
_PHONE = re.compile(r"(?:\+\d{1,3}|\(0\d{1,4}\)|\d{2,5})(?:[ ./-]?\d{2,9}){1,5}")
_CODE = re.compile(r"[A-Za-z]{3} ?[A-Za-z]{3} ?\d\d[A-Za-z]\d\d ?[A-Za-z]\d{3}[A-Za-z]")


def split(text: str) -> list[str]:
    """Tokens with the white space and quote marks that follow them; joined they give the text."""
    lead = re.match(r"[\s>|]+", text)
    head = [lead.group()] if lead else []
    return head + _TOKEN.findall(text, lead.end() if lead else 0)


def shape(token: str) -> str:
    """Runs of upper case, lower case and digits closed up to one sign each."""
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", token)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", s))[:14]


def core(token: str) -> str:
    """The token without what follows it."""
    return token.rstrip(" \t\n>|") or token.strip() or " "


def features(token: str, own: bool, listed: bool = True) -> list[str]:
    """Features of a token for its own label, or fewer of them for its neighbours'; ``listed``: whether given names count as such."""
    word = core(token)
    low = word.lower()
    if "@" in word or "(at)" in low:
        kind = "email"
        form = re.sub(r"[a-z]+", "a", re.sub(r"\d+", "0", re.split(r"@|\(at\)", low)[0]))
        out = [f"k={kind}", f"mail={form[:8]}", "id" if re.search(r"\d{5}", low) else "noid"]
    elif _CODE.fullmatch(word):
        out = ["k=code", "s=" + shape(word)]
    elif re.fullmatch(r"[A-Z]{2} ?\d{7}|[A-Z]{2}\d{5}[A-Z]{2}", word):
        out = ["k=doc", "s=" + shape(word)]
    elif word[0] in "+(0123456789" and any(ch.isdigit() for ch in word):
        digits = sum(ch.isdigit() for ch in word)
        if re.fullmatch(r"\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{1,2}:\d{2}", word):
            out = ["k=date"]
        elif re.fullmatch(r"\d{1,3}(?:\.\d{3})*,\d{2}", word):
            out = ["k=amount"]
        elif digits >= 6 and _PHONE.fullmatch(word):
            out = ["k=phone", "s=" + shape(word), f"d={min(digits, 14)}", f"first={word[:1] if word[0] in '+(' else word[0]}", "s2=" + re.sub(r"\d", "0", word)[:12]]
        else:
            out = ["k=num", f"d={min(digits, 8)}", "s=" + shape(word)]
    elif word[0].isalpha():
        upper, lower = word.isupper(), word.islower()
        kind = "init" if len(word) == 1 and upper else "UP" if upper else "low" if lower else "Cap" if word[0].isupper() else "mix"
        out = [f"k={kind}", "w=" + low]
        if low in (_FULL if lower else _GIVEN):
            # which given name it is must not matter
            if listed or lower:
                out = [f"k={kind}", "given", "given" + kind] + (["givennl"] if own and "\n" in token else [])
            else:
                out = [f"k={kind}"] + (["e3=" + low[-3:] + kind[0], "long" + kind if len(low) > 6 else "short" + kind] if own or kind != "low" else [])
        elif low.rstrip(".") in _TITLES or low in _TITLES:
            out.append("title")
        elif low.rstrip(".") in _ROADS or low in _ROADS:
            out += ["road", "road" + kind]
        elif len(low) > 5 and _GERMAN_ROAD.search(low) and not lower:
            out.append("groad")
        elif low in _TRADES:
            out.append("trade")
        elif own or kind != "low":
            out += ["e3=" + low[-3:] + kind[0], "long" + kind if len(low) > 6 else "short" + kind]
    else:
        out = ["w=" + word[:6]]
    if own:
        out.append("nl" if "\n" in token else "sp" if token[-1:] == " " else "glue")
    elif "\n" in token:
        out.append("nl")
    return out


class Tagger:
    """A trained field: feature weights for each offset and label transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves  # (offset, feature, label), (label, label)
        self.rows: dict[tuple, int] = {}
        self.seen: dict[str, int] = {}
        self.table = np.zeros((len(OFFSETS), 1024, len(LABELS)), np.float32)
        self.cut = np.zeros(1024, np.int32)
        self.reach = self._reach()
        self.row(" ")  # row 0 stands for no token

    def _reach(self) -> tuple[np.ndarray, np.ndarray]:
        """What the transitions can give a label over none at most: where the mention ends with it, and where the next token goes on."""
        m, k = self.moves, len(LABELS)
        ends, goes = np.zeros(k, np.float32), np.zeros(k, np.float32)
        real = m > -1e3
        for y in range(1, k):
            first, inner = (y - 1) // 2 * 2 + 1, (y - 1) // 2 * 2 + 2
            before = max(m[p, y] - m[p, NONE] for p in range(k) if real[p, y])
            ends[y] = before + max(m[y, n] - m[NONE, n] for n in range(k) if real[y, n] and real[NONE, n])
            goes[y] = before + m[y, inner] - m[NONE, first] + max(m[inner, n] - m[first, n] for n in range(k) if real[inner, n] and real[first, n])
        return ends, goes

    def open(self, e: np.ndarray) -> np.ndarray:
        """Which tokens may have another label than none on a best path.

        If a token had one, none could take its place: the next token, where it goes on with the mention,
        would begin it. What that costs at most is proven by the emissions of both and the transitions.
        """
        ends, goes = self.reach
        gain = e[:, 1:] - e[:, :1]
        lost = np.full((len(e), len(KINDS)), -np.inf, np.float32)
        lost[:-1] = e[1:, 2::2] - e[1:, 1::2]
        return (gain + np.maximum(ends[1:], goes[1:] + np.repeat(lost, 2, axis=1)) >= -1e-3).any(axis=1)

    def row(self, token: str) -> int:
        """The table row of a token; tokens with equal features share one."""
        own = tuple(sorted(i for f in features(token, True) if (i := self.index.get("o:" + f)) is not None))
        near = tuple(sorted(i for f in features(token, False) if (i := self.index.get("n:" + f)) is not None))
        key = (own, near, len(core(token)), len(token))
        at = self.rows.get(key)
        if at is None:
            at = self.rows[key] = len(self.rows)
            if at >= self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
                self.cut = np.concatenate([self.cut, np.zeros_like(self.cut)])
            for k, o in enumerate(OFFSETS):
                ids = own if o == 0 else near
                self.table[k, at] = self.weights[k, list(ids)].sum(axis=0) if ids else 0.0
            self.cut[at] = len(core(token))
        return at

    def rows_of(self, tokens: list[str]) -> list[int]:
        seen = self.seen
        out = list(map(seen.get, tokens))
        if None in out:
            if len(seen) > 300_000:
                seen.clear()
            for i, at in enumerate(out):
                if at is None:
                    token = tokens[i]
                    at = out[i] = self.row(token)
                    if len(token) < 40:
                        seen[token] = at
        return out

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """Label scores of a run of tokens; the run is padded with row 0 on both sides."""
        n = len(rows)
        padded = np.concatenate([[0, 0], rows, [0, 0]])
        e = self.table[2][rows]
        for k, o in enumerate(OFFSETS):
            if o:
                e += self.table[k][padded[2 + o : 2 + o + n]]
        return e

    def labels(self, rows: np.ndarray, gaps: np.ndarray | None = None) -> np.ndarray:
        """The best label of every token; the places ``gaps`` are none."""
        n = len(rows)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        e = self.emissions(rows)
        open_ = self.open(e)
        if gaps is not None:
            open_[gaps] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        order = np.argsort(-sizes, kind="stable")
        for lo in range(0, len(order), 65536):
            part = order[lo : lo + 65536]
            self._viterbi(e, starts[part], sizes[part], out)
        return out

    def _viterbi(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        """Best paths of stretches, longest first, all at once: step t works on those longer than t."""
        if not len(starts):
            return
        k, longest = e.shape[1], int(sizes[0])
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # stretches with more than t tokens
        score = self.moves[NONE] + e[starts]
        back: list[np.ndarray] = [np.zeros((0, k), np.int8)]
        moves = np.ascontiguousarray(self.moves.T)  # (to, from)
        for t in range(1, longest):
            m = int(alive[t])
            both = score[:m, None, :] + moves
            step = both.argmax(axis=2)
            back.append(step.astype(np.int8))
            score[:m] = np.take_along_axis(both, step[:, :, None], 2)[:, :, 0] + e[starts[:m] + t]
        best = (score + self.moves[:, NONE]).argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            m = int(alive[t])
            out[starts[:m] + t] = best[:m]
            if t:
                best[:m] = back[t][np.arange(m), best[:m]]

    def mentions(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of every mention of every text, from 1, both ends included."""
        tokens, bounds = [], []
        for text in texts:
            mine = split(text) if text else []
            tokens += mine
            tokens += ["\n", "\n"]  # two empty places part the texts
            bounds.append(len(tokens))
        rows = np.array(self.rows_of(tokens), np.int64)
        ends = np.array(bounds, np.int64)
        for gap in (1, 2):
            rows[ends - gap] = 0
        labels = self.labels(rows, np.concatenate([ends - 1, ends - 2]))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        for gap in (1, 2):
            sizes[ends - gap] = 0
        stop = np.cumsum(sizes)
        begin = stop - sizes
        inside = np.flatnonzero(labels)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not len(inside):
            return out
        kind = (labels[inside] - 1) // 2
        first = (labels[inside] % 2 == 1) | np.concatenate([[True], (np.diff(inside) != 1) | (np.diff(kind) != 0)])
        a = np.flatnonzero(first)
        b = np.append(a[1:], len(inside)) - 1
        which = np.searchsorted(ends, inside[a], side="right")
        base = np.concatenate([[0], stop[ends - 1]])[which]
        for i, j, w, o in zip(a.tolist(), b.tolist(), which.tolist(), base.tolist(), strict=True):
            s, e = int(begin[inside[i]]) - o, int(begin[inside[j]] + self.cut[rows[inside[j]]]) - o
            label = KINDS[kind[i]]
            for x, y in settle(label, texts[w], s, e):
                out[w].append(("email" if label == "name" and "@" in texts[w][x:y] else label, x + 1, y))
        return out


_ADDRESS_END = re.compile(r"^.*\d(?:\s?(?:bis|ter)|/(?:[A-Za-z]|bis|ter)|[A-Za-z])?(?!\w)", re.S)
_NAME_PARTS = re.compile(r"(?<![-‐\u00ad¬])[ \t>|]*\n[ \t>|\n]*|\s+(?:e|und|and|et|o)\s+|(?<=[a-zà-ÿA-ZÀ-Þ]{3})\.\s+")
_LEADING_TITLE = re.compile(r"^(?:(?:dott\.ssa|dr\.ssa|prof\.ssa|sig\.ra|avv|dott|dr|ing|arch|geom|rag|sig|prof|avvocato|signora?)\.?\s+)+", re.I)


_ROAD_BEFORE = re.compile(r"(?<![\w.])(?:via|viale|v\.le|piazza|p\.zza|piazzale|p\.le|corso|c\.so|vicolo|v\.lo|largo|l\.go|loc\.|strada|contrada|lungomare)\s+(?:[^\W\d_]+(?:['’]|[ ]+)){0,3}$", re.I)
_INITIAL_BEFORE = re.compile(r"(?<![\w.])[A-Z]\. ?$")


def settle(kind: str, text: str, s: int, e: int) -> list[tuple[int, int]]:
    """An exact check of a mention's ends: the spans (from 0, end exclusive) that the kind's own form allows."""
    part = text[s:e]
    if kind == "phone":
        m = re.search(r"[+(\d].*\d", part, re.S)
        return [(s + m.start(), s + m.end())] if m and sum(c.isdigit() for c in m.group()) >= 6 else []
    if kind == "email":
        part = part.rstrip(".,;:>)")
        return [(s, s + len(part))] if re.search(r"@|\bat\b|\(at\)|chiocciola", part, re.I) else []
    if kind == "address":
        if part[:1] == "." and (head := re.search(r"(?<!\w)\w{1,5}$", text[max(0, s - 8) : s])):
            s -= len(head.group())
            part = text[s:e]
        m = _ADDRESS_END.search(part)
        if m is None:
            return []
        kind_of_street = _ROAD_BEFORE.search(text[max(0, s - 48) : s])
        return [(s - len(kind_of_street.group()) if kind_of_street else s, s + m.end())]
    if kind == "id_number":
        m = _CODE.search(part) or re.search(r"[A-Z]{2} ?\d{5}[A-Z\d]{2}", part)
        return [(s + m.start(), s + m.end())] if m else [(s, e)]
    out: list[tuple[int, int]] = []
    at = 0
    bounds = [(m.start(), m.end()) for m in _NAME_PARTS.finditer(part)] + [(len(part), len(part))]
    apart = False
    for stop, go in bounds:
        piece, base, strict = part[at:stop], s + at, apart
        at, apart = go, bool(re.search(r"[\n.]", part[stop:go]))
        if m := _LEADING_TITLE.match(piece):
            piece, base = piece[m.end() :], base + m.end()
        m = re.search(r"[^\W\d_](?:.*[^\W\d_]\.?)?", piece, re.S)
        if m is None:
            continue
        name = m.group()
        if name.endswith(".") and not re.search(r"(?:^|[\s.])[^\W\d_]\.$", name):
            name = name[:-1]
        words = re.findall(r"[^\W\d_]+", name)
        if len(bounds) > 1 and (len(name) < 3 or not all(w[0].isupper() for w in words)) and not (words and any(w.lower() in _FULL for w in words)):
            continue
        if len(name) < 2 or (strict and not re.match(r"[A-Z]\.", name) and not any(w.lower() in _FULL for w in words)):
            continue
        start = base + m.start()
        if (initial := _INITIAL_BEFORE.search(text[max(0, start - 5) : start])) and not name[1:2] == ".":
            start -= len(initial.group())
        out.append((start, base + m.start() + len(name)))
    return out


def train(rows: list[tuple[str, list[tuple[str, int, int]]]] | None = None, epochs: int = 60, l2: float = 1e-3, rate: float = 0.6, unlisted: int = UNLISTED, prior: bool = True) -> Tagger:
    """Fit the field by its likelihood (batched forward-backward, adaptive steps).

    The labelled table is a bounded input of the repository; training takes seconds on the driver. In each
    ``unlisted``-th row given names are not known as such (0: in none).
    """
    rows = rows if rows is not None else pii_labels.sentences()
    spots, gold, lengths = [], [], []
    listed = [not unlisted or i % unlisted > 0 for i in range(len(rows))]
    for text, mentions in rows:
        tokens = split(text)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        y = np.zeros(len(tokens), np.int64)
        for kind, s, e in mentions:
            k = KINDS.index(kind)
            inside = [i for i in range(len(tokens)) if begin[i] < e and begin[i] + len(core(tokens[i])) > s]
            for n, i in enumerate(inside):
                y[i] = 1 + 2 * k + (n > 0)
        spots.append(tokens)
        gold.append(y)
        lengths.append(len(tokens))
    index: dict[str, int] = {}
    seen: dict[str, int] = {}
    for tokens, known in zip(spots, listed, strict=True):
        for t in tokens:
            for p, own in (("o:", True), ("n:", False)):
                for f in features(t, own, known):
                    seen[p + f] = seen.get(p + f, 0) + 1
    for f, n in seen.items():
        # words seen but a few times are invented values: they must not be remembered
        if n >= (6 if f[2:4] == "w=" else 3):
            index[f] = len(index)
    kinds: dict[tuple, int] = {}
    owns, nears, ids = [], [], []
    for tokens, known in zip(spots, listed, strict=True):
        mine = []
        for t in tokens:
            own = tuple(index[f] for x in features(t, True, known) if (f := "o:" + x) in index)
            near = tuple(index[f] for x in features(t, False, known) if (f := "n:" + x) in index)
            key = (own, near)
            if key not in kinds:
                kinds[key] = len(kinds)
                owns.append(own)
                nears.append(near)
            mine.append(kinds[key])
        ids.append(np.array(mine))
    flat = lambda lists: (np.concatenate([np.full(len(x), i) for i, x in enumerate(lists)]).astype(np.int64), np.concatenate([np.array(x, np.int64) for x in lists]))
    own_at, own_f = flat(owns)
    near_at, near_f = flat(nears)
    k, nf, nt = len(LABELS), len(index), len(kinds)
    w = np.zeros((len(OFFSETS), nf, k))
    for f, (label, weight) in PRIOR.items() if prior else ():
        if "o:" + f in index:
            for name in label.split():
                w[OFFSETS.index(0), index["o:" + f], LABELS.index(name)] = weight
    pulled = w.copy()
    moves = np.zeros((k, k))
    banned = np.zeros((k, k), bool)
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            banned[[i for i, x in enumerate(LABELS) if x[1:] != label[1:] or x == "O"], j] = True
    grad_w, grad_m = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    order = np.argsort(lengths)
    batches = [order[i : i + 256] for i in range(0, len(order), 256)]
    rng = np.random.default_rng(3)
    sum_w, sum_m, summed = np.zeros_like(w), np.zeros_like(moves), 0
    for epoch in range(epochs):
        for batch in rng.permutation(len(batches)):
            pick = batches[batch]
            size, m = max(lengths[i] for i in pick), len(pick)
            x = np.full((m, size + 4), -1)
            y = np.full((m, size), -1)
            for r, i in enumerate(pick):
                x[r, 2 : 2 + lengths[i]] = ids[i]
                y[r, : lengths[i]] = gold[i]
            real = y >= 0
            tables = []
            for q, o in enumerate(OFFSETS):
                at, f = (own_at, own_f) if o == 0 else (near_at, near_f)
                table = np.zeros((nt + 1, k))
                np.add.at(table, at, w[q][f])
                tables.append(table)
            e = sum(tables[q][x[:, 2 + o : 2 + o + size]] for q, o in enumerate(OFFSETS))
            t = np.where(banned, -1e4, moves)
            alpha, beta = np.zeros((m, size, k)), np.zeros((m, size, k))
            a = e[:, 0] + t[NONE]
            alpha[:, 0] = a
            for s in range(1, size):
                top = a.max(axis=1, keepdims=True)
                new = np.log(np.exp(a - top) @ np.exp(t) + 1e-300) + top + e[:, s]
                a = np.where(real[:, s, None], new, a)
                alpha[:, s] = a
            end = a + t[:, NONE]
            z = np.log(np.exp(end - end.max(axis=1, keepdims=True)).sum(axis=1)) + end.max(axis=1)
            last = real.sum(axis=1) - 1
            b = np.zeros((m, k))
            gm = np.zeros((k, k))
            for s in range(size - 1, -1, -1):
                b = np.where((s == last)[:, None], t[:, NONE][None, :], b)
                beta[:, s] = b
                if s:
                    live = real[:, s]
                    into = e[:, s] + b
                    pair = alpha[:, s - 1][:, :, None] + t[None] + into[:, None, :] - z[:, None, None]
                    gm += np.exp(np.minimum(pair[live], 0.0)).sum(axis=0)
                    top = into.max(axis=1, keepdims=True)
                    b = np.where(live[:, None], np.log(np.exp(into - top) @ np.exp(t).T + 1e-300) + top, b)
            p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0.0)) * real[:, :, None]
            np.add.at(p, (*np.nonzero(real), y[real]), -1.0)
            both = real[:, 1:]
            np.add.at(gm, (y[:, :-1][both], y[:, 1:][both]), -1.0)
            for q, o in enumerate(OFFSETS):
                at, f = (own_at, own_f) if o == 0 else (near_at, near_f)
                by = np.zeros((nt + 1, k))
                np.add.at(by, x[:, 2 + o : 2 + o + size][real], p[real])
                g = l2 * (w[q] - pulled[q])
                np.add.at(g, f, by[at])
                grad_w[q] += g * g
                w[q] -= rate * g / np.sqrt(grad_w[q])
            gm = np.where(banned, 0.0, gm) + l2 * moves
            grad_m += gm * gm
            moves -= rate * gm / np.sqrt(grad_m)
            if 2 * epoch >= epochs:  # the mean of the later steps is steadier than the last one
                sum_w += w
                sum_m += moves
                summed += 1
    w, moves = sum_w / summed, sum_m / summed
    return Tagger(index, w.astype(np.float32), np.where(banned, -1e4, moves).astype(np.float32))


_WORKER: dict[int, Tagger] = {}
_MODEL: list[Tagger] = []


def default_tagger() -> Tagger:
    """The tagger of the repository's labelled table, trained once for each driver process."""
    if not _MODEL:
        _MODEL.append(train())
    return _MODEL[0]


def _on_worker(shared) -> Tagger:
    """The worker's tagger, built once from the broadcast weights (their size is set by the labelled table)."""
    key = id(shared.value)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Tagger(*shared.value)
    return _WORKER[key]


def _share(df: DataFrame, tagger: Tagger | None):
    tagger = tagger or default_tagger()
    return df.sparkSession.sparkContext.broadcast((tagger.index, tagger.weights, tagger.moves))


def find(df: DataFrame, key: str, texts: dict[str, str], tagger: Tagger | None = None) -> DataFrame:
    """(key, field, kind, start_pos, end_pos): one row for each mention.

    ``texts`` maps a field's name to its column. Null and empty texts have no mention; repeated rows
    have theirs repeatedly. Texts are read whole.
    """
    shared = _share(df, tagger)
    fields = list(texts)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = _on_worker(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for n, field in enumerate(fields):
                    found = model.mentions(batch.column(1 + n).to_pylist())
                    index = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                    rows = [r for f in found for r in f]
                    k, s, e = zip(*rows, strict=True) if rows else ((), (), ())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(index), pa.array([field] * len(rows), pa.string()), pa.array(k, pa.string()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], [key, "field", "kind", "start_pos", "end_pos"])

    columns = [F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(texts.values())]
    return df.select(F.col(key), *columns).mapInArrow(run, f"`{key}` {kind}, field string, kind string, start_pos int, end_pos int")


def redact(df: DataFrame, key: str, texts: dict[str, str], tagger: Tagger | None = None) -> DataFrame:
    """(key, field, text): every text with each mention replaced by the placeholder of its kind; nulls stay null."""
    shared = _share(df, tagger)
    fields = list(texts)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = _on_worker(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for n, field in enumerate(fields):
                    source = batch.column(1 + n).to_pylist()
                    out = [None if t is None else replace(t, m) for t, m in zip(source, model.mentions(source), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([field] * len(out), pa.string()), pa.array(out, pa.string())], [key, "field", "text"])

    columns = [F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(texts.values())]
    return df.select(F.col(key), *columns).mapInArrow(run, f"`{key}` {kind}, field string, text string")


def replace(text: str, mentions: list[tuple[str, int, int]]) -> str:
    """The text with its mentions replaced."""
    out, at = [], 0
    for kind, s, e in mentions:
        out += (text[at : s - 1], PLACEHOLDERS[kind])
        at = e
    return "".join(out) + text[at:]
