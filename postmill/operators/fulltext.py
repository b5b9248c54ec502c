"""Full-text search: the MATCH grammar and a positional token index that answers it without reading texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text

FIELDS = ("subject", "sender", "recipients", "body", "attachments")


@dataclass(frozen=True)
class Phrase:
    """Words in a row; the last one may be a prefix. ``first``: only at the start of a field."""

    words: tuple[str, ...]
    prefix: bool = False
    fields: tuple[str, ...] = FIELDS
    first: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases with at most ``distance`` words between the end of one and the start of the next."""

    phrases: tuple[Phrase, ...]
    distance: int = 10
    fields: tuple[str, ...] = FIELDS


@dataclass(frozen=True)
class Both:
    """AND, OR or NOT (the left side without the right one)."""

    how: str
    left: object
    right: object


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([(){}:+,^*-])|([^\s"(){}:+,^*-]+))')


class _Reader:
    """Recursive descent over: or := and (OR and)*; and := not (AND? not)*; not := unit (NOT unit)*."""

    def __init__(self, query: str):
        self.tokens: list[str] = []
        at = 0
        while query[at:].strip():
            m = _TOKEN.match(query, at)
            if not m:
                raise ValueError("unbalanced quotes")
            self.tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        t = self.peek()
        if not t or (wanted and t != wanted):
            raise ValueError(f"expected {wanted or 'a word'} at {t or 'the end'}")
        self.at += 1
        return t

    def either(self, fields):
        out = self.every(fields)
        while self.peek() == "OR":
            self.take()
            out = Both("or", out, self.every(fields))
        return out

    def every(self, fields):
        out = self.without(fields)
        while self.peek() and self.peek() not in ("OR", "NOT", ")"):
            if self.peek() == "AND":
                self.take()
            out = Both("and", out, self.without(fields))
            while self.peek() == "NOT":
                self.take()
                out = Both("not", out, self.unit(fields))
        return out

    def without(self, fields):
        out = self.unit(fields)
        while self.peek() == "NOT":
            self.take()
            out = Both("not", out, self.unit(fields))
        return out

    def columns(self, fields):
        """A column filter in front of a unit, or the fields as they are."""
        start, other = self.at, False
        if self.peek() == "-":
            self.take()
            other = True
        names = []
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                names.append(self.take())
            self.take()
        elif re.fullmatch(r"\w+", self.peek()):
            names = [self.take()]
        if not names or self.peek() != ":":
            if other:
                raise ValueError("expected a column")
            self.at = start
            return fields
        self.take(":")
        for n in names:
            if n not in FIELDS:
                raise ValueError(f"no such field: {n}")
        return tuple(f for f in fields if (f in names) != other)

    def unit(self, fields):
        fields = self.columns(fields)
        if self.peek() == "(":
            self.take()
            out = self.either(fields)
            self.take(")")
            return out
        if self.peek() == "NEAR" and self.peek(1) == "(":
            self.take()
            self.take()
            phrases, distance = [], 10
            while self.peek() != ")":
                if self.peek() == ",":
                    self.take()
                    distance = int(self.take())
                    break
                phrases.append(self.phrase(fields))
            self.take(")")
            if not phrases:
                raise ValueError("empty search")
            return Near(tuple(phrases), distance, fields)
        return self.phrase(fields)

    def phrase(self, fields) -> Phrase:
        first = self.peek() == "^"
        if first:
            self.take()
        words: list[str] = []
        while True:
            t = self.take()
            if t in ("AND", "OR", "NOT") or re.fullmatch(r"[(){}:+,^*-]", t):
                raise ValueError(f"unexpected {t}")
            words += _words(t[1:-1].replace('""', '"') if t.startswith('"') else t)
            if self.peek() != "+":
                break
            self.take()
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        if not words:
            raise ValueError("empty search")
        return Phrase(tuple(words), prefix, fields, first)


_FOLDED = str.maketrans(text.ACCENTED, text.PLAIN)


def _words(t: str) -> list[str]:
    return re.findall(r"[^\W_]+", t.lower().translate(_FOLDED))


def parse_match(query: str):
    """The tree of a MATCH string; a query that cannot be read raises ValueError.

    Grammar: words joined by AND (or nothing), OR, NOT and parentheses, "a phrase" or word + word,
    prefix*, ^first word, field:, {several fields}: and -field: before a unit, NEAR(a b, words between).
    """
    reader = _Reader(query)
    out = reader.either(FIELDS)
    if reader.peek():
        raise ValueError(f"unexpected {reader.peek()}")
    return out


def _phrases(tree) -> list[Phrase]:
    if isinstance(tree, Both):
        return _phrases(tree.left) + _phrases(tree.right)
    return list(tree.phrases) if isinstance(tree, Near) else [tree]


def _compile(tree, starts) -> Column:
    """The tree as a boolean Column; ``starts(phrase, field)`` gives the array of positions where a phrase starts."""
    if isinstance(tree, Both):
        a, b = _compile(tree.left, starts), _compile(tree.right, starts)
        return a & b if tree.how == "and" else a | b if tree.how == "or" else a & ~b
    hit = F.lit(False)
    for f in tree.fields:
        if isinstance(tree, Near):
            hit = hit | _close(tree, [starts(p, f) for p in tree.phrases])
        else:
            at = starts(tree, f)
            hit = hit | (F.array_contains(at, 0) if tree.first else F.size(at) > 0)
    return hit


def _close(near: Near, found: list[Column]) -> Column:
    """Whether the phrases can be chosen so that all lie within the distance of each other."""
    # a clump: what lies between the first end and the last start is at most the distance
    size = [len(p.words) for p in near.phrases]
    ok = F.lit(True)
    for at in found:
        ok = ok & (F.size(at) > 0)
    if len(found) == 1:
        return ok

    def from_(k: int, low: Column, high: Column) -> Column:
        if k == len(found):
            return high - low <= near.distance
        return F.exists(found[k], lambda p: from_(k + 1, F.least(low, p + size[k]), F.greatest(high, p)))

    return ok & F.exists(found[0], lambda p: from_(1, p + size[0], p))


def _field_words(field: str) -> Column:
    return F.filter(F.split(text.fold(F.coalesce(F.col(field), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def matches(query: str) -> Column:
    """A MATCH string as one boolean expression over the fields' texts, for a scan without an index."""

    def starts(p: Phrase, field: str) -> Column:
        words = _field_words(field)
        last = len(p.words) - 1

        def here(w: Column, i: Column) -> Column:
            ok = (w.startswith(p.words[0]) if p.prefix and not last else w == p.words[0])
            for k, word in enumerate(p.words[1:], 1):
                then = F.coalesce(F.get(words, i + k), F.lit(""))
                ok = ok & (then.startswith(word) if p.prefix and k == last else then == word)
            return F.when(ok, i)

        return F.array_compact(F.transform(words, here))

    return F.coalesce(_compile(parse_match(query), starts), F.lit(False))


def token_index(df: DataFrame, key: str = "rowid_fts", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Inverted index (token, key, field): one row for each distinct word of a field."""
    listed = F.array(*[F.struct(F.lit(f).alias("field"), text.tokens(F.col(f)).alias("words")) for f in fields])
    return df.select(key, F.inline(listed)).select(F.explode("words").alias("token"), key, "field")


def build_index(df: DataFrame, path: str, key: str = "rowid_fts", fields: tuple[str, ...] = FIELDS, salts: int = 8) -> None:
    """Write the positional index: token, key, field, positions (from 0), sorted by token so that a search reads few row groups.

    A word of a third of all texts is spread over ``salts`` tasks.
    """
    listed = F.array(*[F.struct(F.lit(f).alias("field"), _field_words(f).alias("words")) for f in fields])
    words = df.select(F.col(key).alias("key"), F.inline(listed)).select("key", "field", F.posexplode("words").alias("at", "token"))
    words = words.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    found = words.groupBy("salt", "token", "field", "key").agg(F.collect_list("at").alias("positions"))
    found.repartition("token", "salt").sortWithinPartitions("token").select("token", "field", "key", "positions").write.mode("overwrite").parquet(path)


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Keys of the texts that a MATCH string finds, from the index alone; only rows of its words are read."""
    tree = parse_match(query)
    terms = sorted({(w, p.prefix and k == len(p.words) - 1) for p in _phrases(tree) for k, w in enumerate(p.words)})
    token = F.col("token")
    wanted = F.lit(False)
    for word, prefix in terms:
        wanted = wanted | (token.startswith(word) if prefix else token == word)
    rows = spark.read.parquet(path).where(wanted)
    columns = {}
    for n, (word, prefix) in enumerate(terms):
        for m, f in enumerate(FIELDS):
            here = (token.startswith(word) if prefix else token == word) & (F.col("field") == f)
            columns[word, prefix, f] = f"_{n}_{m}", F.flatten(F.collect_list(F.when(here, F.col("positions"))))
    found = rows.groupBy("key").agg(*[c.alias(n) for n, c in columns.values()])

    def starts(p: Phrase, field: str) -> Column:
        last = len(p.words) - 1
        at = [F.col(columns[w, p.prefix and k == last, field][0]) for k, w in enumerate(p.words)]
        return F.filter(at[0], lambda i: _all([F.array_contains(at[k], i + k) for k in range(1, len(at))]))

    return found.where(_compile(tree, starts)).select("key")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def snippet(c: Column, word: str | list[str], size: int = 16) -> Column:
    """About ``size`` words around the first occurrence of one of the words, cut ends marked; null where none occurs."""
    wanted = [word] if isinstance(word, str) else word
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    hit = lambda w: _any([text.fold(w).contains(x.lower().translate(_FOLDED)) for x in wanted])
    at = F.array_position(F.transform(words, hit), True).cast("int")
    start = F.greatest(at - size // 2, F.lit(1))
    body = F.array_join(F.slice(words, start, F.lit(size)), " ")
    return F.when(at > 0, F.concat(F.when(start > 1, " … ").otherwise(""), body, F.when(start + size <= F.size(words), " … ").otherwise("")))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def with_snippets(hits: DataFrame, texts: DataFrame, query: str, key: str = "rowid_fts", field: str = "body") -> DataFrame:
    """Search hits and a snippet of the field around the query's words; only the hits' texts are read."""
    words = sorted({w for p in _phrases(parse_match(query)) for w in p.words})
    return hits.join(texts.select(key, field), key).select(key, snippet(F.col(field), words).alias("snippet"))
