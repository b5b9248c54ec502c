"""Exact byte-level BPE by per-prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding. It is found among
the vocabulary's tokens that are suffixes of the prefix (an automaton over the vocabulary lists
them in one pass) by testing whether the token is compatible with the one that ends the shorter
prefix. Back-pointers then give the ids. Work is linear in the piece, however long it is, and no
merge queue is kept.
"""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits a text before the merges; white space is spelled out by its Unicode property so that no
#: engine's own notion of it matters. Fixed value of the public vocabulary.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", root: str | None = None) -> str:
    """Where a public vocabulary lies: ``root``, else POSTMILL_TOKENIZERS, else the installed package."""
    root = root or os.environ.get("POSTMILL_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder of one vocabulary. The piece cache is bounded by ``cache`` entries and only saves time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, cache: int = 200_000):
        import ahocorasick

        self.ranks, self.cache_size, self.cache = ranks, cache, {}
        self.find = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.length = [0] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.pairs: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.length[i] = len(token)
            if len(token) > 1 and (two := self._halves(token, i)):
                self.left[i], self.right[i] = two
                self.pairs[two] = i
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merge of ``rank`` joins: those left when only earlier merges run."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                if (r := self.ranks.get(parts[k] + parts[k + 1], rank)) < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's is exactly [a, b].

        Merges are undone from the latest on; the pair fails as soon as some earlier merge would
        have joined the two sides across their border.
        """
        bound = len(self.length)
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < bound:
                return False
            halves_a, halves_b = self.right[a] != a, self.left[b] != b
            if halves_a and (a > b or not halves_b):
                bound, a = a, self.right[a]
            elif halves_b:
                bound, b = b + 1, self.left[b]
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        data = text.encode("utf-8")
        n = len(data)
        last = [-1] * (n + 1)
        length, compatible = self.length, self.compatible
        for end, token in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                last[end] = token
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null one has none."""
        if not text:
            return []
        cache, out = self.cache, []
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= 64:
                    if len(cache) >= self.cache_size:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, Bpe] = {}


def encoder(path: str) -> Bpe:
    """The worker's encoder of the vocabulary at ``path``, built once for each Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Bpe(read_ranks(path))
    return _ENCODERS[path]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of each row. Null and empty texts have an empty list; repeated rows stay repeated.

    Only the two columns are read; no row is shuffled.
    """
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([bpe.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens) of each row; null and empty texts count 0."""
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = encoder(path)
        for batch in batches:
            counts = np.fromiter((len(bpe.encode(t)) for t in batch.column(1).to_pylist()), np.int32, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], [key, "n_tokens"])

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_tokens int")
