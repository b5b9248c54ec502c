"""Tokens against the public encoder; packing against its own invariants."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.llm import packing, tokenize

tiktoken = pytest.importorskip("tiktoken")

TEXTS = ["", None, " ", "  \n\n  x", "città è più   bella!!\t\t\n", "I'll we've don't 'S", "Привет мир 你好 🎉🎉", "a" * 3000, "=" * 700 + "x", "   spazio", "1234567 12.3e5", "\x1c\x85a"]


@pytest.fixture(scope="module")
def bpe():
    return tokenize.Bpe(tokenize.read_ranks(tokenize.vocabulary_path()))


@pytest.fixture(scope="module")
def public():
    ranks = tokenize.read_ranks(tokenize.vocabulary_path())
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_public_encoder(bpe, public):
    rng = random.Random(5)
    words = [t for t in TEXTS if t] + ["".join(rng.choice("abèé ßÀ'\n 01.-<>中я🎉") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    for text in words:
        assert bpe.encode(text) == public.encode_ordinary(text), repr(text)


def test_encode_rows(spark, bpe):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")], "doc_id long, text string, ids string")
    rows = tokenize.encode(df).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == sorted([(i, bpe.encode(t)) for i, t in enumerate(TEXTS)] + [(3, bpe.encode(TEXTS[3]))])
    assert tokenize.encode(df.limit(0)).count() == 0


def check(sizes, capacity, rows):
    bins, seen = {}, {}
    for r in rows:
        if r.bin_id is None:
            assert r.n == 0
            continue
        bins.setdefault(r.bin_id, []).append(r.n)
        seen.setdefault(r.doc_id, []).append((r.start, r.n))
    assert all(sum(b) <= capacity for b in bins.values())
    assert sorted(bins) == list(range(len(bins)))
    for i, n in sizes:
        if n:
            at = 0
            for start, k in sorted(seen[i]):
                assert start == at
                at += k
            assert at == n and (n > capacity or len(seen[i]) == 1)
    return len(bins)


def test_pack(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 7, 7, 7, rng.randint(1, 150), rng.randint(1, 40)])) for i in range(1500)] + [(9000, None)]
    df = spark.createDataFrame([(i, n, 1) for i, n in sizes], "doc_id long, n_tokens int, capacity int")
    kinds = spark.createDataFrame([(1, "a", 50), (2, "b", 100), (3, "c", None), (4, "d", 0)], "container_id int, label string, capacity int")
    rows = packing.pack(df, kinds).collect()
    total = sum(n or 0 for _, n in sizes)
    for i, capacity in ((1, 50), (2, 100)):
        own = [r for r in rows if r.container_id == i]
        assert {r.doc_id for r in own} == {k for k, _ in sizes}
        used = check([(k, n or 0) for k, n in sizes], capacity, own)
        assert used <= total / capacity * 1.02 + 2
    assert packing.pack(df.limit(0), kinds).count() == 0
    assert packing.pack(df, kinds.limit(0)).count() == 0


def test_plan_ties_and_one_length():
    assert packing.plan({}, 10) == []
    assert packing.plan({10: 3}, 10) == [(10, 0, 3, 0, 1)]
    assert packing.bins_used(packing.plan({3: 7}, 10)) == 3
    assert packing.bins_used(packing.plan({6: 2, 4: 2}, 10)) == 2


def test_capacities_beyond_any_packed_code(spark):
    big = (1 << 24) + 5
    sizes = spark.createDataFrame([(1, 5), (2, big), (3, big - 5)], "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([(1, big), (2, 1 << 20)], "container_id int, capacity int")
    got = {(r.doc_id): r.bin_id for r in packing.pack(sizes, kinds).where("container_id = 1").collect()}
    assert got[1] == got[3] != got[2]
