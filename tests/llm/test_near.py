"""The near-dedup stage against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.conftest import SF
from tickgrid.llm import near, simhash


def _sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]


def _components(texts):
    """The smallest place in each text's component, over all pairs with a Jaccard similarity of 0.8 or more."""
    sets, low = _sets(texts), list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                low[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("limit, unlike", [(1, 256), (1, 0), (4, 2), (64, 256)])
def test_near_copies_equal_brute_force(spark, monkeypatch, limit, unlike):
    monkeypatch.setattr(near, "PAIR_LIMIT", limit)
    monkeypatch.setattr(near, "UNLIKE_LIMIT", unlike)
    r = random.Random(limit)
    words = [f"w{i}" for i in range(300)]
    line = r.choices(words, k=40)
    texts = [None, "", "a b", "A  b", "a b c d e"]
    for _ in range(12):
        own = r.choices(words, k=r.randrange(30, 160)) + line
        for _ in range(10):
            new = list(own)
            for _ in range(r.randrange(7)):
                new[r.randrange(len(new))] = r.choice(words)
            texts.append(" ".join(new[r.randrange(6) :]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in near.near_copies(rows).collect()}
    want = dict(enumerate(_components(texts)))
    assert got == want and 15 < len(set(want.values())) < len(texts)
    assert sorted(x.doc_id for x in simhash.keep_one(rows).collect()) == sorted(set(want.values()))


def test_signatures_bound_the_differing_shingles(spark):
    r = random.Random(5)
    whole = [r.getrandbits(63) for _ in range(6000)]
    sets = [np.unique(np.array(x, np.int64)) for x in (whole[:2000], whole[:2100], whole[100:2300], whole[1900:4000], whole[4000:])]
    assert sorted({len(near.signature(s)) * 64 for s in sets}) == [2048, 4096]
    table = spark.createDataFrame([(i, len(s), near.signature(s).tolist()) for i, s in enumerate(sets)], "set_id long, n int, signature array<long>")
    every = [(i, j) for j in range(5) for i in range(j)]
    got = {tuple(x) for x in near._may_be_alike(spark.createDataFrame(every, "u long, v long"), table).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)} == {(i, j) for i, j in every if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}


def test_stage_finds_the_near_copies_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text")
    rows = docs.collect()
    want = [rows[i].doc_id for i in _components([x.text for x in rows])]
    assert [x.component_id for x in near.near_copies(docs).orderBy("doc_id").collect()] == want


def test_alike_sets_share_a_part_key():
    r, alike = random.Random(9), 0
    for _ in range(3000):
        whole = [r.getrandbits(62) for _ in range(r.choice([3, 5, 6, 9, 20, 60, 200, 900]))]
        a, b = list(whole), list(whole)
        for _ in range(r.randrange(2 + len(whole) // 8)):
            of = r.choice([a, b])
            of.pop(r.randrange(len(of))) if len(of) > 1 and r.random() < 0.5 else of.append(r.getrandbits(62))
        x, y = np.unique(np.array(a, np.int64)), np.unique(np.array(b, np.int64))
        shared = len(np.intersect1d(x, y))
        if 5 * shared >= 4 * (len(x) + len(y) - shared):
            alike += 1
            assert len(np.intersect1d(near.part_keys(x), near.part_keys(y))), (len(x), len(y), shared)
        assert len(near.part_keys(x)) < 4 * len(x) + 60
    assert alike > 1000


def test_a_shingle_of_thousands_of_unlike_sets_yields_few_pairs(spark, monkeypatch):
    """Short texts around one passage, some of them near copies: all share shingles that are in every prefix."""
    r, n = random.Random(3), 3000
    words = [f"w{i}" for i in range(5000)]
    passage = r.choices(words, k=14)
    texts = [r.choices(words, k=r.randrange(20, 30)) for _ in range(n)]
    texts = [t[:9] + passage + t[9:] for t in texts]
    copies = {n + k: i for k, i in enumerate(range(0, n, 50))}
    texts += [[*texts[i], "end"] for i in copies.values()]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    met = []
    join = near._may_be_alike
    monkeypatch.setattr(near, "_may_be_alike", lambda pairs, signatures: met.append(pairs.count()) or join(pairs, signatures))
    monkeypatch.setattr(near, "UNLIKE_LIMIT", 256)
    # Nothing is told to be common, so that the passage stands in many prefixes.
    monkeypatch.setattr(near, "COMMON", 10**9)
    got = {x.doc_id: x.component_id for x in near.near_copies(rows).collect()}
    assert got == {i: copies.get(i, i) for i in range(len(texts))}
    assert len(met) == 2 and 20 * met[1] < n * (n - 1) / 2, met
