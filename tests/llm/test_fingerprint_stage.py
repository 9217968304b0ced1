"""The pipeline's near-dedup stage: SimHash keys propose, whole sets decide, and nothing else links texts."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm.test_near import _sets
from tickgrid.llm import near


@pytest.mark.parametrize("limit, unlike", [(64, 4096), (2, 0)])
def test_stage_links_alike_texts_that_share_a_fingerprint_key(spark, monkeypatch, limit, unlike):
    monkeypatch.setattr(near, "PAIR_LIMIT", limit)
    monkeypatch.setattr(near, "UNLIKE_LIMIT", unlike)
    monkeypatch.setattr(near, "_entries", None)  # the prefix index has no part in it
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    line = r.choices(words, k=60)
    texts = [None, "", "a b", "A  b"]
    for _ in range(12):
        own = r.choices(words, k=r.randrange(60, 160)) + line
        for _ in range(8):
            new = list(own)
            for _ in range(r.randrange(3)):
                new[r.randrange(len(new))] = r.choice(words)
            texts.append(" ".join(new))
    sets, keys = _sets(texts), [set(near.fingerprint_keys(near.grams(t)).tolist()) for t in texts]
    low, linked, alike = list(range(len(texts))), 0, 0

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                alike += 1
                if keys[i] & keys[j]:
                    linked += 1
                    x, y = root(i), root(j)
                    low[max(x, y)] = min(x, y)
    assert 2 * linked > alike > 100
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, rows, "").collect()) == sorted({root(i) for i in range(len(texts))})


def test_stage_pairs_grow_with_a_group_of_near_copies(spark, monkeypatch):
    r = random.Random(2)
    words, n = [f"w{i}" for i in range(5000)], 60
    own = r.choices(words, k=200)
    texts = [" ".join([*own[: 3 * i], "new", *own[3 * i + 1 :]]) for i in range(n)] + [" ".join(r.choices(words, k=200)) for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    met = []
    join = near._may_be_alike
    monkeypatch.setattr(near, "_may_be_alike", lambda pairs, signatures: met.append(pairs.count()) or join(pairs, signatures))
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, rows, "").collect()) == [0, *range(n, 2 * n)]
    assert n - 1 <= sum(met) < 12 * n, met
