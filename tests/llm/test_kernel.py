"""The string kernel against its definition, the folded model against the unfolded one, and held-out documents."""

from __future__ import annotations

import os
import zlib
from itertools import combinations

import numpy as np
import pytest

from tickgrid.llm import toxicity

WORDS = ["idiot", "idi-ot", "idxiot", "iddiot", "tionre", "abcabcabc", "ab", "a.b.c", "zzzzzzzzzzzzzzzz", "worthless"]


def _plain_vector(word: str) -> dict[str, float]:
    """All subsequences of three letters within SPAN places, each with DECAY per place between its ends."""
    out: dict[str, float] = {}
    squares = 0.0
    for i, j, k in combinations(range(len(word)), 3):
        s = word[i] + word[j] + word[k]
        if k - i < toxicity.SPAN and all("a" <= c <= "z" for c in s):
            w = toxicity.DECAY ** (k - i - 2)
            out[s] = out.get(s, 0) + w
            squares += w * w
    return {s: v / max(squares, 1e-9) ** 0.5 for s, v in out.items()}


def test_kernel_equals_its_definition():
    got = toxicity.vectors(WORDS)
    plain = [_plain_vector(w) for w in WORDS]
    want = [[sum(v * b.get(s, 0) for s, v in a.items()) for b in plain] for a in plain]
    assert np.allclose(got @ got.T, want, atol=1e-5)


def test_folded_weights_equal_the_svm():
    positive, negative = {"idiot": 2.0, "moron": 1.0}, {w: 1.0 for w in ("tionre", "stable", "ander", "ablesh")}
    land = ["idiot", "moron", "tionre", "stable"]
    beta, bias = toxicity.fit_words(positive, negative, land)
    vector, white = toxicity.nystroem(land)
    features = toxicity.vectors(WORDS) @ vector.T @ white
    # The SVM's weights in feature space, by solving for them from its values on the landmarks.
    w = np.linalg.lstsq(vector @ vector.T @ white, vector @ beta, rcond=None)[0]
    assert np.allclose(toxicity.vectors(WORDS) @ beta, features @ w, atol=1e-4)
    score = dict(zip(WORDS, toxicity.margins(WORDS, beta, bias)))
    assert score["idiot"] > 0.5 and score["idxiot"] > 0 and score["tionre"] < 0


@pytest.mark.parametrize("sf,recall,false", [("sf0.1", 0.9, 0.03)])
def test_held_out_documents(spark, sf, recall, false):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip(f"no {path}")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").select("doc_id", "predicted", "toxic").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    bad, good = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in bad) >= recall * len(bad) and sum(r.predicted for r in good) <= false * len(good)


def test_odd_texts(spark):
    texts = [None, "", " ", ".", "word " * 200_000, "x" * 1_000_000, "ß漢字 é 😀", "a.b.c.d", "idiot " * 5]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 8)) for i in range(27)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 27 and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id % 9 == 8} == {1}
