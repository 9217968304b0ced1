"""Pipeline stages on tables whose other columns have odd or clashing names."""

from __future__ import annotations

import pytest

from tests.conftest import SF
from tickgrid.llm import dedup, pii, simhash, toxicity

ODD = "doc_id long, text string, `a.b` long, `__set` long, `c0` long, `component` string, `a``b c` long, `label` int"


@pytest.mark.parametrize("stage", ["toxic", "exact", "near", "pii"])
def test_stages_keep_odd_columns(spark, stage):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, i, 2, 3, "x", 4, 5) for i, t in enumerate([words, words + " more", None, "", "other text"])] + [(None, "null id", 9, 2, 3, "x", 4, 5)] * 2
    df = spark.createDataFrame(rows, ODD)
    run = {
        "toxic": lambda: toxicity.reject_toxic(df, spark.read.parquet(f"{SF}/labels.parquet").limit(0)),
        "exact": lambda: dedup.keep_first(df),
        "near": lambda: simhash.keep_one(df),
        "pii": lambda: pii.redact(df),
    }
    out = run[stage]()
    assert out.columns == df.columns
    got = {r["a.b"]: (r["__set"], r["c0"], r["component"], r["a`b c"], r["label"]) for r in out.collect()}
    assert set(got.values()) == {(2, 3, "x", 4, 5)} and 4 in got and 0 in got
    assert (1 in got) == (stage != "near")
