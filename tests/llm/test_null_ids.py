"""Rows without a doc_id, and repeated rows, in the dedup stages."""

from __future__ import annotations

from tickgrid.llm import dedup, simhash

LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [(None, "alone of its kind", 1), (None, "alone of its kind", 2), (None, LONG, 3), (5, LONG + " more", 4), (6, "another text", 5), (6, "another text", 5), (None, "yet another", 6), (None, "another  text", 7)]


def test_one_row_per_group_stays(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n int").repartition(3)
    near = simhash.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in near) == ["5", "6", "6", "None", "None"]
    assert sorted(r.text for r in near if r.doc_id is None) == ["alone of its kind", "yet another"]
    first = dedup.keep_first(docs)
    assert first.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in first.collect()) == sorted([("None", "alone of its kind"), ("None", LONG), ("5", LONG + " more"), ("6", "another text"), ("None", "yet another")])


def test_exact_dedup_of_one_large_group(spark):
    """Half of all rows are one text; among them repeated rows, the same text under other white space, and null ids."""
    rows = [(i, "same  text" if i % 2 else f"text {i}") for i in range(4000)] + [(1, "same text")] * 70_000 + [(None, "same\ttext")] * 3 + [(None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = dedup.exact_groups(docs)
    sizes = {(r.keep_id, r.group_size, r.kept): r["count"] for r in out.groupBy("keep_id", "group_size", "kept").count().collect()}
    large = 2000 + 70_000 + 3
    assert sizes.pop((1, large, True)) == 1 and sizes.pop((1, large, False)) == large - 1
    assert sizes == {(i, 1, True): 1 for i in [*range(0, 4000, 2), None]}
    kept = [(r.doc_id, " ".join(r.text.split())) for r in dedup.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "same text"), (None, "alone"), *((i, f"text {i}") for i in range(0, 4000, 2))], key=str)


def test_exact_dedup_leaves_single_texts_unshuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    plan = dedup.keep_first(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and dedup.keep_first(docs).count() == 50
