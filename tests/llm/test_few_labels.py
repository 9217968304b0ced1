"""Toxicity where labelled documents are few."""

from __future__ import annotations

import random

from tickgrid.llm import toxicity


def _tables(spark, texts, toxic):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")


def _plain(r):
    return ["".join(r.choice(["ti", "on", "re", "sh", "an", "the", "le"]) for _ in range(r.randrange(1, 4))) for _ in range(400)]


def test_few_toxic_documents_give_a_model(spark):
    r = random.Random(5)
    plain = _plain(r)
    toxic = [int(i % 10 == 0) for i in range(90)]
    texts = [" ".join(r.choices(plain, k=30) + ["moron", "idiot"] * t) for t in toxic]
    docs, labels = _tables(spark, texts, toxic)
    got = {x.doc_id: x.predicted for x in toxicity.classify(docs, labels).collect()}
    assert [got[i] for i in range(90)] == toxic
    assert toxicity.fit(docs.limit(2), labels.limit(2))["beta"].any()


def test_a_rare_insult_of_many_toxic_documents_is_told():
    # 12 of 1,500 toxic documents (0.8 %) and no benign one hold it; 150 stems are as common in both classes.
    told = toxicity._telling({(12, 0): 1, (150, 850): 150, (1, 5): 5000}, 6000, 1500, 8500)
    assert told == [(12, 0)]


def test_training_rows_share_a_header_but_not_a_text(spark):
    r = random.Random(6)
    plain = _plain(r)
    toxic = [i % 2 for i in range(24)]
    texts = ["Posted by a very busy source with one header for each and every text. " + " ".join(r.choices(plain, k=40)) for _ in toxic]
    texts[20] = texts[4]
    texts[21] = texts[5] + " more"
    docs, labels = _tables(spark, texts, toxic)
    learned = [i for i in range(24) if docs.sparkSession.range(1).selectExpr(f"crc32('{i}') % 4").first()[0] != 2]
    groups: dict = {}
    for i in learned:
        groups.setdefault({20: 4, 21: 5}.get(i, i), []).append(i)
    rows = toxicity.training_rows(docs.unionByName(docs.limit(3)), labels).collect()
    assert sorted(x.doc_id for x in rows) == sorted(map(min, groups.values())) and len(rows) > 8
