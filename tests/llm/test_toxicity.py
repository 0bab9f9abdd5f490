import random

import numpy as np

from auditloom.llm import toxicity as tox
from tests.llm.fixtures import documents, prose

SF = "/root/testdata/sf0.1"


def test_chain_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = tox.train(docs, labels.where("doc_id % 5 <> 0"), {"low_quality": "1 - quality", "toxic": "toxic"})
    held = labels.where("doc_id % 5 = 0")
    rows = tox.score(docs, chain).join(held.withColumnRenamed("toxic", "wanted"), "doc_id").collect()
    hits = sum(r.toxic and r.wanted == 1 for r in rows)
    found, real = sum(r.toxic for r in rows), sum(r.wanted for r in rows)
    print("held out:", len(rows), "real", real, "found", found, "hits", hits, "threshold", chain.threshold)
    assert hits >= 0.5 * real and hits >= 0.7 * found


def test_planted_words_and_odd_rows(spark):
    rng = random.Random(2)
    texts = []
    for k in range(400):
        words = prose(k, 60).split()
        if k % 4 == 0:
            words[rng.randrange(60)] = "Blorgh!"
            words[rng.randrange(60)] = "blorgh"
        texts.append(" ".join(words))
    df = documents(spark, texts + [None, "", "blorgh " * 3000], extra=True)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)] + [(5000, 1, 1), (6000, None, 1)], "doc_id long, quality int, toxic int")
    chain = tox.train(df, labels, {"low_quality": "1 - quality", "toxic": "toxic"})
    found = {r.doc_id: r.toxic for r in tox.score(df, chain).collect()}
    assert len(found) == 403 and found[402] and not found[400] and not found[401]
    right = sum(found[k] == (k % 4 == 0) for k in range(300, 400))
    assert right >= 95
    assert tox.score(df.limit(0), chain).count() == 0


def test_no_labels(spark):
    df = documents(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = tox.score(df, tox.train(df, labels, {"toxic": "toxic"})).collect()
    assert [r.toxic for r in rows] == [False, False]


def test_out_of_fold_probabilities_and_threshold():
    found, wanted = np.array([0.9, 0.8, 0.7, 0.2]), np.array([1.0, 1.0, 0.0, 0.0])
    assert 0.7 < tox.best_threshold(found, wanted) < 0.8
    rows = tox.Rows(np.array([0, 2, 3, 3]), np.array([0, 5, 7], dtype=np.int32), np.array([1, 2, 3], dtype=np.float32))
    assert rows.dot(np.arange(8.0)).tolist() == [10, 21, 0]
    assert rows.take(np.array([2, 0])).dot(np.arange(8.0)).tolist() == [0, 10]


def test_bounded_sample_and_clashing_columns(spark):
    docs = documents(spark, [prose(k, 30) + (" vile" if k % 2 else " kind") for k in range(60)], extra=True)
    docs = docs.unionByName(docs.limit(5))
    labels = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic", "id as __id", "1 as body").unionByName(spark.createDataFrame([(1, 0, 0, 0), (3, None, 0, 0)], "doc_id long, toxic int, __id long, body int"))
    rules = tox.ChainRules(sample_features=2000)
    chain = tox.train(docs, labels, {"low": "1 - toxic", "toxic": "toxic"}, rules)
    assert chain.names == ["low", "toxic"] and len(chain.models) == 2
    assert tox.score(docs, chain, rules).count() == 65
