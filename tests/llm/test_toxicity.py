import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanmill.llm.toxicity import Model, drop_toxic, features, fit, fold, op6_toxicity, scores, train, words


def corpus(n=3000):
    rng = random.Random(1)
    common = [f"{a}{b}" for a in ("stone", "river", "cloud", "field", "winter") for b in ("s", "ing", "ed", "ly", "er", "est")]
    bad = ["vile", "nastyone", "nastytwo", "nastythree", "wretch"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.12
        t = [rng.choice(common) + rng.choice(["", "x", "y"]) for _ in range(rng.randrange(5, 60))] + [rng.choice(bad) for _ in range(rng.randrange(1, 4) * toxic)]
        rng.shuffle(t)
        docs.append((i, " ".join(t)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return docs, labels


def test_words():
    assert words(None) == set() and words("A a%%% b2c É") == {"a", "b", "c", "é"}
    assert len(features("abcd")) == 2 and len(features("abcdefgh")) == 4 and len(features("a")) == 1


def test_fit_without_positives():
    assert fit([], [np.array([1], np.uint32)], 0.1).score("x") < 1e-6
    assert 0 <= Model({}, -50.0).score(None) < 1e-6


def test_held_out(spark):
    docs, labels = corpus()
    docs += [(9000, None), (9001, ""), (None, "vile"), (9001, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("kind", F.lit(1))
    rows = spark.createDataFrame([*labels, (77777, 1), (5, None)], "doc_id long, toxic int")
    model = train(d, rows)
    got = scores(d, model).withColumn("out", fold() == 0).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [(truth[r.doc_id], r.score) for r in got if r.out and r.doc_id in truth]
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.98 and np.mean(np.array(pos) >= 0.5) > 0.95 and np.mean(np.array(neg) < 0.5) > 0.97
    again = train(d.repartition(7), rows.repartition(3))
    assert again.weights == model.weights and again.bias == model.bias
    kept = drop_toxic(d, rows)
    assert kept.columns == d.columns and kept.count() == sum(r.score < 0.5 for r in got)


@pytest.mark.parametrize("labels", [[], [(1, 0)]])
def test_no_toxic_labels(spark, labels):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert drop_toxic(d, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 2


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = rows.withColumn("toxic", F.when(fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert train(d, rows).weights == train(d, turned).weights


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert drop_toxic(d, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_query(spark, tmp_path):
    docs, labels = corpus(600)
    docs += [(9000, None), (9001, ""), (9001, "")]
    d, rows = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    d.selectExpr("*", "'x' as score").write.parquet(f"{tmp_path}/documents.parquet")
    rows.write.parquet(f"{tmp_path}/labels.parquet")
    model = train(d, rows)

    def by_hand(text):
        """The model's sum over distinct words, without its memo."""
        z = model.bias + sum(model.weights.get(f, 0.0) for w in words(text) for f in features(w))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    got = sorted(op6_toxicity(spark, str(tmp_path)).collect())
    assert [r.doc_id for r in got] == sorted(i for i, _ in docs)
    text = dict(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(r.score - by_hand(text[r.doc_id])) < 1e-6 and r.predicted == (r.score >= 0.5)
