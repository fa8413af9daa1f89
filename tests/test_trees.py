import heapq
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from spanmill.operators import metrics
from spanmill.plans import boosting, model, registry
from spanmill.plans.trees import Ensemble, parse, written

HAND = """tree
version=v4
num_class=1
num_tree_per_iteration=1
label_index=0
max_feature_idx=2
objective=binary sigmoid:2
feature_names=a b c
feature_infos=[0:9] [0:9] [0:9]
tree_sizes=1 1 1

Tree=0
num_leaves=4
num_cat=0
split_feature=0 1 2
split_gain=10 5 2.5
threshold=3.5 2 0.5
decision_type=2 8 10
left_child=1 -1 -2
right_child=2 -3 -4
leaf_value=0.25 -0.5 1 2
leaf_count=1 2 3 4
is_linear=0
shrinkage=0.05


Tree=1
num_leaves=1
num_cat=0
leaf_value=-0.125
shrinkage=0.05


Tree=2
num_leaves=3
num_cat=0
split_feature=2 2
split_gain=1 7
threshold=0 -1
decision_type=4 6
left_child=1 -1
right_child=-2 -3
leaf_value=10 20 40
shrinkage=0.05


end of trees

feature_importances:
a=1

parameters:
end of parameters

pandas_categorical:null
"""


def by_hand(a, b, c):
    """The three trees, rule by rule."""
    nan = math.isnan
    # decision 2: missing isn't treated, so NaN is 0; 8: NaN goes right; 10: NaN goes left
    if (0.0 if nan(a) else a) <= 3.5:
        x = 0.25 if not nan(b) and b <= 2 else 1.0
    else:
        x = -0.5 if nan(c) or c <= 0.5 else 2.0
    # decision 4: zero and NaN go right; 6: they go left
    zero = nan(c) or abs(c) <= 1e-35
    if not zero and c <= 0:
        y = 10.0 if c <= -1 else 40.0
    else:
        y = 20.0
    return x - 0.125 + y


def test_text_of_a_model(spark):
    e = parse(HAND)
    values = [-2.0, -1.0, 0.0, 1e-36, 0.5, 2.0, 3.5, 4.0, float("nan")]
    rows = [(a, b, c) for a in values for b in values for c in values]
    want = [by_hand(*r) for r in rows]
    assert e.margins(np.array(rows)).tolist() == want
    df = spark.createDataFrame([(*r, w) for r, w in zip(rows, want, strict=True)] + [(None, None, None, by_hand(*[float("nan")] * 3))], "a double, b double, c double, w double")
    got = df.select("w", e.margin().alias("m"), e.probability().alias("p")).collect()
    assert all(r.m == r.w and math.isclose(r.p, 1 / (1 + math.exp(-2 * r.w))) for r in got)
    again = parse(written(e))
    assert written(again) == written(e) and again.margins(np.array(rows)).tolist() == want and again.slope == 2.0
    assert e.importance() == [("a", 10.0, 1), ("c", 10.5, 3), ("b", 5.0, 1)] or e.importance()[0] == ("c", 10.5, 3)


@pytest.mark.parametrize("broken", [("num_cat=0\nsplit", "num_cat=1\nsplit"), ("is_linear=0", "is_linear=1"), ("leaf_value=0.25 -0.5 1 2", "leaf_value=0.25 -0.5 1"), ("num_class=1", "num_class=3"), ("decision_type=2 8 10", "decision_type=3 8 10")])
def test_texts_that_cannot_be_read(broken):
    with pytest.raises(ValueError):
        parse(HAND.replace(*broken))


def test_a_folder_from_elsewhere(spark, tmp_path):
    (tmp_path / "lgbm_model.txt").write_text(HAND)
    (tmp_path / "features.json").write_text('["a", "b", "c"]')
    (tmp_path / "threshold.json").write_text('{"tau": 0.75}')
    b = model.load(str(tmp_path))
    df = spark.createDataFrame([(1.0, 5.0, -3.0)], "a double, b double, c double")
    assert b.threshold == 0.75 and math.isclose(b.score(df).first().raw, 1 / (1 + math.exp(-2 * by_hand(1.0, 5.0, -3.0))))


def samples(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 40, n), rng.integers(0, 6, n), rng.integers(0, 100, n)]).astype(float)
    x[rng.random(n) < 0.1, 1] = np.nan
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] / 10 - 2 + np.where(x[:, 1] == 3, 2.0, -0.5))))).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, label int")


def brute_tree(x, g, h, leaves, least):
    """Best first, one split at a time; every place of every feature is tried."""
    low = np.where(np.isnan(x), -np.inf, x)

    def best(rows):
        top = None
        for f in range(x.shape[1]):
            for v in np.unique(low[rows, f]):
                left = low[rows, f] <= v
                if min(left.sum(), (~left).sum()) >= least:
                    a, b = rows[left], rows[~left]
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum()
                    if top is None or gain > top[0] + 1e-9:
                        top = (gain, f, v, a, b)
        return top

    heap, done, k = [], [], 0
    ready = [np.arange(len(x))]
    out = []
    while True:
        for rows in ready:
            if (b := best(rows)) and b[0] > 1e-9:
                heapq.heappush(heap, (-b[0], k, rows, b))
            else:
                out.append(rows)
            k += 1
        if not heap or len(done) + 1 == leaves:
            break
        _, _, rows, b = heapq.heappop(heap)
        done.append((round(b[0], 6), b[1], b[2]))
        ready = [b[3], b[4]]
    return sorted(done), [rows for _, _, rows, _ in heap] + out


@pytest.mark.parametrize("leaves", [2, 7, 64])
def test_trees_equal_brute_force(spark, leaves):
    x, y = samples()
    df = frame(spark, x, y).repartition(4)
    e, kept, weight, _ = boosting.boost(df, df.limit(0), ["a", "b", "c"], rounds=2, maxLeaves=leaves, minInstancesPerNode=50, featureShare=1.0, subsamplingRate=1.0)
    assert kept == 2 and math.isclose(weight, (y == 0).sum() / (y == 1).sum())
    w, m = np.where(y == 1, weight, 1.0), np.zeros(len(y))
    for tree in e.trees:
        p = 1 / (1 + np.exp(-m))
        splits, parts = brute_tree(x, w * (p - y), w * p * (1 - p), leaves, 50)
        assert sorted((round(g, 6), int(f), -np.inf if t < -1e308 else t) for g, f, t in zip(tree.gain, tree.feature, tree.threshold, strict=True)) == splits
        at = tree.leaves(x)
        assert len(parts) == len(tree.value) <= leaves and all(len(set(at[rows])) == 1 and len(rows) >= min(50, len(y)) for rows in parts)
        for rows in parts:
            g, h = (w * (p - y))[rows].sum(), (w * p * (1 - p))[rows].sum()
            assert math.isclose(tree.value[at[rows[0]]], -0.05 * g / h, abs_tol=1e-9)
        m = m + tree.value[at]
    assert np.allclose(e.margins(x), m)
    assert e.importance()[0][1] == max(sum(t.gain[t.feature == f].sum() for t in e.trees) for f in range(3))


def test_patience_and_warm_rounds(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SETTLED", 2)  # margins written anew twice
    x, y = samples(900, 2)
    df = frame(spark, x, y)
    train, val = df.where("c < 70"), df.where("c >= 70")
    how = {"minInstancesPerNode": 20, "stepSize": 0.6, "maxLeaves": 8}
    full, kept, _, losses = boosting.boost(train, val, ["a", "b"], rounds=6, patience=6, **how)
    assert len(losses) == 6 and kept == int(np.argmin(losses)) + 1 == len(full.trees)
    short, early, _, fewer = boosting.boost(train, val, ["a", "b"], rounds=6, patience=1, **how)
    # the beginning is the same, and rounds stop when the patience is spent
    assert fewer == losses[: len(fewer)] and written(Ensemble(short.trees, ["a", "b"])) == written(Ensemble(full.trees[:early], ["a", "b"]))
    # the loss is that of the margins
    rows = np.array([(r.a, r.b, r.label) for r in val.select("a", "b", "label").collect()], float)
    weight = metrics.class_weight(train, "label").first()[0]
    w, m = np.where(rows[:, 2] == 1, weight, 1.0), full.margins(rows[:, :2])
    assert math.isclose(losses[kept - 1], (w * np.logaddexp(0, np.where(rows[:, 2] == 1, -m, m))).sum() / w.sum())


@pytest.mark.parametrize("depth", [None, 3])
def test_small_nodes_are_finished_in_one_pass(spark, monkeypatch, depth):
    """The trees don't depend on where a node is finished; where all rows fit in a task, a round is one pass."""
    x, y = samples(1500, 4)
    df = frame(spark, x, y).repartition(3)
    train, val = df.where("c < 70"), df.where("c >= 70")
    texts, passes = [], []
    pandas = type(df).toPandas
    for rows in (1, 400, 50_000):
        monkeypatch.setattr(boosting, "TASK_ROWS", rows)
        ran = []
        monkeypatch.setattr(type(df), "toPandas", lambda d, ran=ran: ran.append(1) or pandas(d))
        e, kept, _, losses = boosting.boost(train, val, ["a", "b", "c"], rounds=2, minInstancesPerNode=20, maxLeaves=8, maxDepth=depth, stepSize=0.3)
        passes.append(len(ran))
        assert len(losses) == 2
        texts.append([[(t.feature.tolist(), t.threshold.tolist(), t.left.tolist(), t.right.tolist(), np.round(t.value, 9).tolist(), t.count.tolist()) for t in e.trees], np.round(losses, 9).tolist()])
        monkeypatch.undo()
    # a pass for each of two trees, and one for the last loss
    assert all(t[1] == texts[0][1] for t in texts) and passes[2] == 3
    leaves = [[sorted(zip(t[4], t[5], strict=True)) for t in x[0]] for x in texts]
    assert all(x == leaves[0] for x in leaves)


def test_a_round_of_some_more_rows_is_one_pass_too(spark, monkeypatch):
    """A hundred thousand rows of a few bytes are no reason for a pass a level."""
    counted, grown = [], []
    step, finish = boosting._counted, boosting._grown
    monkeypatch.setattr(boosting, "_counted", lambda *a: counted.append(1) or step(*a))
    monkeypatch.setattr(boosting, "_grown", lambda *a: grown.append(1) or finish(*a))
    df = spark.range(60_000).selectExpr("cast(id % 97 as double) as a", "cast(id % 31 as double) as b", "cast((id % 97) * (id % 31) % 11 < 4 as int) as label")
    e, kept, _, losses = boosting.boost(df, df.where("a < 20"), ["a", "b"], rounds=2)
    assert len(losses) == 2 and len(e.trees) == kept and len(e.trees[0].value) > 8
    assert not counted and len(grown) == 3


def test_texts_are_read_once_for_training(spark, monkeypatch, tmp_path):
    docs = spark.range(400).selectExpr("id as doc_id", "concat(repeat('a. ', cast(id % 13 as int)), 'b') as text", "'en' as lang", "id % 50 as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(400).selectExpr("id as doc_id", "cast(id % 13 > 6 as int) as quality").write.parquet(f"{tmp_path}/labels.parquet")
    got = []
    fit = boosting.boost
    monkeypatch.setattr(boosting, "boost", lambda *a: got.append(a) or fit(*a, rounds=2))
    out = registry.QUERIES["gbt_fit_score"](spark, str(tmp_path))
    frames = [*got[0][:2], out]
    assert not [f for f in frames if "documents.parquet" in f._jdf.queryExecution().optimizedPlan().toString() or "Relation [" in f._jdf.queryExecution().optimizedPlan().toString()]
    assert {r.doc_id % 13: r.dots for r in got[0][0].collect()} == {k: float(k) for k in range(13)}
    assert out.count() == 60 and sum(f.count() for f in frames) == 400


def test_loss_beside_trees_by_level(spark):
    """As many rounds and leaves: the loss is no worse than that of Spark's trees, within a few hundredths."""
    x, y = samples(1600, 3)
    x = np.nan_to_num(x, nan=-1.0)
    df = frame(spark, x, y)
    train, val = df.where("c < 70").cache(), df.where("c >= 70")
    own, kept, weight, losses = boosting.boost(train, val, ["a", "b"], rounds=8, patience=8, stepSize=0.3, maxLeaves=8, minInstancesPerNode=20, featureShare=1.0, subsamplingRate=1.0)
    level = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=8, maxDepth=3, stepSize=0.15, minInstancesPerNode=20, seed=1).fit(model.assembled(train, ["a", "b"]))
    out = model.Bundle(level, ["a", "b"]).score(val).select("raw", "label").collect()
    p, t = np.array([r.raw for r in out]), np.array([r.label for r in out])
    mine = model.Bundle(own, ["a", "b"]).score(val).select("raw", "label").toPandas()
    auc = lambda p, t: np.mean([(a > b) + 0.5 * (a == b) for a in p[t == 1] for b in p[t == 0]])
    assert auc(mine["raw"].to_numpy(), mine["label"].to_numpy()) >= auc(p, t) - 0.02
    train.unpersist()


def test_odd_training_rows(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(None, float("-inf"), 1.0, i % 2) for i in range(60)] + [(rng.random(), float("inf"), 1.0, 1) for i in range(60)] + [(1.0, 1.0, 1.0, None)], "a double, b double, c double, label int")
    e, kept, _, _ = boosting.boost(df, df.limit(0), ["a", "b", "c"], rounds=2, minInstancesPerNode=20, featureShare=1.0, subsamplingRate=1.0)
    assert kept == 2 and e.trees[0].feature.tolist()[0] in (0, 1)
    assert len(set(e.margins(np.array([[np.nan, -np.inf, 1.0], [0.5, np.inf, 1.0]])).tolist())) == 2
    for part in (df.where("label = 1"), df.limit(0)):
        e, _, _, _ = boosting.boost(part, part, ["a", "b", "c"], rounds=3)
        assert np.isfinite(e.margins(np.zeros((1, 3)))).all()
    parse(written(e))
