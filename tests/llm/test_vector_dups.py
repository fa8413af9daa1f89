import numpy as np
import pytest
from pyspark.sql import functions as F
from spanmill.llm import vector_dups
from spanmill.llm.vector_dups import centres, margin, near_vectors, op11_vector_dups

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """n_links and component of each row, pair by pair."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, k in enumerate(good):
        x = np.array(rows[k][1], float)
        for j in good[a + 1 :]:
            y = np.array(rows[j][1], float)
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                n[k] += 1
                n[j] += 1
                up[max(root(k), root(j))] = min(root(k), root(j))
    names = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        names[r] = min((x for x in (names.get(r), i) if x is not None), default=None)
    return sorted(((i, n[k], names[root(k)], i == names[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def clustered(rng, dim=12, groups=10, each=25, wide=0.28):
    """Points round centres, many pairs near the threshold on either side."""
    c = rng.standard_normal((groups, dim))
    return [(c[i % groups] + wide * rng.standard_normal(dim)).round(4).tolist() for i in range(groups * each)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CELL_ROWS", 12), ("BLOCK_ROWS", 7), ("SLICE", 5)):
        monkeypatch.setattr(vector_dups, name, value)


def test_brute_force(spark, small):
    rng = np.random.default_rng(1)
    vectors = clustered(rng)
    # a dense group, a chain, copies in another length and scale, and what takes no part
    vectors += [(np.ones(12) + 0.05 * rng.standard_normal(12)).tolist() for _ in range(60)]
    vectors += [[float(np.cos(k * 0.3)), float(np.sin(k * 0.3))] + [0.0] * 10 for k in range(20)]
    rows = list(enumerate(vectors))
    rows += [(400 + k, [1e100 * x for x in vectors[k]]) for k in range(5)] + [(450 + k, vectors[3]) for k in range(30)] + [(3, vectors[3]), (3, vectors[4]), (None, vectors[5]), (None, [0.0] * 11 + [-1.0])]
    rows += [(500, None), (501, []), (502, [0.0] * 12), (503, [float("nan")] + [1.0] * 11), (504, [None] + [1.0] * 11), (505, [float("inf")] + [1.0] * 11)]
    rows += [(600 + k, [1.0, 0.05 * k]) for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("x")).withColumn("n_links", F.lit("y"))
    got = sorted(map(tuple, near_vectors(df, deviations=100.0).collect()), key=str)
    assert got == brute(rows)


def test_recall(spark, small):
    """With the usual margin, on pairs just above the threshold."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        x = rng.standard_normal(32)
        z = rng.standard_normal(32)
        x /= np.sqrt(x @ x)
        z -= (z @ x) * x
        z /= np.sqrt(z @ z)
        s = rng.uniform(0.9001, 0.93)
        rows += [(2 * k, x.tolist()), (2 * k + 1, (s * x + np.sqrt(1 - s * s) * z).tolist())]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).agg(F.sum("n_links")).first()[0]
    want = sum(n for _, n, _, _ in brute(rows))
    assert want >= 800 and got <= want and got / want >= 0.95


def test_hot_group(spark, small):
    """Half of all rows in one dense group: its pairs are counted, not compared."""
    rng = np.random.default_rng(3)
    rows = [(k, (np.eye(16)[0] + 0.02 * rng.standard_normal(16)).tolist()) for k in range(200)] + [(1000 + k, rng.standard_normal(16).tolist()) for k in range(200)]
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, SCHEMA), deviations=100.0).collect()), key=str)
    assert got == brute(rows)


def test_centres_and_margin():
    rng = np.random.default_rng(4)
    c = centres(np.concatenate([x / np.linalg.norm(x, axis=1)[:, None] for x in (np.eye(8)[[0] * 200] + 0.01 * rng.standard_normal((200, 8)), rng.standard_normal((50, 8)))]), 60)
    far = c @ c.T - 2 * np.eye(len(c))
    assert far.max() < np.sqrt(0.95) and np.allclose((c * c).sum(axis=1), 1)
    assert margin(2) == pytest.approx(np.sqrt(0.19), abs=1e-6) and margin(64) < 0.12


def test_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = list(enumerate(clustered(rng, 16, 6, 12)))
    spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "cast(embedding as array<float>) as embedding", "1 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    as_read = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    got = op11_vector_dups(spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and [d for _, d in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(as_read)


def test_few_rows(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.1]), (3, [0.0, 1.0])], SCHEMA)
    assert sorted(map(tuple, near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert near_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in near_vectors(df.where("vec_id = 3")).collect()] == [(3, 0, 3, True)]
