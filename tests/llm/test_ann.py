import numpy as np
import pytest
from pyspark.sql import functions as F
from spanmill.llm import ann
from spanmill.llm.ann import chi2_cdf, chi2_quantile, nearest, op1_ann

RNG = np.random.default_rng(0)


def brute(rows, is_query, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if is_query(i):
            d = np.sqrt(((m - v) ** 2).sum(axis=1))
            d[ids == i] = np.inf
            at = np.lexsort((ids, d))[:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in at if np.isfinite(d[j])]
    return out


def test_chi_square():
    # the sum of squares of m normal numbers
    x = (RNG.standard_normal((200_000, 8)) ** 2).sum(axis=1)
    for q in (0.1, 0.5, 0.9, 0.99):
        assert abs((x <= chi2_quantile(q, 8)).mean() - q) < 0.005 and abs(chi2_cdf(chi2_quantile(q, 8), 8) - q) < 1e-9


@pytest.mark.parametrize("hot", [0, 400])
def test_recall(spark, monkeypatch, hot):
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
    centres = RNG.standard_normal((12, 16)) * 3
    rows = [(i, (centres[i % 12] + RNG.standard_normal(16)).round(4).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(hot)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0, 2.0]), (None, rows[0][1]), (5005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("score", F.lit(1))
    got = {}
    for r in nearest(df, F.expr("vec_id % 25 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, lambda i: i % 25 == 0, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [r for r, _, _ in g] == list(range(1, 11)) and q not in [i for _, i, _ in g]
        assert [(s, i) for _, i, s in g] == sorted((s, i) for _, i, s in g)
        hits += len({i for _, i, _ in g} & {i for i, _ in w})
    assert hits / (10 * len(want)) >= 0.95


def exactly(rows, is_query, k=10):
    """All neighbours row by row; a query with several vectors has a list for each."""
    good = [(i, np.array(v, float)) for i, v in rows]
    out = []
    for i, v in {(i, tuple(v)) for i, v in good if is_query(i)}:
        near = sorted((float(np.sqrt(((w - np.array(v)) ** 2).sum())), j) for j, w in good if j != i)[:k]
        out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("at_once", [2000, 3])
def test_equal_vectors(spark, monkeypatch, at_once):
    """A third of all rows have one vector, queries too; some ids have several rows, some several vectors."""
    monkeypatch.setattr(ann, "ASKED_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in rows]
    rows += [(1000 + i, [1.0, 2.0, 1.0, 0.0]) for i in range(150)] + [(20, [1.0, 2.0, 1.0, 0.0])] * 15 + [(40, [2.0, 2.0, 1.0, 0.0])] + [(41, rows[3][1])] * 4
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.expr("vec_id % 20 = 0"), confidence=1 - 1e-12).collect()
    assert sorted(map(tuple, got)) == exactly(rows, lambda i: i % 20 == 0)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(400)]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, op1_ann(spark, str(tmp_path)).collect()))
    want = exactly([(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows], lambda i: i % 100 == 0)
    assert len(got) == len(want) == 40 and len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 36
    assert all(abs(d - w) < 1e-9 for (q, r, v, d), (p, s, u, w) in zip(got, want, strict=True) if (q, v) == (p, u) and r == s)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest(df, F.expr("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 2, 1.0), (0, 3, 1, 2**0.5)]
    assert nearest(df.limit(0), F.expr("vec_id = 0")).count() == 0
    assert nearest(df.where("vec_id = 0"), F.expr("vec_id = 0")).count() == 0
