import math
import random

import pytest
from pyspark.sql import functions as F
from spanmill.functions import cigar as C
from spanmill.functions import sequence as S
from spanmill.functions.scalar import logistic, mean0, phred, ratio0, var0
from spanmill.operators import intervals, metrics, splits


def rows(spark, y, p):
    return spark.createDataFrame(list(zip(y, p, strict=True)), "y int, p double")


def test_range_joins(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), i, rng.randrange(-50, 400)) for i in range(150)]
    ranges = [(rng.choice("ab"), 1000 + i, s, s + rng.choice([0, 1, 5, 130])) for i, s in enumerate(rng.randrange(-60, 400) for _ in range(150))]
    p, r = spark.createDataFrame(points, "k string, i int, at long"), spark.createDataFrame(ranges, "k string, j int, lo long, hi long")
    want = sorted((i, j) for k, i, at in points for m, j, lo, hi in ranges if k == m and lo <= at < hi)
    for size in (1, 7, 1000):
        how = {"on": ["k"], "point": "at", "lo": "lo", "hi": "hi", "bin_size": size}
        assert sorted((x.i, x.j) for x in intervals.range_join(p, r, **how).collect()) == want
        assert sorted(x.i for x in intervals.semi_range_join(p, r, **how).collect()) == sorted({i for i, _ in want})
    assert "Cartesian" not in (plan := intervals.range_join(p, r, **how)._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert intervals.good_bin_size(r, "lo", "hi", 10) == 130


def test_active_join_makes_no_pairs_to_find_what_entered(spark):
    """Many ranges over many points of one bin, against a sweep; columns of any kind don't bring in a sort of pairs."""
    rng = random.Random(5)
    points = sorted((rng.choice("ab"), rng.randrange(0, 300)) for _ in range(120))
    ranges = [(rng.choice("ab"), i, s, s + rng.choice([0, 1, 2, 3, 60]), "x") for i, s in enumerate(rng.randrange(-20, 300) for _ in range(200))]
    want = []
    for k in "ab":
        for g in range(3):
            reads, held = sorted((r[2], r[1], r[3]) for r in ranges if r[0] == k), []
            for i, (m, at) in enumerate(points):
                if m == k and at // 100 == g:
                    held += [r for r in reads if r[0] <= at < r[2] and r not in held]
                    held.sort()
                    while held and held[0][2] <= at:
                        held.pop(0)
                    want += [(i, r[1]) for r in held]
    p = spark.createDataFrame([(k, i, at, at // 100) for i, (k, at) in enumerate(points)], "k string, i int, at long, g long")
    r = spark.createDataFrame(ranges, "k string, j int, lo long, hi long, what string")
    for size in (7, 1000):
        out = intervals.active_join(p, r, on=["k"], group="g", point="at", lo="lo", hi="hi", order="j", bin_size=size)
        assert sorted((x.i, x.j) for x in out.collect()) == sorted(want) and out.columns.count("what") == 1
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_tiles(spark):
    got = intervals.tile_regions(spark.createDataFrame([("a", 10), ("b", 4), ("c", 0)], "name string, length long"), 4).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 4), ("a", 5, 8), ("a", 9, 10), ("b", 1, 4)]
    with pytest.raises(ValueError):
        intervals.tile_regions(None, 0)


def test_sequence_cases(spark):
    cases = [("ACGTTGCA", 3, (6, 6)), ("CCAAAAAAAAGG", 4, (1, 8)), ("GGCACACACACATT", 4, (2, 10)), ("ACGT", 3, (1, 1)), ("", 0, (1, 1)), ("A", 0, (1, 1)), ("ACGTTGCATT", 0, (6, 6))]
    df = spark.createDataFrame([(s, p) for s, p, _ in cases], "s string, p int")
    got = df.select("s", "p", S.tandem("s", "p").alias("t"), S.homopolymer("s", "p").alias("h"), S.gc_fraction("s").alias("g"), S.entropy("s").alias("e")).collect()
    for r, (s, _, want) in zip(got, cases, strict=True):
        if s != "ACGTTGCA":
            assert (r.t.unit, r.t.total) == want, s
        assert math.isclose(r.g, sum(c in "GC" for c in s) / max(1, len(s)))
        assert math.isclose(r.e, -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)), abs_tol=1e-12) and str(r.e) != "-0.0"
    assert got[1].h == 8 and got[4].h == 1


def test_cigar(spark):
    df = spark.createDataFrame([("5S10M2I3D4N6=1X2H", 100), ("*", 5), ("", 5)], "cigar string, start long").withColumn("blocks", C.blocks())
    got = df.select(C.reference_end().alias("e"), C.soft_clipped().alias("s"), F.size("blocks").alias("n"), C.query_position("117L").alias("q")).collect()
    assert [tuple(r) for r in got] == [(124, 5, 8, 17), (5, 0, 0, None), (5, 0, 0, None)]


def test_scalars(spark):
    df = spark.createDataFrame([(None,), (2.0,), (4.0,)], "x double")
    assert tuple(df.agg(mean0(F.col("x")), var0(F.col("x"))).first()) == (3.0, 1.0)
    assert tuple(df.where("x is null").agg(mean0(F.col("x")), var0(F.col("x"))).first()) == (0.0, 0.0)
    assert tuple(df.where("x = 2").agg(var0(F.col("x")), ratio0(F.max("x"), F.lit(0))).first()) == (0.0, 0.0)
    got = spark.range(1).select(phred(F.lit(1.0)), phred(F.lit(0.9)), logistic(F.lit(0.0)), logistic(F.lit(1.0), 2.0, -2.0)).first()
    assert round(got[0], 4) == 90.0 and round(got[1], 9) == 10.0 and got[2] == got[3] == 0.5


@pytest.mark.parametrize("seed", range(4))
def test_metrics(spark, seed):
    rng = random.Random(seed)
    y = [int(rng.random() < 0.3) for _ in range(200)] + [0, 1]
    p = [round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * v, 0.2))), 1 if seed % 2 else 3) for v in y]
    df = rows(spark, y, p)
    pos, neg = [b for a, b in zip(y, p, strict=True) if a], [b for a, b in zip(y, p, strict=True) if not a]
    area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.auroc(df).first()[0], area)
    steps, last, ap, best = sorted(set(p), reverse=True), 0.0, 0.0, (-1.0, 0.0)
    for t in steps:
        tp, n = sum(b >= t for b in pos), sum(b >= t for b in p)
        precision, recall = tp / n, tp / len(pos)
        ap += (recall - last) * precision
        last = recall
        best = max(best, (2 * precision * recall / (precision + recall + 1e-9), -t))
    assert math.isclose(metrics.average_precision(df).first()[0], ap)
    got = metrics.best_threshold(df).first()
    assert math.isclose(got.f1, best[0]) and got.threshold == -best[1]
    c = metrics.confusion(df, 0.5).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (sum(b >= 0.5 for b in pos), sum(b >= 0.5 for b in neg), sum(b < 0.5 for b in pos), sum(b < 0.5 for b in neg))
    assert math.isclose(metrics.brier(df).first()[0], sum((a - b) ** 2 for a, b in zip(y, p, strict=True)) / len(y))


def test_confusion_without_positives(spark):
    c = metrics.confusion(rows(spark, [0, 0], [0.1, 0.2]), 0.5).first()
    assert (c.precision, c.recall, c.f1) == (0.0, 0.0, 0.0)


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 10 == 0) for i in range(1000)], "k int, label boolean")
    got = {(r.label, r.split): r["count"] for r in splits.stratified(df, ["k"]).groupBy("label", "split").count().collect()}
    assert got == {(True, "train"): 70, (True, "val"): 15, (True, "test"): 15, (False, "train"): 630, (False, "val"): 135, (False, "test"): 135}
    c = spark.createDataFrame([("chr1",), ("chr19",), ("chr20",), (None,)], "chrom string")
    assert [r.split for r in splits.by_chromosome(c).collect()] == ["train", "val", "test", "train"]


def test_metrics_without_one_class(spark):
    for y, area, ap in (([0, 0, 0], None, 0.0), ([1, 1, 1], None, 1.0), ([], None, 0.0)):
        df = rows(spark, y, [0.1, 0.5, 0.5][: len(y)])
        assert metrics.auroc(df).first()[0] == area and metrics.average_precision(df).first()[0] == ap
        assert metrics.best_threshold(df).count() == (1 if y else 0)


def test_no_window_over_everything(spark):
    """A third of all rows share one score, the others have one each."""
    rng = random.Random(9)
    y = [int(rng.random() < 0.4) for _ in range(3000)]
    p = [0.5 if i % 3 == 0 else rng.random() for i in range(3000)]
    df = rows(spark, y, p)
    got = metrics.curve(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    for r in rng.sample(got.collect(), 60):
        assert (r.tp, r.fp) == (sum(a for a, b in zip(y, p, strict=True) if b >= r.p), sum(1 - a for a, b in zip(y, p, strict=True) if b >= r.p)) and (r.n_pos, r.n_neg) == (sum(y), 3000 - sum(y))


def test_split_of_a_large_label(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else 1) for i in range(3000)], "k int, label int").withColumn("split", F.lit("x"))
    out = splits.stratified(df, ["k"])
    assert out.columns == df.columns and "_label, _bucket" in (plan := out._jdf.queryExecution().optimizedPlan().toString()).replace("#", ", ") or "_bucket" in plan
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    for label, n in ((None, 429), (1, 2571)):
        assert abs(got[label, "train"] - 0.7 * n) < 1 and abs(got[label, "val"] - 0.15 * n) < 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, splits.stratified(df.repartition(7), ["k"]).collect()), key=str)


def test_summary_agrees_with_single_metrics(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), int(rng.random() < 0.3), rng.choice([0.0, 1.0, 1e-9, rng.random(), round(rng.random(), 1), -2.5, 1e6])) for _ in range(600)]
    data += [("one", 1, 0.5), ("none", 0, 0.5), ("none", 0, None), ("a", None, 0.25)]
    df = spark.createDataFrame(data, "g string, y int, p double")
    got = {r.g: r for r in metrics.summary(df, by=["g"], threshold=0.4).collect()}
    best = {r.g: r for r in metrics.summary(df, by=["g"]).collect()}
    assert set(got) == {"a", "b", None, "one", "none"}
    for g, r in got.items():
        own = df.where(F.col("g").eqNullSafe(g))
        c, t = metrics.confusion(own.where("y is not null and p is not null"), 0.4).first(), metrics.best_threshold(own).first()
        assert tuple(r[k] for k in c.asDict()) == tuple(c) and (r.best_threshold, r.best_f1) == tuple(t)
        area, alone = metrics.auroc(own).first()[0], metrics.summary(own, threshold=0.4).first()
        assert (r.auroc is None and area is None) or math.isclose(r.auroc, area)
        assert math.isclose(r.average_precision, metrics.average_precision(own).first()[0], abs_tol=1e-12) and math.isclose(r.brier, metrics.brier(own).first()[0])
        assert {k: v for k, v in r.asDict().items() if k != "g"} == pytest.approx(alone.asDict())
        at = metrics.confusion(own.where("y is not null and p is not null"), best[g].best_threshold).first()
        assert (best[g].tp, best[g].fp, best[g].n) == (at.tp, at.fp, r.n)
    none = metrics.summary(df.limit(0)).first()
    assert (none.n, none.auroc, none.brier, none.best_threshold, none.tp) == (0, None, None, None, 0)


def test_scores_at_both_ends(spark):
    p = [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, 1.0, 0.5]
    df = spark.createDataFrame([(i % 2, x) for i, x in enumerate(p)], "y int, p double")
    order = lambda x: (1, 0.0) if x != x else (0, x)
    for r in metrics.curve(df).collect():
        assert r.tp + r.fp == sum(order(x) >= order(r.p) for x in p)
