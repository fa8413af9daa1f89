"""Ranking and calibration metrics of (y, p) by aggregation; ties are grouped, so all are exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio0
from ..sources import files

STEPS_AN_OCTAVE = 512


def _step(p: str) -> Column:
    """A whole number that rises with the score: the place of its logarithm, so a bucket's bounds need no look at the data."""
    place = lambda x: f"{1 << 22} + floor({STEPS_AN_OCTAVE} * log2({x}))"
    return F.expr(f"case when isnan({p}) or {p} = double('inf') then {1 << 23}L when {p} > 0 then {place(p)} when {p} = 0 then 0L when {p} = double('-inf') then {-(1 << 23)}L else -({place('-' + p)}) end")


def curve(rows: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by, p, dp, dn, tp, fp, n_pos, n_neg) for each distinct score, counting what scores at least that; null scores count for nothing.

    Distinct scores are written once, dealt over buckets by the logarithm of the score. The sums of all buckets (some hundreds an
    octave, whatever the number of rows) are added up per group, by the driver where there is one group only; a window then goes over the scores of one
    bucket, so no task holds all scores.
    """
    own, spark = [*by, "_b"], rows.sparkSession
    steps = rows.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.sum(F.col(y).cast("long")).alias("dp"), F.sum(1 - F.col(y).cast("long")).alias("dn"))
    steps = files.settled(steps.withColumn("_b", _step("p")))
    sums = steps.groupBy(*own).agg(F.sum("dp").alias("_p"), F.sum("dn").alias("_n"))
    if by:
        every, above = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*own, *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_p", "_n")], F.sum("_p").over(every).alias("n_pos"), F.sum("_n").over(every).alias("n_neg"))
    else:
        found, above = sums.orderBy(F.desc("_b")).collect(), [(0, 0)]
        for r in found:
            above.append((above[-1][0] + (r["_p"] or 0), above[-1][1] + (r["_n"] or 0)))
        sums = spark.createDataFrame([(r["_b"], *x, *above[-1]) for r, x in zip(found, above, strict=False)], "_b bigint, _p_above bigint, _n_above bigint, n_pos bigint, n_neg bigint")
    same = F.lit(True)
    for c in own:
        same = same & F.col(f"steps.{c}").eqNullSafe(F.col(f"sums.{c}"))
    both = steps.alias("steps").join((sums if by else F.broadcast(sums)).alias("sums"), same).select("steps.*", "_p_above", "_n_above", "n_pos", "n_neg")
    down = Window.partitionBy(*own).orderBy(F.desc("p"))
    return both.select(*by, "p", "dp", "dn", (F.col("_p_above") + F.sum("dp").over(down)).alias("tp"), (F.col("_n_above") + F.sum("dn").over(down)).alias("fp"), "n_pos", "n_neg")


def summary(rows: DataFrame, y: str = "y", p: str = "p", *, by: Sequence[str] = (), threshold: float | None = None) -> DataFrame:
    """All metrics of a group in one pass over its curve: n, n_pos, n_neg, auroc, average_precision, brier, best_threshold and best_f1,
    and tp, fp, fn, tn, precision, recall, f1 at ``threshold`` (at the best one if it is None).

    Values are as the single metrics define them; without ``by`` there is one row, also of no scores.
    """
    d = F.lit(1.0)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), ratio0(F.col("tp") * d, F.col("n_pos"))
    steps = curve(rows, y, p, by).withColumn("f1", 2 * precision * recall / (precision + recall + 1e-9))
    counts = F.struct("tp", "fp", "n_pos", "n_neg")
    # of the highest F1 the lowest threshold; what scores at least a given one is what the lowest score from there on counts
    best = F.max(F.struct(F.col("f1").alias("f1"), (-F.col("p")).alias("less"), counts.alias("c")))
    given = best["c"] if threshold is None else F.min_by(F.when(F.col("p") >= threshold, counts), F.when(F.col("p") >= threshold, F.col("p")))
    pos, neg = F.coalesce(F.max("n_pos"), F.lit(0)), F.coalesce(F.max("n_neg"), F.lit(0))
    out = steps.groupBy(*by).agg(
        pos.alias("n_pos"), neg.alias("n_neg"),
        F.try_divide(F.sum(F.col("dn") * (F.col("tp") - F.col("dp") / 2.0)), pos * d * neg).alias("auroc"),
        F.coalesce(F.try_divide(F.sum(F.col("dp") * F.col("tp") / (F.col("tp") + F.col("fp"))), pos * d), F.lit(0.0)).alias("average_precision"),
        F.try_divide(F.sum(F.col("dp") * F.pow(F.col("p") - 1, F.lit(2)) + F.col("dn") * F.pow("p", F.lit(2))), (pos + neg) * d).alias("brier"),
        (-best["less"]).alias("best_threshold"), best["f1"].alias("best_f1"), given.alias("_c"),
    )
    out = out.withColumns({"n": F.col("n_pos") + F.col("n_neg"), "tp": F.coalesce("_c.tp", F.lit(0)), "fp": F.coalesce("_c.fp", F.lit(0))})
    out = out.withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp"), "precision": ratio0(F.col("tp") * d, F.col("tp") + F.col("fp")), "recall": ratio0(F.col("tp") * d, F.col("n_pos"))})
    out = out.withColumn("f1", ratio0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select(*by, "n", "n_pos", "n_neg", "auroc", "average_precision", "brier", "best_threshold", "best_f1", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def pr_curve(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    c = curve(rows, y, p)
    return c.select(F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), ratio0(F.col("tp").cast("double"), F.col("n_pos")).alias("recall"))


def auroc(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row; ties count half; null if one of the classes is missing."""
    area = F.try_divide(F.sum(F.col("dn") * (F.col("tp") - F.col("dp") / 2.0)), F.max("n_pos").cast("double") * F.max("n_neg"))
    return curve(rows, y, p).agg(area.alias("auroc"))


def average_precision(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row; 0 without positives."""
    step = F.col("dp") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve(rows, y, p).agg(F.coalesce(F.try_divide(F.sum(step), F.max("n_pos").cast("double")), F.lit(0.0)).alias("average_precision"))


def best_threshold(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row (threshold, f1) with the highest F1; the lowest threshold on a tie."""
    c = pr_curve(rows, y, p)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    return c.select("threshold", f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def confusion(rows: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    hit, true = F.col(p) >= threshold, F.col(y) == 1
    tp, fp, fn = F.count_if(hit & true), F.count_if(hit & ~true), F.count_if(~hit & true)
    counts = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    d = F.lit(1.0)
    out = counts.withColumns({"precision": ratio0(F.col("tp") * d, F.col("tp") + F.col("fp")), "recall": ratio0(F.col("tp") * d, F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def brier(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def class_weight(rows: DataFrame, y: str = "y") -> DataFrame:
    """Negatives per positive, with at least one positive assumed."""
    return rows.agg((F.count_if(F.col(y) == 0) / F.greatest(F.count_if(F.col(y) == 1), F.lit(1))).alias("scale_pos_weight"))
