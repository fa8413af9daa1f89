"""Boosted trees with calibrated probabilities, and the bundle of files that holds them.

Models are grown leaf by leaf (``boosting``) and kept as text (``trees``). Spark's own trees, grown by level, can be fitted and bundled too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import logistic
from ..operators import metrics
from ..sources import files
from ..sources.files import exists, read_json, read_text, write_json, write_text
from .trees import Ensemble, parse, written

# Columns that are never features; of the first, none has to exist.
DROPPED = ("softclip_mean_alt",)
ID_COLUMNS = ("chrom", "pos", "ref", "alt", "label", "split", "matched")
ALIASES = {"read_pos_mean": "read_end_dist_mean", "read_pos_var": "read_end_dist_var"}
DEFAULT_THRESHOLD = 0.5
ROUNDS = 2000
# Names that a model's text may have in its folder; the first is written.
TEXTS = ("model.txt", "lgbm_model.txt")


def feature_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ID_COLUMNS and c not in DROPPED]


def with_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with older column names filled in; raises KeyError if a feature is still missing."""
    for new, old in ALIASES.items():
        if new not in rows.columns and old in rows.columns:
            rows = rows.withColumn(new, F.col(old))
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise KeyError(f"missing features: {missing}")
    return rows


@dataclass
class Bundle:
    model: Ensemble | GBTClassificationModel
    features: list[str]
    slope: float | None = None
    intercept: float | None = None
    threshold: float = DEFAULT_THRESHOLD

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with raw and prob."""
        rows = with_features(rows, self.features)
        if isinstance(self.model, Ensemble):
            out = rows.withColumn("raw", self.model.probability(self.features))
        else:
            out = self.model.transform(assembled(rows, self.features)).withColumn("raw", vector_to_array("probability")[1])
        prob = logistic(F.col("raw"), self.slope, self.intercept) if self.slope is not None else logistic(F.col("raw"))
        return out.withColumn("prob", prob).drop("_features", "rawPrediction", "probability", "prediction")


def assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    casted = rows.withColumns({f"_f{i}": F.col(n).cast("double") for i, n in enumerate(names)})
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(names))], outputCol="_features", handleInvalid="keep").transform(casted).drop(*[f"_f{i}" for i in range(len(names))])


def best_prefix(losses: list[float], patience: int) -> int:
    """Number of rounds up to the lowest loss that ``patience`` further rounds don't improve on."""
    best, at = float("inf"), 0
    for i, x in enumerate(losses):
        if x < best:
            best, at = x, i
        elif i - at >= patience:
            break
    return at + 1


def shortened(gbt: GBTClassifier, model: GBTClassificationModel, kept: int) -> GBTClassificationModel:
    """The model of the first ``kept`` rounds."""
    java, context = model._java_obj, SparkSession.active().sparkContext
    trees, weights = java.trees(), java.treeWeights()
    first = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, kept)
    share = context._gateway.new_array(context._jvm.double, kept)
    for i in range(kept):
        first[i], share[i] = trees[i], weights[i]
    out = gbt._copyValues(GBTClassificationModel(context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), first, share, model.numFeatures, model.numClasses)))
    out._transfer_params_to_java()
    return out


def boost(train: DataFrame, validation: DataFrame, names: list[str], *, rounds: int = ROUNDS, patience: int = 50, seed: int = 42, **more) -> tuple[GBTClassificationModel, int, float]:
    """(model, rounds kept, class weight): the rounds up to the lowest validation loss that ``patience`` further ones don't improve on.

    Fits of twice as many rounds each time, from twice the patience up to ``rounds``, until the patience is spent; the last is
    cut to the best round, so all fits together cost at most two of the last.
    """
    weight = metrics.class_weight(train, "label").first()[0]
    weighted = lambda d: assembled(d, names).withColumn("_w", F.when(F.col("label") == 1, float(weight)).otherwise(1.0)).withColumn("label", F.col("label").cast("double"))
    how = {"stepSize": 0.05, "maxDepth": 6, "featureSubsetStrategy": "0.8", "subsamplingRate": 0.8, "minInstancesPerNode": 50} | more
    gbt = GBTClassifier(labelCol="label", featuresCol="_features", weightCol="_w", seed=seed, **how)
    files.checkpoint_folder(train.sparkSession)  # the trainer cuts its lineage there every few rounds
    rows, seen = weighted(train).cache(), weighted(validation).cache()
    try:
        n = min(rounds, 2 * patience)
        while True:
            model = gbt.setMaxIter(n).fit(rows)
            kept = best_prefix(model.evaluateEachIteration(seen), patience)
            if n == rounds or n - kept >= patience:
                break
            n = min(rounds, 2 * n)
    finally:
        rows.unpersist()
        seen.unpersist()
    return shortened(gbt, model, kept) if kept < n else model, kept, float(weight)


def platt(rows: DataFrame, raw: str = "raw", label: str = "label") -> tuple[float, float]:
    """(slope, intercept) of an unregularised logistic regression of the label on the raw score."""
    x = VectorAssembler(inputCols=[raw], outputCol="_x").transform(rows.select(F.col(raw), F.col(label).cast("double").alias("_y")))
    fitted = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.0, standardization=False, maxIter=1000, tol=1e-12).fit(x)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def evaluate(rows: DataFrame, threshold: float, y: str = "label", p: str = "prob") -> dict:
    m = metrics.summary(rows, y, p, threshold=threshold).first()
    out = {k: round(m[k], 4) for k in ("precision", "recall", "f1")}
    if m["n_pos"] and m["n_neg"]:
        out |= {"auroc": round(m["auroc"], 4), "auprc": round(m["average_precision"], 4)}
    return out | {"brier": round(m["brier"] or 0.0, 4), "n": m["n"], "n_pos": m["n_pos"], "n_neg": m["n_neg"]}


def importance(model: Ensemble | GBTClassificationModel, names: list[str]) -> list[tuple[str, float, int]]:
    """(feature, gain, number of splits), largest gain first: the splits' total gain, or for Spark's trees a share."""
    import re

    if isinstance(model, Ensemble):
        return model.importance()
    splits = [0] * len(names)
    for tree in model.trees:
        for i in re.findall(r"If \(feature (\d+) ", tree.toDebugString):
            splits[int(i)] += 1
    return sorted(zip(names, model.featureImportances.toArray().tolist(), splits, strict=True), key=lambda r: (-r[1], r[0]))


def save(bundle: Bundle, path: str, results: dict) -> None:
    if isinstance(bundle.model, Ensemble):
        write_text(f"{path}/{TEXTS[0]}", written(bundle.model))
    else:
        bundle.model.write().overwrite().save(f"{path}/model")
    write_json(f"{path}/features.json", bundle.features)
    write_json(f"{path}/results.json", results | {"threshold": bundle.threshold, "features": bundle.features, "n_features": len(bundle.features)})
    write_json(f"{path}/threshold.json", {"tau": bundle.threshold})
    if bundle.slope is not None:
        write_json(f"{path}/scaler.json", {"slope": bundle.slope, "intercept": bundle.intercept})
    spark = SparkSession.active()
    rows = importance(bundle.model, bundle.features)
    spark.createDataFrame(rows, "feature string, gain double, split int").coalesce(1).write.mode("overwrite").csv(f"{path}/feature_importance.csv", header=True)


def stored_threshold(path: str) -> float:
    """The first of results.json and threshold.json that names one; 0 counts as none."""
    for name in ("results.json", "threshold.json"):
        if exists(f"{path}/{name}"):
            found = read_json(f"{path}/{name}")
            if value := found.get("threshold") or found.get("tau"):
                return float(value)
    return DEFAULT_THRESHOLD


def load(path: str) -> Bundle:
    """A bundle of ``save``, or a folder with a model's text and the names of its features from elsewhere."""
    scaler = read_json(f"{path}/scaler.json") if exists(f"{path}/scaler.json") else {}
    texts = [f"{path}/{t}" for t in TEXTS if exists(f"{path}/{t}")]
    fitted = parse(read_text(texts[0])) if texts else GBTClassificationModel.load(f"{path}/model")
    return Bundle(fitted, read_json(f"{path}/features.json"), scaler.get("slope"), scaler.get("intercept"), stored_threshold(path))
