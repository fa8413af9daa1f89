"""Quality gate for texts: score, label, choose a threshold for each language on held-out documents, decide on all documents.

It does for a table of texts what ``train`` and ``predict`` do for calls: labels are joined by key (a key that is both good and bad is
good), labelled rows are split with equal shares of each label, the threshold is the one of best F1 on the validation part, and the
test part measures it. The score is a logistic function of the entropy of a text's characters; its slope and centre are settings.

    python -m jobs.quality_gate --documents DOCS --labels LABELS --out OUT [--config FILE]

``OUT/decisions``: doc_id, text_score, label (null: unlabelled), passed; partitioned by lang and split (train, val, test or none).
``OUT/report``: one row for each language: threshold, val_f1 and the test part's n, auroc, average precision, precision, recall, f1; partitioned by lang.
A language without labelled validation rows has the default threshold. Null texts have no characters; a null language is one of
its own, and an empty one is null. Both outputs are replaced as a whole, so a rerun gives the same, also after a run that failed.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.config import settings
from spanmill.functions import sequence
from spanmill.functions.scalar import logistic
from spanmill.operators import labels as labelling
from spanmill.operators import metrics, splits

log = logging.getLogger("jobs.quality_gate")


def scored(documents: DataFrame, config: dict) -> DataFrame:
    """(doc_id, lang, text_score)"""
    rows = documents.select("doc_id", F.expr("nullif(lang, '')").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    x = sequence.text_entropy("text") - config["centre"]
    return rows.select("doc_id", "lang", (F.round(logistic(x, config["slope"]), config["digits"]) + 0.0).alias("text_score"))


def labelled(rows: DataFrame, known: DataFrame, config: dict) -> DataFrame:
    """``rows`` with label and split; both null where nothing is known of a document."""
    # a document is a key of one column here; the label join wants the four of a call
    key = lambda d: d.select(F.lit("").alias("chrom"), F.col("doc_id").alias("pos"), F.lit("").alias("ref"), F.lit("").alias("alt"))
    named = rows.select(F.lit("").alias("chrom"), F.col("doc_id").alias("pos"), F.lit("").alias("ref"), F.lit("").alias("alt"), "lang", "text_score")
    out = labelling.label(named, key(known.where("quality = 1")), key(known.where("quality = 0")))
    out = out.select(F.col("pos").alias("doc_id"), "lang", "text_score", "label", "matched")
    parted = splits.stratified(out.where("matched"), ["doc_id"], "label", seed=config["seed"], held=config["held"], test_share=config["test_share"])
    rest = out.where("not matched").withColumns({"label": F.lit(None).cast("int"), "split": F.lit("none")})
    return parted.withColumn("label", F.col("label").cast("int")).unionByName(rest).drop("matched")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> dict:
    """Write decisions and report; returns counts."""
    config = config or settings(__file__)
    docs, known = spark.read.parquet(documents), spark.read.parquet(labels)
    decisions, report = f"{out}/decisions", f"{out}/report"
    # scores are read back by both parts below: texts are read once
    rows = f"{out}/scored"
    seen = Observation("documents")
    labelled(scored(docs.observe(seen, F.count(F.lit(1)).alias("n")), config), known, config).write.mode("overwrite").parquet(rows)
    marked = spark.read.parquet(rows)

    measured = lambda part: metrics.summary(marked.where(F.col("split") == part), "label", "text_score", by=["lang"])
    chosen = measured("val").select("lang", F.col("best_threshold").alias("threshold"), F.col("best_f1").alias("val_f1"))
    chosen = marked.select("lang").distinct().alias("l").join(chosen.alias("c"), F.col("l.lang").eqNullSafe(F.col("c.lang")), "left")
    chosen = chosen.select("l.lang", F.coalesce("threshold", F.lit(config["default_threshold"])).alias("threshold"), "val_f1")
    decided = marked.alias("m").join(chosen.alias("t"), F.col("m.lang").eqNullSafe(F.col("t.lang"))).select("m.*", "threshold", (F.col("text_score") >= F.col("threshold")).alias("passed"))
    decided.repartition("lang", "split").write.mode("overwrite").partitionBy("lang", "split").parquet(decisions)

    decided = spark.read.schema(decided.schema).parquet(decisions)
    tests = measured("test").select("lang", "n", "auroc", "average_precision").alias("a")
    at = decided.where("split = 'test'").groupBy("lang")
    hit, good = F.col("passed"), F.col("label") == 1
    at = at.agg(F.count_if(hit & good).alias("tp"), F.count_if(hit & ~good).alias("fp"), F.count_if(~hit & good).alias("fn")).alias("b")
    same = lambda x: F.col("t.lang").eqNullSafe(F.col(f"{x}.lang"))
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), y), F.lit(0.0))
    whole = chosen.alias("t").join(tests, same("a"), "left").join(at, same("b"), "left")
    whole = whole.select(
        "t.*", F.coalesce("a.n", F.lit(0)).alias("n"), "auroc", "average_precision", share("tp", F.col("tp") + F.col("fp")).alias("precision"), share("tp", F.col("tp") + F.col("fn")).alias("recall"),
        share("tp", F.col("tp") + (F.col("fp") + F.col("fn")) / 2).alias("f1"),
    )
    # one row for each language
    whole.coalesce(1).write.mode("overwrite").partitionBy("lang").parquet(report)
    counts = {"documents": seen.get["n"], "decisions": decided.count(), "languages": spark.read.parquet(report).count()}
    log.info("read %d documents, wrote %d decisions and %d languages to %s", *counts.values(), out)
    return counts


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.quality_gate")
    for a in ("documents", "labels", "out"):
        p.add_argument(f"--{a}", required=True)
    p.add_argument("--config", help="JSON file of settings over jobs/quality_gate.json")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName("quality_gate").getOrCreate()
    try:
        run(spark, a.documents, a.labels, a.out, settings(__file__, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
