"""Train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALIDATION, TEST = ("chr19",), ("chr20",)


def by_chromosome(rows: DataFrame, validation=VALIDATION, test=TEST) -> DataFrame:
    """Adds split; everything else, null chromosomes too, is train."""
    return rows.withColumn("split", F.when(F.col("chrom").isin(*validation), "val").when(F.col("chrom").isin(*test), "test").otherwise("train"))


def stratified(rows: DataFrame, key: list[str], label: str = "label", *, seed: str = "42", held: float = 0.30, test_share: float = 0.50) -> DataFrame:
    """Adds split, with the same shares for each label: by rank of a hash of the key.

    A rank is the count of a label's rows in lower hash buckets, of which there are 4096, plus the rank inside the bucket.
    """
    hashed = rows.withColumn("_hash", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(seed))))
    hashed = hashed.withColumn("_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int")).withColumn("_label", F.to_json(F.struct(label)))
    own = Window.partitionBy("_label")
    starts = hashed.groupBy("_label", "_bucket").agg(F.count("*").alias("_m"))
    starts = starts.withColumns({"_n": F.sum("_m").over(own), "_start": F.coalesce(F.sum("_m").over(own.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).drop("_m")
    rank = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_hash", *key))
    out = hashed.withColumn("_rank", rank).join(starts, ["_label", "_bucket"]).withColumn("_share", (F.col("_start") + F.col("_rank") - 0.5) / F.col("_n"))
    split = F.when(F.col("_share") >= held, "train").when(F.col("_share") >= held * test_share, "val").otherwise("test")
    return out.withColumn("split", split).select(*[c for c in rows.columns if c != "split"], "split")
