"""Labels, lookups and annotations by variant key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import exact_round, exact_text, phred

KEY = ["chrom", "pos", "ref", "alt"]
INFO_ID, FILTER_ID = "INDEL_PROB", "INDEL_FILTERED"


def keys(variants: DataFrame) -> DataFrame:
    """Distinct indel keys of all ALTs of (chrom, pos, ref, alt array)."""
    every = variants.select("chrom", "pos", "ref", F.explode("alt").alias("alt"))
    return every.where("length(ref) != length(alt)").dropDuplicates(KEY)


def label(features: DataFrame, true_keys: DataFrame, false_keys: DataFrame) -> DataFrame:
    """``features`` with label (1 for true keys, which win; else 0) and matched."""
    t = true_keys.select(*KEY).dropDuplicates(KEY).withColumn("_t", F.lit(1))
    f = false_keys.select(*KEY).dropDuplicates(KEY).withColumn("_f", F.lit(1))
    out = features.join(t, KEY, "left").join(f, KEY, "left")
    return out.withColumns({"label": F.when(F.col("_t") == 1, 1).otherwise(0), "matched": F.coalesce("_t", "_f").isNotNull()}).drop("_t", "_f").select(*features.columns, "label", "matched")


def last_wins(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """One row per key: the value of the last row in order."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def annotate(variants: DataFrame, scores: DataFrame, threshold: float, *, info_id: str = INFO_ID, filter_id: str = FILTER_ID) -> DataFrame:
    """``variants`` (chrom, pos, ref, alt array, qual, filter, info, ord) with the scores of their indel ALTs.

    ``scores``: key and prob, one row per key. Records without a scored indel pass unchanged. The others get the
    list of found probabilities, the quality of the best, and the filter name if the best is below the threshold; a
    filter is left alone on records that pass. n_miss: indel ALTs without a score.
    """
    # a site and REF have a few scores; one join, and the rest inside the row
    site = KEY[:3]
    known = scores.groupBy(*site).agg(F.collect_list(F.struct("alt", "prob")).alias("_known"))
    out = variants.join(known.select(*[F.col(c).alias(f"_{c}") for c in site], "_known"), [variants[c] == F.col(f"_{c}") for c in site], "left").drop(*[f"_{c}" for c in site])
    of = F.expr("transform(filter(alt, a -> length(a) != length(ref)), a -> try_element_at(filter(_known, k -> k.alt = a), 1).prob)")
    out = out.withColumn("_all", F.coalesce(of, F.array().cast("array<double>"))).drop("_known")
    out = out.withColumns({"_found": F.filter("_all", lambda x: x.isNotNull()), "n_miss": F.size(F.filter("_all", lambda x: x.isNull())).cast("long")})
    best, has = F.array_max("_found"), F.size("_found") > 0
    text = F.concat(F.lit(f"{info_id}="), F.array_join(F.expr(f"transform(_found, p -> {exact_text('p', 4)})"), ","))
    empty = F.col("info").isNull() | F.col("info").isin("", ".")
    out = out.withColumn("_phred", phred(best))
    out = out.withColumns(
        {
            "info": F.when(~has, F.col("info")).when(empty, text).otherwise(F.concat_ws(";", "info", text)),
            "qual": F.when(has, exact_round("_phred", 2)).otherwise(F.col("qual")),
            "filter": F.when(has & (best < threshold), F.lit(filter_id)).otherwise(F.col("filter")),
            "passed": F.when(has, best >= threshold),
        }
    )
    return out.select(*variants.columns, "n_miss", "passed")
