"""Incremental pileup: features of sites from the reads over them, kept up to date while files of events arrive.

An event is a site (one type) or a read that lasts from its time for ``value`` hours. A site is described by the reads that hold it, as
in a whole extraction, but each run takes only files that no run took before: a file stream with
``availableNow``, whose checkpoint is the mark. A new file's reads may hold old sites, and old reads new sites. So every batch

1. writes its events below ``events``, by batch, kind and day,
2. joins new sites with all reads so far and older sites with new reads, only where their times can meet,
3. writes what these pairs add to a site (counts, means and squared deviations, which can be merged) below ``parts``, by batch and day,
4. merges the parts of the days it touched and writes these days below ``features``.

Every write replaces whole partitions, named by the batch or the day, before the stream marks the batch as done. A batch that
failed on the way runs again with the same files and number and gives the same partitions; a run without new files changes nothing.

    python -m jobs.pileup_stream --events EVENTS --out OUT [--checkpoint DIR] [--config FILE]

``EVENTS`` is a Parquet file or a folder of them that grows by new files. Features: ``OUT/features``, partitioned by day.
Sites without reads have no row. Rows with a null user, id, time or type take no part; a null value is a read that holds nothing.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.config import settings
from spanmill.functions.scalar import mean0, ratio0
from spanmill.operators import intervals

log = logging.getLogger("jobs.pileup_stream")
DAY_US = 86_400_000_000
SITE = ["day", "user_id", "site"]


def _micros(kind: str) -> Column:
    if kind == "timestamp_ntz":
        return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return F.unix_micros("ts")


def typed(events: DataFrame, config: dict) -> DataFrame:
    """(kind, user_id, event_id, event_type, value, start, stop, day): sites hold their own place only."""
    kind = F.when(F.col("event_type") == config["site_type"], "site").otherwise("read")
    rows = events.where("user_id is not null and event_id is not null and ts is not null and event_type is not null")
    rows = rows.select(kind.alias("kind"), "user_id", "event_id", "event_type", "value", _micros(dict(events.dtypes)["ts"]).alias("start"))
    lasts = F.round(F.coalesce("value", F.lit(0.0)) * config["unit_us"]).cast("long")
    rows = rows.withColumn("stop", F.col("start") + F.when(F.col("kind") == "read", lasts).otherwise(1))
    return rows.withColumn("day", F.expr(f"date_from_unix_date(cast(floor(start / {DAY_US}) as int))"))


def _replace(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write whole partitions; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def added(sites: DataFrame, reads: DataFrame, config: dict) -> DataFrame:
    """What the pairs of ``sites`` and ``reads`` add to each site: counts, sums, means and squared deviations."""
    sites = sites.select("day", "user_id", F.col("event_id").alias("site"), F.col("start").alias("pos0"))
    pairs = intervals.range_join(sites, reads.select("user_id", "event_type", "value", "start", "stop"), on=["user_id"], point="pos0", lo="start", hi="stop", bin_size=config["bin_us"])
    alt, v = F.col("event_type") == config["alt_type"], F.col("value")
    a = F.when(alt, v)
    return pairs.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(alt).alias("n_alt"), F.count_if(v >= config["high_value"]).alias("n_high"),
        F.sum(F.when(~alt, v)).alias("sum_ref"), F.count(F.when(~alt, v)).alias("v_ref"), F.count(a).alias("v_alt"), F.avg(a).alias("m_alt"), (F.var_pop(a) * F.count(a)).alias("d_alt"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """The features of each site from all that its parts add."""
    own = Window.partitionBy(*SITE)
    mean = F.sum(F.col("m_alt") * F.col("v_alt")).over(own) / F.sum("v_alt").over(own)
    rows = parts.withColumn("mean", F.when(F.sum("v_alt").over(own) > 0, mean))
    # squared deviations from the common mean: each part's own, and those of its mean
    apart = F.coalesce("d_alt", F.lit(0.0)) + F.coalesce(F.col("v_alt") * F.pow(F.col("m_alt") - F.col("mean"), F.lit(2)), F.lit(0.0))
    sums = rows.groupBy(*SITE).agg(*[F.sum(c).alias(c) for c in ("n", "n_alt", "n_high", "sum_ref", "v_ref", "v_alt")], F.max("mean").alias("mean"), F.sum(apart).alias("apart"))
    alt, ref = F.coalesce("mean", F.lit(0.0)), F.coalesce(ratio0(F.col("sum_ref"), F.col("v_ref")), F.lit(0.0))
    return sums.select(
        *SITE, F.col("n").alias("total_depth"), F.col("n_alt").alias("alt_depth"), (F.col("n_alt") / F.col("n")).alias("allele_balance"),
        alt.alias("mean_alt"), F.when(F.col("v_alt") < 2, 0.0).otherwise(F.col("apart") / F.col("v_alt")).alias("var_alt"), ref.alias("mean_ref"), (alt - ref).alias("mean_diff"),
        ratio0(F.col("n").cast("double"), F.col("n_high")).alias("depth_ratio"),
    )


def take(batch: DataFrame, number: int, out: str, config: dict) -> int:
    """One batch of new events, from files to features; returns how many of them took part."""
    spark = batch.sparkSession
    events, parts, features = f"{out}/events", f"{out}/parts", f"{out}/features"
    kept = typed(batch, config).withColumn("batch", F.lit(number).cast("long"))
    _replace(kept.repartition("kind", "day"), events, ["batch", "kind", "day"])

    # with a schema, since a folder that no row was written to has none
    seen = spark.read.schema(kept.schema).parquet(events).where(F.col("batch") <= number)
    new, old = seen.where(F.col("batch") == number), seen.where(F.col("batch") < number)
    site, read = F.col("kind") == "site", (F.col("kind") == "read") & (F.col("stop") > F.col("start"))
    ends = new.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(site, F.col("start"))).alias("first_site"), F.max(F.when(site, F.col("start"))).alias("last_site"),
        F.min(F.when(read, F.col("start"))).alias("first_read"), F.max(F.when(read, F.col("stop"))).alias("last_read"),
    ).first()
    found = []
    if ends["first_site"] is not None:
        # of all reads those that can hold a new site; days and times are pruned in the scan
        last = F.expr(f"date_from_unix_date(cast(floor({ends['last_site']} / {DAY_US}) as int))")
        reach = seen.where(read & (F.col("day") <= last) & (F.col("start") <= ends["last_site"]) & (F.col("stop") > ends["first_site"]))
        found.append(added(new.where(site), reach, config))
    if ends["first_read"] is not None and number:
        first, last = (F.expr(f"date_from_unix_date(cast(floor({x} / {DAY_US}) as int))") for x in (ends["first_read"], ends["last_read"]))
        known = old.where(site & F.col("day").between(first, last) & (F.col("start") >= ends["first_read"]) & (F.col("start") < ends["last_read"]))
        found.append(added(known, new.where(read), config))
    if not found:
        log.info("batch %d: %d events, neither sites nor reads that last", number, ends["n"])
        return ends["n"]
    # a site is new or old, so no batch has two parts of it
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    _replace(both.withColumn("batch", F.lit(number).cast("long")).repartition("day"), parts, ["batch", "day"])

    every = spark.read.schema(both.withColumn("batch", F.lit(0).cast("long")).schema).parquet(parts).where(F.col("batch") <= number)
    days = [r["day"] for r in every.where(F.col("batch") == number).select("day").distinct().collect()]  # as many as the batch has days
    if days:
        rows = merged(every.where(F.col("day").isin(days)))
        _replace(rows.repartition(config["files_per_day"] * len(days), "day"), features, ["day"])
    log.info("batch %d: took %d events, wrote features of %d days to %s", number, ends["n"], len(days), features)
    return ends["n"]


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take all files of ``events`` that no earlier run with this checkpoint took; returns counts."""
    config = config or settings(__file__)
    folder, _, name = events.rstrip("/").rpartition("/")
    # as a pattern of one name, since a stream takes a plain path for a folder
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{folder or '.'}/{{{name}}}")
    taken: list[int] = []
    query = stream.writeStream.foreachBatch(lambda batch, number: taken.append(take(batch, number, out, config))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    counts = {"batches": len(taken), "events": sum(taken)}
    log.info("read %(events)d events in %(batches)d batches", counts)
    return counts


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.pileup_stream")
    for a in ("events", "out"):
        p.add_argument(f"--{a}", required=True)
    p.add_argument("--checkpoint", help="default: OUT/checkpoint")
    p.add_argument("--config", help="JSON file of settings over jobs/pileup_stream.json")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName("pileup_stream").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.events, a.out, a.checkpoint or f"{a.out}/checkpoint", settings(__file__, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
