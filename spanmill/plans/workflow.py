"""The four steps as functions over paths: extract, build, train, predict."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..operators import haplotypes, intervals, labels, metrics, pileup, splits
from ..sources import bam, fasta, files, text
from ..sources import vcf as vcf_source
from . import boosting, model

log = logging.getLogger(__name__)
CHROMOSOMES = tuple(f"chr{i}" for i in range(1, 23))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet or CSV, by suffix."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    out = rows.write.mode("overwrite")
    out.parquet(path) if path.endswith(".parquet") else out.option("header", True).csv(path)


def read_variants(spark: SparkSession, path: str, chroms: Sequence[str] | None = None) -> DataFrame:
    """Records of a VCF; of a block-gzipped one with an index only those of ``chroms`` are read, by many tasks."""
    if vcf_source.indexed(path):
        return vcf_source.read_indexed(spark, path, **({"regions": ",".join(f"{c}:1-{1 << 29}" for c in chroms)} if chroms is not None else {}))
    return text.read_vcf(spark, path)


def site_regions(sites: DataFrame, chunk: int, most: int = 20_000) -> str | None:
    """The tiles that hold sites, as regions; None if there are more than ``most``. There are as many as the sequences are long, at most."""
    tiles = intervals.with_tile(sites, chunk).groupBy("chrom", "tile").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).limit(most + 1).collect()
    return None if len(tiles) > most else ",".join(f"{r['chrom']}:{r['a']}-{r['b']}" for r in tiles)


def read_reads(spark: SparkSession, path: str, chroms: Sequence[str] | None = None, regions: str | None = None) -> DataFrame:
    """Reads by suffix; of an indexed BAM file only the parts that hold ``regions``, or else ``chroms``, are read."""
    if path.endswith(".bam") and regions is not None and files.exists(path + ".bai"):
        return bam.read_bam(spark, path, regions=regions)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".bam"):
        return bam.read_bam(spark, path, **({"chroms": ",".join(chroms)} if chroms is not None else {}))
    return text.read_sam(spark, path)


def extract(spark: SparkSession, vcf: str, reads: str, ref: str, out: str, *, chroms: Sequence[str] = CHROMOSOMES, mode: str = "strict", chunk: int = pileup.CHUNK) -> None:
    """Features of the indels of a VCF, as CSV or Parquet, part files in site order. Chromosomes that the index doesn't know are left out with a warning."""
    known = [r.name for r in text.read_fai(spark, ref + ".fai").where(F.col("name").isin(list(chroms))).select("name").distinct().collect()]
    for c in sorted(set(chroms) - set(known)):
        log.warning("%s is not in the index of %s: left out", c, ref)
    on = lambda d: d.where(F.col("chrom").isin(known))
    variants = on(read_variants(spark, vcf, known))
    # of an indexed file only reads over sites are read; a sweep's buffer holds no others either
    regions = site_regions(pileup.indel_sites(variants), chunk) if reads.endswith(".bam") else None
    aligned = on(read_reads(spark, reads, known, regions))
    size = intervals.good_bin_size(aligned.select("start", C.reference_end().alias("read_end")), "start", "read_end")
    rows = pileup.extract(variants, aligned, on(fasta.fasta_bins(spark, ref)), mode=mode, chunk=chunk, bin_size=size)
    write_table(rows.sortWithinPartitions(*pileup.KEY), out)


def left_aligned(keys: DataFrame, bins: DataFrame) -> DataFrame:
    return haplotypes.left_aligned(keys, bins, files.settled)


def compare(calls: DataFrame, truth: DataFrame, regions: DataFrame | None = None, bins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(true, false) indel keys of the calls; inside ``regions`` (BED) if given.

    With ``bins`` of the sequence a record is true if it belongs to the largest choice of calls and truth that spell one sequence
    (other records than indels take part in that); without them keys are compared, alleles trimmed.
    """
    if regions is not None:
        inside = lambda d: intervals.semi_range_join(d.withColumn("pos0", F.col("pos") - 1), regions, on=["chrom"], point="pos0", lo="start", hi="end").drop("pos0")
        calls, truth = inside(calls), inside(truth)
    own = labels.keys(calls)
    if bins is None:
        known = haplotypes.trimmed(labels.keys(truth)).select(*labels.KEY).distinct()
        mine = haplotypes.trimmed(own.withColumn("call", F.struct("pos", "ref", "alt")))
        back = lambda d: d.select("chrom", "call.*").select(*labels.KEY)
        return back(mine.join(known, labels.KEY, "left_semi")), back(mine.join(known, labels.KEY, "left_anti"))
    found = haplotypes.matched(calls, truth, bins, files.settled).where("side = 0")
    found = files.settled(found.select("chrom", "pos", "ref", F.explode("alt").alias("alt")).distinct())
    same = [own["chrom"] == found["chrom"], own["pos"] == found["pos"], F.upper(own["ref"]) == found["ref"], F.upper(own["alt"]) == found["alt"]]
    return own.join(found, same, "left_semi"), own.join(found, same, "left_anti")


def build(spark: SparkSession, features: str, out: str, *, tp: str | None = None, fp: str | None = None, vcf: str | None = None, truth: str | None = None, bed: str | None = None, ref: str | None = None) -> dict:
    """Labelled features, from a comparison's two VCFs or from calls and truth (by the sequences they spell if ``ref`` is given); returns counts."""
    if tp:
        true = labels.keys(text.read_vcf(spark, tp))
        false = labels.keys(text.read_vcf(spark, fp)) if fp else true.limit(0)
    elif vcf and truth:
        true, false = compare(text.read_vcf(spark, vcf), text.read_vcf(spark, truth), text.read_bed(spark, bed) if bed else None, fasta.fasta_bins(spark, ref) if ref else None)
    else:
        raise ValueError("give tp (and fp), or vcf and truth")
    rows = labels.label(read_table(spark, features, pileup.SCHEMA), true, false)
    seen = Observation("build")
    counts = [F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), F.count_if(~F.col("matched")).alias("n_unmatched")]
    write_table(rows.observe(seen, *counts).drop("matched"), out)
    return dict(seen.get)


def train(spark: SparkSession, data: str, out: str, *, by_chromosome: bool = False, **how) -> dict:
    rows = read_table(spark, data)
    names = model.feature_columns(rows)
    parted = splits.by_chromosome(rows) if by_chromosome else splits.stratified(rows, labels.KEY)
    part = lambda s: parted.where(F.col("split") == s)
    fitted, kept, weight, _ = boosting.boost(part("train"), part("val"), names, **how)
    bundle = model.Bundle(fitted, names)
    raw = bundle.score(part("val"))
    bundle.slope, bundle.intercept = model.platt(raw)
    val = bundle.score(part("val")).select("label", "raw", "prob").cache()
    try:
        best = metrics.best_threshold(val, "label", "prob").first()
        bundle.threshold = float(best["threshold"]) if best else model.DEFAULT_THRESHOLD
        results = {
            "split_method": "chromosome" if by_chromosome else "stratified", "best_iteration": kept, "scale_pos_weight": weight, "params": how,
            "brier_raw": metrics.brier(val, "label", "raw").first()[0], "brier_calibrated": metrics.brier(val, "label", "prob").first()[0],
            "val_metrics": model.evaluate(val, bundle.threshold), "test_metrics": model.evaluate(bundle.score(part("test")), bundle.threshold),
        }
    finally:
        val.unpersist()
    model.save(bundle, out, results)
    return results


def predict(spark: SparkSession, features: str, vcf: str, model_dir: str, out: str) -> dict:
    """The VCF with probabilities, qualities and filters; returns counts of records and of ALTs without a score."""
    bundle = model.load(model_dir)
    rows = read_table(spark, features, None if features.endswith(".parquet") else pileup.SCHEMA)
    scored = bundle.score(rows.withColumn("_row", F.monotonically_increasing_id()))
    scores = labels.last_wins(scored, labels.KEY, "prob", "_row")
    marked = labels.annotate(text.read_vcf(spark, vcf), scores, bundle.threshold)
    seen = Observation("predict")
    counts = [F.count_if(F.col("passed")).alias("pass"), F.count_if(~F.col("passed")).alias("filtered"), F.coalesce(F.sum("n_miss"), F.lit(0)).alias("no_match")]
    # settled first: the writer's sort samples its input, and a count belongs to one pass
    marked.observe(seen, *counts).write.mode("overwrite").parquet(f"{out}.records")
    text.write_vcf(spark.read.parquet(f"{out}.records"), text.vcf_header(spark, vcf), out)
    files.remove(spark, f"{out}.records")
    return dict(seen.get)


def require(*paths: str) -> None:
    for p in paths:
        if not files.exists(p):
            raise FileNotFoundError(p)
