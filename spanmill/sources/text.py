"""Line formats through Spark's own text reader: VCF, SAM, BED and FASTA indexes.

Plain files are split by Spark, gzipped ones (block-gzipped too) are read whole by one task each; convert
large inputs to Parquet once. ``ord`` is a line's place: file, block, line; it sorts as the file does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.labels import FILTER_ID, INFO_ID

ORD = "struct<file:string,block:bigint,line:bigint>"
STRETCH = 1 << 16


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select("value", place.alias("ord"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (1-based), id, ref, alt array, qual, filter, info, rest (FORMAT and samples), ord."""
    f = F.split("value", "\t", 9)
    at = lambda i: F.try_element_at(f, F.lit(i))
    alt = F.when((at(5) == ".") | at(5).isNull(), F.array().cast("array<string>")).otherwise(F.split(at(5), ","))
    rows = _lines(spark, path).where("value not like '#%' and value != ''")
    return rows.select(
        at(1).alias("chrom"), at(2).cast("long").alias("pos"), at(3).alias("id"), at(4).alias("ref"), alt.alias("alt"),
        at(6).try_cast("double").alias("qual"), at(7).alias("filter"), at(8).alias("info"), at(9).alias("rest"), "ord",
    )


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """The header lines, in order."""
    return [r.value for r in _lines(spark, path).where("value like '#%'").orderBy("ord").collect()]


def numbered(rows: DataFrame, name: str = "nth") -> DataFrame:
    """``rows`` with their number from 1 on in the order of ``ord``.

    A row's number is the count of rows in earlier stretches of ``STRETCH`` lines, plus its place in its own; a window sees
    one stretch, and one over all has a row for each stretch.
    """
    own = ["_file", "_block", "_stretch"]
    placed = rows.withColumns({"_file": F.col("ord.file"), "_block": F.col("ord.block"), "_stretch": F.expr(f"ord.line div {STRETCH}")})
    before = Window.orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = placed.withColumn("_place", F.row_number().over(Window.partitionBy(*own).orderBy("ord.line"))).join(starts, own)
    return out.select(*rows.columns, (F.col("_start") + F.col("_place")).alias(name))


def write_vcf(records: DataFrame, header: list[str], path: str, *, info_id: str = INFO_ID, filter_id: str = FILTER_ID) -> None:
    """Header with the two added lines, then the records in input order, as text part files."""
    added = [
        f'##INFO=<ID={info_id},Number=A,Type=Float,Description="Probability that the indel is real">',
        f'##FILTER=<ID={filter_id},Description="Below the probability threshold">',
    ]
    known = [h for h in added if not any(x.startswith(h[: h.index(",") + 1]) for x in header)]
    lines = [*header[:-1], *known, *header[-1:]] if header else known
    dot = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("."))
    qual = F.coalesce(F.when(F.col("qual") == F.floor("qual"), F.format_string("%.0f", "qual")).otherwise(F.col("qual").cast("string")), F.lit("."))
    alt = F.when(F.size("alt") > 0, F.array_join("alt", ",")).otherwise(".")
    text = F.concat_ws("\t", "chrom", "pos", dot("id"), "ref", alt, qual, dot("filter"), dot("info"), "rest")
    spark = records.sparkSession
    first = spark.createDataFrame([(i, h) for i, h in enumerate(lines)], "n int, value string").select(F.lit(0).alias("part"), "n", F.lit(None).cast(ORD).alias("ord"), "value")
    rest = records.select(F.lit(1).alias("part"), F.lit(0).alias("n"), F.col("ord").cast(ORD).alias("ord"), text.alias("value"))
    first.unionByName(rest).orderBy("part", "n", "ord").select("value").write.text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chrom, start (0-based), mapq, cigar, isize, seq, quals, nm, ord."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where("value not like '@%' and value != ''")
    seq = F.when(F.get(f, F.lit(9)) == "*", "").otherwise(F.get(f, F.lit(9)))
    quals = F.when(F.get(f, F.lit(10)) == "*", F.array_repeat(F.lit(255), F.length(seq))).otherwise(F.transform(F.filter(F.split(F.get(f, F.lit(10)), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33))
    nm = F.try_element_at(F.transform(F.filter(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: t.like("NM:i:%")), lambda t: F.substring(t, 6, 12).cast("long")), F.lit(1))
    return rows.select(
        F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).cast("int").alias("flag"), F.get(f, F.lit(2)).alias("chrom"), (F.get(f, F.lit(3)).cast("long") - 1).alias("start"), F.get(f, F.lit(4)).cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"),
        F.get(f, F.lit(8)).cast("long").alias("isize"), seq.alias("seq"), quals.alias("quals"), nm.alias("nm"), "ord",
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start (0-based), end (exclusive)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value != '' and value not like '#%' and value not like 'track%' and value not like 'browser%'")
    return rows.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start"), F.get(f, F.lit(2)).cast("long").alias("end"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """name, length (0 if it isn't a number), offset, line_bases, line_width."""
    f = F.split("value", "\t")
    number = lambda i: F.coalesce(F.try_element_at(f, F.lit(i)).try_cast("long"), F.lit(0))
    return spark.read.text(path).where("value != ''").select(F.get(f, F.lit(0)).alias("name"), number(2).alias("length"), number(3).alias("offset"), number(4).alias("line_bases"), number(5).alias("line_width"))
