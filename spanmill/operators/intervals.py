"""Joins of points with the ranges that hold them, as equi-joins on bins.

An unbinned range condition would be a nested loop. Each range goes to every bin it touches and each
point to one bin, so a pair meets exactly once and nothing has to be deduplicated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1_000


def tile_regions(lengths: DataFrame, chunk: int) -> DataFrame:
    """(chrom, start, end), 1-based and inclusive, that cover (name, length); the last tile is clipped."""
    if chunk <= 0:
        raise ValueError("chunk must be positive")
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"), F.lit(chunk).cast("long")))
    tiles = lengths.where("length > 0").select(F.col("name").alias("chrom"), "length", starts.alias("start"))
    return tiles.select("chrom", "start", F.least(F.col("start") + (chunk - 1), "length").alias("end"))


def with_tile(sites: DataFrame, chunk: int, pos: str = "pos") -> DataFrame:
    """Each 1-based position's tile; a position is in one tile only."""
    return sites.withColumn("tile", F.expr(f"({pos} - 1) div {int(chunk)}"))


def good_bin_size(ranges: DataFrame, lo: str, hi: str, least: int = BIN) -> int:
    """The 99th percentile of lengths, so that most ranges touch two bins at most."""
    q = ranges.agg(F.percentile_approx(F.col(hi) - F.col(lo), 0.99)).first()[0]
    return max(least, int(q or 0))


def range_join(points: DataFrame, ranges: DataFrame, *, on: Sequence[str], point: str, lo: str, hi: str, bin_size: int = BIN) -> DataFrame:
    """Inner join of points and ranges with equal ``on`` columns and lo <= point < hi."""
    left = points.withColumn("_bin", F.expr(f"floor({point} / {bin_size})"))
    # an empty range goes to one bin, where it holds nothing: a filter of its own would work out computed ends twice
    right = ranges.withColumn("_bin", F.explode(F.expr(f"sequence(floor({lo} / {bin_size}), floor(greatest({lo}, {hi} - 1) / {bin_size}))")))
    return left.join(right, ["_bin", *on]).where((F.col(lo) <= F.col(point)) & (F.col(point) < F.col(hi))).drop("_bin")  # a sort compares the first key's prefix


def semi_range_join(points: DataFrame, ranges: DataFrame, *, on: Sequence[str], point: str, lo: str, hi: str, bin_size: int = BIN) -> DataFrame:
    """Points inside at least one range, each once."""
    right = ranges.where(F.col(hi) > F.col(lo)).withColumn("_bin", F.explode(F.expr(f"sequence(floor({lo} / {bin_size}), floor(({hi} - 1) / {bin_size}))")))
    left = points.withColumn("_bin", F.expr(f"floor({point} / {bin_size})"))
    same = [left[c] == right[c] for c in (*on, "_bin")]
    return left.join(right, [*same, right[lo] <= left[point], left[point] < right[hi]], "left_semi").drop("_bin")


def active_join(points: DataFrame, ranges: DataFrame, *, on: Sequence[str], group: str, point: str, lo: str, hi: str, order: str, bin_size: int = BIN) -> DataFrame:
    """The join of a sweep that only drops ranges from the front of its queue.

    A range enters at the first point it holds and stays while any range before it in (lo, order) reaches
    beyond the point. So the ranges that hold some point of a group (``group`` is a column of the points) are taken
    once, their ends replaced by the running maximum, and joined again.

    Whether a range holds a point is asked of the points of a bin and group together, so no pairs are made for it and its work
    doesn't grow with the depth; only the ranges' ends and order take part, and the other columns join once by them.
    """
    keys = [*on, group]
    lists = points.withColumn("_bin", F.expr(f"floor({point} / {bin_size})")).groupBy(*keys, "_bin").agg(F.sort_array(F.collect_set(point)).alias("_at"))
    narrow = ranges.where(F.col(hi) > F.col(lo)).select(*on, lo, hi, order)
    touched = narrow.withColumn("_bin", F.explode(F.expr(f"sequence(floor({lo} / {bin_size}), floor(({hi} - 1) / {bin_size}))"))).join(lists, [*on, "_bin"])
    # of most bins the first or the last point decides
    least, most = F.element_at("_at", 1), F.element_at("_at", -1)
    inside = (least < F.col(hi)) & (most >= F.col(lo)) & ((least >= F.col(lo)) | (most < F.col(hi)) | F.exists("_at", lambda p: (p >= F.col(lo)) & (p < F.col(hi))))
    entered = touched.where(inside).select(*keys, order, lo, hi).distinct()
    reach = F.max(hi).over(Window.partitionBy(*keys).orderBy(lo, order).rowsBetween(Window.unboundedPreceding, 0))
    active = entered.withColumn("_reach", reach)
    own = [*on, order, lo, hi]
    return range_join(points, ranges.join(active, own), on=keys, point=point, lo=lo, hi="_reach", bin_size=bin_size).drop("_reach")
