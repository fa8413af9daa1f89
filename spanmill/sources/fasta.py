"""Reference sequences as overlapping bins, read by byte ranges through the FASTA index."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pileup import FASTA_BIN, FASTA_MARGIN
from .files import opened
from .text import read_fai

ROWS = "chrom string, bin bigint, bin_start bigint, seq string"
BINS_AT_ONCE = 1_000


def _range(f, offset: int, bases: int, width: int, start: int, end: int) -> str:
    place = lambda p: offset + p // bases * width + p % bases
    f.seek(place(start))
    return f.read(place(end - 1) + 1 - place(start)).replace(b"\n", b"").replace(b"\r", b"").decode("ascii", "replace").upper()


def fasta_bins(spark: SparkSession, path: str, *, bin_size: int = FASTA_BIN, margin: int = FASTA_MARGIN) -> DataFrame:
    """(chrom, bin, bin_start, seq): each bin with a margin on both sides, clipped to the contig, upper case."""
    index = read_fai(spark, path + ".fai").where("length > 0 and line_bases > 0")
    runs = index.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {bin_size}"), F.lit(BINS_AT_ONCE).cast("long"))))

    def run(frames: Iterator):
        import pandas as pd

        for frame in frames:
            with opened(path) as f:
                for r in frame.itertuples(index=False):
                    last = min(r.first + BINS_AT_ONCE, (r.length - 1) // bin_size + 1)
                    lo, hi = max(0, r.first * bin_size - margin), min(r.length, last * bin_size + margin)
                    whole = _range(f, r.offset, r.line_bases, r.line_width, lo, hi)
                    starts = [max(0, b * bin_size - margin) for b in range(r.first, last)]
                    seqs = [whole[s - lo : min(r.length, (b + 1) * bin_size + margin) - lo] for s, b in zip(starts, range(r.first, last), strict=True)]
                    yield pd.DataFrame({"chrom": r.name, "bin": range(r.first, last), "bin_start": starts, "seq": seqs})

    return runs.repartition(F.col("name"), F.col("first")).mapInPandas(run, ROWS)
