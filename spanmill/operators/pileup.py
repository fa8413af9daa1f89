"""The 46 features of an indel site from the reads over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import pairs as P
from ..functions import sequence as S
from ..functions.scalar import in_small_methods, ratio0
from . import intervals

SKIPPED_FLAGS = 4 | 256 | 1024 | 2048  # unmapped, secondary, duplicate, supplementary
FLANK, BEFORE, AFTER = 5, 50, 49
FASTA_BIN, FASTA_MARGIN = 1_000, 64
CHUNK = 1_000_000

# The feature columns in output order.
KEY = ["chrom", "pos", "ref", "alt"]
FEATURES = [
    "allele_balance", "total_depth", "alt_depth", "mq_mean_alt", "mq_var_alt", "mq_mean_ref", "strand_ratio_alt", "strand_ratio_ref", "read_end_dist_mean", "read_end_dist_var",
    "softclip_rate_alt", "bq_mean_alt", "bq_var_alt", "bq_mean_ref", "nbq_alt", "nbq_ref", "bq_drop_alt", "indel_length", "is_insertion", "insert_entropy", "homopolymer_length",
    "gc_content_50bp", "udp_dp_ratio", "pileup_entropy", "nm_mean_alt", "nm_mean_ref", "proper_pair_rate_alt", "proper_pair_rate_ref", "mismatch_rate_alt", "cigar_agreement",
    "haplotype_entropy", "fragment_support_rate", "read_end_dist_mean_alt", "read_end_dist_mean_ref", "softclip_rate_ref", "softclip_diff", "isize_mean_alt", "isize_mean_ref", "isize_dev",
    "flank_bq_alt", "flank_bq_ref", "true_mismatch_rate_alt", "tandem_repeat_unit", "tandem_repeat_length", "mq0_fraction", "mq_diff",
]
INTEGERS = ["total_depth", "alt_depth", "indel_length", "is_insertion", "homopolymer_length", "tandem_repeat_unit", "tandem_repeat_length"]
SCHEMA = ", ".join(["chrom string", "pos bigint", "ref string", "alt string", *(f"{c} {'bigint' if c in INTEGERS else 'double'}" for c in FEATURES)])


def indel_sites(variants: DataFrame) -> DataFrame:
    """Candidates from (chrom, pos, ref, alt array, ord): first ALT, length other than REF's."""
    sites = variants.where("size(alt) >= 1").select("chrom", "pos", "ref", F.get("alt", F.lit(0)).alias("alt"), F.col("ord").alias("site_ord"))
    sites = sites.where("length(ref) != length(alt)").withColumn("indel_length", F.expr("cast(length(alt) - length(ref) as bigint)"))
    return sites.withColumns({"pos0": F.col("pos") - 1, "is_insertion": F.col("indel_length") > 0, "indel_size": F.abs("indel_length")})


def shuffled(bins: DataFrame) -> DataFrame:
    """The reference's bins for a join that shuffles them: Spark's estimate of rows that are made, not read, is far too low, and it would send them to every task."""
    return bins.hint("merge")


def with_context(sites: DataFrame, fasta_bins: DataFrame) -> DataFrame:
    """Adds flank (11 bases) with its start, and context (up to 100) with the site's place in it; empty if the sequence is missing."""
    binned = sites.withColumn("bin", F.expr(f"pos0 div {FASTA_BIN}")).repartition("chrom", "bin")  # else a small file of sites is one task, however many there are
    joined = binned.join(shuffled(fasta_bins).select("chrom", "bin", "bin_start", F.upper("seq").alias("seq")), ["chrom", "bin"], "left")
    joined = joined.withColumns({"flank_start": F.expr(f"greatest(0L, pos0 - {FLANK})"), "context_start": F.expr(f"greatest(0L, pos0 - {BEFORE})")})
    piece = lambda start, end: F.coalesce(F.expr(f"substring(seq, cast({start} - bin_start + 1 as int), cast({end} - {start} + 1 as int))"), F.lit(""))
    joined = joined.withColumns({"flank": piece("flank_start", f"pos0 + {FLANK}"), "context": piece("context_start", f"pos0 + {AFTER}"), "at": F.expr("cast(pos0 - context_start as int)")})
    joined = joined.withColumn("tandem", S.tandem("context", "at"))
    return joined.withColumns(
        {
            "gc_content_50bp": S.gc_fraction("context"),
            "homopolymer_length": S.homopolymer("context", "at"),
            "tandem_repeat_unit": F.col("tandem.unit"),
            "tandem_repeat_length": F.col("tandem.total"),
            "insert_entropy": F.when(F.col("is_insertion"), S.entropy("alt")).otherwise(0.0),
        }
    ).drop("bin", "bin_start", "seq", "context", "context_start", "at", "tandem")


def usable_reads(reads: DataFrame) -> DataFrame:
    """Reads that count. What a join needs is their end; CIGARs and qualities are looked at in pairs."""
    kept = reads.where(F.col("flag").bitwiseAND(SKIPPED_FLAGS) == 0)
    return kept.select("chrom", "start", "ord", "mapq", "flag", "isize", "seq", "quals", "cigar", C.reference_end().alias("read_end"), F.coalesce("nm", F.lit(0)).cast("double").alias("nm"))


def extract(variants: DataFrame, reads: DataFrame, fasta_bins: DataFrame, *, mode: str = "strict", chunk: int = CHUNK, bin_size: int = intervals.BIN) -> DataFrame:
    """Key and 46 features of each indel site with reads.

    strict: a read counts if it holds the site. compat: also reads that a sweep with a front-only queue
    still has in its buffer; that depends on ``chunk``, as each tile starts with an empty buffer.
    """
    if mode not in ("strict", "compat"):
        raise ValueError("mode must be strict or compat")
    sites, usable = with_context(indel_sites(variants), fasta_bins), usable_reads(reads)
    if mode == "strict":
        pairs = intervals.range_join(sites, usable, on=["chrom"], point="pos0", lo="start", hi="read_end", bin_size=bin_size)
    else:
        pairs = intervals.active_join(intervals.with_tile(sites, chunk), usable, on=["chrom"], group="tile", point="pos0", lo="start", hi="read_end", order="ord", bin_size=bin_size)
    return _features(pairs)


def _features(pairs: DataFrame) -> DataFrame:
    """Sums of the pairs."""
    p = pairs.withColumn("shown", P.shown(FLANK)).select("*", "shown.*").withColumns(
        {
            "fwd": F.expr("if(flag & 16 = 0, 1D, 0D)"),
            "pp": F.expr("if(flag & 2 != 0, 1D, 0D)"),
            "mate": F.expr("if(flag & 1 != 0 and flag & 8 = 0, 1D, 0D)"),
            "span": F.expr("if(flag & 2 != 0 and isize != 0, cast(abs(isize) as double), null)"),
            "mq": in_small_methods(F.col("mapq").cast("double")),
        }
    )
    # what differs by read is summed by (site, signature) first, alternative reads only by signature; then the few sums of a site
    site = [*KEY, "site_ord"]
    same = ["indel_length", "is_insertion", "insert_entropy", "homopolymer_length", "gc_content_50bp", "tandem_repeat_unit", "tandem_repeat_length"]
    summed = ["mq", "fwd", "ed", "sc", "bq", "nbq", "nm", "pp", "mate", "span", "fbq"]
    spread = ["mq", "ed", "bq"]
    bases = len(P.BASES)
    narrow = p.select(*site, *same, "is_alt", "sig", "base", "al", "mm", *summed)
    parts = narrow.groupBy(*site, "is_alt", "sig").agg(
        *[F.first(c).alias(c) for c in same],
        F.sum(in_small_methods(F.lit(1))).alias("n"), F.count_if(F.col("mq") >= 20).alias("high"), F.count_if(F.col("mq") == 0).alias("zero"), F.sum("al").alias("al"), F.sum("mm").alias("mm"), F.count("span").alias("n_span"),
        *[F.sum(c).alias(c) for c in summed], *[F.sum(F.col(c) * F.col(c)).alias(f"{c}2") for c in spread], *[F.count_if(F.col("base") == i).alias(f"b{i}") for i in range(bases)],
    )
    sides = {"alt": F.col("is_alt"), "ref": ~F.col("is_alt")}
    both = [*summed, "n", "n_span", "ed2"]
    sums = parts.groupBy(*site).agg(
        *[F.first(c).alias(c) for c in same], *[F.sum(F.when(when, F.col(c))).alias(f"{c}_{side}") for side, when in sides.items() for c in both],
        *[F.sum(F.when(sides["alt"], F.col(c))).alias(f"{c}_alt") for c in ("mq2", "bq2", "al", "mm")], *[F.sum(f"b{i}").alias(f"b{i}") for i in range(bases)], F.sum(in_small_methods(F.col("n"))).alias("n"), F.sum("high").alias("high"), F.sum("zero").alias("zero"),
        F.max(F.when(sides["alt"], F.col("n"))).alias("most"), F.sum(F.when(sides["alt"], F.col("n") * F.log2("n"))).alias("n_log"),
    )
    sums = sums.fillna(0, [f"{c}_{side}" for side in sides for c in both] + ["mq2_alt", "bq2_alt", "al_alt", "mm_alt"])
    mean = lambda c, side, n="n": ratio0(F.col(f"{c}_{side}"), F.col(f"{n}_{side}"))
    var = lambda total, squares, n: F.when(n < 2, 0.0).otherwise(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0)))
    seen = sum((F.col(f"b{i}") for i in range(1, bases)), F.col("b0"))
    shares = [F.col(f"b{i}") / F.col("seen") for i in range(bases)]
    entropy = sum((F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in shares), F.lit(0.0)) + 0.0
    n, alts, ed = F.col("n"), F.col("n_alt").cast("double"), F.col("ed_alt") + F.col("ed_ref")
    out = sums.withColumn("seen", seen).select(
        *site, *same, in_small_methods(n).alias("total_depth"), F.col("n_alt").alias("alt_depth"),
        mean("mq", "alt").alias("mq_mean_alt"), var(F.col("mq_alt"), F.col("mq2_alt"), alts).alias("mq_var_alt"), mean("mq", "ref").alias("mq_mean_ref"), mean("fwd", "alt").alias("strand_ratio_alt"), mean("fwd", "ref").alias("strand_ratio_ref"),
        (ed / n).alias("read_end_dist_mean"), var(ed, F.col("ed2_alt") + F.col("ed2_ref"), n.cast("double")).alias("read_end_dist_var"), mean("ed", "alt").alias("read_end_dist_mean_alt"), mean("ed", "ref").alias("read_end_dist_mean_ref"),
        mean("sc", "alt").alias("softclip_rate_alt"), mean("sc", "ref").alias("softclip_rate_ref"), mean("bq", "alt").alias("bq_mean_alt"), var(F.col("bq_alt"), F.col("bq2_alt"), alts).alias("bq_var_alt"), mean("bq", "ref").alias("bq_mean_ref"),
        mean("nbq", "alt").alias("nbq_alt"), mean("nbq", "ref").alias("nbq_ref"), ratio0(n.cast("double"), F.col("high")).alias("udp_dp_ratio"), F.when(F.col("seen") > 0, entropy).otherwise(0.0).alias("pileup_entropy"),
        mean("nm", "alt").alias("nm_mean_alt"), mean("nm", "ref").alias("nm_mean_ref"), mean("pp", "alt").alias("proper_pair_rate_alt"), mean("pp", "ref").alias("proper_pair_rate_ref"), mean("mate", "alt").alias("fragment_support_rate"),
        mean("span", "alt", "n_span").alias("isize_mean_alt"), mean("span", "ref", "n_span").alias("isize_mean_ref"), mean("fbq", "alt").alias("flank_bq_alt"), mean("fbq", "ref").alias("flank_bq_ref"),
        ratio0(F.col("mm_alt").cast("double"), F.col("al_alt")).alias("true_mismatch_rate_alt"), (F.col("zero") / n).alias("mq0_fraction"),
        F.when(alts > 0, F.col("most") / alts).alias("cigar_agreement"), F.when(alts > 0, F.log2(alts) - F.col("n_log") / alts + 0.0).alias("haplotype_entropy"),
    )
    out = out.withColumns(
        {
            "allele_balance": F.col("alt_depth") / F.col("total_depth"),
            "bq_drop_alt": F.col("bq_mean_ref") - F.col("bq_mean_alt"),
            "softclip_diff": F.col("softclip_rate_alt") - F.col("softclip_rate_ref"),
            "isize_dev": F.col("isize_mean_alt") - F.col("isize_mean_ref"),
            "mq_diff": F.col("mq_mean_alt") - F.col("mq_mean_ref"),
            "mismatch_rate_alt": F.col("true_mismatch_rate_alt"),
            "cigar_agreement": F.coalesce("cigar_agreement", F.lit(0.0)),
            "haplotype_entropy": F.coalesce("haplotype_entropy", F.lit(0.0)),
            "is_insertion": F.col("is_insertion").cast("long"),
        }
    )
    return out.select(*KEY, *(F.col(f).cast("long" if f in INTEGERS else "double").alias(f) for f in FEATURES))
