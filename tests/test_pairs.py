import random
import re

import pytest
from pyspark.sql import functions as F
from spanmill.functions import cigar as C
from spanmill.functions import pairs as P
from spanmill.operators import pileup

SITES = "chrom string, pos long, ref string, alt array<string>, ord long"
READS = "qname string, flag int, chrom string, start long, mapq int, cigar string, isize long, seq string, quals array<int>, nm int, ord long"
BINS = "chrom string, bin long, bin_start long, seq string"


def test_shown(spark):
    """The batches against the columns over single CIGARs and base by base: many blocks, odd CIGARs, short, missing and lower-case sequences, over several batches."""
    rng, rows = random.Random(5), []
    cigars = ["*", "", None, "7", "5Q3M7", "12MM3I", "M4D", "0M0D3M", "3M2", "1H2S3M1I2M2D4M3N2=1X5S", "1S" * 9 + "20M" + "1I1M2D1M" * 6 + "100000D5M"]
    for i in range(900):
        cigar = cigars[i] if i < len(cigars) else "".join(f"{rng.choice([0, 1, 2, 3, 5, 9, 30])}{rng.choice('MMMMIDS=XN')}" for _ in range(rng.randrange(1, 12)))
        n = rng.choice([0, 3, 20, 70, None])
        seq = None if n is None else "".join(rng.choice("ACGTNacgt?") for _ in range(n))
        quals = rng.choice([None, [], [rng.randrange(60) for _ in range(rng.randrange(90))]])
        pos = rng.randrange(60)
        told_start = max(0, pos - 5)
        rows.append((i, rng.randrange(max(1, pos - 20), pos + 3), cigar, seq, quals, pos, rng.random() < 0.5, rng.randrange(1, 7), "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 4, pos + 6 - told_start]))), told_start))
    df = spark.createDataFrame(rows, "id long, start long, cigar string, seq string, quals array<int>, pos0 long, is_insertion boolean, indel_size long, flank string, flank_start long")
    df = df.withColumns({"blocks": C.blocks(), "shown": P.shown(5)})
    want = {"alt": F.coalesce(C.supports("is_insertion", "indel_size", "pos0"), F.lit(False)), "signature": C.signature("pos0"), "sc": F.coalesce(C.blocks_clipped().cast("double"), F.lit(0.0)), "q": C.query_position("pos0"), "mean": F.expr(C.mean("quals"))}
    got = df.select("*", *[c.alias(f"_{k}") for k, c in want.items()]).collect()
    assert len(got) == len(rows) and sum(r._alt for r in got) > 30 and sum(r.shown.mm for r in got) > 30
    for r in got:
        x, seq, quals = r.shown, r.seq or "", r.quals or []
        assert (x.is_alt, x.sig, x.sc, x.bq) == (r._alt, r._signature if r._alt else None, r._sc, pytest.approx(r._mean)), r
        base = seq[r._q] if r._q is not None and r._q < len(seq) else None
        assert x.base == (P.BASES.index(base) if base and base in P.BASES else -1), r
        size = len(seq) or 150
        assert x.ed == (size // 2 if r._q is None else min(r._q, max(size - r._q, 0))), r
        places = {b.r + k: b.q + k for b in r.blocks or [] if b.op in "M=X" for k in range(b.n)}
        rated = {p: quals[q] for p, q in places.items() if q < len(quals)}
        n, f = ([v for p, v in rated.items() if lo <= p - r.pos0 <= hi] for lo, hi in ((-4, 6), (-5, 5)))
        whole = bool(seq and quals)
        assert (x.nbq, x.fbq, x.al) == (pytest.approx(sum(n) / max(len(n), 1)), pytest.approx(sum(f) / max(len(f), 1) if whole else 0), len(f) if whole else 0), r
        told = {r.flank_start + k: c for k, c in enumerate(r.flank)}
        assert x.mm == (sum(seq[q].upper() != told[p] for p, q in places.items() if abs(p - r.pos0) <= 5 and q < len(seq) and p in told) if whole else 0), r


def test_shown_without_rows(spark):
    df = spark.createDataFrame([], "start long, cigar string, seq string, quals array<int>, pos0 long, is_insertion boolean, indel_size long, flank string, flank_start long")
    assert df.select(P.shown(5)).count() == 0


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_plan_of_an_extraction(spark, tmp_path, mode):
    """Neither reads nor pairs pass an interpreted loop over blocks or qualities, and a single small file of sites is more than one task."""
    spark.createDataFrame([("c", p, "A", ["AT"], p) for p in range(1, 4000, 7)], SITES).coalesce(1).write.parquet(f"{tmp_path}/sites")
    reads = spark.createDataFrame([(f"r{i}", 0, "c", i, 30, "30M", 0, "A" * 30, [30] * 30, 0, i) for i in range(0, 4000, 9)], READS)
    bins = spark.createDataFrame([("c", b, b * 1000, "A" * 1100) for b in range(4)], BINS)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan isn't known before it runs
    try:
        sites = spark.read.parquet(f"{tmp_path}/sites")
        told = pileup.extract(sites, reads, bins, mode=mode, chunk=500)._jdf.queryExecution().executedPlan().toString()
        context = pileup.with_context(pileup.indel_sites(sites), bins)
        busy = context.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert not re.findall(r"quals[^,]*lambdafunction|named_struct\(op|blocks#", told)
    assert busy > 1
