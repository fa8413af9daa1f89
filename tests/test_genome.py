import math
import random
import re
import struct
from collections import Counter

import pytest
from genome import bam, fasta, genome, is_support, pairs_of, sam, strict, sweep, vcf
from pyspark.sql import functions as F
from spanmill.functions import cigar as C
from spanmill.operators import labels, pileup
from spanmill.sources import bam as bam_source
from spanmill.sources import fasta as fasta_source
from spanmill.sources import text

REF, READS, SITES = genome(1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    (d / "a.sam").write_text(sam(REF, READS))
    data, index = bam(REF, READS)
    (d / "a.bam").write_bytes(data)
    (d / "b.bam").write_bytes(data)
    (d / "b.bam.bai").write_bytes(index)
    fa, fai = fasta(REF)
    (d / "ref.fa").write_text(fa)
    (d / "ref.fa.fai").write_text(fai)
    (d / "calls.vcf").write_text(vcf(SITES))
    return str(d)


COLUMNS = ["qname", "flag", "chrom", "start", "mapq", "cigar", "isize", "seq", "quals", "nm"]


def test_sam(spark, folder):
    got = text.read_sam(spark, f"{folder}/a.sam").orderBy("ord").select(*COLUMNS).collect()
    assert [r.asDict() for r in got] == [{c: x[c] for c in COLUMNS} for x in READS]


@pytest.mark.parametrize(("name", "parts"), [("a", 1), ("b", 4)])
def test_bam(spark, folder, name, parts):
    df = bam_source.read_bam(spark, f"{folder}/{name}.bam", split_bytes=5_000)
    assert df.rdd.getNumPartitions() >= parts
    assert [r.asDict() for r in df.orderBy("ord").select(*COLUMNS).collect()] == [{c: x[c] for c in COLUMNS} for x in READS]


def test_bam_regions(spark, tmp_path):
    """With an index of each reference only the asked one's ranges are read."""
    data, _ = bam(REF, READS)
    blocks, starts, at = bgzf_starts()
    index = b"BAI\1" + struct.pack("<i", 2)
    for c in REF:
        places = [p for p, x in zip(starts, READS, strict=True) if x["chrom"] == c]
        index += struct.pack("<i", 0) + struct.pack("<i", len(places)) + struct.pack(f"<{len(places)}Q", *places)
    (tmp_path / "c.bam").write_bytes(data)
    (tmp_path / "c.bam.bai").write_bytes(index)
    for chroms in (["chr1"], ["chr2"], ["chr1", "chr2"], ["chr9"]):
        df = bam_source.read_bam(spark, f"{tmp_path}/c.bam", split_bytes=3_000, chroms=",".join(chroms))
        assert [r.asDict() for r in df.orderBy("ord").select(*COLUMNS).collect()] == [{c: x[c] for c in COLUMNS} for x in READS if x["chrom"] in chroms]
    whole = bam_source.read_bam(spark, f"{tmp_path}/c.bam", split_bytes=3_000)
    assert whole.count() == len(READS) and whole.rdd.getNumPartitions() > 3


def bgzf_starts():
    """Places of the records, from the one-reference index."""
    data, index = bam(REF, READS)
    (n,) = struct.unpack_from("<i", index, 36)
    return data, struct.unpack_from(f"<{n}Q", index, 40), n


def test_fasta(spark, folder):
    got = {(r.chrom, r.bin): r for r in fasta_source.fasta_bins(spark, f"{folder}/ref.fa", bin_size=100, margin=7).collect()}
    assert len(got) == sum(-(-len(s) // 100) for s in REF.values())
    for (c, b), r in got.items():
        lo = max(0, b * 100 - 7)
        assert r.bin_start == lo and r.seq == REF[c][lo : b * 100 + 107]


def test_numbers_of_lines(spark, tmp_path, monkeypatch):
    """Numbers go on over stretches and files, without a window over all rows."""
    monkeypatch.setattr(text, "STRETCH", 4)
    for f in "ba":
        (tmp_path / f"{f}.vcf").write_text("##x\n" + "".join(f"{f}\t{i}\t.\tA\tAT\t.\t.\t.\n" for i in range(30)) + "#y\n")
    rows = text.numbered(text.read_vcf(spark, str(tmp_path)))
    got = sorted((r.nth, r.chrom, r.pos) for r in rows.collect())
    assert got == [(i + 1, "ab"[i // 30], i % 30) for i in range(60)]
    assert "row_number() windowspecdefinition(_file" in rows._jdf.queryExecution().toString()


def test_vcf(spark, folder):
    got = text.read_vcf(spark, f"{folder}/calls.vcf").orderBy("ord").collect()
    assert [(r.chrom, r.pos, r.ref, r.alt) for r in got] == SITES
    assert got[0].rest == "GT\t0/1" and got[0].qual == 30.0
    assert len(text.vcf_header(spark, f"{folder}/calls.vcf")) == 3


def close(got, want):
    assert sorted((r.chrom, r.pos, r.ref, r.alt) for r in got) == sorted(k for k, _ in want)
    rows = {}
    for r in got:
        rows.setdefault((r.chrom, r.pos, r.ref, r.alt), r)
    for key, row in want:
        for name in pileup.FEATURES:
            assert math.isclose(rows[key][name], row[name], abs_tol=1e-9), (key, name, rows[key][name], row[name])


@pytest.mark.parametrize("mode", [("strict", 0), ("compat", 90), ("compat", 1_000_000)])
def test_features(spark, folder, mode):
    variants, reads, bins = text.read_vcf(spark, f"{folder}/calls.vcf"), text.read_sam(spark, f"{folder}/a.sam"), fasta_source.fasta_bins(spark, f"{folder}/ref.fa")
    want = list(strict(REF, READS, SITES)) if mode[0] == "strict" else list(sweep(REF, READS, SITES, mode[1]))
    got = pileup.extract(variants, reads, bins, mode=mode[0], chunk=mode[1] or 1, bin_size=70)
    assert got.columns == [*pileup.KEY, *pileup.FEATURES]
    close(got.collect(), want)
    assert sum(row["alt_depth"] > 0 for _, row in want) > 3


def test_empty_inputs(spark, folder):
    variants, reads, bins = text.read_vcf(spark, f"{folder}/calls.vcf"), text.read_sam(spark, f"{folder}/a.sam"), fasta_source.fasta_bins(spark, f"{folder}/ref.fa")
    assert pileup.extract(variants.limit(0), reads, bins).count() == 0
    assert pileup.extract(variants, reads.limit(0), bins).count() == 0
    bare = pileup.extract(variants, reads, bins.limit(0)).collect()
    assert bare and all((r.gc_content_50bp, r.homopolymer_length, r.tandem_repeat_unit, r.tandem_repeat_length) == (0.0, 1, 1, 1) for r in bare)
    with pytest.raises(ValueError):
        pileup.extract(variants, reads, bins, mode="other")


def test_pairs_run_in_small_methods(spark, folder):
    """No part of the plan of an extraction is a method that the JVM would interpret (more than 8,000 bytes)."""
    variants, reads, bins = text.read_vcf(spark, f"{folder}/calls.vcf"), text.read_sam(spark, f"{folder}/a.sam"), fasta_source.fasta_bins(spark, f"{folder}/ref.fa")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan isn't known before it runs
    try:
        out = pileup.extract(variants, reads, bins, mode="compat", chunk=90, bin_size=70)
        told = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert sizes and max(sizes) <= 8_000


@pytest.mark.parametrize("cigar", ["*", "7M", "3S4M", "2S3M1I2M1D4M", "1H2S3M1I2M2D4M3N2=1X5S", "3M0D0M2M", None])
def test_blocks(spark, cigar):
    want, r, q = [], 10, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        want.append((op, int(n), r, q))
        r, q = r + (int(n) if op in "M=XDN" else 0), q + (int(n) if op in "M=XIS" else 0)
    df = spark.createDataFrame([(cigar, 10)], "cigar string, start long").withColumn("blocks", C.blocks())
    got = df.select("blocks", C.blocks_clipped().alias("sc"), C.soft_clipped().alias("known")).first()
    assert got.blocks == (None if cigar is None else want) and got.sc == got.known


def test_windows_of_odd_reads(spark):
    """Short qualities or sequences, empty blocks and several blocks in a window count as they would base by base."""
    ref = "".join(random.Random(3).choice("ACGT") for _ in range(60))
    reads = []
    for i, cigar in enumerate(["30M", "8M3D9M2N8M", "9M1I4M0M5M", "10M2I1M2D2M9S", "4S6M1D20M", "12M30N2M"]):
        n = sum(int(k) for k, op in re.findall(r"(\d+)([MIS=X])", cigar))
        for seq, quals in [(n, n), (n - 9, n), (n, n - 9), (0, n), (n, 0)]:
            reads.append((f"r{len(reads)}", 0, "c", 8 + i % 3, 30, cigar, 0, ("ACGTA" * 20)[:seq], [(7 * k + i) % 40 for k in range(quals)], 1, len(reads)))
    frame = spark.createDataFrame(reads, "qname string, flag int, chrom string, start long, mapq int, cigar string, isize long, seq string, quals array<int>, nm int, ord long")
    sites = spark.createDataFrame([("c", p, "A", ["AT"], p) for p in (12, 17, 20, 22, 25, 30)], "chrom string, pos long, ref string, alt array<string>, ord long")
    bins = spark.createDataFrame([("c", 0, 0, ref[:27])], "chrom string, bin long, bin_start long, seq string")
    got = {(r.pos): r for r in pileup.extract(sites, frame, bins).collect()}
    for pos, row in got.items():
        pos0, alt, other = pos - 1, [], []
        for _, _, _, start, _, cigar, _, seq, quals, _, _ in reads:
            pairs, end = pairs_of({"start": start, "cigar": cigar})
            if not start <= pos0 < end:
                continue
            n = [quals[q] for p, q in pairs.items() if pos0 - 4 <= p <= pos0 + 6 and q < len(quals)]
            f = [quals[q] for p, q in pairs.items() if pos0 - 5 <= p <= pos0 + 5 and q < len(quals)]
            near, whole = [(p, q) for p, q in pairs.items() if pos0 - 5 <= p <= pos0 + 5], bool(quals and seq)
            wrong = sum(p < 27 and q < len(seq) and seq[q] != ref[p] for p, q in near)
            x = (sum(n) / len(n) if n else 0.0, sum(f) / len(f) if f and whole else 0.0, len(f) if whole else 0, wrong if whole else 0)
            (alt if is_support({"start": start, "cigar": cigar}, True, 1, pos0) else other).append(x)
        mean = lambda g, i: sum(x[i] for x in g) / len(g) if g else 0.0
        al = sum(x[2] for x in alt)
        want = [len(alt) + len(other), mean(alt, 0), mean(other, 0), mean(alt, 1), mean(other, 1), sum(x[3] for x in alt) / al if al else 0.0]
        told = [row.total_depth, row.nbq_alt, row.nbq_ref, row.flank_bq_alt, row.flank_bq_ref, row.mismatch_rate_alt]
        assert told == pytest.approx(want, abs=1e-9), pos
    assert len(got) == 6 and any(r.mismatch_rate_alt > 0 for r in got.values())


def test_labels(spark):
    key = "chrom string, pos long, ref string, alt string"
    rows = spark.createDataFrame([("c", 1, "A", "AT"), ("c", 2, "A", "AT"), ("c", 3, "A", "AT"), ("c", 4, "A", "NA")], key)
    tp = spark.createDataFrame([("c", 1, "A", "AT"), ("c", 1, "A", "AT"), ("c", 4, "A", "NA")], key)
    fp = spark.createDataFrame([("c", 1, "A", "AT"), ("c", 2, "A", "AT")], key)
    got = {r.pos: (r.label, r.matched) for r in labels.label(rows, tp, fp).collect()}
    assert got == {1: (1, True), 2: (0, True), 3: (0, False), 4: (1, True)}


def test_annotate_and_write(spark, folder, tmp_path):
    rng = random.Random(3)
    variants = text.read_vcf(spark, f"{folder}/calls.vcf")
    scores = {}
    for c, p, r, alts in SITES:
        for a in alts:
            if len(a) != len(r) and rng.random() < 0.7:
                scores[(c, p, r, a)] = rng.choice([0.25, 0.5, 1.0, 0.123456])
    rows = spark.createDataFrame([(*k, v) for k, v in scores.items()], "chrom string, pos long, ref string, alt string, prob double")
    out = labels.annotate(variants, rows, 0.5)
    text.write_vcf(out, text.vcf_header(spark, f"{folder}/calls.vcf"), f"{tmp_path}/out")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out").withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id()).orderBy("f", "i").collect()]
    head = [x for x in lines if x.startswith("#")]
    assert lines[: len(head)] == head and len(head) == 5 and head[-1].startswith("#CHROM")
    records = [x.split("\t") for x in lines[len(head) :]]
    assert [(r[0], int(r[1]), r[3], r[4].split(",")) for r in records] == SITES
    before = [x.split("\t") for x in vcf(SITES).splitlines()[3:]]
    miss = 0
    for new, old, (c, p, r, alts) in zip(records, before, SITES, strict=True):
        indels = [a for a in alts if len(a) != len(r)]
        found = [scores[(c, p, r, a)] for a in indels if (c, p, r, a) in scores]
        miss += len(indels) - len(found)
        assert new[8:] == old[8:]
        if not found:
            assert new == old
            continue
        text_ = "INDEL_PROB=" + ",".join(f"{x:.4f}" for x in found)
        assert new[7] == (text_ if old[7] == "." else f"{old[7]};{text_}")
        assert math.isclose(float(new[5]), -10 * math.log10(1 - min(max(found), 1 - 1e-9)), abs_tol=0.0051)
        assert new[6] == (old[6] if max(found) >= 0.5 else "INDEL_FILTERED")
    assert out.agg(F.sum("n_miss")).first()[0] == miss


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.9), ("a", 3, 0.2), ("b", 0, 0.5)], "k string, o int, prob double")
    assert Counter(map(tuple, labels.last_wins(df, ["k"], "prob", "o").collect())) == Counter([("a", 0.2), ("b", 0.5)])
