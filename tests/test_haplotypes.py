import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F
from spanmill.operators import haplotypes, pileup
from spanmill.operators.haplotypes import replay
from spanmill.plans import sites, workflow
from spanmill.sources import files

ROW = "chrom string, pos long, ref string, alt array<string>"


def spellings(ref, records):
    """Every choice of records that don't overlap, with an allele of each: {sequence: choices}."""
    out = {}
    for taken in product([0, 1], repeat=len(records)):
        for which in product(*[range(len(r[2])) if t else [0] for r, t in zip(records, taken, strict=True)]):
            text, at = "", 0
            for (start, end, alleles), t, w in zip(records, taken, which, strict=True):
                if t:
                    if start < at:
                        break
                    text, at = text + ref[at:start] + alleles[w], end
            else:
                out.setdefault(text + ref[at:], set()).add(taken)
    return out


def brute(ref, sides):
    a, b = (spellings(ref, s) for s in sides)
    return max((sum(x) + sum(y), sum(x), x, y) for s in a.keys() & b.keys() for x in a[s] for y in b[s])[2:]


def bits(mask, n):
    return tuple(mask >> (n - 1 - i) & 1 for i in range(n))


def some_records(rng, ref, most=4):
    out = set()
    for _ in range(rng.randint(0, most)):
        start = rng.randrange(len(ref) - 1)
        end = min(len(ref), start + rng.randint(1, 3))
        alleles = {rng.choice([ref[start], ref[start:end] * 2, "".join(rng.choice("AC") for _ in range(rng.randint(1, 3)))]) for _ in range(rng.choice([1, 1, 2]))} - {ref[start:end]}
        if alleles:
            out.add((start, end, tuple(sorted(alleles))))
    return [(a, b, list(x)) for a, b, x in sorted(out)]


@pytest.mark.parametrize("letters", ["AAC", "ACG", "AC"])
def test_replay_equals_every_choice(letters):
    rng = random.Random(letters)
    hits = 0
    for _ in range(700):
        ref = "".join(rng.choice(letters) for _ in range(rng.randint(6, 22)))
        sides = (some_records(rng, ref), some_records(rng, ref))
        got = tuple(bits(m, len(s)) for m, s in zip(replay(ref, sides), sides, strict=True))
        assert got == brute(ref, sides)
        hits += sum(got[0])
    assert hits > 40


def test_replay_of_many_records():
    """One cluster of thousands of records takes no more than a walk along it."""
    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(30_000))
    calls = [(i, i + 2, [ref[i]]) for i in range(10, 29_900, 7)]
    truth = [c for c in calls if c[0] % 5]
    a, b = replay(ref, (calls, truth))
    assert b == (1 << len(truth)) - 1 and bin(a).count("1") == len(truth)


def reference(spark, seqs):
    """Bins of 1,000 bases with margins of 64."""
    rows = [(c, b, max(0, b * 1000 - 64), s[max(0, b * 1000 - 64) : (b + 1) * 1000 + 64]) for c, s in seqs.items() for b in range((len(s) - 1) // 1000 + 1)]
    return spark.createDataFrame(rows, "chrom string, bin long, bin_start long, seq string")


def test_whole_call_sets(spark):
    """Groups of records far from each other, some of them across bins, against all choices of each group."""
    rng = random.Random(11)
    seqs = {c: "".join(rng.choice("AAACCGT") for _ in range(40_000)) for c in ("chr1", "chr2")}
    calls, truth, want = [], [], set()
    for c, s in seqs.items():
        for at in [*range(500, 39_000, 777), 985, 1995]:
            if any(abs(at - x) < 400 and at != x for x in range(500, 39_000, 777)):
                continue
            part = s[at : at + 24]
            sides = some_records(rng, part), some_records(rng, part)
            if rng.random() < 0.6:
                sides = (sides[0], sorted(sides[0] + sides[1])[:4]) if rng.random() < 0.5 else (sides[0], sides[0])
            for rows, side in zip((calls, truth), sides, strict=True):
                rows += [(c, at + 1 + a, part[a:b], x) for a, b, x in side]
            # with all of the sequence around: what leaves the 24 bases may meet its like there
            sides = tuple([(a + 200, b + 200, x) for a, b, x in side] for side in sides)
            for side, taken in enumerate(brute(s[at - 200 : at + 224], sides)):
                want |= {(side, c, at + 1 + a - 200, s[at - 200 :][a:b], tuple(sorted(x))) for (a, b, x), t in zip(sides[side], taken, strict=True) if t}
    got = haplotypes.matched(spark.createDataFrame(calls + calls[:3], ROW), spark.createDataFrame(truth, ROW), reference(spark, seqs), files.settled)
    got = {(r.side, r.chrom, r.pos, r.ref, tuple(r.alt)) for r in got.collect()}
    # records that say the same twice may be chosen one for the other: counts are unique, choices are by order
    assert got == want and len(got) > 60


def test_records_that_say_the_same_together(spark):
    s = "GATTACA" * 300
    p = 707  # 0-based, a G
    calls = [("c", p + 1, s[p : p + 2], [s[p]]), ("c", p + 3, s[p + 2 : p + 4], [s[p + 3]]), ("c", 1400, s[1399], [s[1399] + "CCC", s[1399] + "G"]), ("c", 30, "<DEL>", ["A"]), ("c", 31, s[30], ["<DEL>", "*"]), (None, 5, "A", ["AT"])]
    truth = [("c", p + 1, s[p : p + 3], [s[p]]), ("c", 1400, s[1399].lower(), [s[1399].lower() + "ccc"])]
    frames = [spark.createDataFrame(x, ROW) for x in (calls, truth)]
    bins = reference(spark, {"c": s})
    t, f = workflow.compare(*frames, bins=bins)
    found = sorted((r.pos, r.alt) for r in t.collect())
    # a record of two alleles is true as a whole
    assert found == [(p + 1, s[p]), (p + 3, s[p + 3]), (1400, s[1399] + "CCC"), (1400, s[1399] + "G")]
    assert sorted((r.pos, r.alt) for r in f.collect()) == [(5, "AT"), (30, "A"), (31, "<DEL>")]
    # a region that holds one of them only
    regions = spark.createDataFrame([("c", 1300, 1500)], "chrom string, start long, end long")
    t, f = workflow.compare(*frames, regions, bins)
    assert {r.pos for r in t.collect()} == {1400} and f.count() == 0
    # no sequence of that name: records that are equal
    t, _ = workflow.compare(*frames, bins=reference(spark, {"d": s}))
    assert {r.pos for r in t.collect()} == {1400}
    t, f = workflow.compare(frames[0], frames[1].limit(0), bins=bins)
    assert t.count() == 0 and f.count() == 7


def test_the_reference_is_made_by_all_tasks(spark, tmp_path):
    spark.range(1, 900).selectExpr("id as p_partkey", "cast(id % 7 as int) as p_size", "'n' as p_name").write.parquet(f"{tmp_path}/part.parquet")
    bins = sites.call_sets(spark, str(tmp_path))[2]
    rows = bins.select("chrom", "bin", "bin_start").collect()
    assert sorted(tuple(r) for r in rows) == [(f"chr{c}", b, max(0, b * 1000 - 64) // 32 * 32) for c in (1, 2, 3) for b in range(289)]
    assert bins.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_the_reference_is_not_sent_to_every_task(spark, tmp_path):
    """Its rows are made, and their size is estimated far too low; a driver failed when it held them all."""
    spark.range(1, 900).selectExpr("id as p_partkey", "cast(id % 7 as int) as p_size", "concat('n', id) as p_name").write.parquet(f"{tmp_path}/part.parquet")
    plans = []

    def settle(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return files.settled(df)

    calls, truth, bins = sites.call_sets(spark, str(tmp_path))
    settle(haplotypes.matched(calls, truth, bins, settle))
    settle(pileup.with_context(pileup.indel_sites(calls.withColumn("ord", F.col("pos"))), bins))
    assert sum(bool(re.search(r"\w+Join \[chrom#\d+, bin#\d+", p)) for p in plans) >= 3
    assert not [p for p in plans if re.search(r"Broadcast\w*Join \[chrom#\d+, bin#\d+", p)]


def test_left_aligned_over_long_repeats(spark):
    """Units that turn within the first look, beyond it, beyond their bin, and up to the sequence's start."""
    rng = random.Random(5)
    body = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    s = "A" * 90 + "C" + body(300) + "G" + "T" * 40 + "C" + body(500) + "G" + "CA" * 80 + "T" + body(400) + "G" + "A" * 1500 + "C" + body(300)
    want = lambda p, ref, alt: turned_left(s, p, ref, alt)
    keys = []
    for end in [s.index("AC", 80) + 1, s.index("T" * 40) + 40, s.index("CA" * 80) + 160, s.index("A" * 1500) + 1500]:
        for unit in (1, 2):
            for at in (end, end - 7):
                keys += [("c", at - unit, s[at - unit - 1 : at], s[at - unit - 1]), ("c", at, s[at - 1], s[at - 1] + s[at - unit : at])]
    got = haplotypes.left_aligned(spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "chrom string, pos long, ref string, alt string, i int"), reference(spark, {"c": s}), files.settled)
    assert {r.i: (r.pos, r.ref, r.alt) for r in got.collect()} == {i: want(*k[1:]) for i, k in enumerate(keys)}


def turned_left(s, pos, ref, alt):
    """One base a step."""
    while len(ref) != len(alt) and min(len(ref), len(alt)) == 1 and ref[0] == alt[0] and pos > 1 and max(ref, alt, key=len)[-1] == ref[0]:
        first = s[pos - 2]
        ref, alt, pos = first + ref[:-1] if len(ref) > 1 else first, first + alt[:-1] if len(alt) > 1 else first, pos - 1
    return pos, ref, alt
