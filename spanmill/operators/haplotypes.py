"""Comparison of two call sets by the sequences they spell.

Two callers may describe one change by different records: another place in a repeat, one long or two short ones. So
records that lie near each other, of both sets, form a cluster, and in each cluster the largest choice of records of both sets is
looked for whose alleles, put into the reference, give one and the same sequence. Ploidy is ignored: one allele of a record
is enough for the record.

A cluster is a stretch of occupied bins; a record occupies the bins from where its alleles begin when moved left as far as they
go up to its end. Distinct bins of a chromosome are as many as its length allows, however many records there are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pileup import FASTA_BIN, FASTA_MARGIN, shuffled

BIN = 64
NEAR = 64  # bases that all keys are held against; few go on from there
RECORD = "struct<pos:bigint,ref:string,alt:array<string>>"


def trimmed(keys: DataFrame) -> DataFrame:
    """Keys without shared last bases, then without shared first bases, at least one base left on both sides."""
    rest = "array_max(filter(sequence(0, least(length(ref), length(alt)) - 1), n -> right(ref, n) = right(alt, n)))"
    out = keys.withColumn("_n", F.expr(rest)).selectExpr("* except (ref, alt, _n)", "left(ref, length(ref) - _n) as ref", "left(alt, length(alt) - _n) as alt")
    first = "array_max(filter(sequence(0, least(length(ref), length(alt)) - 1), n -> left(ref, n) = left(alt, n)))"
    return out.withColumn("_n", F.expr(first)).selectExpr("* except (pos, ref, alt, _n)", "pos + _n as pos", "substring(ref, _n + 1) as ref", "substring(alt, _n + 1) as alt")


def left_aligned(keys: DataFrame, bins: DataFrame, settle) -> DataFrame:
    """Trimmed keys moved to the left as far as the sequence allows: a lone inserted or deleted unit turns by one base a step.

    ``bins``: (chrom, bin, bin_start, seq) as ``fasta_bins`` gives them. A key moves by ``NEAR`` bases at most, in later rounds within its bin and
    margin; what reaches their start, and nothing else, goes on in the next round. ``settle`` writes a round's rows.
    """
    rows, done, reach = settle(trimmed(keys)), None, NEAR
    names = rows.columns
    while True:
        there = rows.withColumn("bin", F.expr(f"(pos - 1) div {FASTA_BIN}")).join(shuffled(bins).select("chrom", "bin", "bin_start", F.upper("seq").alias("_seq")), ["chrom", "bin"], "left")
        # the anchor and the bases before it, nearest first, against the unit, last base first, again and again
        there = there.withColumn("_n", F.expr("cast(pos - 1 - bin_start as int)"))
        there = there.withColumn("_left", F.expr(f"reverse(substring(_seq, greatest(1, _n - {reach} + 1), least(_n, {reach})))")).withColumn("_unit", F.expr("reverse(substring(if(length(ref) > length(alt), ref, alt), 2))"))
        there = there.withColumn("_run", F.expr("concat(left(ref, 1), _left)")).withColumn("_same", F.expr("repeat(_unit, cast(length(_run) div greatest(1, length(_unit)) + 1 as int))"))
        anchored = F.expr("least(length(ref), length(alt)) = 1 and length(ref) != length(alt) and left(ref, 1) = left(alt, 1) and _seq is not null")
        common = F.expr("aggregate(transform(sequence(0, 10), k -> shiftleft(1, 10 - k)), 0, (n, s) -> if(n + s <= length(_run) and left(_run, n + s) = left(_same, n + s), n + s, n))")
        there = there.withColumn("_steps", F.when(anchored, F.least(common, F.length("_left"))).otherwise(0))
        turned = "concat(substring(_unit, _steps % greatest(1, length(_unit)) + 1), left(_unit, _steps % greatest(1, length(_unit))))"
        there = there.withColumn("_turned", F.expr(f"concat(substring(_run, _steps + 1, 1), reverse({turned}))")).withColumn("_anchor", F.expr("substring(_run, _steps + 1, 1)"))
        out = there.select(
            *[c for c in names if c not in ("pos", "ref", "alt")], (F.col("pos") - F.col("_steps")).alias("pos"),
            F.expr("if(_steps = 0, ref, if(length(ref) > length(alt), _turned, _anchor))").alias("ref"), F.expr("if(_steps = 0, alt, if(length(ref) > length(alt), _anchor, _turned))").alias("alt"),
            F.expr("_steps > 0 and _steps = length(_left) and pos - _steps > 1").alias("_more"),
        )
        out = settle(out)
        still, rows = out.where("not _more").select(*names), out.where("_more").select(*names)
        done = still if done is None else done.unionByName(still)
        if rows.isEmpty():
            return done
        reach = FASTA_BIN + FASTA_MARGIN


# ---------------------------------------------------------------- one cluster


def _emitted(lead: tuple[int, str], side: int, new: str) -> tuple[int, str] | None:
    """Which side is ahead by which bases after ``side`` has spelled ``new``; None if the two differ."""
    ahead, text = lead
    if not new:
        return lead
    if not text or ahead == side:
        return side, text + new
    n = min(len(text), len(new))
    if text[:n] != new[:n]:
        return None
    return (ahead, text[n:]) if len(text) > n else (side, new[n:])


def replay(ref: str, sides: tuple[list[tuple[int, int, list[str]]], list[tuple[int, int, list[str]]]]) -> tuple[int, int]:
    """Bit masks (first record: highest bit) of the records of both sides that spell one sequence.

    ``sides``: of each (start, end, alleles) in ``ref``, by start. The most records win, then the most of the first side, then
    those that stand first. Records are decided on in order, for the side that has spelled less; whatever is sure is
    spelled at once, so choices that differ from the other side end early, and of choices that leave the same to do the best one goes on.
    """
    ends = len(sides[0]), len(sides[1])

    def spelled(state, side: int, c: int, p: int, text: str):
        """(c, p, lead) after ``text`` and all reference up to the next record."""
        until = sides[side][c][0] if c < ends[side] else len(ref)
        lead = _emitted(state, side, text + ref[p:until])
        return None if lead is None else (c, max(p, until), lead)

    a = spelled((0, ""), 0, 0, 0, "")
    b = spelled(a[2], 1, 0, 0, "")
    layer = {(0, 0, a[1], b[1], b[2]): (0, 0, 0, 0)}
    for _ in range(sum(ends)):
        further: dict = {}
        for (ca, cb, pa, pb, lead), (n, na, ma, mb) in layer.items():
            side = 0 if ca < ends[0] and (cb == ends[1] or lead[0] == 1 or not lead[1]) else 1
            c, p = (ca, pa) if side == 0 else (cb, pb)
            start, end, alleles = sides[side][c]
            choices = [(0, p, "")] + [(1, end, ref[p:start] + x) for x in alleles if start >= p]
            for taken, to, text in choices:
                if (after := spelled(lead, side, c + 1, to, text)) is None:
                    continue
                if side == 0:
                    key, value = (c + 1, cb, after[1], pb, after[2]), (n + taken, na + taken, 2 * ma + taken, mb)
                else:
                    key, value = (ca, c + 1, pa, after[1], after[2]), (n + taken, na, ma, 2 * mb + taken)
                if further.get(key, (-1,)) < value:
                    further[key] = value
        layer = further
    return max(value for (_, _, _, _, lead), value in layer.items() if not lead[1])[2:]


def _replayed(frames: Iterator) -> Iterator:
    """(side, record) of the matched records of each cluster."""
    import pandas as pd

    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            sets = [sorted(((int(x["pos"]), x["ref"], list(x["alt"])) for x in s), key=lambda v: (v[0], v[0] + len(v[1]), v[1], v[2])) for s in (r.calls, r.truth)]
            if r.seq is None:  # no sequence: only records that are equal
                for side, own, other in ((0, *sets), (1, sets[1], sets[0])):
                    out += [(r.chrom, side, v) for v in own if any(v[:2] == w[:2] and set(v[2]) & set(w[2]) for w in other)]
                continue
            sides = tuple([(p - 1 - r.lo, p - 1 - r.lo + len(x), alts) for p, x, alts in s] for s in sets)
            for side, (mask, own) in enumerate(zip(replay(r.seq, sides), sets, strict=True)):
                out += [(r.chrom, side, v) for i, v in enumerate(own) if mask >> (len(own) - 1 - i) & 1]
        yield pd.DataFrame({"chrom": [c for c, _, _ in out], "side": [s for _, s, _ in out], "pos": [v[0] for _, _, v in out], "ref": [v[1] for _, _, v in out], "alt": [v[2] for _, _, v in out]})


# ---------------------------------------------------------------- all of them


def _records(variants: DataFrame, side: int) -> DataFrame:
    """Distinct (side, chrom, pos, ref, alt), alleles that are sequences only."""
    bases = "'^[ACGTN]+$'"
    rows = variants.select(F.lit(side).alias("side"), "chrom", F.col("pos").cast("long").alias("pos"), F.upper("ref").alias("ref"), F.expr(f"array_sort(array_distinct(filter(transform(alt, a -> upper(a)), a -> a rlike {bases} and a != upper(ref))))").alias("alt"))
    return rows.where(f"chrom is not null and pos > 0 and ref rlike {bases} and size(alt) > 0").dropDuplicates()


def matched(calls: DataFrame, truth: DataFrame, bins: DataFrame, settle) -> DataFrame:
    """(side, chrom, pos, ref, alt) of the records (chrom, pos, ref, alt array) of ``calls`` (side 0) and ``truth`` (1) that spell the same.

    Alleles come in upper case, distinct and sorted. ``bins`` is the reference as ``fasta_bins`` gives it; ``settle`` writes a table once.
    """
    key = ["side", "chrom", "pos", "ref", "alt"]
    bins = settle(bins)  # used in each round, and for the clusters
    records = settle(_records(calls, 0).unionByName(_records(truth, 1)))
    alleles = records.select("chrom", "pos", "ref", F.explode("alt").alias("alt"), F.struct(*key).alias("record"))
    first = left_aligned(alleles, bins, settle).groupBy("record").agg(F.min("pos").alias("first"))
    spans = settle(first.select("record.*", F.least("first", F.col("record.pos")).alias("first")).withColumns({"lo": F.col("first") - 1, "hi": F.expr("pos - 1 + length(ref)")}))

    # stretches of occupied bins
    occupied = spans.select("chrom", F.explode(F.expr(f"sequence(lo div {BIN}, hi div {BIN})")).alias("b")).distinct()
    stretch = occupied.withColumn("cluster", F.col("b") - F.row_number().over(Window.partitionBy("chrom").orderBy("b")))
    placed = spans.withColumn("b", F.expr(f"lo div {BIN}")).join(stretch, ["chrom", "b"])
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("pos", "ref", "alt")))
    clusters = placed.groupBy("chrom", "cluster").agg(of(0).alias("calls"), of(1).alias("truth"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    clusters = settle(clusters.where("size(calls) > 0 and size(truth) > 0"))

    # the reference of a cluster, from the cores of its bins
    pieces = clusters.select("chrom", "cluster", "lo", "hi", F.explode(F.expr(f"sequence(lo div {FASTA_BIN}, (hi - 1) div {FASTA_BIN})")).alias("bin")).join(shuffled(bins).select("chrom", "bin", "bin_start", F.upper("seq").alias("_seq")), ["chrom", "bin"], "left")
    pieces = pieces.withColumns({"_from": F.expr(f"greatest(lo, bin * {FASTA_BIN})"), "_to": F.expr(f"least(hi, (bin + 1) * {FASTA_BIN})")})
    pieces = pieces.withColumn("piece", F.expr("substring(_seq, cast(_from - bin_start + 1 as int), cast(_to - _from as int))"))
    listed = F.array_sort(F.collect_list(F.struct("bin", "piece")))
    spelled = pieces.groupBy("chrom", "cluster").agg(F.array_join(F.transform(listed, lambda x: x["piece"]), "").alias("seq"), F.first("lo").alias("_lo"), F.first("hi").alias("_hi"))
    spelled = spelled.select("chrom", "cluster", F.when(F.length("seq") == F.col("_hi") - F.col("_lo"), F.col("seq")).alias("seq"))
    whole = clusters.join(spelled, ["chrom", "cluster"]).select("chrom", "lo", "seq", "calls", "truth")
    return whole.mapInPandas(_replayed, "chrom string, side int, pos bigint, ref string, alt array<string>").select(*key)
