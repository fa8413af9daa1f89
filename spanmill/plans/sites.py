"""The whole feature extraction on the driver's tables, and the same in SQL.

Lineitem gives reads (one for each order and line number), part gives variants, and a hash of chromosome and place gives
the reference sequence, so positions grow with the tables and depth doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pileup

TILE = 2_000
LONG = 160
HEX, DNA, SOFT = "0123456789abcdef", "ACGTTGCAAACCGGTT", "AAAAAACCCGGTTAAC"

_READS = f"""
select *, 'chr' || (s % 3 + 1) as chrom, k as start, k * 8 + ln as ord, case when rf = 'R' then 'I' else 'D' end as op,
    (p & 27) + case when p % 11 = 0 then 1024 when p % 13 = 0 then 512 when p % 17 = 0 then 4 else 0 end as flag,
    case when p % 9 = 0 then 0 else (s * 3 + ln) % 61 end as mapq, case when p % 5 = 0 then 0 else p % 700 - 300 end as isize, case when p % 4 <> 0 then p % 6 end as nm,
    sc + m1 + m2 + case when rf = 'R' then ln else 0 end as n, translate(md5(cast(p as varchar(20))), '{HEX}', '{DNA}') as dna
from (select l_orderkey as k, l_linenumber as ln, max(l_partkey) as p, max(l_suppkey) as s, cast(max(l_quantity) as int) as m1, max(l_returnflag) as rf,
    cast(max(l_partkey) % 9 + 1 as int) as m2, cast(max(l_suppkey) % 25 as int) as sc from lineitem group by l_orderkey, l_linenumber)
"""
_SITES = f"""
select p_partkey as ord, 'chr' || (p_partkey % 3 + 1) as chrom, p_partkey * 7 + 1 as pos, substr(letters, 1, case when p_size % 2 = 1 then 1 else 1 + p_size % 6 end) as ref,
    substr(letters, 1, case when p_size % 2 = 1 then 1 + p_size % 5 else 1 end) as alt from (select p_partkey, p_size, translate(md5(p_name), '{HEX}', '{DNA}') as letters from part)
"""


def _bins(part: DataFrame, every: int, more: int) -> DataFrame:
    """The reference as fasta bins up to the last part, of 32 bases a block, made by all tasks."""
    last = part.agg(F.max("p_partkey")).first()[0]
    ends = part.sparkSession.range(0 if last is None else (last * every + more) // 1000 + 1).select(F.explode(F.array(*[F.lit(f"chr{i}") for i in (1, 2, 3)])).alias("chrom"), F.col("id").alias("bin"))
    base = f"translate(md5(concat(chrom, ':', b)), '{HEX}', '{SOFT}')"
    bins = ends.withColumn("bin_start", F.expr(f"greatest(0L, bin * {pileup.FASTA_BIN} - {pileup.FASTA_MARGIN}) div 32 * 32"))
    return bins.withColumn("seq", F.expr(f"array_join(transform(sequence(bin_start div 32, ((bin + 1) * {pileup.FASTA_BIN} + {pileup.FASTA_MARGIN}) div 32), b -> {base}), '')"))


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants, reads, fasta bins)."""
    lineitem, part = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/part.parquet")
    # the same rows, but for the flag: only whether the greatest is R is asked, and the greatest number needs no sort as that of texts does
    rows = _READS.replace("max(l_returnflag) as rf", "if(max(case when l_returnflag > 'R' then 2 when l_returnflag = 'R' then 1 else 0 end) = 1, 'R', '') as rf")
    # qualities repeat after 40 bases and start at 23 * (p + ln) % 40 of that cycle, as 7 * 23 % 40 = 1
    cycle = f"array({', '.join(str(i * 7 % 40 + 2) for i in range(40 + LONG))})"
    quals = f"if(n <= {LONG} and p + ln >= 0, slice({cycle}, cast((p + ln) % 40 * 23 % 40 + 1 as int), n), transform(sequence(0, n - 1), i -> cast((p + i * 7 + ln) % 40 + 2 as int))) as quals"
    reads = spark.sql(rows.replace("from lineitem", "from {lineitem}"), lineitem=lineitem).selectExpr(
        "concat('r', ord) as qname", "cast(flag as int) as flag", "chrom", "start", "cast(mapq as int) as mapq", "concat(if(sc > 0, concat(sc, 'S'), ''), m1, 'M', ln, op, m2, 'M') as cigar", "isize",
        "substr(repeat(dna, 3), 1, n) as seq", quals, "nm", "ord",
    )
    sites = spark.sql(_SITES.replace("from part", "from {part}"), part=part)
    variants = sites.select("chrom", "pos", "ref", F.array("alt", F.concat("alt", F.lit("A"))).alias("alt"), "ord")
    return variants, reads, _bins(part, 7, 100)


def extracted(spark: SparkSession, d: str, mode: str) -> DataFrame:
    out = pileup.extract(*tables(spark, d), mode=mode, chunk=TILE, bin_size=128)
    rounded = {c: F.round(F.col(c) + 1e-9, 4 if "_var" in c else 6) + 0.0 for c in pileup.FEATURES if c not in pileup.INTEGERS}
    return out.withColumns(rounded)


def sql(mode: str) -> str:
    """All 46 features, written out from their definitions."""
    held = "x join s on x.chrom = s.chrom and start <= pos0 and pos0 < stop"
    pairs = {
        "strict": f"pr as (select x.* exclude (chrom, ord), s.* exclude (chrom, ord), s.chrom as chrom, s.ord as site, x.ord as read from {held})",
        "compat": f"""held as (select distinct s.chrom as c, pos0 // {TILE} as tile, x.ord as read, start, stop from {held}),
reach as (select *, max(stop) over (partition by c, tile order by start, read rows between unbounded preceding and current row) as reach from held),
pr as (select x.* exclude (chrom, ord), s.* exclude (chrom, ord), s.chrom as chrom, s.ord as site, x.ord as read from s join reach h on h.c = s.chrom and h.tile = pos0 // {TILE} and h.start <= pos0 and pos0 < h.reach join x on x.ord = h.read)""",
    }[mode]
    r = lambda e, n=6: f"round(({e}) + 1e-9, {n}) + 0"
    mean = lambda e, who: f"coalesce(avg({e}) filter ({who}), 0)"
    var = lambda e, who: f"case when count({e}) filter ({who}) < 2 then 0 else var_pop({e}) filter ({who}) end"
    a, b, u = "sup", "not sup", "true"
    span = "case when flag & 2 <> 0 and isize <> 0 then abs(isize) end"
    columns = {
        "allele_balance": r("count(*) filter (sup) / count(*)"), "total_depth": "count(*)", "alt_depth": "count(*) filter (sup)",
        "mq_mean_alt": r(mean("mapq", a)), "mq_var_alt": r(var("mapq", a), 4), "mq_mean_ref": r(mean("mapq", b)),
        "strand_ratio_alt": r(mean("(flag & 16 = 0)::int", a)), "strand_ratio_ref": r(mean("(flag & 16 = 0)::int", b)),
        "read_end_dist_mean": r(mean("ed", u)), "read_end_dist_var": r(var("ed", u), 4), "softclip_rate_alt": r(mean("sc", a)),
        "bq_mean_alt": r(mean("bq", a)), "bq_var_alt": r(var("bq", a), 4), "bq_mean_ref": r(mean("bq", b)), "nbq_alt": r(mean("nbq", a)), "nbq_ref": r(mean("nbq", b)),
        "bq_drop_alt": r(f"{mean('bq', b)} - {mean('bq', a)}"), "indel_length": "any_value(length(alt) - length(ref))", "is_insertion": "any_value(ins::int)",
        "insert_entropy": r("any_value(case when ins then alt_entropy else 0 end)"), "homopolymer_length": "any_value(run)", "gc_content_50bp": r("any_value(gc)"),
        "udp_dp_ratio": r("coalesce(count(*) / nullif(count(*) filter (mapq >= 20), 0), 0)"), "pileup_entropy": r("coalesce(any_value(base_entropy), 0)"),
        "nm_mean_alt": r(mean("coalesce(nm, 0)", a)), "nm_mean_ref": r(mean("coalesce(nm, 0)", b)), "proper_pair_rate_alt": r(mean("(flag & 2 <> 0)::int", a)), "proper_pair_rate_ref": r(mean("(flag & 2 <> 0)::int", b)),
        "mismatch_rate_alt": r("coalesce(sum(mm) filter (sup) / nullif(sum(al) filter (sup), 0), 0)"), "cigar_agreement": r("coalesce(any_value(agreement), 0)"), "haplotype_entropy": r("coalesce(any_value(sig_entropy), 0)"),
        "fragment_support_rate": r(mean("(flag & 1 <> 0 and flag & 8 = 0)::int", a)), "read_end_dist_mean_alt": r(mean("ed", a)), "read_end_dist_mean_ref": r(mean("ed", b)), "softclip_rate_ref": r(mean("sc", b)),
        "softclip_diff": r(f"{mean('sc', a)} - {mean('sc', b)}"), "isize_mean_alt": r(mean(span, a)), "isize_mean_ref": r(mean(span, b)), "isize_dev": r(f"{mean(span, a)} - {mean(span, b)}"),
        "flank_bq_alt": r(mean("fbq", a)), "flank_bq_ref": r(mean("fbq", b)), "true_mismatch_rate_alt": r("coalesce(sum(mm) filter (sup) / nullif(sum(al) filter (sup), 0), 0)"),
        "tandem_repeat_unit": "any_value(unit)", "tandem_repeat_length": "any_value(total)", "mq0_fraction": r(mean("(mapq = 0)::int", u)), "mq_diff": r(f"{mean('mapq', a)} - {mean('mapq', b)}"),
    }
    listed = ", ".join(f"({e})::{'bigint' if c in pileup.INTEGERS else 'double'} as {c}" for c, e in columns.items())
    entropy = "log2(sum(c)) - sum(c * log2(c)) / sum(c)"
    window = f"list_aggregate(list_transform(range(lo // 32, (pos0 + 49) // 32 + 1), lambda b: translate(md5(chrom || ':' || b), '{HEX}', '{SOFT}')), 'string_agg', '')"
    return f"""with r0 as ({_READS}),
x as (select *, substr(repeat(dna, 3), 1, n) as seq, start + m1 + m2 + case when op = 'D' then ln else 0 end as stop, start + m1 + case when op = 'D' then ln else 0 end as r2, sc + m1 + case when op = 'I' then ln else 0 end as q2,
    list_avg(list_transform(range(0, n), lambda i: (p + i * 7 + ln) % 40 + 2)) as bq from r0 where flag & 3332 = 0),
s0 as (select *, pos - 1 as pos0, length(alt) > length(ref) as ins, abs(length(alt) - length(ref)) as size, greatest(0, pos - 51) as lo from ({_SITES}) where length(alt) <> length(ref)),
s1 as (select *, substr({window}, (lo % 32 + 1)::bigint, (pos0 + 50 - lo)::bigint) as ctx, (pos0 - lo)::bigint as nth from s0),
ae as (select ord, {entropy} as alt_entropy from (select ord, ch, count(*) as c from (select ord, unnest(string_split(alt, '')) as ch from s0) where ch <> '' group by all) group by ord),
tu as (select ord, ctx, nth, unnest([1, 2, 3, 4, 5, 6]) as u from s1),
tv as (select ord, u, length(regexp_extract(ctx[nth + 1:], '^((' || ctx[nth + 1:nth + u] || ')*)', 1)) + length(regexp_extract(reverse(ctx[1:nth]), '^((' || reverse(ctx[nth + 1:nth + u]) || ')*)', 1)) as t from tu where nth + u <= length(ctx)),
tr as (select ord, arg_max(u, t * 10 - u) as u, max(t) as t from tv group by ord),
s as (select s1.*, alt_entropy, length(regexp_replace(ctx, '[^GC]', '', 'g')) / length(ctx) as gc, (select t from tv where tv.ord = s1.ord and u = 1) as run, case when tr.t > 1 then tr.u else 1 end as unit, greatest(1, tr.t) as total
    from s1 left join ae using (ord) join tr using (ord)),
{pairs},
w as (select site, read, unnest(range(pos0 - 5, pos0 + 7)) as y, pos0, start, m1, m2, r2, sc, q2, seq, ctx, lo, p, ln from pr),
q as (select site, read, y, pos0, (p + qy * 7 + ln) % 40 + 2 as quality, seq[qy + 1] as own, ctx[y - lo + 1] as told from (select *, case when start <= y and y < start + m1 then sc + y - start when r2 <= y and y < r2 + m2 then q2 + y - r2 end as qy from w) where qy is not null),
n as (select site, read, coalesce(avg(quality) filter (y >= pos0 - 4), 0) as nbq, coalesce(avg(quality) filter (y <= pos0 + 5), 0) as fbq, count(*) filter (y <= pos0 + 5) as al, count(*) filter (y <= pos0 + 5 and own <> told) as mm from q group by all),
pq as (select *, case when start <= pos0 and pos0 < start + m1 then sc + pos0 - start when r2 <= pos0 and pos0 < r2 + m2 then q2 + pos0 - r2 end as qp from pr),
f as (select pq.* exclude (n), case when qp is not null then least(qp, pq.n - qp) else pq.n // 2 end as ed, case when qp is not null then seq[qp + 1] end as base, coalesce(nbq, 0) as nbq, coalesce(fbq, 0) as fbq, coalesce(al, 0) as al, coalesce(mm, 0) as mm,
    abs(ln - size) <= greatest(1, size // 2) and case when ins then op = 'I' and abs(start + m1 - pos0) <= 2 else op = 'D' and start + m1 - 2 <= pos0 and pos0 <= start + m1 + ln + 2 end as sup,
    array_to_string(list_filter([case when sc > 0 then 'S' || least(sc, 20) end, case when start + m1 >= pos0 - 3 and start <= pos0 + 3 then 'M' || least(m1, 10) end,
        case when (op = 'I' and abs(start + m1 - pos0) <= 3) or (op = 'D' and start + m1 - 3 <= pos0 and pos0 <= start + m1 + ln + 3) then op || ln end,
        case when r2 + m2 >= pos0 - 3 and r2 <= pos0 + 3 then 'M' || least(m2, 10) end], lambda z: z is not null), ' ') as sig
    from pq left join n on n.site = pq.site and n.read = pq.read),
be as (select site, {entropy} as base_entropy from (select site, base, count(*) as c from f where base is not null group by all) group by site),
se as (select site, max(c) / sum(c) as agreement, {entropy} as sig_entropy from (select site, sig, count(*) as c from f where sup group by all) group by site)
select chrom, pos, ref, alt, {listed} from f left join be using (site) left join se using (site) group by site, chrom, pos, ref, alt"""


# ---------------------------------------------------------------- two call sets

# Each part is a place of its own, 320 bases from the next; calls and truth say the same, or not, in several ways.
_BLOCK = f"translate(md5('chr' || cast(p % 3 + 1 as varchar(20)) || ':' || cast(p * 10 + N as varchar(20))), '{HEX}', '{SOFT}')"
_PLACES = f"""select p, 'chr' || cast(p % 3 + 1 as varchar(20)) as chrom, 30 + p % 7 as o, {" || ".join(_BLOCK.replace("N", n) for n in "012")} as s from (select p_partkey as p from part)"""
_AT = "substr(s, cast(o as int) + {} + 1, {})"
_ROWS = [
    ("0, 1", "p % 6 = 0", 0, _AT.format(0, 4), _AT.format(0, 1)),  # the same record
    ("1", "p % 6 = 1", 0, _AT.format(0, 3), _AT.format(0, 1)),  # one deletion, called as two
    ("0", "p % 6 = 1", 0, _AT.format(0, 2), _AT.format(0, 1)),
    ("0", "p % 6 = 1", 2, _AT.format(2, 2), _AT.format(3, 1)),
    ("1", "p % 6 = 2", 0, _AT.format(0, 1), _AT.format(0, 1) + " || 'ACG'"),  # one insertion, anchored on either side
    ("0", "p % 6 = 2", 1, _AT.format(1, 1), "'ACG' || " + _AT.format(1, 1)),
    ("1", "p % 6 = 3", 0, _AT.format(0, 3), _AT.format(0, 1)),  # another length
    ("0", "p % 6 = 3", 0, _AT.format(0, 2), _AT.format(0, 1)),
    ("1", "p % 6 = 4", 0, _AT.format(0, 2), _AT.format(0, 1)),  # a deletion and a changed base, called as one record
    ("1", "p % 6 = 4", 5, _AT.format(5, 1), f"translate({_AT.format(5, 1)}, 'ACGT', 'CGTA')"),
    ("0", "p % 6 = 4", 0, _AT.format(0, 6), f"{_AT.format(0, 1)} || {_AT.format(2, 3)} || translate({_AT.format(5, 1)}, 'ACGT', 'CGTA')"),
    ("1", "p % 6 = 5", 0, _AT.format(0, 1), _AT.format(0, 1) + " || 'GG'"),  # one of two alleles
    ("0", "p % 6 = 5", 0, _AT.format(0, 1), f"{_AT.format(0, 1)} || 'GG|' || {_AT.format(0, 1)} || 'T'"),
    ("0", "p % 5 = 0", 20, _AT.format(20, 1), _AT.format(20, 1) + " || 'CA'"),  # true nowhere, but where repeats make it so
]
_SETS = " union all ".join(f"select {side} as side, p, chrom, s, o + {more} as place, {ref} as ref, {alts} as alts from places where {when}" for sides, when, more, ref, alts in _ROWS for side in sides.split(", "))


def call_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, truth, fasta bins)."""
    part = spark.read.parquet(f"{d}/part.parquet")
    # a small file of parts is one task, however many there are
    places = spark.sql(_PLACES.replace("from part", "from {part}"), part=part.select("p_partkey").repartition("p_partkey"))

    def rows(own: str) -> DataFrame:
        """The rows of one side, all made in one pass over the places."""
        made = [f"if({when}, array(named_struct('place', o + {more}, 'ref', {ref}, 'alts', {alts})), array())" for sides, when, more, ref, alts in _ROWS if own in sides.split(", ")]
        out = places.select("p", "chrom", F.expr(f"inline(concat({', '.join(made)}))"))
        return out.select("chrom", F.expr("p * 320 + place + 1").alias("pos"), "ref", F.split("alts", "[|]").alias("alt"))

    return rows("0"), rows("1"), _bins(part, 320, 400)


# Every choice of records of either side is spelled out; the best pair of equal sequences stays.
COMPARE_SQL = f"""with recursive places as ({_PLACES}), r as (select distinct side, p, chrom, s, place, ref, list_sort(string_split(alts, '|')) as alt from ({_SETS})),
v as (select *, row_number() over (partition by side, p order by place, length(ref), ref, alt) as i from r),
h as (select side, p, s, 0 as i, 0 as done, '' as hap, '' as mask from (select distinct side, p, s from v)
union all select side, p, s, i + 1, case when a is null then done else place + length(ref) end, case when a is null then hap else hap || s[done + 1:place] || a end, mask || case when a is null then '0' else '1' end
from (select h.*, v.place, v.ref, unnest([null] || v.alt) as a from h join v on v.side = h.side and v.p = h.p and v.i = h.i + 1) where a is null or place >= done),
w as (select h.side, h.p, hap || s[done + 1:] as hap, mask, length(replace(mask, '0', '')) as n from h join (select side, p, max(i) as last from v group by all) using (side, p) where i = last),
best as (select a.p, arg_max(a.mask, (a.n + b.n, a.n, a.mask, b.mask)) as mask from w a join w b on a.side = 0 and b.side = 1 and a.p = b.p and a.hap = b.hap group by a.p),
k as (select chrom, p * 320 + place + 1 as pos, ref, unnest(alt) as alt, coalesce(mask[i], '0') = '1' as matched from v left join best using (p) where side = 0)
select chrom, pos, ref, alt, bool_or(matched) as matched from k where length(ref) <> length(alt) group by all"""
