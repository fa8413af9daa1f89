"""Queries over the driver's tables and their SQL.

The tables hold no sequencing data, so each operator runs on an analogous query: a user is a chromosome, an event's time
a position, its value a length in hours, its type an allele class; lineitem makes CIGAR strings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequence as S
from ..functions.scalar import exact_round, exact_text, logistic, mean0, phred, ratio0, var0
from ..operators import intervals, labels, metrics, pileup, splits
from ..sources import files, text
from . import boosting, model, sites, workflow

HOUR = 3_600_000_000
BIN = 6 * HOUR
TILE = 5 * 24 * HOUR
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6) + 0.0


def _micros(df: DataFrame, c: str) -> F.Column:
    if dict(df.dtypes)[c] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
    return F.unix_micros(c)


def _sites_reads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "value", _micros(t(spark, d, "events"), "ts").alias("at"))
    sites = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("site"), F.col("at").alias("pos0"))
    reads = e.where("event_type != 'purchase'").select("user_id", "event_id", "event_type", "value", F.col("at").alias("start"), (F.col("at") + F.round(F.col("value") * HOUR).cast("long")).alias("stop"))
    return sites, reads


_SR = f"""with e as (select event_id, user_id, event_type, value, epoch_us(ts) as mu from events),
s as (select user_id, event_id as site, mu as pos0 from e where event_type = 'purchase'),
r as (select user_id, event_id, event_type, value, mu as start, mu + round(value * {HOUR})::bigint as stop from e where event_type <> 'purchase')"""


def _pile(pairs: DataFrame) -> DataFrame:
    alt, v = F.col("event_type") == "click", F.col("value")
    a, b = F.when(alt, v), F.when(~alt, v)
    n = F.count(F.lit(1))
    return pairs.groupBy("user_id", "site").agg(
        n.alias("total_depth"), F.count_if(alt).alias("alt_depth"), r6(F.count_if(alt) / n).alias("allele_balance"),
        r6(mean0(a)).alias("mean_alt"), F.round(var0(a) + 1e-9, 4).alias("var_alt"), r6(mean0(b)).alias("mean_ref"), r6(mean0(a) - mean0(b)).alias("mean_diff"),
        r6(ratio0(n.cast("double"), F.count_if(v >= 20))).alias("depth_ratio"),
    )


_PILE = """select user_id, site, count(*) as total_depth, count(*) filter (event_type = 'click') as alt_depth, round(count(*) filter (event_type = 'click') / count(*), 6) + 0 as allele_balance,
round(coalesce(avg(value) filter (event_type = 'click'), 0), 6) + 0 as mean_alt, round(case when count(*) filter (event_type = 'click') < 2 then 0 else var_pop(value) filter (event_type = 'click') end + 1e-9, 4) as var_alt,
round(coalesce(avg(value) filter (event_type <> 'click'), 0), 6) + 0 as mean_ref,
round(coalesce(avg(value) filter (event_type = 'click'), 0) - coalesce(avg(value) filter (event_type <> 'click'), 0), 6) + 0 as mean_diff,
round(case when count(*) filter (value >= 20) > 0 then count(*) / (count(*) filter (value >= 20)) else 0 end, 6) + 0 as depth_ratio from p group by user_id, site"""


@query(f"{_SR}, p as (select s.user_id, site, event_type, value from s join r on s.user_id = r.user_id and start <= pos0 and pos0 < stop) {_PILE}")
def pileup_strict(spark, d):
    sites, reads = _sites_reads(spark, d)
    return _pile(intervals.range_join(sites, reads, on=["user_id"], point="pos0", lo="start", hi="stop", bin_size=BIN))


@query(f"""{_SR}, st as (select *, pos0 // {TILE} as tile from s),
held as (select distinct r.user_id, tile, event_id, start, stop, event_type, value from st join r on st.user_id = r.user_id and start <= pos0 and pos0 < stop),
m as (select *, max(stop) over (partition by user_id, tile order by start, event_id rows between unbounded preceding and current row) as reach from held),
p as (select st.user_id, site, event_type, value from st join m on st.user_id = m.user_id and st.tile = m.tile and start <= pos0 and pos0 < reach) {_PILE}""")
def pileup_compat(spark, d):
    sites, reads = _sites_reads(spark, d)
    sites = sites.withColumn("tile", F.expr(f"pos0 div {TILE}"))
    return _pile(intervals.active_join(sites, reads, on=["user_id"], group="tile", point="pos0", lo="start", hi="stop", order="event_id", bin_size=BIN))


@query(f"""{_SR}, c as (select site, event_type, count(*) as c from s join r on s.user_id = r.user_id and start <= pos0 and pos0 < stop group by all)
select site, round(max(c) / sum(c), 6) + 0 as agreement, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0 as entropy from c group by site""")
def pileup_entropy(spark, d):
    sites, reads = _sites_reads(spark, d)
    c = intervals.range_join(sites, reads, on=["user_id"], point="pos0", lo="start", hi="stop", bin_size=BIN).groupBy("site", "event_type").agg(F.count(F.lit(1)).cast("double").alias("c"))
    c = c.groupBy("site").agg(F.max("c").alias("m"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return c.select("site", r6(F.col("m") / F.col("n")).alias("agreement"), r6(F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


@query(f"{_SR} select count(*) as n, coalesce(sum(site), 0)::bigint as sum_site from s where exists (select 1 from r where s.user_id = r.user_id and start <= pos0 and pos0 < stop)")
def region_semi_join(spark, d):
    sites, reads = _sites_reads(spark, d)
    inside = intervals.semi_range_join(sites, reads, on=["user_id"], point="pos0", lo="start", hi="stop", bin_size=BIN)
    return inside.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("site"), F.lit(0)).alias("sum_site"))


@query("select user_id, event_type, round(coalesce(avg(value), 0), 6) + 0 as mean0, round(case when count(value) < 2 then 0 else var_pop(value) end + 1e-9, 4) as var0, count(*) as n from events group by user_id, event_type")
def mean0_var0(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(r6(mean0(F.col("value"))).alias("mean0"), F.round(var0(F.col("value")) + 1e-9, 4).alias("var0"), F.count(F.lit(1)).alias("n"))


@query("""with l as (select c_nationkey as chrom, max(c_custkey) as length from customer group by 1), s as (select chrom, length, unnest(range(1, length + 1, 37)) as start from l)
select chrom::varchar as chrom, start::bigint as start, least(start + 36, length)::bigint as "end" from s""")
def tile_regions(spark, d):
    lengths = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("name")).agg(F.max("c_custkey").alias("length"))
    return intervals.tile_regions(lengths, 37)


@query(f"""{_SR}, a as (select user_id, pos0 // {TILE} as tile, count(*) as sites from s group by all), b as (select user_id, start // {TILE} as tile, count(*) as reads from r group by all)
select b.user_id, b.tile, reads, coalesce(sites, 0) as sites, sites is null as empty from b left join a on a.user_id = b.user_id and a.tile = b.tile""")
def tile_assign(spark, d):
    sites, reads = _sites_reads(spark, d)
    tiles = lambda x, p, n: x.groupBy("user_id", F.expr(f"{p} div {TILE}").alias("tile")).agg(F.count(F.lit(1)).alias(n))
    both = tiles(reads, "start", "reads").join(tiles(sites, "pos0", "sites"), ["user_id", "tile"], "left")
    return both.select("user_id", "tile", "reads", F.coalesce("sites", F.lit(0)).alias("sites"), F.col("sites").isNull().alias("empty"))


@query(f"select l_linenumber, count(*) as n from lineitem where ((l_orderkey * 4 + l_linenumber) & {pileup.SKIPPED_FLAGS}) = 0 group by 1")
def flag_filter(spark, d):
    flag = (F.col("l_orderkey") * 4 + F.col("l_linenumber")).bitwiseAND(pileup.SKIPPED_FLAGS)
    return t(spark, d, "lineitem").where(flag == 0).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("""select p_partkey as pos, p_brand as ref, p_type as alt, (length(p_type) - length(p_brand))::bigint as indel_length, length(p_type) > length(p_brand) as is_insertion,
abs(length(p_type) - length(p_brand))::bigint as indel_size from part where length(p_type) <> length(p_brand)""")
def indel_predicate(spark, d):
    v = t(spark, d, "part").select(F.lit("c").alias("chrom"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("ref"), F.array("p_type").alias("alt"), F.lit(0).alias("ord"))
    return pileup.indel_sites(v).select("pos", "ref", "alt", "indel_length", "is_insertion", "indel_size")


@query(sites.sql("strict"))
def extract_strict(spark, d):
    """All 46 features of the operator itself."""
    return sites.extracted(spark, d, "strict")


@query(sites.sql("compat"))
def extract_compat(spark, d):
    return sites.extracted(spark, d, "compat")


@query(sites.COMPARE_SQL)
def compare_haplotypes(spark, d):
    """Calls against truth by the sequences they spell."""
    calls, truth, bins = sites.call_sets(spark, d)
    true, false = workflow.compare(calls, truth, bins=bins)
    return true.withColumn("matched", F.lit(True)).unionByName(false.withColumn("matched", F.lit(False)))


def _cigars(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_quantity").cast("int").alias("m1"), (F.col("l_partkey") % 9 + 1).cast("int").alias("m2"),
        (F.col("l_suppkey") % 25).cast("int").alias("sc"), F.col("l_orderkey").alias("start"), F.when(F.col("l_returnflag") == "R", "I").otherwise("D").alias("op"), (F.col("l_partkey") % 60).alias("off"),
    )
    li = li.withColumn("cigar", F.expr("concat(if(sc > 0, concat(sc, 'S'), ''), m1, 'M', ln, op, m2, 'M')"))
    return li.withColumn("blocks", C.blocks()).withColumn("pos0", F.col("start") + F.col("off"))


_CB = """with b as (select l_orderkey as k, l_linenumber as ln, l_quantity::int as m1, (l_partkey % 9 + 1)::int as m2, (l_suppkey % 25)::int as sc, l_orderkey as start,
case when l_returnflag = 'R' then 'I' else 'D' end as op, l_partkey % 60 as off, l_orderkey + l_partkey % 60 as pos0 from lineitem)"""


@query(_CB + " select op, count(*) as n, sum(start + m1 + m2 + case when op = 'D' then ln else 0 end)::bigint as ends, sum(sc)::bigint as clipped from b group by op")
def cigar_parse(spark, d):
    c = _cigars(spark, d).withColumns({"stop": C.reference_end(), "s": C.soft_clipped()})
    return c.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("stop").alias("ends"), F.sum("s").alias("clipped"))


@query(_CB + """ select ln, count(*) filter (op = 'I' and abs(start + m1 - pos0) <= 2 and abs(ln - 3) <= 1) as insertions,
count(*) filter (op = 'D' and start + m1 - 2 <= pos0 and pos0 <= start + m1 + ln + 2 and abs(ln - 3) <= 1) as deletions from b group by ln""")
def cigar_support(spark, d):
    c = _cigars(spark, d)
    return c.groupBy("ln").agg(F.count_if(C.supports("true", "3", "pos0")).alias("insertions"), F.count_if(C.supports("false", "3", "pos0")).alias("deletions"))


@query(_CB + """, s as (select list_filter([case when sc > 0 then 'S' || least(sc, 20) end,
case when start + m1 >= pos0 - 3 and start <= pos0 + 3 then 'M' || least(m1, 10) end,
case when (op = 'I' and abs(start + m1 - pos0) <= 3) or (op = 'D' and start + m1 - 3 <= pos0 and pos0 <= start + m1 + ln + 3) then op || ln end,
case when start + m1 + (case when op = 'D' then ln else 0 end) + m2 >= pos0 - 3 and start + m1 + (case when op = 'D' then ln else 0 end) <= pos0 + 3 then 'M' || least(m2, 10) end], lambda x: x is not null) as l from b)
select array_to_string(l, ' ') as signature, count(*) as n from s group by 1""")
def cigar_signature(spark, d):
    return _cigars(spark, d).select(C.signature("pos0").alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


@query(_CB + """, q as (select case when off < m1 then sc + off when off >= m1 + (case when op = 'D' then ln else 0 end) and off < m1 + (case when op = 'D' then ln else 0 end) + m2
then sc + off - (case when op = 'D' then ln else 0 end) + (case when op = 'I' then ln else 0 end) end as q from b)
select count(q) as aligned, count(*) - count(q) as none, coalesce(sum(q), 0)::bigint as sum_q from q""")
def aligned_position(spark, d):
    q = C.query_position("pos0")
    return _cigars(spark, d).select(q.alias("q")).agg(F.count("q").alias("aligned"), F.count_if(F.col("q").isNull()).alias("none"), F.coalesce(F.sum("q"), F.lit(0)).alias("sum_q"))


_DNA = "translate(lower(p_name || p_type || p_brand), 'abcdefghijklmnopqrstuvwxyz #0123456789', 'ACGTACGTACGTACGTACGTACGTACAGTACGTACGTA')"


def _dna(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", F.expr(_DNA).alias("s")).withColumn("at", F.expr("cast(p_partkey % 12 as int)"))


@query(f"with b as (select p_partkey, {_DNA} as s from part) select p_partkey, round(length(regexp_replace(s, '[^GC]', '', 'g')) / length(s), 6) + 0 as gc from b")
def gc_fraction(spark, d):
    return _dna(spark, d).select("p_partkey", r6(S.gc_fraction("s")).alias("gc"))


@query(f"""with b as (select p_partkey, {_DNA} as s, (p_partkey % 12)::int as ix from part), c as (select *, s[ix + 1] as x from b)
select p_partkey, (length(regexp_extract(s[ix + 1:], '^(' || x || '*)', 1)) + length(regexp_extract(reverse(s[1:ix]), '^(' || x || '*)', 1)))::bigint as run from c""")
def homopolymer(spark, d):
    return _dna(spark, d).select("p_partkey", S.homopolymer("s", "at").alias("run"))


@query(f"""with b as (select p_partkey, {_DNA} as s, (p_partkey % 12)::int as ix from part), u as (select *, unnest([1, 2, 3, 4, 5, 6]) as u from b), v as (select *, s[ix + 1:ix + u] as x from u where ix + u <= length(s)),
w as (select *, length(regexp_extract(s[ix + 1:], '^((' || x || ')*)', 1)) + length(regexp_extract(reverse(s[1:ix]), '^((' || reverse(x) || ')*)', 1)) as total from v),
k as (select p_partkey, arg_max({{'u': u, 't': total}}, total * 10 - u) as m from w group by p_partkey)
select p_partkey, (case when m.t > 1 then m.u else 1 end)::bigint as unit, greatest(1, m.t)::bigint as total from k""")
def tandem_repeat(spark, d):
    return _dna(spark, d).select("p_partkey", S.tandem("s", "at").alias("x")).select("p_partkey", "x.unit", "x.total")


@query("""with c as (select p_partkey, unnest(string_split(p_type, '')) as ch from part), n as (select p_partkey, ch, count(*) as c from c where ch <> '' group by all)
select p_partkey, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0 as entropy from n group by p_partkey""")
def string_entropy(spark, d):
    return t(spark, d, "part").select("p_partkey", r6(S.entropy("p_type")).alias("entropy"))


@query("""select doc_id, case when doc_id in (select doc_id from labels where quality = 1) then 1 else 0 end as label, doc_id in (select doc_id from labels) as matched from documents""")
def label_left_join(spark, d):
    key = lambda x: x.select(F.col("lang").alias("chrom"), F.col("doc_id").alias("pos"), F.lit("a").alias("ref"), F.lit("b").alias("alt"))
    docs = t(spark, d, "documents").select("doc_id", "lang")
    known = docs.join(t(spark, d, "labels"), "doc_id")
    true, false = known.where("quality = 1"), known.where("quality = 0")
    return labels.label(key(docs), key(true.unionByName(true)), key(false)).select(F.col("pos").alias("doc_id"), "label", "matched")


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber as o from lineitem)
select l_orderkey, l_linenumber, arg_max(o, o) as last from l group by all""")
def last_wins_lookup(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey * 1000000 + l_suppkey * 100 + l_linenumber").alias("last"))
    return labels.last_wins(rows.withColumn("_o", F.col("last")), ["l_orderkey", "l_linenumber"], "last", "_o")


@query("""with li as (select l_orderkey, l_linenumber, max(l_discount * 8 + 0.15) as prob from lineitem group by all),
a as (select o_orderkey, unnest([1, 2, 3, 4]) as i from orders), j as (select a.o_orderkey, i, prob from a left join li on l_orderkey = o_orderkey and l_linenumber = i),
g as (select o_orderkey, count(prob) as n, max(prob) as best, count(*) - count(prob) as miss from j group by 1)
select o_orderkey, n, miss as n_miss, printf('%.2f', case when n > 0 then -10 * log10(1 - least(best, 1 - 1e-9)) else 0 end)::double + 0 as qual, case when n > 0 and best < 0.5 then 'INDEL_FILTERED' else o_orderstatus end as filter from g join orders using (o_orderkey)""")
def annotate_records(spark, d):
    orders = t(spark, d, "orders").select(
        F.lit("c").alias("chrom"), F.col("o_orderkey").alias("pos"), F.lit("").alias("ref"), F.array(*[F.lit(x) for x in ("1", "2", "3", "4")]).alias("alt"),
        F.lit(0.0).alias("qual"), F.col("o_orderstatus").alias("filter"), F.lit(".").alias("info"), F.col("o_orderkey").alias("ord"),
    )
    scores = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_discount") * 8 + 0.15).alias("prob"))
    scores = scores.select(F.lit("c").alias("chrom"), F.col("l_orderkey").alias("pos"), F.lit("").alias("ref"), F.col("l_linenumber").cast("string").alias("alt"), "prob")
    out = labels.annotate(orders, scores, 0.5)
    n = F.when(F.col("info") == ".", 0).otherwise(F.size(F.split("info", ","))).cast("long")
    return out.select(F.col("pos").alias("o_orderkey"), n.alias("n"), "n_miss", (F.col("qual") + 0.0).alias("qual"), "filter")


@query("select doc_id, case when source in ('src1', 'src2') then 'val' when source = 'src3' then 'test' else 'train' end as split from documents")
def split_by_key(spark, d):
    return splits.by_chromosome(t(spark, d, "documents").select("doc_id", F.col("source").alias("chrom")), ("src1", "src2"), ("src3",)).select("doc_id", "split")


@query("""with r as (select doc_id, quality, (row_number() over (partition by quality order by md5(doc_id || '|42'), doc_id) - 0.5) / count(*) over (partition by quality) as s from labels)
select doc_id, quality, case when s >= 0.3 then 'train' when s >= 0.15 then 'val' else 'test' end as split from r""")
def split_stratified(spark, d):
    return splits.stratified(t(spark, d, "labels"), ["doc_id"], "quality").select("doc_id", "quality", "split")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.round(F.least(F.col("n_chars"), F.lit(4000)) / 4000, 2).alias("p"))
    return docs.join(t(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


_YP = "with x as (select quality as y, round(least(n_chars, 4000) / 4000, 2) as p from documents join labels using (doc_id))"
_CURVE = _YP + """, g as (select p, sum(y)::bigint as dp, sum(1 - y)::bigint as dn from x group by p),
c as (select p, dp, dn, sum(dp) over (order by p desc) as tp, sum(dn) over (order by p desc) as fp, sum(dp) over () as np, sum(dn) over () as nn from g)"""


@query(_YP + " select round(count(*) filter (y = 0) / greatest(count(*) filter (y = 1), 1), 6) + 0 as scale_pos_weight from x")
def class_weight(spark, d):
    return metrics.class_weight(_scored(spark, d)).select(r6(F.col("scale_pos_weight")).alias("scale_pos_weight"))


@query("select quality, toxic, count(*) as n from labels group by all order by n desc")
def value_counts(spark, d):
    return t(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query(_YP + """, c as (select count(*) filter (p >= 0.4 and y = 1) as tp, count(*) filter (p >= 0.4 and y = 0) as fp, count(*) filter (p < 0.4 and y = 1) as fn, count(*) filter (p < 0.4 and y = 0) as tn from x)
select *, round(tp / (tp + fp), 6) + 0 as precision, round(tp / (tp + fn), 6) + 0 as recall, round(2 * tp / (2 * tp + fp + fn), 6) + 0 as f1 from c""")
def confusion(spark, d):
    return metrics.confusion(_scored(spark, d), 0.4).select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(_YP + " select round(avg(pow(p - y, 2)), 6) + 0 as brier from x")
def brier(spark, d):
    return metrics.brier(_scored(spark, d)).select(r6(F.col("brier")).alias("brier"))


@query(_CURVE + " select round(sum(dn * (tp - dp / 2)) / (max(np) * max(nn)), 6) + 0 as auroc from c")
def auroc(spark, d):
    return metrics.auroc(_scored(spark, d)).select(r6(F.col("auroc")).alias("auroc"))


@query(_CURVE + " select round(sum(dp / np * tp / (tp + fp)), 6) + 0 as average_precision from c")
def avg_precision(spark, d):
    return metrics.average_precision(_scored(spark, d)).select(r6(F.col("average_precision")).alias("average_precision"))


@query(_CURVE + " select p as threshold, round(tp / (tp + fp), 6) + 0 as precision, round(tp / np, 6) + 0 as recall from c")
def pr_curve(spark, d):
    return metrics.pr_curve(_scored(spark, d)).select("threshold", *[r6(F.col(c)).alias(c) for c in ("precision", "recall")])


@query(_CURVE + ", f as (select p as threshold, tp / (tp + fp) as pr, tp / np as re from c) select threshold, round(2 * pr * re / (pr + re + 1e-9), 6) + 0 as f1 from f order by 2 * pr * re / (pr + re + 1e-9) desc, threshold limit 1")
def best_f1(spark, d):
    return metrics.best_threshold(_scored(spark, d)).select("threshold", r6(F.col("f1")).alias("f1"))


@query("select o_orderkey, round(-10 * log10(1 - least(o_totalprice / 500000, 1 - 1e-9)), 6) + 0 as qual from orders")
def qual_transform(spark, d):
    return t(spark, d, "orders").select("o_orderkey", r6(phred(F.col("o_totalprice") / 500000)).alias("qual"))


@query("select p_partkey, printf('%.2f', p_partkey / 200.0::double) as two, printf('%.4f', p_partkey / 20000.0::double) as four, printf('%.2f', p_partkey / 200.0::double)::double as rounded from part")
def exact_decimals(spark, d):
    """Doubles on both sides of half-way decimals, rounded from their exact values."""
    return t(spark, d, "part").select("p_partkey", F.expr(exact_text("p_partkey / 200D", 2)).alias("two"), F.expr(exact_text("p_partkey / 20000D", 4)).alias("four"), exact_round("p_partkey / 200D", 2).alias("rounded"))


@query("select c_custkey, round(1 / (1 + exp(-(c_acctbal / 1000))), 6) + 0 as p, round(1 / (1 + exp(-(c_acctbal / 1000 * 0.5 + 0.1))), 6) + 0 as calibrated from customer")
def sigmoid(spark, d):
    x = F.col("c_acctbal") / 1000
    return t(spark, d, "customer").select("c_custkey", r6(logistic(x)).alias("p"), r6(logistic(x, 0.5, 0.1)).alias("calibrated"))


_ALTS = """with li as (select l_orderkey, l_linenumber, max(l_discount * 8 + 0.15) as prob from lineitem group by all),
a as (select o_orderkey, o_orderstatus, unnest([1, 2, 3, 4]) as i from orders), j as (select a.*, prob from a left join li on l_orderkey = o_orderkey and l_linenumber = i),
g as (select o_orderkey, any_value(o_orderstatus) as status, count(prob) as n, max(prob) as best, string_agg(printf('%.4f', prob), ',' order by i) filter (prob is not null) as probs from j group by 1)"""


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").select(
        F.lit("c").alias("chrom"), F.col("o_orderkey").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit("").alias("ref"), F.array(*[F.lit(x) for x in ("1", "2", "3", "4")]).alias("alt"),
        F.lit(7.0).alias("qual"), F.col("o_orderstatus").alias("filter"), F.when(F.col("o_orderkey") % 2 == 0, "DP=3").alias("info"), F.lit("GT\t0/1").alias("rest"),
        F.struct(F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("o_orderkey").alias("line")).alias("ord"),
    )
    scores = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_discount") * 8 + 0.15).alias("prob"))
    scores = scores.select(F.lit("c").alias("chrom"), F.col("l_orderkey").alias("pos"), F.lit("").alias("ref"), F.col("l_linenumber").cast("string").alias("alt"), "prob")
    return labels.annotate(orders, scores, 0.5)


@query(_ALTS + """ select o_orderkey, case when n = 0 then case when o_orderkey % 2 = 0 then 'DP=3' else '' end else case when o_orderkey % 2 = 0 then 'DP=3;' else '' end || 'INDEL_PROB=' || probs end as info,
n > 0 and best >= 0.5 as passed from g""")
def annotate_text(spark, d):
    """The added texts themselves."""
    return _annotated(spark, d).select(F.col("pos").alias("o_orderkey"), F.coalesce("info", F.lit("")).alias("info"), F.coalesce("passed", F.lit(False)).alias("passed"))


@query(_ALTS + """ select o_orderkey as pos, 'c' as chrom, '.' as id, 'X' as ref, '1|2|3|4' as alts, case when n > 0 and best < 0.5 then 'INDEL_FILTERED' else status end as filter,
case when n = 0 then case when o_orderkey % 2 = 0 then 'DP=3' else '.' end else case when o_orderkey % 2 = 0 then 'DP=3;' else '' end || 'INDEL_PROB=' || probs end as info, n = 0 as untouched,
row_number() over (order by o_orderkey) as nth, 4::bigint as n_header from g""")
def vcf_roundtrip(spark, d):
    """Annotated records written as VCF, with header lines, and read again in their order."""
    path = _folder(spark, "records")
    head = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]
    text.write_vcf(_annotated(spark, d).withColumn("ref", F.lit("X")), head, path)
    back = text.numbered(text.read_vcf(spark, path))
    return back.select(
        "pos", "chrom", "id", "ref", F.array_join("alt", "|").alias("alts"), "filter", "info", (F.col("qual") == 7).alias("untouched"), "nth", F.lit(len(text.vcf_header(spark, path))).cast("long").alias("n_header")
    )


@query("select n_name as name, case when n_nationkey % 5 = 0 then 0 else n_nationkey * 100 end::bigint as length from nation")
def fai_scan(spark, d):
    path = _folder(spark, "index")
    length = F.when(F.col("n_nationkey") % 5 == 0, "x").otherwise((F.col("n_nationkey") * 100).cast("string"))
    t(spark, d, "nation").select(F.concat_ws("\t", "n_name", length, F.lit("7"), F.lit("60")).alias("value")).write.text(path)
    return text.read_fai(spark, path).select("name", "length")


@query(_CURVE + """, z as (select count(*) filter (p >= 0.4 and y = 1) as tp, count(*) filter (p >= 0.4 and y = 0) as fp, count(*) filter (p < 0.4 and y = 1) as fn, count(*) as n, count(*) filter (y = 1) as n_pos, avg(pow(p - y, 2)) as b from x),
m as (select sum(dn * (tp - dp / 2)) / (max(np) * max(nn)) as a, sum(dp / np * tp / (tp + fp)) as v from c)
select round(tp / (tp + fp), 4) + 0 as precision, round(tp / (tp + fn), 4) + 0 as recall, round(2 * tp / (2 * tp + fp + fn), 4) + 0 as f1, round(a, 4) + 0 as auroc, round(v, 4) + 0 as auprc, round(b, 4) + 0 as brier, n, n_pos, n - n_pos as n_neg from z, m""")
def evaluate(spark, d):
    found = model.evaluate(_scored(spark, d), 0.4, "y", "p")
    kinds = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in found.items())
    return spark.createDataFrame([tuple(found.values())], kinds)


@query("select p_brand, count(*) as split, round(sum(p_retailprice), 2) + 0 as gain from part group by 1 order by gain desc, p_brand limit 10")
def topk_importance(spark, d):
    g = t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("split"), (F.round(F.sum("p_retailprice"), 2) + 0.0).alias("gain"))
    return g.orderBy(F.desc("gain"), "p_brand").limit(10)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{files.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def csv_roundtrip(spark, d):
    path = _folder(spark, "suppliers")
    workflow.write_table(t(spark, d, "supplier"), path)
    return workflow.read_table(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def parquet_roundtrip(spark, d):
    path = _folder(spark, "suppliers") + ".parquet"
    workflow.write_table(t(spark, d, "supplier"), path)
    return workflow.read_table(spark, path)


@query("select c_custkey, c_acctbal as read_end_dist_mean, c_acctbal as read_pos_mean from customer")
def schema_contract(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("read_end_dist_mean"))
    return model.with_features(rows, ["read_pos_mean"]).select("c_custkey", "read_end_dist_mean", "read_pos_mean")


def _training(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.expr("cast(length(text) - length(replace(text, '.', '')) as double)").alias("dots"), F.col("lang"))
    return splits.stratified(docs.join(t(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").drop("lang"), ["doc_id"])


@query()
def gbt_fit_score(spark, d):
    """Leaf-wise trees with all default parameters, fitted on the training part and scored on the test part."""
    rows = files.settled(_training(spark, d))  # the texts are read once
    names = ["n_chars", "dots"]
    part = lambda s: rows.where(F.col("split") == s)
    fitted, _, _, _ = boosting.boost(part("train"), part("val"), names)
    return model.Bundle(fitted, names).score(part("test")).select("doc_id", "label", "raw", "prob")


_STEP_FEATURES = ("d", "e", "f")
_STEP = """with x as (select quality as label, n_chars // 200 as d, length(text) - length(replace(text, '.', '')) as e, case when doc_id % 4 > 0 then length(lang) + doc_id % 7 end as f from documents join labels using (doc_id)),
w as (select count(*) filter (label = 0) / count(*) filter (label = 1) as k from x), g as (select d, e, f, case when label = 1 then -k * 0.5 else 0.5 end as g, case when label = 1 then k * 0.25 else 0.25 end as h from x, w)"""


def _step_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").selectExpr("doc_id", "cast(n_chars div 200 as double) as d", "cast(length(text) - length(replace(text, '.', '')) as double) as e", "cast(if(doc_id % 4 > 0, length(lang) + doc_id % 7, null) as double) as f")
    return docs.join(t(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query(_STEP + """, u as (select 'd' as feature, 0 as nth, d as v, g, h from g union all select 'e', 1, e, g, h from g union all select 'f', 2, f, g, h from g),
b as (select feature, nth, v, sum(g) as g, sum(h) as h, count(*) as n from u group by all),
c as (select *, sum(g) over o as gl, sum(h) over o as hl, sum(n) over o as nl, sum(g) over (partition by feature) as ga, sum(h) over (partition by feature) as ha, sum(n) over (partition by feature) as na
from b window o as (partition by feature order by v nulls first)),
s as (select *, gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha as gain from c where nl >= 50 and na - nl >= 50),
best as (select * from s qualify row_number() over (order by gain desc, nth, v nulls first) = 1)
select feature, coalesce(v, -1.7976931348623157e308)::double as threshold, round(gain, 6) + 0 as gain, nl::bigint as n_left, (na - nl)::bigint as n_right, round(-0.05 * gl / hl, 6) + 0 as left_value, round(-0.05 * (ga - gl) / (ha - hl), 6) + 0 as right_value from best""")
def boosted_split(spark, d):
    """The first split of the first tree: the best of all places in all features, and the values on both sides."""
    rows = _step_rows(spark, d)
    fitted, _, _, _ = boosting.boost(rows, rows.limit(0), list(_STEP_FEATURES), rounds=1, maxLeaves=2, featureShare=1.0, subsamplingRate=1.0)
    tree = fitted.trees[0]
    row = (fitted.features[int(tree.feature[0])], float(tree.threshold[0]), float(tree.gain[0]), int(tree.count[0]), int(tree.count[1]), float(tree.value[0]), float(tree.value[1]))
    out = spark.createDataFrame([row], "feature string, threshold double, gain double, n_left bigint, n_right bigint, left_value double, right_value double")
    return out.withColumns({c: r6(F.col(c)) for c in ("gain", "left_value", "right_value")})


# Newton's steps on sums over all rows, from 0
@query(_YP.replace("with x", "with recursive x").replace("as (select quality as y", "as (select doc_id, quality as y") + """, r as (select 0 as k, 0::double as a, 0::double as b union all
select k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) from
(select k, a, b, sum((q - y) * p) as ga, sum(q - y) as gb, sum(q * (1 - q) * p * p) as haa, sum(q * (1 - q) * p) as hab, sum(q * (1 - q)) as hbb
from (select k, a, b, y, p, 1 / (1 + exp(-(a * p + b))) as q from r, x where k < 12) group by k, a, b))
select doc_id, round(1 / (1 + exp(-(a * p + b))), 5) + 0 as prob from x, r where k = 12""")
def platt_fit(spark, d):
    slope, intercept = model.platt(_scored(spark, d).select(F.col("p").alias("raw"), F.col("y").alias("label")))
    return _scored(spark, d).select("doc_id", (F.round(logistic(F.col("p"), slope, intercept), 5) + 0.0).alias("prob"))
