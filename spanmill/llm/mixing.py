"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected ``target / source size`` times. The running sum of these
expectations, shifted by one random offset for the source, crosses whole numbers; a document is
emitted once for each crossing inside its own step. Expectations are 24-bit fixed-point integers,
so the running sum is exact and reruns agree.

Documents stand in the order (size class, sub-run, size, doc_id, hash). Sizes then change slowly along the
sum, which keeps a source's taken words within a few documents of its target. Sub-runs are dealt by a hash of
doc_id and text; their number follows the row count, so it decides which copies are taken, but not the law.
A source may hold most rows: the sum is made from counts of size classes, of sub-runs inside a class, and of rows
inside a sub-run, and rows that repeat are one row with a count, so no task ever holds a whole source.

Defined results: null text has size 0; null source is a source of its own, last in order; a null
doc_id is a value like any other; repeated rows are separate documents, and which of equal rows is taken doesn't
matter; rows with one doc_id and size but different texts stand in the order of their hash; an empty table gives
an empty result; input columns called like an output column are replaced by it, all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table, word_count

SCALE_BITS = 24
WEIGHTS = (5, 2, 1)
CAP = 3
ROWS_PER_RUN = 50_000
LEAST_RUNS = 16
SEED = "mix-1"
OUT = ["size", "source_size", "target", "copies", "taken"]


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """One row per source of (source, source_size, n) with its ``target``: water-filling in closed form.

    In ascending order of cap / weight a source is capped as long as its cap is at most its part of what
    the sources before it leave over; all later ones share the rest by weight.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    left = lambda x: F.sum(x).over(everything) - F.coalesce(F.sum(x).over(before), F.lit(0.0))
    out = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size").cast("double") * cap).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    out = out.withColumn("_rest", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    out = out.withColumn("_wrest", left("_w")).withColumn("_capped", F.col("_ratio") <= F.col("_rest") / F.col("_wrest"))
    out = out.withColumn("_level", F.min(F.when(~F.col("_capped"), F.struct("_ratio", F.col("_rest") / F.col("_wrest")))).over(everything)["col2"])
    return out.select("source", "source_size", "n", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))).alias("target"))


def own_hash() -> Column:
    """32 bits that tell a row by its doc_id and text."""
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """64 bits that tell a row by all its columns."""
    return F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])


def _crossings(rows: DataFrame, weights: Sequence[float], share: float, cap: float, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, size, own, n: how many rows are alike, perhaps id, which breaks ties, and more) with source_size, target and
    the running sum before and behind each of the n rows: at(i) is the whole part of offset + (rank + i) * rate."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    rows = rows.withColumn("key", key)
    stats = settled(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")))
    total = stats.agg(F.sum("n")).first()[0] or 0
    runs = max(LEAST_RUNS, total // ROWS_PER_RUN)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << SCALE_BITS) + 0.5)).otherwise(0).cast("long")
    targets = source_targets(stats, weights=weights, share=share, cap=cap).select(key.alias("key"), "source_size", "target", rate.alias("rate"))
    targets = targets.withColumn("offset", F.conv(F.substring(F.md5(F.concat(F.lit(seed), "key")), 1, SCALE_BITS // 4), 16, 10).cast("long"))
    rows = rows.withColumn("class", (F.length(F.bin("size")) * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")).cast("long")).withColumn("run", F.pmod("own", F.lit(runs)))
    cell = ["key", "class", "run"]
    # three prefix sums: over a source's classes (some hundreds), over a class's runs, over a run's rows
    first = lambda *by, over: F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy(over).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy(*cell).agg(F.sum("n").alias("m"))
    classes = cells.groupBy("key", "class").agg(F.sum("m").alias("m")).select("key", "class", first("key", over="class").alias("class_start")).join(targets, "key")
    starts = cells.select(*cell, first("key", "class", over="run").alias("run_start")).join(classes, ["key", "class"])
    inside = Window.partitionBy(*cell).orderBy("size", F.col("doc_id").asc_nulls_first(), "own", *(["id"] if "id" in rows.columns else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, cell)
    return rows.withColumn("rank", F.col("class_start") + F.col("run_start") + F.col("rank")).drop(*cell, "class_start", "run_start")


def _at(i) -> Column:
    return F.expr(f"shiftright(offset + (rank + {i}) * rate, {SCALE_BITS})")


def mix(docs: DataFrame, *, size_col: str | None = None, own_col: str | None = None, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (= copies x size) for every row.

    ``docs`` needs doc_id and source, and text unless ``size_col`` names a column with the sizes and ``own_col`` one with ``own_hash``.
    """
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long") if size_col else word_count(F.col("text"))
    kept = [c for c in docs.columns if c not in OUT]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "doc_id", "source", size.alias("size"), (F.col(own_col) if own_col else own_hash()).alias("own"))
    # equal rows are one row with a count, so that even they are spread
    rows = rows.groupBy("row", "doc_id", "source", "size", "own").agg(F.count("*").alias("n"))
    out = _crossings(rows, weights, share, cap, seed).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    out = out.withColumn("copies", _at("i + 1") - _at("i"))
    return out.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs`` only.

    Copies are settled on rows of a few numbers; texts move once, in the join that brings them back.
    """
    row, doc_id, tell = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("id")
    narrow = docs.select(tell, doc_id, "source", word_count(F.col("text")).alias("size"), own_hash().alias("own"))
    alike = settled(narrow.groupBy("doc_id", "id", "source", "size", "own").agg(F.count("*").alias("n")))
    taken = _crossings(alike, weights, share, cap, seed).select(F.col("doc_id").alias("_doc"), F.col("id").alias("_id"), "n", (_at("n") - _at(0)).cast("int").alias("copies")).where("copies > 0")
    taken = settled(taken)
    keyed = docs.select(row, doc_id, tell)
    same = keyed["doc_id"].eqNullSafe(taken["_doc"]) & (keyed["id"] == taken["_id"])
    found = keyed.join(taken, same).select("row", "doc_id", "id", "n", "copies")
    once = found.where("n = 1").select("row", "copies")
    again = found.where("n > 1").groupBy("doc_id", "id").agg(F.first("row").alias("row"), F.first("copies").alias("copies")).select("row", "copies")
    both = once.unionByName(again) if taken.where("n > 1").limit(1).count() else once
    return both.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; one settled scan gives the sizes."""
    docs = table(spark, sf_dir, "documents")
    sizes = settled(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), own_hash().alias("own")))
    return mix(sizes, size_col="words", own_col="own").select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP3_SQL = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 8))::bigint as own from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as n from d group by source),
w as (select *, ([5, 2, 1])[((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::double as w, source_size * {CAP}::double as cap from s),
r as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over () - coalesce(sum(w) over (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as wrest from w),
l as (select *, cap / w <= rest / wrest as capped from r),
v as (select *, (select rest / wrest from l x where not capped order by cap / w, source asc nulls last limit 1) as level from l),
t as (select source, source_size, case when capped then cap else least(cap, level * w) end as target from v),
u as (select source, source_size, target, case when source_size > 0 then floor(target / source_size * {1 << SCALE_BITS} + 0.5)::bigint else 0 end as rate,
    ('0x' || substr(md5('{SEED}' || case when source is null then 'n' else 's' || source end), 1, {SCALE_BITS // 4}))::bigint as off from t),
c as (select *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) as cls, own % (select greatest({LEAST_RUNS}, count(*) // {ROWS_PER_RUN}) from d) as run from d),
k as (select *, row_number() over (partition by source order by cls, run, size, doc_id nulls first, own) - 1 as rk from c),
e as (select k.doc_id, k.size, u.source_size, u.target, k.source, ((off + (rk + 1) * rate) >> {SCALE_BITS}) - ((off + rk * rate) >> {SCALE_BITS}) as copies from k join u on k.source is not distinct from u.source)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, source, copies::bigint as copies from e
"""
