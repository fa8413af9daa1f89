"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. They start in shards dealt by a hash; in each round a block of
linked documents (one text, one start shard) asks for the shard where most of its neighbours are, and
moves if that shard's capacity quota allows. Blocks are rows of (text, start shard, count), so a text
with a third of all documents is 24 rows, and no pair is ever formed. Loads and quotas are tables of one
row per shard.

Quotas may be loose while labels move, since a last sweep makes sizes even: documents ranked by (label, text) are cut into equal runs, so counts
differ by one at most and a cut parts at most one text per boundary. Ranks come from counts of cells and
ranks inside cells; a frequent text is dealt over several cells, and rows with one doc_id and text are one row with a count
until the end.

Defined results: a null text counts as an empty one; null doc_ids and repeated rows are documents of
their own; texts are read whole, however long; an empty table gives an empty result; with fewer documents than shards some
shards are empty. Only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table

SHARDS = 24
ROUNDS = 6
SLACK = 0.5
CELL_ROWS = 5_000


def _unit(*cols) -> F.Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.expr("1.0D") * F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _propagate(blocks: DataFrame, fixed: DataFrame, shards: int, rounds: int, capacity: float) -> DataFrame:
    """``blocks`` (grp, start, n, cur) after some rounds of moves; ``fixed``: the load (cur, n) that never moves."""
    state = blocks
    for k in range(rounds):
        votes = state.groupBy("grp", "cur").agg(F.sum("n").alias("v"))
        best = votes.groupBy("grp").agg(F.max(F.struct("v", F.xxhash64("grp", "cur").alias("tie"), "cur"))["cur"].alias("best"))
        loads = state.select("cur", "n").unionByName(fixed).groupBy("cur").agg(F.sum("n").alias("load"))
        asked = state.join(best, "grp")
        wanted = asked.where("cur != best").groupBy("best").agg(F.sum("n").alias("wanted"))
        # half of what asks to leave a shard counts as room in it; all tables here have one row per shard
        leaving = asked.where("cur != best").groupBy(F.col("cur").alias("best")).agg(F.sum("n").alias("leaving"))
        room = wanted.join(F.broadcast(loads.withColumnRenamed("cur", "best")), "best", "left").join(F.broadcast(leaving), "best", "left")
        room = room.select("best", "wanted", F.greatest(F.lit(0.0), F.lit(capacity) - F.coalesce("load", F.lit(0)) + F.coalesce("leaving", F.lit(0)) / 2).alias("room"))
        moves = (F.col("cur") != F.col("best")) & (F.col("n") <= F.col("room")) & (_unit("grp", "cur", F.lit(k)) < F.col("room") / F.col("wanted"))
        # one row per shard on the broadcast side
        state = settled(asked.join(F.broadcast(room), "best", "left").select("grp", "start", "n", F.when(moves, F.col("best")).otherwise(F.col("cur")).alias("cur")))
    return state


def shard(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``; counts of shards differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("grp"))
    base = base.groupBy(*base.columns).agg(F.count("*").alias("m"))
    base = settled(base.withColumn("start", F.pmod(F.xxhash64("doc_id", "grp"), F.lit(shards)).cast("int")))
    blocks = base.groupBy("grp", "start").agg(F.sum("m").alias("n")).withColumn("copies", F.sum("n").over(Window.partitionBy("grp")))
    blocks = settled(blocks)
    total = blocks.agg(F.sum("n")).first()[0] or 0
    linked = blocks.where("copies > 1")
    fixed = blocks.where("copies = 1").groupBy(F.col("start").alias("cur")).agg(F.sum("n").alias("n"))
    moved = _propagate(linked.select("grp", "start", "n", F.col("start").alias("cur")), settled(fixed), shards, rounds, (1 + slack) * total / shards)
    labels = moved.join(linked.select("grp", "start", "copies"), ["grp", "start"]).select("grp", "start", "copies", "cur")
    rows = base.join(labels, ["grp", "start"], "left").withColumns({"label": F.coalesce("cur", "start"), "copies": F.coalesce("copies", F.lit(1))})

    strips = max(8, total // (shards * CELL_ROWS))
    rows = rows.withColumn("strip", F.pmod(F.xxhash64("grp"), F.lit(strips)))
    rows = rows.withColumn("part", F.when(F.col("copies") > CELL_ROWS // 10, F.pmod(F.xxhash64("doc_id", "text_crc32"), F.ceil(F.col("copies") / (CELL_ROWS // 10)))).otherwise(0))
    cell = ["label", "strip", "part"]
    of_label = Window.partitionBy("label").orderBy("strip", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).agg(F.sum("m").alias("n"))
    # one row per label: at most as many as there are shards
    starts = cells.groupBy("label").agg(F.sum("n").alias("n")).select("label", F.coalesce(F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("label_start"))
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("n").over(of_label), F.lit(0))).drop("n").join(F.broadcast(starts), "label")
    before = Window.partitionBy(*cell).orderBy("copies", "grp", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_cell", F.coalesce(F.sum("m").over(before), F.lit(0)))
    rows = rows.join(cells, cell).withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    rows = rows.withColumn("rank", F.col("label_start") + F.col("cell_start") + F.col("in_cell") + F.col("again"))
    rows = rows.withColumn("shard", F.expr(f"int(rank * {shards} div {max(1, total)})"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - first).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
