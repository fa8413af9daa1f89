"""Shared helpers: lineage cuts, the folder that all executors share, joins on hot keys, bounded memos."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS, HOT_KEYS = 1_000, 10_000
MEMO_BYTES = 16 << 20
DOOR = 1 << 22  # places in the table of what came before


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one only where none is set, on a local master."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="spanmill-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``scratch``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, without its lineage; survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def spread_join(rows: DataFrame, named: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``named``, which has one row for each key and in ``n`` how many rows share the key.

    Keys with more than HOT_ROWS rows and more than a HOT_KEYSth part of all ``total`` rows are broadcast: that is at
    most HOT_KEYS keys, whatever the data. All other keys are shuffled, and none of them fills a task.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = named.where(F.col(n) > most).drop(n), named.where(F.col(n) <= most).drop(n)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


class Memo(dict):
    """A dict from text of at most about ``limit`` bytes, in two generations of half of that each.

    When the newer one is full it becomes the older one. ``again`` looks there and moves what it finds to the newer one, so
    what is asked for often stays.
    """

    def __init__(self, limit: int = MEMO_BYTES):
        super().__init__()
        self.limit = self.room = limit // 2
        self.older: dict = {}

    def again(self, key: str):
        value = self.older.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        self.room -= 170 + len(key) + (len(value) if isinstance(value, bytes) else 24)
        if self.room < 0:
            self.older = dict(self)
            self.clear()
            self.room = self.limit
        self[key] = value


class Chosen(Memo):
    """A memo that keeps a key when it comes again: most words of a corpus come once, and would push out others.

    A table of hashes, emptied when half full, says what came before.
    """

    def __init__(self, limit: int = MEMO_BYTES):
        super().__init__(limit)
        self.door, self.came = bytearray(DOOR), 0

    def again(self, key: str):
        value = self.older.get(key)
        if value is not None:
            super().keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        place = hash(key) & DOOR - 1
        if self.door[place]:
            super().keep(key, value)
            return
        self.door[place] = 1
        self.came += 1
        if self.came > DOOR // 2:
            self.door, self.came = bytearray(DOOR), 0
