"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

A vector is projected on ``m`` Gaussian directions. For a pair at distance d, the squared projected distance over
d^2 follows a chi-square law with m degrees of freedom. A search takes projected neighbours in ascending order
and verifies them on the original vectors; it stops once, for the k-th best distance d so far, a
neighbour within d would have shown up by now with probability ``confidence``.

The kd-tree has two levels. The upper one, at most ``MAX_CELLS`` cells, is fitted on a bounded sample of
projections and places every row; a cell with many rows (whatever their values) is dealt over blocks by a hash, so a block
holds about ``BLOCK_ROWS`` rows. Each block builds the lower tree over all its rows. A query first searches its own cell,
which bounds its k-th distance; then it visits those other cells whose boxes pass the stopping test. Queries
are sent to cells, some ``ASKED_AT_ONCE`` to a block at a time.

Equal vectors are one search, and at most the first rows of equal vectors are searched: no query takes more than its k nearest
and its own, and ties go to smaller ids, so the result is the same, and a vector that a third of all rows share costs no more
than another.

Defined results: vectors that are null, zero, not finite, or not of the most frequent length (the shorter one on a tie)
take no part, nor do null ids; rows that share the query's id are its own; a query row that occurs twice
gets its list twice under one id only if the vectors differ; rows that repeat are neighbours each; ties go to the smaller id;
an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table

M = 8
CONFIDENCE = 0.99
SEED = 20
SAMPLE_ROWS = 20_000
CELL_ROWS = 4_096
MAX_CELLS = 4_096
BLOCK_ROWS = 16_384
LEAF_ROWS = 64
LEAVES_AT_ONCE = 4
ASKED_AT_ONCE = 2_000
K = 10


def chi2_cdf(x: float, m: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def projection(dim: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class Splits:
    """A kd-tree given by its splits: rows go left below the value."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(max(1, (1 << depth) - 1), np.int64)
        self.value = np.full(max(1, (1 << depth) - 1), np.inf)
        parts = [points]
        for level in range(depth):
            nxt = []
            for j, p in enumerate(parts):
                node = (1 << level) - 1 + j
                if len(p):
                    axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                    self.axis[node], self.value[node] = axis, np.median(p[:, axis])
                    left = p[:, axis] < self.value[node]
                    nxt += [p[left], p[~left]]
                else:
                    nxt += [p, p]
            parts = nxt

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for level in range(self.depth):
            node = (1 << level) - 1 + at
            at = 2 * at + (points[np.arange(len(points)), self.axis[node]] >= self.value[node])
        return at


class Block:
    """The lower kd-tree: leaves of at most LEAF_ROWS rows with their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        order, leaves, stack = np.arange(len(ids)), [], [(0, len(ids))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= LEAF_ROWS:
                if hi > lo:
                    leaves.append((lo, hi))
                continue
            p = projected[order[lo:hi]]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(p[:, axis], mid)]
            stack += [(lo, lo + mid), (lo + mid, hi)]
        self.ids, self.vectors, self.projected, self.leaves = ids[order], vectors[order], projected[order], leaves
        self.low = np.array([self.projected[a:b].min(axis=0) for a, b in leaves]).reshape(-1, projected.shape[1])
        self.high = np.array([self.projected[a:b].max(axis=0) for a, b in leaves]).reshape(-1, projected.shape[1])

    def search(self, own: int | None, vector: np.ndarray, projected: np.ndarray, k: int, bound: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest found, at most ``bound`` away; stop: the chi-square quantile."""
        ids, dist = np.empty(0, np.int64), np.empty(0)
        lower = (np.maximum(np.maximum(self.low - projected, projected - self.high), 0) ** 2).sum(axis=1)
        order = np.argsort(lower, kind="stable")
        for at in range(0, len(order), LEAVES_AT_ONCE):
            reach = stop * bound * bound
            leaves = [int(i) for i in order[at : at + LEAVES_AT_ONCE] if lower[i] <= reach]
            if not leaves:
                break
            rows = np.concatenate([np.arange(*self.leaves[i]) for i in leaves])
            near = ((self.projected[rows] - projected) ** 2).sum(axis=1)
            rows = rows[near <= reach] if own is None else rows[(near <= reach) & (self.ids[rows] != own)]
            d = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(axis=1))
            ids, dist = np.concatenate((ids, self.ids[rows])), np.concatenate((dist, d))
            keep = np.lexsort((ids, dist))[:k]
            ids, dist = ids[keep], dist[keep]
            if len(dist) == k:
                bound = min(bound, float(dist[-1]))
        return ids, dist


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, width)


def _prepare(dim: int, splits: Splits | None):
    """Valid rows with the vector and its projection as bytes, the projection as an array, and the cell."""
    directions = projection(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.and_kleene(b.column(0).is_valid(), pa.compute.equal(pa.compute.list_value_length(b.column(1)), dim)))
            flat = b.column(1).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            flat, ids = np.ascontiguousarray(flat[good]), b.column(0).filter(pa.array(good))
            near = np.ascontiguousarray(flat @ directions)
            cells = splits.cell(near) if splits else np.zeros(len(near), np.int64)
            arrays = [ids, pa.array([x.tobytes() for x in flat], pa.binary()), pa.array(list(near), pa.list_(pa.float64())), pa.array(cells, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "vec", "near", "cell"])

    return run


PREPARED = "vec_id long, vec binary, near array<double>, cell int"
FOUND = "qkey long, vec_id long, score double"


def nearest(vectors: DataFrame, queries, *, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) that the condition ``queries`` picks."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    most = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (most["dim"], most["n"]) if most else (1, 0)
    stop = chi2_quantile(confidence, M)

    # the upper tree: from a bounded sample of projections, by a hash of the id
    part = max(1, n // SAMPLE_ROWS)
    sampled = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(part)) == 0).mapInArrow(_prepare(dim, None), PREPARED).select("near").limit(2 * SAMPLE_ROWS)
    points = np.array([r["near"] for r in sampled.collect()]).reshape(-1, M)
    depth = min(int(math.log2(MAX_CELLS)), max(0, math.ceil(math.log2(max(1, n / CELL_ROWS)))))
    splits = Splits(points, depth)
    # of one vector's rows: as many ids as a query could take besides its own, and of one id as many rows
    placed = settled(rows.mapInArrow(_prepare(dim, splits), PREPARED))
    same = Window.partitionBy("vec", "vec_id").orderBy("cell")
    few = placed.withColumn("again", F.row_number().over(same)).where(F.col("again") <= k)
    few = settled(few.withColumn("nth", F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth"))

    # at most MAX_CELLS rows: count and box of each cell
    ends = [f(F.col("near")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(M)]
    stats = few.groupBy("cell").agg(F.count("*").alias("n"), F.max("again").alias("again"), *ends).collect()
    # a search that doesn't leave its own rows out finds them too
    wanted = k + max((r["again"] for r in stats), default=1)
    blocks = {r["cell"]: -(-r["n"] // BLOCK_ROWS) for r in stats}
    cells = np.array([r["cell"] for r in stats], np.int64)
    low, high = (np.array([[r[f"{x}{i}"] for i in range(M)] for r in stats]).reshape(-1, M) for x in ("lo", "hi"))

    def of_cell(values: dict[int, int]) -> F.Column:
        """A number for each cell, 1 where there is none."""
        listed = [values.get(c, 1) for c in range(max(values, default=0) + 1)]
        return F.element_at(F.lit(listed).cast("array<int>"), F.col("cell") + 1)

    data = few.select("vec_id", "vec", "near", "cell", F.pmod(F.xxhash64("vec_id", "vec"), of_cell(blocks)).cast("int").alias("block"))
    # ids with several vectors leave all their rows out; all other queries are asked by vector alone
    several = few.select("vec_id", "vec").distinct().groupBy("vec_id").agg(F.count("*").alias("vectors")).where("vectors > 1").select(F.col("vec_id").alias("query_id"), F.lit(True).alias("several"))
    queries_of = placed.where(queries).select(F.col("vec_id").alias("query_id"), "vec", "near", "cell").join(several, "query_id", "left")
    queries_of = queries_of.withColumn("own", F.when(F.col("several"), F.col("query_id"))).withColumn("qkey", F.xxhash64("vec", "own"))
    queries_of = settled(queries_of.groupBy("query_id", "qkey", "own", "vec", "near", "cell").agg(F.lit(1).alias("one")))
    asked = settled(queries_of.groupBy("qkey", "own", "vec", "near", "cell").agg(F.lit(1).alias("one")).drop("one"))

    def route(home: bool):
        def run(frames):
            import pandas as pd

            for f in frames:
                out = []
                for row in f.itertuples(index=False):
                    if home:
                        go = [row.cell] if row.cell in blocks else []
                    else:
                        p = np.asarray(row.near)
                        lower = (np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(axis=1)
                        go = [int(c) for c in cells[lower <= stop * row.bound**2] if c != row.cell]
                    out += [(c, row.qkey, row.own, row.vec, row.near, row.bound) for c in go]
                yield pd.DataFrame(out, columns=["cell", "qkey", "own", "vec", "near", "bound"]).astype({"own": "Int64"})

        return run

    routed = "cell int, qkey long, own long, vec binary, near array<double>, bound double"

    def search(data, asked):
        import pandas as pd

        if not len(data) or not len(asked):
            return pd.DataFrame({"qkey": [], "vec_id": [], "score": []}).astype({"qkey": "int64", "vec_id": "int64", "score": "float64"})
        block = Block(data["vec_id"].to_numpy(np.int64), _matrix(data["vec"], dim), np.stack(list(data["near"])))
        vecs, near = _matrix(asked["vec"], dim), np.stack(list(asked["near"]))
        keys, owns, bounds = asked["qkey"].to_numpy(np.int64), [None if pd.isna(x) else int(x) for x in asked["own"]], asked["bound"].to_numpy(np.float64)
        found = [block.search(owns[i], vecs[i], near[i], wanted, bounds[i], stop) for i in range(len(asked))]
        return pd.DataFrame({"qkey": np.repeat(keys, [len(x) for x, _ in found]), "vec_id": np.concatenate([x for x, _ in found]), "score": np.concatenate([d for _, d in found])})

    def searched(asked):
        """All blocks of the cells; a block with many queries is there once for each part of them."""
        parts = {r["cell"]: -(-r["n"] // ASKED_AT_ONCE) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MAX_CELLS rows
        there = asked.withColumn("block", F.explode(F.sequence(F.lit(0), of_cell(blocks) - 1))).withColumn("part", F.pmod("qkey", of_cell(parts)).cast("int"))
        held = data.where(F.col("cell").isin(list(parts))) if len(parts) < 100 else data
        held = held.withColumn("part", F.explode(F.sequence(F.lit(0), of_cell(parts) - 1)))
        return held.groupBy("cell", "block", "part").cogroup(there.groupBy("cell", "block", "part")).applyInPandas(search, FOUND)

    best = Window.partitionBy("qkey").orderBy("score", "vec_id")
    ranked = lambda x: x.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= wanted)
    first = settled(ranked(searched(settled(asked.withColumn("bound", F.lit(float("inf"))).mapInPandas(route(True), routed)))))
    bounds = first.groupBy("qkey").agg(F.max(F.when(F.col("nth") == wanted, F.col("score"))).alias("bound"))
    again = asked.join(bounds, "qkey", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    second = searched(settled(again.select("qkey", "own", "vec", "near", "cell", "bound").mapInPandas(route(False), routed)))
    every = ranked(first.drop("nth").unionByName(second)).select("qkey", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy("score", "vec_id"))
    out = queries_of.select("query_id", "qkey").join(every, "qkey").where("vec_id != query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"))
