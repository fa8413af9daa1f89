"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one representative a group.

Centres are fitted on a bounded sample; every distinct vector is placed. It lives in the cell of its nearest centre and visits
each other cell whose border it is near: a partner's part across the border is ``sqrt(1 - LINK^2)`` at most, and in a
direction that has nothing to do with the border it is normal with that over ``sqrt(dim - 1)``, so vectors within ``MARGIN``
such deviations visit (in few dimensions that is the bound itself, and nothing is lost). A pair is missed only if neither visits
the other's cell; the tests and the README hold measured recall. Whatever is found is linked by its exact cosine.

Centres nearer to each other than half the linking angle are one centre, so a dense group isn't cut up. Vectors within
half the angle of their centre are its core: they are linked with each other by the triangle inequality, so a group with a
third of all rows is counted, not compared; only vectors within one and a half angles of the centre can link with a core. Of
all others a cell's vectors are compared block by block, one pair of blocks a task, as matrix products in slices. A task
returns for each vector its number of links and its group's first member, never pairs. Equal vectors are one vector with a count.

Vectors of another length than the most frequent one have a cell for their length, without a centre, cut into blocks like any other.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and name their own
component; vectors of different lengths don't link; rows that repeat are vectors of their own, linked with each other; rows
with a null vec_id take part but name a component only where it has no other id, and then are kept; ties go to the smaller id; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, spread_join, table
from .simhash import _Sets, components

LINK = 0.9
MARGIN = 2.0  # deviations
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 16 << 20
CELL_ROWS = 512
MAX_CELLS = 4_096
FITS = 5
BLOCK_ROWS = 8_192
SLICE = 1_024
SEED = 11
_EPS = 1e-9


def _units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors take part, and these divided by their lengths."""
    units = []
    for i in range(len(column)):
        v = column[i]
        if not v.is_valid or not len(v.values) or v.values.null_count:
            units.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            units.append(None)
            continue
        x = x / top
        units.append(x / math.sqrt(float(x @ x)))
    return np.array([u is not None for u in units], bool), units


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vec, dim): the unit vector as doubles, null if it takes no part."""
    for b in batches:
        _, units = _units(b.column(1))
        vec = pa.array([None if u is None else u.tobytes() for u in units], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), vec, pa.array([0 if u is None else len(u) for u in units], pa.int32())], ["vec_id", "vec", "dim"])


def centres(sample: np.ndarray, k: int, link: float = LINK) -> np.ndarray:
    """At most ``k`` unit vectors by spherical k-means, none within half the linking angle of another."""
    if not len(sample):
        return sample.reshape(0, sample.shape[1] if sample.ndim == 2 else 0)
    rng = np.random.default_rng(SEED)
    c = sample[np.sort(rng.choice(len(sample), min(k, len(sample)), replace=False))].copy()
    half = math.sqrt((1 + link) / 2)
    for fit in range(FITS):
        sums = np.zeros_like(c)
        for at in range(0, len(sample), SLICE):
            part = sample[at : at + SLICE]
            np.add.at(sums, (part @ c.T).argmax(axis=1), part)
        size = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(size[:, None] > _EPS, sums / np.maximum(size, _EPS)[:, None], c)
        if fit in (FITS - 2, FITS - 1):  # once more after the first merging, since means move
            kept: list[int] = []
            gone = np.zeros(len(c), bool)
            for i in range(len(c)):
                if not gone[i]:
                    kept.append(i)
                    gone |= c @ c[i] >= half
            c = c[kept]
    return c


def margin(dim: int, link: float = LINK, deviations: float = MARGIN) -> float:
    """How far from a border, as a sine, vectors still visit the cell behind it."""
    across = math.sqrt(1 - link * link)
    return min(across, deviations * across / math.sqrt(max(1, dim - 1))) + _EPS


CORE, RESIDENT, VISITOR = 0, 1, 2
PLACED = "node long, vec binary, m long, cell int, home int, role int, near boolean, visits array<int>"


def _place(c: np.ndarray, dim: int, link: float, deviations: float):
    """Rows (node, vec, m, dim) once for their own cell and once for each they visit; cells of other lengths are negative."""
    half, wide = math.sqrt((1 + link) / 2) + _EPS, math.cos(1.5 * math.acos(link)) - _EPS
    reach = margin(dim, link, deviations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
        np.fill_diagonal(apart, 1.0)
        for b in batches:
            own = np.asarray(b.column(3).to_numpy() == dim)
            for at in range(0, b.num_rows, SLICE):
                part, mine = b.slice(at, SLICE), own[at : at + SLICE]
                rows, cell, home, role, near, visits = [], [], [], [], [], []
                other = np.flatnonzero(~mine)
                for i in other:
                    d = -part.column(3)[int(i)].as_py()
                    rows.append(int(i)), cell.append(d), home.append(d), role.append(RESIDENT), near.append(False), visits.append([])
                who = np.flatnonzero(mine)
                if len(who):
                    u = np.frombuffer(b"".join(part.column(1).take(pa.array(who)).to_pylist()), np.float64).reshape(-1, dim)
                    cos = u @ c.T
                    at_home = cos.argmax(axis=1)
                    best = cos[np.arange(len(u)), at_home]
                    goes = best[:, None] - cos <= reach * apart[at_home]
                    goes[np.arange(len(u)), at_home] = False
                    for j, i in enumerate(who):
                        there, h = np.flatnonzero(goes[j]), int(at_home[j])
                        listed = there.tolist()
                        rows += [int(i)] * (1 + len(listed))
                        cell += [h, *listed]
                        home += [h] * (1 + len(listed))
                        role += [CORE if best[j] >= half else RESIDENT, *[VISITOR] * len(listed)]
                        near += [bool(best[j] >= wide), *(cos[j, there] >= wide).tolist()]
                        visits += [listed, *[None] * len(listed)]
                out = [part.column(k).take(pa.array(rows, pa.int64())) for k in range(3)]
                out += [pa.array(x, pa.int32()) for x in (cell, home, role)] + [pa.array(near, pa.bool_()), pa.array(visits, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(out, ["node", "vec", "m", "cell", "home", "role", "near", "visits"])

    return run


TASK = ["cell", "kind", "a", "b"]
FOUND = "node long, links long, root long"


def _compared(link: float):
    """The links between two sides of a task (kind c: core with others, r: residents with visitors, s: residents with residents)."""

    def run(key, frame):
        import pandas as pd

        cell, kind = int(key[0]), key[1]
        none = pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        sides = frame["side"].to_numpy()
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        alone = kind == "s" and key[2] == key[3]
        if alone:
            left = right = np.arange(len(frame))
        if not len(left) or not len(right):
            return none
        nodes, m, home = (frame[x].to_numpy(np.int64) for x in ("node", "m", "home"))
        vec = np.frombuffer(b"".join(frame["vec"]), np.float64).reshape(len(frame), -1)
        # which rows visit which cells with smaller numbers: a pair that two cells see counts in the smaller one
        lists = [np.asarray(v, np.int64) if v is not None else np.empty(0, np.int64) for v in frame["visits"]]
        base = int(max((int(x.max()) for x in lists if len(x)), default=0)) + int(home.max()) + 2 if kind != "s" else 1
        known = np.sort(np.concatenate([i * base + x for i, x in enumerate(lists)])) if kind != "s" else np.empty(0, np.int64)
        links, sets = np.zeros(len(frame), np.int64), _Sets(len(frame))
        for i in range(0, len(left), SLICE):
            a = left[i : i + SLICE]
            for j in range(i if alone else 0, len(right), SLICE):
                b = right[j : j + SLICE]
                x, y = np.nonzero(vec[a] @ vec[b].T >= link)
                x, y = a[x], b[y]
                if alone and i == j:
                    x, y = x[x < y], y[x < y]
                if kind != "s" and len(known) and len(x):
                    asked = x * base + home[y]
                    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                    again = (home[y] != cell) & (home[y] < cell) & (known[at] == asked)
                    x, y = x[~again], y[~again]
                if len(x):
                    np.add.at(links, x, m[y])
                    np.add.at(links, y, m[x])
                    sets.join(x, y)
        has = np.flatnonzero(links)
        return pd.DataFrame({"node": nodes[has], "links": links[has], "root": nodes[sets.root[has]]}) if len(has) else none

    return run


def _dealt(placed: DataFrame) -> DataFrame:
    """Each placed row once for every task that compares it: block numbers are hashes, and a cell's counts say how many blocks it has."""
    blocks = lambda c: F.ceil(F.count_if(c) / BLOCK_ROWS).cast("int")
    core, near = F.col("role") == CORE, (F.col("role") != CORE) & F.col("near")
    sizes = placed.groupBy("cell").agg(blocks(core).alias("nc"), blocks(near).alias("nn"), blocks(F.col("role") == RESIDENT).alias("nr"), blocks(F.col("role") == VISITOR).alias("nv"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    # one row a cell: at most MAX_CELLS and one for each other length
    rows = placed.join(F.broadcast(sizes), "cell").withColumns({"c": own("nc"), "n": own("nn"), "r": own("nr"), "v": own("nv")})
    task = lambda kind, a, b, side: f"named_struct('kind', '{kind}', 'a', cast({a} as int), 'b', cast({b} as int), 'side', {side})"
    every = lambda n: f"if({n} > 0, sequence(0, {n} - 1), cast(array() as array<int>))"
    with_core = f"if(near, transform({every('nc')}, i -> {task('c', 'i', 'n', 1)}), array())"
    tasks = F.expr(
        f"case role when {CORE} then transform({every('nn')}, i -> {task('c', 'c', 'i', 0)}) "
        f"when {RESIDENT} then concat({with_core}, transform({every('nv')}, i -> {task('r', 'r', 'i', 0)}), "
        f"transform({every('nr')}, i -> {task('s', 'least(i, r)', 'greatest(i, r)', 'if(i < r, 1, 0)')})) "
        f"else concat({with_core}, transform({every('nr')}, i -> {task('r', 'i', 'v', 1)})) end"
    )
    return rows.select("cell", "node", "vec", "m", "home", F.when(F.col("role") != VISITOR, F.col("visits")).alias("visits"), F.explode(tasks).alias("t")).select("cell", "t.kind", "t.a", "t.b", "t.side", "node", "vec", "m", "home", "visits")


def near_vectors(vectors: DataFrame, *, link: float = LINK, deviations: float = MARGIN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_prepared, "vec_id long, vec binary, dim int")
    rows = settled(rows)
    groups = rows.where("vec is not null").groupBy("vec", "dim").agg(F.min("vec_id").alias("name"), F.count("*").alias("m"))
    # numbered once and written: the numbers don't change after that
    nodes = settled(groups.withColumn("node", F.monotonically_increasing_id()))
    lengths = nodes.groupBy("dim").agg(F.count("*").alias("n"), F.sum("m").alias("rows")).orderBy(F.desc("n"), "dim")
    most, total = lengths.first(), nodes.agg(F.sum("m")).first()[0] or 0
    dim, n = (most["dim"], most["n"]) if most else (1, 0)

    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    part = max(1, -(-n // wanted))
    sampled = nodes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec"), F.lit(part)) == 0)).select("vec").orderBy("vec").limit(wanted)
    sample = np.frombuffer(b"".join(r["vec"] for r in sampled.collect()), np.float64).reshape(-1, dim)
    c = centres(sample, max(1, min(MAX_CELLS, n // CELL_ROWS)), link)
    if n and not len(c):  # a hash may leave a small table's sample empty
        c = np.eye(1, dim)
    placed = settled(nodes.select("node", "vec", "m", "dim").mapInArrow(_place(c, dim, link, deviations), PLACED))

    found = settled(_dealt(placed).groupBy(*TASK).applyInPandas(_compared(link), FOUND))
    cores = placed.where(F.col("role") == CORE)
    # one row a cell
    of_core = cores.groupBy("cell").agg(F.sum("m").alias("core"), F.min("node").alias("root"))
    in_core = cores.select("cell", "node", "m").join(F.broadcast(of_core), "cell")
    counts = found.select("node", "links").unionByName(in_core.select("node", (F.col("core") - F.col("m")).alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(in_core.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    named = nodes.select("node", "vec", "name", "m").join(counts, "node", "left").join(roots.withColumnRenamed("u", "node"), "node", "left")
    named = settled(named.select("vec", "name", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    ids = settled(named.groupBy("root").agg(F.min("name").alias("component_id"), F.count("*").alias("members")))
    named = settled(spread_join(named, ids, "root", "members", n).select("vec", "m", "n_links", "component_id"))
    linked = spread_join(rows.where("vec is not null").select("vec_id", "vec"), named, "vec", "m", total).select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
