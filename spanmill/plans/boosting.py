"""Leaf-wise gradient boosting on DataFrames.

Features become quantile bins once. A table of (part, label, hash, bins, margin) is written to the shared folder, and written anew with
the margins of all trees so far every ``SETTLED`` rounds; in between a task adds the few newer trees itself, so nothing is fitted again.

A tree grows in steps. A step is one pass over the rows: each task adds up gradients, hessians and counts by (node, feature, bin)
for the nodes that the step makes, and one shuffle by (node, feature) adds the tasks' sums and takes the best split. The driver gets
one row for each node, never sums by bin. (Siblings are both counted: the difference from the parent would need the
parent's sums kept between steps.) Splits are taken best first up to ``maxLeaves``: a step splits all nodes that the best-first order
takes given what is known, and the tree is done when the order takes only nodes whose children are known, so the tree is that of
one split at a time. The first step of a round also gives the validation loss of the model before it.

A node of at most ``TASK_ROWS`` rows is finished in one pass: its rows' bins, gradients and hessians go to one task, which splits the node and what comes
of it, best first, up to as many leaves as a tree may have. The tree's order takes such splits from their beginning, so more are never asked for.
Those nodes wait until no larger one is open, so a tree is a few steps for its large nodes and one for all small ones.

Missing values (null, NaN, minus infinity) go left. Ties go to the feature that stands first, then to the lower threshold.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from .trees import DEFAULT_LEFT, NAN_MISSING, Ensemble, Tree

ROUNDS = 2000
SETTLED = 20
EDGES = 254
TASK_ROWS = 500_000  # of a node that a task finishes: 31 MB with 46 features
PASS_ROWS = 25_000  # that a task of a pass takes at least
BATCHES = 16
LEAST_HESSIAN = 1e-3
IDLE = 5  # rounds in a row without a split, after which there is nothing to learn
LOSS = -1  # node number of the validation loss
LOWEST = -1.7976931348623157e308


def bin_edges(rows: DataFrame, names: list[str]) -> list[np.ndarray]:
    """For each feature the upper ends of its bins: all values if these are few, else quantiles."""
    finite = lambda n: F.when(~F.isnan(F.col(f"`{n}`").cast("double")) & (F.col(f"`{n}`").cast("double") > F.lit(float("-inf"))), F.col(f"`{n}`").cast("double"))
    shares = [(i + 1) / (EDGES + 1) for i in range(EDGES)]
    asked = [x for i, n in enumerate(names) for x in (F.percentile_approx(finite(n), shares, 10_000).alias(f"q{i}"), F.approx_count_distinct(finite(n)).alias(f"n{i}"))]
    found = rows.agg(*asked).first()
    few = [i for i in range(len(names)) if found[f"n{i}"] <= EDGES * 3 // 4]
    every = rows.agg(*[F.collect_set(finite(names[i])).alias(f"s{i}") for i in few]).first() if few else {}
    edges = [np.unique(np.array(every[f"s{i}"] if i in few else found[f"q{i}"] or [], np.float64)) for i in range(len(names))]
    return [e if len(e) <= EDGES else np.unique(found[f"q{i}"]) for i, e in enumerate(edges)]


def _binned(edges: list[np.ndarray]):
    """(part, y, bins) from (part, y, u, features)."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            if not len(f):
                continue
            x = np.stack(list(f["x"])).astype(np.float64)
            bins = np.empty(x.shape, np.uint8)
            for j, e in enumerate(edges):
                v = x[:, j]
                bins[:, j] = np.where(np.isnan(v) | (v == -np.inf), 0, 1 + np.searchsorted(e, v, "left"))
            yield pd.DataFrame({"part": f["part"], "y": f["y"], "u": f["u"], "bins": [b.tobytes() for b in bins], "margin": 0.0})

    return run


ROWS = "part int, y int, u bigint, bins binary, margin double"


class Growing:
    """A tree over bins while it grows: node numbers in order of their making."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.depth = [-1], [0], [-1], [-1], [0]
        self.best: list[dict | None] = [None]

    def split(self, node: int) -> None:
        b = self.best[node]
        self.feature[node], self.bin[node] = b["feature"], b["bin"]
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        # the children's sums are known; whether they have splits isn't yet
        left = {"gain": -math.inf, **{k: b[f"{k}_left"] for k in ("n", "g", "h")}}
        for child in (left, {"gain": -math.inf, **{k: b[k] - b[f"{k}_left"] for k in ("n", "g", "h")}}):
            for x, v in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.depth, self.depth[node] + 1), (self.best, child)):
                x.append(v)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in (self.feature, self.bin, self.left, self.right))


def _reached(arrays, bins: np.ndarray) -> np.ndarray:
    feature, at_bin, left, right = arrays
    at = np.zeros(len(bins), np.int64)
    while (rows := np.flatnonzero(feature[at] >= 0)).size:
        node = at[rows]
        at[rows] = np.where(bins[rows, feature[node]] <= at_bin[node], left[node], right[node])
    return at


def _margin(frame, bins: np.ndarray, newer) -> np.ndarray:
    out = frame["margin"].to_numpy(np.float64).copy()
    for arrays, value in newer:
        out += value[_reached(arrays, bins)]
    return out


def _with_margins(n: int, newer):
    def run(frames: Iterator) -> Iterator:
        for f in frames:
            bins = np.frombuffer(b"".join(f["bins"]), np.uint8).reshape(-1, n)
            yield f.assign(margin=_margin(f, bins, newer))

    return run


def _in_bag(u: np.ndarray, salt: int, share: float) -> np.ndarray:
    x = u.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64 < share


SUMS = "node int, feature int, sums binary"


def _counted(n: int, base: float, weight: float, newer, arrays, numbers: list[int], features: list[int], size: int, bag: tuple[int, float], loss: bool):
    """A task's sums for the nodes ``numbers``, and of the validation loss."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        sums = np.zeros((3, len(features), len(numbers), size))
        place = np.full(int(len(arrays[0])), -1)
        place[numbers] = np.arange(len(numbers))
        lost = np.zeros(2)
        for f in frames:
            bins = np.frombuffer(b"".join(f["bins"]), np.uint8).reshape(-1, n)
            y, m = f["y"].to_numpy(np.float64), base + _margin(f, bins, newer)
            w, train = np.where(y == 1, weight, 1.0), f["part"].to_numpy() == 0
            if loss and not train.all():
                v = ~train
                lost += [float((w[v] * np.logaddexp(0.0, np.where(y[v] == 1, -m[v], m[v]))).sum()), float(w[v].sum())]
            rows = np.flatnonzero(train & _in_bag(f["u"].to_numpy(np.int64), *bag))
            own = place[_reached(arrays, bins[rows])]
            rows, own = rows[own >= 0], own[own >= 0]
            p = 1.0 / (1.0 + np.exp(-m[rows]))
            g, h = w[rows] * (p - y[rows]), w[rows] * p * (1 - p)
            for j, k in enumerate(features):
                code = own * size + bins[rows, k]
                for i, x in enumerate((g, h, None)):
                    sums[i, j] += np.bincount(code, x, len(numbers) * size).reshape(-1, size)
        out = [(node, k, np.ascontiguousarray(sums[:, j, i]).tobytes()) for i, node in enumerate(numbers) if sums[2, 0, i].any() for j, k in enumerate(features)]
        out += [(LOSS, 0, lost.tobytes())] if loss else []
        yield pd.DataFrame(out, columns=["node", "feature", "sums"])

    return run


BEST = "node int, feature int, gain double, bin int, n bigint, g double, h double, n_left bigint, g_left double, h_left double"


def best_bin(sums: np.ndarray, least: int) -> tuple[float, int]:
    """(gain, bin) of the best split of one node and feature; gain is minus infinity without one."""
    g, h, n = np.cumsum(sums, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / h + (g[-1] - g) ** 2 / (h[-1] - h) - g[-1] ** 2 / h[-1]
    good = (n >= least) & (n[-1] - n >= least) & (h >= LEAST_HESSIAN) & (h[-1] - h >= LEAST_HESSIAN) & np.isfinite(gain)
    if not good.any():
        return -math.inf, 0
    b = int(np.argmax(np.where(good, gain, -np.inf)))
    return float(gain[b]), b


def _best(least: int):
    """The tasks' sums of one (node, feature) together, and its best split."""

    def run(key, frame):
        import pandas as pd

        sums = np.sum([np.frombuffer(x) for x in frame["sums"]], axis=0)
        if key[0] == LOSS:
            row = (LOSS, 0, float(sums[0]), 0, 0, float(sums[1]), 0.0, 0, 0.0, 0.0)
        else:
            sums = sums.reshape(3, -1)
            gain, b = best_bin(sums, least)
            (g, h, n), (g_left, h_left, n_left) = (map(float, x) for x in (sums.sum(axis=1), sums[:, : b + 1].sum(axis=1)))
            row = (int(key[0]), int(key[1]), gain, b, int(n), g, h, int(n_left), g_left, h_left)
        return pd.DataFrame([row], columns=[c.split()[0] for c in BEST.split(", ")])

    return run


PACKED = "node int, bins binary, g binary, h binary"


def _packed(n: int, base: float, weight: float, newer, arrays, numbers: list[int], bag: tuple[int, float], loss: bool):
    """The bins, gradients and hessians of a task's rows in the nodes ``numbers``, and of the validation loss its parts."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            bins = np.frombuffer(b"".join(f["bins"]), np.uint8).reshape(-1, n)
            y, m = f["y"].to_numpy(np.float64), base + _margin(f, bins, newer)
            w, train = np.where(y == 1, weight, 1.0), f["part"].to_numpy() == 0
            out = []
            if loss and not train.all():
                v = ~train
                out.append((LOSS, b"", (w[v] * np.logaddexp(0.0, np.where(y[v] == 1, -m[v], m[v]))).sum().tobytes(), w[v].sum().tobytes()))
            rows = np.flatnonzero(train & _in_bag(f["u"].to_numpy(np.int64), *bag))
            at = _reached(arrays, bins[rows])
            for k in numbers:
                own = rows[at == k]
                if own.size:
                    p = 1.0 / (1.0 + np.exp(-m[own]))
                    out.append((k, bins[own].tobytes(), (w[own] * (p - y[own])).tobytes(), (w[own] * p * (1 - p)).tobytes()))
            yield pd.DataFrame(out, columns=["node", "bins", "g", "h"])

    return run


GROWN = "root int, node int, left int, right int, feature int, gain double, bin int, n bigint, g double, h double, n_left bigint, g_left double, h_left double"


def _grown(n: int, features: list[int], size: int, least: int, leaves: int, depth: int | None, depths: dict[int, int]):
    """All of one node's subtree that a tree of ``leaves`` leaves can take: a row for each node, numbered in the order of their making."""

    def run(key, frame):
        import pandas as pd

        root, names = int(key[0]), [c.split()[0] for c in GROWN.split(", ")]
        g, h = (np.frombuffer(b"".join(frame[c])) for c in ("g", "h"))
        if root == LOSS:
            return pd.DataFrame([(LOSS, 0, -1, -1, 0, float(g.sum()), 0, 0, float(h.sum()), 0.0, 0, 0.0, 0.0)], columns=names)
        bins = np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(-1, n)
        # added up batch by batch, as in a step, while these are few
        sizes = [len(x) // 8 for x in frame["g"]]
        batches = len(sizes) if len(sizes) <= BATCHES else 1
        batch = np.repeat(np.arange(batches), sizes) if batches == len(sizes) else np.zeros(len(g), np.int64)

        def best(rows: np.ndarray) -> dict:
            top = None
            for k in features:
                code = batch[rows] * size + bins[rows, k]
                sums = np.stack([np.bincount(code, x, batches * size).reshape(batches, size).sum(axis=0) for x in (g[rows], h[rows], None)])
                gain, b = best_bin(sums, least)
                if top is None or gain > top["gain"]:
                    (g_all, h_all, _), (g_left, h_left, n_left) = (map(float, x) for x in (sums.sum(axis=1), sums[:, : b + 1].sum(axis=1)))
                    top = {"feature": k, "gain": gain, "bin": b, "n": len(rows), "g": g_all, "h": h_all, "n_left": int(n_left), "g_left": g_left, "h_left": h_left}
            return top

        tree, members = Growing(), {0: np.arange(len(g))}
        tree.depth[0], tree.best[0] = depths[root], best(members[0])
        while True:
            _, open_ = chosen(tree, leaves, depth)
            if not open_:
                break
            for k in open_:
                b, rows = tree.best[k], members.pop(k)
                tree.split(k)
                left = bins[rows, b["feature"]] <= b["bin"]
                for c, own in ((tree.left[k], rows[left]), (tree.right[k], rows[~left])):
                    if len(own) >= 2 * least and (depth is None or tree.depth[c] < depth):
                        members[c], tree.best[c] = own, best(own)
        empty = dict.fromkeys(("feature", "bin", "n_left", "g_left", "h_left"), 0)
        return pd.DataFrame([{"root": root, "node": k, "left": tree.left[k], "right": tree.right[k], **empty, **b} for k, b in enumerate(tree.best)], columns=names)

    return run


def chosen(tree: Growing, leaves: int, depth: int | None) -> tuple[list[int], list[int]]:
    """(nodes that the best-first order splits, those among them whose children aren't known), by what is known."""
    can = lambda k: tree.best[k] is not None and tree.best[k]["gain"] > 1e-12 and (depth is None or tree.depth[k] < depth)
    heap, taken = [(-tree.best[0]["gain"], 0)] if can(0) else [], []
    while heap and len(taken) + 1 < leaves:
        _, k = heapq.heappop(heap)
        taken.append(k)
        if tree.left[k] >= 0:
            for c in (tree.left[k], tree.right[k]):
                if can(c):
                    heapq.heappush(heap, (-tree.best[c]["gain"], c))
    return taken, [k for k in taken if tree.left[k] < 0]


def _finished(tree: Growing, taken: list[int], rate: float, edges: list[np.ndarray]) -> tuple[Tree, tuple]:
    """The tree over values, and over bins with a value for each node."""
    inner = {k: i for i, k in enumerate(sorted(taken))}
    leaves = sorted({c for k in taken for c in (tree.left[k], tree.right[k])} - set(taken)) or [0]
    numbers = inner | {k: -1 - i for i, k in enumerate(leaves)}
    value = np.array([-rate * b["g"] / b["h"] if b and b["h"] > 0 else 0.0 for b in (tree.best[k] for k in leaves)])
    ends = [LOWEST if not b else float(edges[f][b - 1]) for f, b in ((tree.feature[k], tree.bin[k]) for k in inner)]
    array = lambda x, kind=np.int64: np.array(x, kind)
    out = Tree(
        array([tree.feature[k] for k in inner]), array(ends, np.float64), array([DEFAULT_LEFT | NAN_MISSING << 2] * len(inner)), array([numbers[tree.left[k]] for k in inner]), array([numbers[tree.right[k]] for k in inner]),
        value, array([tree.best[k]["gain"] for k in inner], np.float64), array([b["n"] if b else 0 for b in (tree.best[k] for k in leaves)]),
    )
    feature, at_bin, left, right = tree.arrays()
    feature[[k for k in range(len(feature)) if k not in inner]] = -1
    by_node = np.zeros(len(feature))
    by_node[leaves] = value
    return out, ((feature, at_bin, left, right), by_node)


def boost(
    train: DataFrame, validation: DataFrame, names: list[str], *, rounds: int = ROUNDS, patience: int = 50, seed: int = 42, stepSize: float = 0.05, maxLeaves: int = 64, maxDepth: int | None = None,
    minInstancesPerNode: int = 50, featureShare: float = 0.8, subsamplingRate: float = 0.8, subsamplingEvery: int = 5,
) -> tuple[Ensemble, int, float, list[float]]:
    """(model, rounds kept, class weight, validation loss after each round): up to the lowest loss that ``patience`` further rounds don't improve on.

    Rows need the columns ``names`` and label (0 or 1). Without validation rows all rounds are taken.
    """
    pos, neg = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    weight = neg / max(pos, 1)
    base = math.log(pos * weight / neg) if pos and neg else 0.0
    edges = bin_edges(train, names)
    size, n = max(len(e) for e in edges) + 2, len(names)
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in names]).alias("x")
    part = lambda d, k: d.where(F.col("label").isin(0, 1)).select(F.lit(k).alias("part"), F.col("label").cast("int").alias("y"), F.xxhash64("label", *[f"`{c}`" for c in names]).alias("u"), x)
    rows = part(train, 0).unionByName(part(validation, 1))
    rows = files.settled(rows.mapInPandas(_binned(edges), ROWS))
    tasks = max(1, math.ceil(rows.count() / PASS_ROWS))
    rows = rows.coalesce(tasks)  # small tables: few tasks a pass; large ones keep theirs

    trees, newer, losses, idle = [], [], [], 0
    rng = np.random.default_rng(seed)
    while True:
        features = sorted(rng.choice(n, max(1, round(n * featureShare)), replace=False).tolist())
        tree = Growing()

        def step(numbers: list[int], loss: bool, tree=tree, features=features):
            bag = (seed * 1_000_003 + len(trees) // subsamplingEvery, subsamplingRate)
            sums = rows.mapInPandas(_counted(n, base, weight, list(newer), tree.arrays(), numbers, features, size, bag, loss), SUMS)
            best = sums.groupBy("node", "feature").applyInPandas(_best(minInstancesPerNode), BEST)
            order = F.struct("gain", -F.col("feature"), -F.col("bin"))
            top = best.groupBy("node").agg(F.max_by(F.struct("gain", "feature", "bin", "n", "g", "h", "n_left", "g_left", "h_left"), order).alias("b"))
            return {r["node"]: r["b"].asDict() for r in top.collect()}  # one row a node

        def finish(numbers: list[int], loss: bool, tree=tree, features=features) -> dict:
            """The nodes' whole subtrees into ``tree``; returns the loss by its number."""
            bag = (seed * 1_000_003 + len(trees) // subsamplingEvery, subsamplingRate)
            packed = rows.mapInPandas(_packed(n, base, weight, list(newer), tree.arrays(), numbers, bag, loss), PACKED)
            depths = {k: tree.depth[k] for k in numbers}
            grown = packed.groupBy("node").applyInPandas(_grown(n, features, size, minInstancesPerNode, maxLeaves, maxDepth, depths), GROWN).toPandas()
            of = dict(tuple(grown.groupby("root")))
            for k in (x for x in numbers if x in of):
                found = {x["node"]: x for x in of[k].to_dict("records")}
                here, tree.best[k] = {0: k}, found[0]
                # in the order in which they were split
                for x in sorted((x for x in found.values() if x["left"] >= 0), key=lambda x: x["left"]):
                    tree.split(here[x["node"]])
                    for c, made in ((x["left"], len(tree.feature) - 2), (x["right"], len(tree.feature) - 1)):
                        here[c], tree.best[made] = made, found[c]
            return {LOSS: of[LOSS].iloc[0].to_dict()} if LOSS in of else {}

        # node 0 of few rows is finished at once
        found = finish([0], True) if pos + neg <= TASK_ROWS else step([0], True)
        found |= {0: tree.best[0]} if tree.best[0] else {}
        if LOSS in found and trees:
            lost = found[LOSS]
            losses.append(lost["gain"] / lost["g"] if lost["g"] else -len(trees))
        best_at = int(np.argmin(losses)) if losses else 0
        if not found.get(0) or len(trees) == rounds or (losses and len(losses) - 1 - best_at >= patience):
            break
        tree.best[0] = found[0]
        waiting: list[int] = []
        while True:
            taken, open_ = chosen(tree, maxLeaves, maxDepth)
            if not open_ and not waiting:
                break
            if not open_:
                finish(waiting, False)
                waiting = []
                continue
            for k in open_:
                tree.split(k)
            # what is too small to be split needs no pass
            made = [c for k in open_ for c in (tree.left[k], tree.right[k]) if tree.best[c]["n"] >= 2 * minInstancesPerNode and (maxDepth is None or tree.depth[c] < maxDepth)]
            waiting += [c for c in made if tree.best[c]["n"] <= TASK_ROWS]
            if large := [c for c in made if tree.best[c]["n"] > TASK_ROWS]:
                for k, b in step(large, False).items():
                    tree.best[k] = b
        idle = 0 if taken else idle + 1
        if idle == IDLE:
            break
        done, binned = _finished(tree, taken, stepSize, edges)
        trees.append(done)
        newer.append(binned)
        if len(newer) == SETTLED:
            rows = files.settled(rows.mapInPandas(_with_margins(n, list(newer)), ROWS)).coalesce(tasks)
            newer.clear()
    kept = int(np.argmin(losses)) + 1 if losses else len(trees)
    trees = trees[:kept] or [_finished(Growing(), [], 0.0, edges)[0]]
    if base:
        trees[0].value = trees[0].value + base
    return Ensemble(trees, list(names)), kept, float(weight), losses
