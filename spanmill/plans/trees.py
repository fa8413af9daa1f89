"""An ensemble of binary trees as node arrays: its text form, its scores as a column, its gains.

The text form is the one that leaf-wise boosting libraries share (a header, then ``Tree=`` sections of space-separated arrays), so models trained
elsewhere can be scored here and the other way round. Read: numerical splits with all three ways of treating missing values.
Categorical splits and linear leaves raise an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of a node's decision type, and what counts as zero, in the text form.
CATEGORICAL, DEFAULT_LEFT = 1, 2
NO_MISSING, ZERO_MISSING, NAN_MISSING = 0, 1, 2
ZERO = 1e-35


@dataclass
class Tree:
    """Inner nodes 0.. with children: another inner node, or ``-1 - leaf``; without inner nodes leaf 0 alone."""

    feature: np.ndarray
    threshold: np.ndarray
    decision: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    count: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x`` (rows, features)."""
        at = np.zeros(len(x), np.int64) if len(self.feature) else np.full(len(x), -1)
        while (rows := np.flatnonzero(at >= 0)).size:
            node = at[rows]
            v, kind = x[rows, self.feature[node]], self.decision[node] >> 2
            nan = np.isnan(v)
            v = np.where(nan & (kind != NAN_MISSING), 0.0, v)
            missing = ((kind == ZERO_MISSING) & (np.abs(v) <= ZERO)) | ((kind == NAN_MISSING) & nan)
            left = np.where(missing, (self.decision[node] & DEFAULT_LEFT) > 0, v <= self.threshold[node])
            at[rows] = np.where(left, self.left[node], self.right[node])
        return -1 - at


@dataclass
class Ensemble:
    trees: list[Tree]
    features: list[str]
    slope: float = 1.0  # probability: logistic of slope x margin
    average: bool = False

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += t.value[t.leaves(x)]
        return out / len(self.trees) if self.average and self.trees else out

    def margin(self, names: list[str] | None = None) -> Column:
        """The sum of leaf values; ``names``: the columns of the features, in order."""
        names = names or self.features
        margins = self.margins

        @F.pandas_udf("double")
        def walk(x: pd.Series) -> pd.Series:
            return pd.Series(margins(np.stack(list(x)).astype(np.float64)) if len(x) else np.empty(0))

        return walk(F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in names]))

    def probability(self, names: list[str] | None = None) -> Column:
        return 1.0 / (1.0 + F.exp(-self.slope * self.margin(names)))

    def importance(self) -> list[tuple[str, float, int]]:
        """(feature, total gain of its splits, number of splits), largest gain first."""
        gain, splits = np.zeros(len(self.features)), np.zeros(len(self.features), np.int64)
        for t in self.trees:
            np.add.at(gain, t.feature, t.gain)
            np.add.at(splits, t.feature, 1)
        return sorted(zip(self.features, gain.tolist(), splits.tolist(), strict=True), key=lambda r: (-r[1], r[0]))


def parse(text: str) -> Ensemble:
    head, *sections = re.split(r"^Tree=\d+\s*$", text.split("end of trees")[0], flags=re.M)
    pairs = lambda s: dict(line.split("=", 1) for line in s.splitlines() if "=" in line)
    top = pairs(head)
    if "feature_names" not in top or int(top.get("num_class", 1)) != 1 or int(top.get("num_tree_per_iteration", 1)) != 1:
        raise ValueError("not the text of an ensemble with one output")
    trees = []
    for s in sections:
        own = pairs(s)
        numbers = lambda k, kind, own=own: np.array(own.get(k, "").split(), kind)
        if int(own.get("num_cat", 0)) or int(own.get("is_linear", 0)):
            raise ValueError("categorical splits and linear leaves aren't supported")
        t = Tree(*[numbers(k, kind) for k, kind in (("split_feature", np.int64), ("threshold", np.float64), ("decision_type", np.int64), ("left_child", np.int64), ("right_child", np.int64), ("leaf_value", np.float64), ("split_gain", np.float64), ("leaf_count", np.int64))])
        n = int(own["num_leaves"])
        if {len(t.threshold), len(t.decision), len(t.left), len(t.right), len(t.feature)} != {n - 1} or len(t.value) != n or (t.decision & CATEGORICAL).any():
            raise ValueError(f"tree {len(trees)}: arrays don't fit {n} leaves")
        t.gain = t.gain if len(t.gain) == n - 1 else np.zeros(n - 1)
        trees.append(t)
    slope = re.search(r"sigmoid:([-+.\deE]+)", top.get("objective", ""))
    return Ensemble(trees, top["feature_names"].split(), float(slope[1]) if slope else 1.0, "average_output" in head.split())


def written(e: Ensemble) -> str:
    """The text form; numbers come back exactly."""
    line = lambda k, values: f"{k}=" + " ".join(repr(v) for v in values.tolist())
    blocks = []
    for i, t in enumerate(e.trees):
        inner = [line(k, v) for k, v in (("split_feature", t.feature), ("split_gain", t.gain), ("threshold", t.threshold), ("decision_type", t.decision), ("left_child", t.left), ("right_child", t.right))]
        counts = [line("leaf_count", t.count)] if len(t.count) else []
        blocks.append("\n".join([f"Tree={i}", f"num_leaves={len(t.value)}", "num_cat=0", *inner, line("leaf_value", t.value), *counts, "is_linear=0", "shrinkage=1"]) + "\n\n")
    names = [re.sub(r"\s", "_", n) for n in e.features]
    top = ["tree", "version=v4", "num_class=1", "num_tree_per_iteration=1", "label_index=0", f"max_feature_idx={len(names) - 1}", f"objective=binary sigmoid:{e.slope:g}", *(["average_output"] if e.average else [])]
    top += [f"feature_names={' '.join(names)}", f"feature_infos={' '.join('none' for _ in names)}", f"tree_sizes={' '.join(str(len(b)) for b in blocks)}"]
    gains = "\n".join(f"{n}={k}" for n, _, k in e.importance() if k)
    return "\n".join(top) + "\n\n" + "".join(blocks) + "end of trees\n\nfeature_importances:\n" + gains + "\n\nparameters:\nend of parameters\n"
