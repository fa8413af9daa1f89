"""Columns over base strings. Positions are 0-based inside the string."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LONGEST_UNIT = 6
COUNTED = 1 << 12  # code points up to which characters are counted in a table


def entropy(s: str) -> Column:
    """Base-2 entropy of a string's characters; 0 for an empty one.

    Each distinct character is counted by removing it, so what is left to read gets shorter at each step.
    """
    step = "transform(array(replace(a.rest, c, '')), r -> named_struct('rest', r, 'n', length(r), 'sum', a.sum + (a.n - length(r)) * log2(a.n - length(r))))[0]"
    sums = f"aggregate(array_distinct(split({s}, '')), named_struct('rest', {s}, 'n', length({s}), 'sum', 0D), (a, c) -> if(c = '', a, {step}), a -> a.sum)"
    return F.expr(f"coalesce(if(length({s}) > 0, log2(length({s})) - {sums} / length({s}), 0D), 0D) + 0D")


def text_entropy(s: str) -> Column:
    """``entropy`` for whole texts: characters are counted once, so the work doesn't grow with the number of different ones.

    What runs inside the tasks stands here as a whole, so they needn't have this package.
    """
    counted = COUNTED

    def bits(text: str | None) -> float:
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return 0.0
        n = np.bincount(points) if points.max() < counted else np.unique(points, return_counts=True)[1]
        n = n[n > 0].astype(np.float64)
        return float(np.log2(len(points)) - (n * np.log2(n)).sum() / len(points)) + 0.0

    @F.pandas_udf(DoubleType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series([bits(t) for t in x], dtype="float64")

    return run(s)


def gc_fraction(s: str) -> Column:
    return F.expr(f"coalesce(regexp_count({s}, '[GC]') / nullif(length({s}), 0), 0D)")


def _run(s: str, p: str, u: str) -> str:
    unit = f"substring({s}, {p} + 1, {u})"
    after = f"length(regexp_extract(substring({s}, {p} + 1), concat('^(?:', {unit}, ')*'), 0))"
    before = f"length(regexp_extract(reverse(substring({s}, 1, {p})), concat('^(?:', reverse({unit}), ')*'), 0))"
    return f"if({p} >= 0 and {p} + {u} <= length({s}), {after} + {before}, 0)"


def homopolymer(s: str, p: str) -> Column:
    """Length of the run of the base at ``p``; 1 outside the string."""
    return F.expr(f"cast(greatest(1, coalesce({_run(s, p, '1')}, 1)) as bigint)")


def tandem(s: str, p: str) -> Column:
    """struct(unit, total) of the longest repeat through ``p`` of units of up to 6; a single copy counts, ties go to the shorter unit."""
    best = f"array_max(transform(sequence(1, {LONGEST_UNIT}), u -> named_struct('total', {_run(s, p, 'u')}, 'less', -u)))"
    told = "if(coalesce(b.total, 0) > 1, named_struct('unit', cast(-b.less as bigint), 'total', cast(b.total as bigint)), named_struct('unit', 1L, 'total', 1L))"
    return F.expr(f"transform(array({best}), b -> {told})[0]")  # all units are tried once
