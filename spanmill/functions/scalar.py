"""Small numeric columns with the conventions used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean0(x: Column) -> Column:
    """Mean, 0 without values."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def var0(x: Column) -> Column:
    """Population variance, 0 with fewer than two values."""
    return F.when(F.count(x) < 2, 0.0).otherwise(F.var_pop(x))


def ratio0(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def in_small_methods(c: Column) -> Column:
    """The same column, as an expression without generated code.

    An operator of many columns that Spark compiles as a whole is one method, beyond 8,000 bytes of which the JVM interprets it, at some 20 times the
    time a row. With one such expression in it Spark makes the operator's projections instead, in many small methods.
    """
    return F.transform(F.array(c), lambda x: x)[0]


def logistic(x: Column, slope: float = 1.0, intercept: float = 0.0) -> Column:
    return 1.0 / (1.0 + F.exp(-(x * slope + intercept)))


def phred(p: Column) -> Column:
    """-10 log10(1 - p), with p capped just below 1, so 90 at most."""
    return -10.0 * F.log10(1.0 - F.least(p, F.lit(1 - 1e-9)))


def exact_scaled(x: str, digits: int) -> str:
    """SQL: x times 10 ** digits as a whole number, rounded from the double's exact value, ties to even; 0 <= x < 2 ** 20.

    The value is split into whole parts of 2 ** -32 and of 2 ** -62 and a rest, each exact, and multiplied as a decimal.
    """
    one, half, ten = 1 << 62, 1 << 61, 10**digits
    d = f"(cast(v.a as decimal(20, 0)) * {1 << 30} + cast(v.b as decimal(20, 0))) * {ten}"
    over = f"(cast(w.d - cast(w.d div {one} as decimal(20, 0)) * {one} - {half} as double) + {ten} * w.c)"
    return f"""transform(transform(transform(array(cast({x} as double)), x -> named_struct('a', floor(x * {1 << 32}D), 'r', (x * {1 << 32}D - floor(x * {1 << 32}D)) * {1 << 30}D)),
        v -> named_struct('a', v.a, 'b', floor(v.r), 'c', v.r - floor(v.r))), v -> transform(array(named_struct('d', {d}, 'c', v.c)),
        w -> (w.d div {one}) + case when {over} > 0 then 1 when {over} < 0 then 0 else (w.d div {one}) % 2 end)[0])[0]"""


def exact_text(x: str, digits: int) -> str:
    """SQL: x with ``digits`` places as text, rounded from its exact value."""
    ten = 10**digits
    return f"transform(array({exact_scaled(x, digits)}), q -> if(q is null, null, concat(q div {ten}, '.', lpad(cast(q % {ten} as string), {digits}, '0'))))[0]"


def exact_round(x: str, digits: int) -> Column:
    """The double nearest to x rounded to ``digits`` places from its exact value."""
    return F.expr(f"{exact_scaled(x, digits)} / {10**digits}D")
