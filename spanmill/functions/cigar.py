"""Columns over CIGAR strings. A block is one operation with its start on the reference (r) and on the read (q)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<op:string,n:int,r:bigint,q:int>>"


FEW = 5  # blocks whose places are added up without a loop


def blocks(cigar: str = "cigar", start: str = "start") -> Column:
    """All blocks of a CIGAR string on a read that starts at ``start`` (0-based)."""
    parsed = f"""transform(regexp_extract_all({cigar}, '(\\\\d+)([MIDNSHP=X])', 0), s -> transform(array(named_struct('op', right(s, 1), 'n', cast(left(s, length(s) - 1) as int))),
        s -> named_struct('op', s.op, 'n', s.n, 'r', if(instr('M=XDN', s.op) > 0, s.n, 0), 'q', if(instr('M=XIS', s.op) > 0, s.n, 0)))[0])"""
    place = lambda i, c, first: " + ".join([first, *(f"get(b, {j}).{c}" for j in range(i))])
    few = ", ".join(f"named_struct('op', get(b, {i}).op, 'n', get(b, {i}).n, 'r', {place(i, 'r', f'cast({start} as bigint)')}, 'q', {place(i, 'q', '0')})" for i in range(FEW))
    return F.expr(f"""transform(array({parsed}), b -> if(array_size(b) <= {FEW}, slice(array({few}), 1, array_size(b)),
        aggregate(b, named_struct('r', cast({start} as bigint), 'q', 0, 'out', cast(array() as {BLOCKS})),
            (a, s) -> named_struct('r', a.r + s.r, 'q', a.q + s.q, 'out', concat(a.out, array(named_struct('op', s.op, 'n', s.n, 'r', a.r, 'q', a.q)))),
            a -> a.out)))[0]""")


def blocks_clipped(b: str = "blocks") -> Column:
    """``soft_clipped`` from blocks that were made already."""
    return F.expr(f"aggregate({b}, 0L, (a, x) -> if(x.op = 'S', a + x.n, a))")


def reference_end(cigar: str = "cigar", start: str = "start") -> Column:
    """One past the last reference position."""
    return F.expr(f"{start} + aggregate(regexp_extract_all({cigar}, '(\\\\d+)[MDN=X]', 1), 0L, (a, n) -> a + cast(n as bigint))")


def soft_clipped(cigar: str = "cigar") -> Column:
    return F.expr(f"aggregate(regexp_extract_all({cigar}, '(\\\\d+)S', 1), 0L, (a, n) -> a + cast(n as bigint))")


def supports(is_insertion: str, length: str, pos0: str, b: str = "blocks", near: int = 2) -> Column:
    """Whether some insertion or deletion block stands for the indel: near its place and of about its length."""
    return F.expr(f"""exists({b}, x -> x.op in ('I', 'D') and abs(x.n - {length}) <= greatest(1, {length} div 2) and
        case when {is_insertion} then x.op = 'I' and abs(x.r - {pos0}) <= {near}
             else x.op = 'D' and x.r - {near} <= {pos0} and {pos0} <= x.r + x.n + {near} end)""")


def signature(pos0: str, b: str = "blocks", window: int = 3) -> Column:
    """The operations around a place as text; long matches count as 10 and soft clips as at most 20."""
    return F.expr(f"""array_join(transform(filter({b}, x ->
            (x.op in ('M', '=', 'X') and x.r + x.n >= {pos0} - {window} and x.r <= {pos0} + {window})
            or (x.op = 'I' and abs(x.r - {pos0}) <= {window})
            or (x.op = 'D' and x.r - {window} <= {pos0} and {pos0} <= x.r + x.n + {window}) or x.op = 'S'),
        x -> concat(x.op, case when x.op in ('M', '=', 'X') then least(x.n, 10) when x.op = 'S' then least(x.n, 20) else x.n end)), ' ')""")


def query_position(pos0: str, b: str = "blocks") -> Column:
    """The read position aligned to a reference position, or null."""
    return F.expr(f"try_element_at(transform(filter({b}, x -> x.op in ('M', '=', 'X') and x.r <= {pos0} and {pos0} < x.r + x.n), x -> cast(x.q + {pos0} - x.r as int)), 1)")


def mean(values: str) -> str:
    """SQL: the mean of an array, 0 if it is empty."""
    return f"coalesce(aggregate({values}, 0D, (a, v) -> a + v) / nullif(size({values}), 0), 0D)"
