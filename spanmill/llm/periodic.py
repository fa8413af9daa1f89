"""Periodic runs of words by a suffix tree: branching tandem repeats, rotated and merged into maximal runs.

The tree is held as suffix array, ranks and the intervals of common prefixes. A node stands for a string of D words and
its leaves are one range of ranks, so whether a position is a leaf below it takes one comparison. At each node
all leaves but those of its largest child are taken (the smaller half: every leaf O(log n) times), and position i
and i + D, or i - D and i, in different children are a tandem repeat that the next word breaks. Turned to the left word by
word until it breaks there too, it is a maximal run; a multiple of a run's period that ends and starts with it is the same run.

A run of at least four periods holds each of its pairs of neighbouring words three times or more. So texts are cut first
between words whose pair occurs less often in its piece, again while that cuts anything; no run crosses a cut. Trees
are built over the pieces that are left, all pieces of a batch together; each piece has its own word numbers and its own end mark.

Defined results: a null or empty text has no runs and collapses to an empty text; white space is ASCII's, and collapsed texts
have one space between words; very long texts are read whole, in a batch of their own; rows are independent, so repeated
rows give equal results, whatever their ids, and an empty table gives an empty result; columns of the input named like a result are replaced, all
others pass.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST, COPIES = 6, 4  # a run's least number of words and of periods
WORDS_AT_ONCE, TEXTS_AT_ONCE = 200_000, 2_000
ROUNDS = 8  # of cutting
MANY = 48  # leaves from which arrays are quicker
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _bounds(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal numbers."""
    cut = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(piece)]))


def _pieces(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, piece number of each): what may lie in a run, in order; ``text`` numbers each word's text, ascending."""
    at, piece = np.arange(len(words)), text
    for _ in range(ROUNDS):
        if len(at) < LEAST:
            return at[:0], piece[:0]
        w = words[at]
        size = int(w.max()) + 1
        inside = piece[1:] == piece[:-1]
        first, second, of = w[:-1][inside], w[1:][inside], piece[:-1][inside]
        if size <= 1 << 20 and int(piece[-1]) + 1 <= 1 << 22:  # at most 62 bits
            keys = (of * size + first) * size + second
        else:
            keys = np.unique(of * size + first, return_inverse=True)[1] * size + second
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        # a new piece starts where another one did, and behind a rare pair
        new = np.ones(len(at), bool)
        new[1:][inside] = count[back] < COPIES - 1
        number = np.cumsum(new) - 1
        long = np.bincount(number)[number] >= LEAST
        same = long.all() and number[-1] == len(np.unique(piece)) - 1
        at, piece = at[long], number[long]
        if len(piece):
            piece = np.cumsum(np.concatenate(([0], piece[1:] != piece[:-1])))
        if same:
            break
    return at, piece


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each); doubling, each round over what isn't told apart yet."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    n, k = len(s), 1
    # a rank is the place of the first suffix of its group
    starts = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))
    size = np.diff(np.concatenate((starts, [n])))
    rank[order] = np.repeat(starts, size)
    open_at = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_at):
        who = order[open_at]
        ahead = who + k
        key = rank[who] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_at], key = who[by], key[by]
        # groups keep their places, so sorted keys go back to ascending places
        new = np.concatenate(([True], key[1:] != key[:-1]))
        heads = open_at[new]
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(key)])))
        rank[order[open_at]] = np.repeat(heads, size)
        open_at = open_at[np.repeat(size > 1, size)]
        k *= 2
    return order, rank


def common_prefixes(s: array, order: array, rank: array) -> array:
    """For each place the number of words shared with the suffix before it."""
    n, h = len(s), 0
    out = array("i", bytes(4 * n))
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            # the last symbol of all occurs once, so neither side runs over the end
            while s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def branching_repeats(s: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """(start, D) of all tandem repeats of strings of up to ``longest`` words whose next word breaks the period; ``s`` ends with a symbol of its own."""
    order_of, rank_of = suffix_array(s)
    order, rank, w = (array("i", x.astype(np.int32).tobytes()) for x in (order_of, rank_of, s))
    shared = common_prefixes(w, order, rank)
    n, found = len(s), set()

    def leaves(depth: int, lo: int, hi: int, a: int, b: int) -> None:
        """The leaves a..b of a node lo..hi against all its leaves."""
        if b - a >= MANY:
            i = order_of[a:b].astype(np.int64)
            for start, other in ((i, i + depth), (i - depth, i - depth)):
                ok = (other >= 0) & (other < n)
                start, other = start[ok], other[ok]
                r = rank_of[other]
                start = start[(r >= lo) & (r < hi)]
                end = start + 2 * depth
                start = start[end < n]
                start = start[s[start + depth] != s[start + 2 * depth]]
                found.update((x, depth) for x in start.tolist())
            return
        for k in range(a, b):
            i = order[k]
            j = i + depth
            if j + depth < n and lo <= rank[j] < hi and w[j] != w[j + depth]:
                found.add((i, depth))
            j = i - depth
            if j >= 0 and lo <= rank[j] < hi and w[i] != w[i + depth]:
                found.add((j, depth))

    def node(depth: int, parts: list[int]) -> None:
        if depth > longest:
            return
        lo, hi = parts[0], parts[-1]
        big = max(range(len(parts) - 1), key=lambda k: parts[k + 1] - parts[k])
        if big:
            leaves(depth, lo, hi, lo, parts[big])
        if parts[big + 1] < hi:
            leaves(depth, lo, hi, parts[big + 1], hi)

    depths: list[int] = []
    parts_of: list[list[int]] = []
    for i in range(1, n + 1):
        h, left = shared[i] if i < n else 0, i - 1
        while depths and depths[-1] > h:
            depth, parts = depths.pop(), parts_of.pop()
            parts.append(i)
            node(depth, parts)
            left = parts[0]
        if h:
            if depths and depths[-1] == h:
                parts_of[-1].append(i)
            else:
                depths.append(h)
                parts_of.append([left, i])
    return sorted(found, key=lambda x: (x[1], x[0]))


def maximal_runs(s: np.ndarray, repeats: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs of two periods or more that ``repeats`` (smaller D first) end."""
    ends: dict[int, list[tuple[int, int]]] = {}
    for i, d in repeats:
        known = ends.setdefault(i + 2 * d, [])
        if any(d % p == 0 and start <= i for start, p in known):
            continue  # several periods of a run with a smaller one
        start, step = i, 8
        while start:
            step = min(step, start)
            apart = np.flatnonzero(s[start - step : start] != s[start - step + d : start + d])
            if len(apart):
                start += int(apart[-1]) + 1 - step
                break
            start, step = start - step, 2 * step
        known.append((start, d))
    return [(start, end - start, p) for end, runs in ends.items() for start, p in runs]


def runs_of(words: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of LEAST words and COPIES periods; starts count over all texts, ``text`` numbers each word's, ascending."""
    at, piece = _pieces(words, text)
    if not len(at):
        return []
    starts, ends = _bounds(piece)
    # each piece with its own word numbers, and an end mark that occurs once
    size = int(words.max()) + 1
    own = np.unique(piece * size + words[at], return_inverse=True)[1]
    ended = np.concatenate([x for a, b in zip(starts, ends, strict=True) for x in (own[a:b], [0])])
    places = np.concatenate([x for a, b in zip(starts, ends, strict=True) for x in (at[a:b], [-1])])
    marks = np.flatnonzero(places < 0)
    ended[marks] = len(at) + np.arange(len(marks))
    longest = int((ends - starts).max()) // COPIES
    found = maximal_runs(ended, branching_repeats(ended, longest))
    return sorted((int(places[a]), n, p) for a, n, p in found if n >= max(LEAST, COPIES * p))


def _batches(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first text, words of each) in groups of bounded size; a longer text stands alone."""
    first, group, held = 0, [], 0
    for i, t in enumerate(texts):
        words = t.split()
        if group and (held + len(words) > WORDS_AT_ONCE or len(group) >= TEXTS_AT_ONCE):
            yield first, group
            first, group, held = i, [], 0
        group.append(words)
        held += len(words)
    if group:
        yield first, group


def collapse(group: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text's words its runs, ascending, and the words without those behind a run's first period."""
    numbers: dict[bytes, int] = {}
    number = lambda w: numbers.setdefault(w, len(numbers))
    sizes = np.array([len(x) for x in group], np.int64)
    words = np.fromiter((number(w) for x in group for w in x), np.int64, int(sizes.sum()))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in group]
    for start, n, p in runs_of(words, np.repeat(np.arange(len(group)), sizes)):
        t = int(np.searchsorted(begins, start, "right")) - 1
        runs[t].append((start - int(begins[t]), n, p))
    out = []
    for own, x in zip(runs, group, strict=True):
        if own:
            gone = np.zeros(len(x) + 1, np.int64)
            for start, n, p in own:
                gone[start + p] += 1
                gone[start + n] -= 1
            x = [w for w, g in zip(x, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
            own = sorted(own, key=lambda r: (r[0], r[2]))
        out.append((own, b" ".join(x)))
    return out


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with runs (start, length, period; by start, then period) and collapsed, the text without repeated periods."""
    kept = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    rows = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias(text), *[F.col(f"`{c}`") for c in kept])
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            for first, group in _batches(texts):
                done = collapse(group)
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own, _ in done], kinds)
                collapsed = pa.array([c for _, c in done], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*b.slice(first, len(group)).columns[1:], runs, collapsed], [*kept, "runs", "collapsed"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text), f"runs {RUNS}", "collapsed string"])
    return rows.mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``; for one in ten of the ids the text's end repeats its own words, as the query's contract has it."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumns({"n": F.expr("nullif(size(w), 0)"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.expr("cast(g % n as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    return rows.select("doc_id", F.expr("if(w is null or n is null, text, array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' '))").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents"))
    best = F.expr("array_min(transform(runs, r -> named_struct('shorter', -r.length, 'start', r.start, 'period', r.period)))")
    out = periodic_runs(docs).withColumn("best", best)
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.shorter div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
