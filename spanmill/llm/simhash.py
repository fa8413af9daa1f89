"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are made in Arrow batches, whole texts, shingles in slices of bounded size. The join runs
on distinct fingerprints. The 64 bits fall into blocks; two fingerprints that differ in at most ``budget``
bits agree on some choice of ``blocks - budget`` blocks, so for each choice the fingerprints that share
those bits form one subtree, and every link lies in some subtree. A task walks its subtrees, some at a time, as a self-join
of tries: node pairs go down together, add up differing bits, and go when the budget is exceeded or when
both sides are already known to be connected. A task returns spanning forests, never all pairs. Larger
subtrees are cut into chunks and joined chunk by chunk in separate tasks, without loss.

The forests' trees are merged by alternating large-star and small-star rounds until nothing changes; up to a fixed number of
edges one task merges them, with the same result.

``near_duplicates`` links fingerprints alone. ``near_copies`` links texts whose sets of five-word shingles have a similarity
of 0.8 or more, and no others. The trie join of their fingerprints comes first: its edges are held against the whole shingle
sets, in groups of bounded size, and what holds is connected from then on, large groups of copies mostly as a whole. But a
similarity of 0.8 may shift any number of bits; so prefix filtering gives the rest: in any fixed order of all shingles, two such
sets share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, and ``l`` of them among ``l - 1`` more, so no link is lost.
The order puts shingles that a sample of the texts holds more than once behind all others; it decides only how many candidates
there are. The first pass finds the texts that have a candidate. The second orders by a sample of these, leaves out what is
connected, and counts what pairs share; those that share enough are held against the whole sets, again in groups of bounded
size. Only texts under a shingle of more than ``ALL_PAIRS`` texts, in both passes and not connected yet, are gathered by
component, one component in a task.

Defined results: a null or empty text, or one without words, has fingerprint 0 and is linked like any
other; a text with fewer words than a shingle is one shingle; a very long text is read whole; repeated rows are separate
documents; null doc_ids take part but never name a component (null if a component has no other); an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, spread_join, table

WORDS = 4
BUDGET = 4
SEED = 42
BITS = 64
SLICE = 1 << 15
CHUNK_ROWS = 50_000
FRONTIER = 40_000
ROWS_AT_ONCE, PAIRED_AT_ONCE = 300_000, 60_000
PAIRS_HELD = 250_000  # 8 MB: pairs that a task adds up before it hands them on
EXPAND, EXPANDED = 64, 8_000  # keys of a pair of nodes that are compared each with each, and such pairs at once
SHINGLE = 5
SAMPLED, SHARE = 12_000, 0.05  # texts that shingles are counted in: as many, or that share of them if that is more
FREQUENT = 1_000_000  # counted shingles that every task gets
ALL_PAIRS = 64  # texts with a shingle in common, up to which each pair is looked at
BROADCAST = 500_000
AT_ONCE = 500
SEEN = 100_000  # texts of a task that are known to have been read
TEXTS_A_PART = 4_000
STAR_ROWS = 2_000
FEW_EDGES = 500_000  # 8 MB: up to so many, one task merges them
LINK_BYTES = 4 << 20  # of shingle sets: two parts of a large group, looked at together, hold some twice that
CLASS = 1.26  # sizes of similar sets are less than this apart
SHARED = 64  # a pair shares one shingle more among the first for so many shingles of its smaller set
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ---------------------------------------------------------------- fingerprints


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _hashes(tokens: list[bytes], words: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, big-endian, in slices."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    first = np.concatenate(([0], ends[: n - 1])).tolist()
    last = (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    for at in range(0, n, SLICE):
        yield np.array([hashed(joined[a:b], SEED) for a, b in zip(first[at : at + SLICE], last[at : at + SLICE], strict=True)], dtype=">u8")


def _print(tokens: list[bytes], words: int) -> int:
    if not tokens:
        return 0
    n, counts = 0, np.zeros(BITS, np.int64)
    for h in _hashes(tokens, words):
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    return _print(_tokens(text), words)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- trie self-join inside a task


class _Sets:
    """Disjoint sets over positions, with array operations."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]) is not None and (up != self.root).any():
                self.root = up

    def same(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        """Where two ranges lie in one set."""
        change = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))
        return (change[hi1 - 1] == change[lo1]) & (change[hi2 - 1] == change[lo2]) & (self.root[lo1] == self.root[lo2])


def trie_forest(keys: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, budget: int) -> np.ndarray:
    """Root position of each key after linking all keys in ``pairs`` of ranges that differ in <= budget bits.

    keys: uint64, ascending inside each range; pairs: arrays lo1, hi1, lo2, hi2 whose keys agree on the
    first ``depth`` bits. Ranges are trie nodes: node pairs descend one bit at a time; equal keys are halved below
    the last bit.
    """
    sets = _Sets(len(keys))
    stack = [(depth, *pairs, np.zeros(len(pairs[0]), np.int8))]
    while stack:
        at, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > FRONTIER:
            for k in range(0, len(lo1), FRONTIER):
                stack.append((at, *(x[k : k + FRONTIER] for x in (lo1, hi1, lo2, hi2, err))))
            continue
        self_pair = (lo1 == lo2) & (hi1 == hi2)
        keep = ~((self_pair & (hi1 - lo1 <= 1)) | sets.same(lo1, hi1, lo2, hi2))
        lo1, hi1, lo2, hi2, err, self_pair = (x[keep] for x in (lo1, hi1, lo2, hi2, err, self_pair))
        n1, n2 = hi1 - lo1, hi2 - lo2
        small = n1 * n2 <= EXPAND
        if small.any():
            every = np.flatnonzero(small)
            for part in (every[i : i + EXPANDED] for i in range(0, len(every), EXPANDED)):
                a1, a2, m2, count = lo1[part], lo2[part], n2[part], (n1 * n2)[part]
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                m2 = np.repeat(m2, count)
                x, y = np.repeat(a1, count) + k // m2, np.repeat(a2, count) + k % m2
                near = (np.bitwise_count(keys[x] ^ keys[y]) <= budget) & (x != y)
                x, y = x[near], y[near]
                sets.join(x, y)
        lo1, hi1, lo2, hi2, err, self_pair = (x[~small] for x in (lo1, hi1, lo2, hi2, err, self_pair))
        if not len(lo1):
            continue
        if at < BITS:
            ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - at)) & np.uint64(1), dtype=np.int64)))
            mid1, mid2, more = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2]), err + 1
        else:
            mid1, mid2, more = (lo1 + hi1) // 2, (lo2 + hi2) // 2, err
        down = [(lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, more), tuple(x[~self_pair] for x in (mid1, hi1, lo2, mid2, more))]
        a, b, c, d, e = (np.concatenate(x) for x in zip(*down, strict=True))
        keep = (b > a) & (d > c) & (e <= budget)
        if keep.any():
            stack.append((at + 1, *(x[keep] for x in (a, b, c, d, e))))
    return sets.root


def _rotated(fp: np.ndarray, chosen: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Bits of the chosen blocks (offset from the top, width) first, the others behind in order."""
    inside = {i for at, w in chosen for i in range(at, at + w)}
    order = [i for at, w in chosen for i in range(at, at + w)] + [i for i in range(BITS) if i not in inside]
    out, k = np.zeros(len(fp), np.uint64), 0
    while k < BITS:  # runs of adjacent bits move together
        run = 1
        while k + run < BITS and order[k + run] == order[k] + run:
            run += 1
        part = (fp >> np.uint64(BITS - order[k] - run)) & np.uint64((1 << run) - 1)
        out |= part << np.uint64(BITS - k - run)
        k += run
    return out


def _tables(blocks: int, budget: int) -> list[tuple[tuple[int, int], ...]]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return list(combinations(parts, blocks - budget))


def _slices(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns as arrays, some whole groups at a time; rows come ordered by the first ``keys`` columns."""
    held, rows, enough = [], 0, ROWS_AT_ONCE
    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
        if rows >= enough:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.logical_and.reduce([c == c[-1] for c in columns[:keys]])
            first = 0 if last.all() else rows - int(np.argmin(last[::-1]))
            if first:
                yield [c[:first] for c in columns]
            held, rows = [[c[first:] for c in columns]], rows - first
            enough = max(ROWS_AT_ONCE, 2 * rows)
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _forests(tables, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _slices(batches, 4):
            cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), len(columns[0])]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                t, _, a, b, c, fp, node = (x[start:stop] for x in columns)
                chosen = tables[int(t[0])]
                depth = sum(w for _, w in chosen)
                turned = _rotated(fp.view(np.uint64), chosen)
                top = turned >> np.uint64(BITS - depth)
                order = np.lexsort((turned, c, b, a, top))
                node, turned, a, b, c, top = (x[order] for x in (node, turned, a, b, c, top))
                new = np.flatnonzero(np.concatenate(([True], (top[1:] != top[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))))
                end = np.append(new[1:], len(node))
                alone = a[new] == b[new]
                first = (~alone) & (c[new] == a[new])
                k = np.flatnonzero(first)
                k = k[k + 1 < len(new)]
                k = k[(top[new[k]] == top[new[k + 1]]) & (a[new[k]] == a[new[k + 1]]) & (b[new[k]] == b[new[k + 1]])]
                pairs = tuple(np.concatenate(x) for x in ((new[alone], new[k]), (end[alone], end[k]), (new[alone], new[k + 1]), (end[alone], end[k + 1])))
                root = trie_forest(turned, pairs, depth, budget)
                moved = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["u", "v"])

    return run


def link_forest(fps: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """Edges (u, v) that connect whatever of the n rows of ``fps`` links lead to each other; at most tables x n.

    fps: distinct fp, or distinct node with fp. Edges are between nodes (fingerprints if there are none).
    """
    blocks = next(b for b in range(budget + 1, budget + 4) if b == budget + 3 or n >> (BITS // b * (b - budget)) <= 2000)
    tables = _tables(blocks, budget)
    own = ["fp", "node"]
    fps = fps if "node" in fps.columns else fps.withColumn("node", F.col("fp"))
    key = lambda chosen: F.xxhash64(*[F.expr(f"shiftrightunsigned(fp, {BITS - at - w}) & {(1 << w) - 1}L") for at, w in chosen])
    rows = fps.select(*own, F.explode(F.array(*[F.struct(F.lit(t).alias("t"), key(chosen).alias("k")) for t, chosen in enumerate(tables)])).alias("x")).select(*own, "x.t", "x.k")
    # subtrees beyond a task's share: there are at most tables x n / CHUNK_ROWS of them
    large = settled(rows.groupBy("t", "k").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK_ROWS).select("t", "k", F.ceil(F.col("m") / CHUNK_ROWS).cast("int").alias("chunks")))
    found = large.count()
    one = F.lit(0)
    if found:
        rows = rows.join(F.broadcast(large) if found <= 10_000 else large, ["t", "k"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        rows = rows.withColumn("c", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = rows.select(*own, "t", "k", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c")
    else:
        rows = rows.select(*own, "t", "k", one.alias("a"), one.alias("b"), one.alias("c"))
    dealt = rows.repartition("t", "k", "a", "b").select("t", "k", "a", "b", "c", *own).sortWithinPartitions("t", "k", "a", "b")
    return dealt.mapInArrow(_forests(tables, budget), "u long, v long")


# ---------------------------------------------------------------- components


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, root) of all edges together."""
    got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if got:
        u, v = (np.concatenate(x) for x in zip(*got, strict=True))
        names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        sets = _Sets(len(names))
        sets.join(at[: len(u)], at[len(u) :])
        moved = np.flatnonzero(sets.root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[sets.root[moved]])], ["u", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) but the roots; root: the smallest node of its component."""
    state = settled(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if state.count() <= FEW_EDGES:
        return settled(state.coalesce(1).mapInArrow(_merged, "u long, root long"))
    mark = None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark or not now[0]:
            return state.withColumnRenamed("v", "root")
        mark = now
        # large star: larger neighbours of u go to the smallest neighbour of u (or u itself)
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settled(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        state = settled(small.where("u != v").distinct())


def near_duplicates(docs: DataFrame, *, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id: smallest doc_id that links lead to."""
    marked = settled(fingerprints(docs, words))
    fps = settled(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    n, rows = fps.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    roots = components(link_forest(fps.select("fp"), n, budget))
    named = settled(fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root")))
    ids = settled(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")))
    named = spread_join(named, ids, "root", "members", n)
    return spread_join(marked, settled(named.select("fp", "copies", "component_id")), "fp", "copies", rows).select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near copies


def shingle_set(tokens: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; none where there are no words."""
    return np.unique(np.concatenate([h.astype(np.uint64) for h in _hashes(tokens, words)])) if tokens else np.zeros(0, np.uint64)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _node(tokens: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b" ".join(tokens), SEED + 1)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of one text are held at a time: those of a batch take ten times its bytes."""
    for b in batches:
        nodes, prints = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
        for i, t in enumerate(b.column(2)):
            tokens = _tokens(t.as_py())
            nodes[i], prints[i] = _node(tokens), _print(tokens, SHINGLE)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed(nodes), _signed(prints)], ["doc_id", "own", "node", "fp"])


def marked_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, own, node, fp) of every row; own: a hash of the text; node: of its words, equal for copies."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("own"), text).mapInArrow(_marks, "doc_id long, own long, node long, fp long")


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray], None]]:
    """Nodes and shingle sets of texts with words, some at a time; of a task's copies mostly one."""
    seen: set[int] = set()
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            rows = {_node(x): x for t in b.column(0).slice(at, AT_ONCE) if (x := _tokens(t.as_py()))}
            rows = {u: x for u, x in rows.items() if u not in seen}
            if len(seen) > SEEN:
                seen.clear()
            seen.update(rows)
            if rows:
                yield list(rows), [shingle_set(x) for x in rows.values()], None


def _of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray], np.ndarray]]:
    """Nodes, shingle sets and labels, some at a time."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            part = b.slice(at, AT_ONCE)
            yield part.column(0).to_numpy().view(np.uint64).tolist(), [np.frombuffer(x.as_py(), np.uint64) for x in part.column(1)], part.column(2).to_numpy()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, set) of every text with words; copies may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets, _ in _of_texts(batches):
            yield pa.RecordBatch.from_arrays([_signed(nodes), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def frequent_shingles(rows: DataFrame, n: int, read) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the n rows holds more than once, ascending, and how often it does."""
    share = min(1.0, max(SHARE, SAMPLED / max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, _ in read(batches):
            h, m = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(h), pa.array(m.astype(np.int64))], ["h", "m"])

    some = rows if share == 1 else rows.where(F.pmod(F.xxhash64(rows.columns[0], F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    counted = some.mapInArrow(run, "h long, m long").groupBy("h").agg(F.sum("m").alias("m")).where("m > 1")
    found = counted.orderBy(F.desc("m"), "h").limit(FREQUENT).toArrow()
    h, m = found.column("h").to_numpy().view(np.uint64), found.column("m").to_numpy()
    order = np.argsort(h)
    return h[order], m[order]


def _rare_first(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], more: int = 0) -> np.ndarray:
    """The first shingles of a set: any set with a similarity of 0.8 or more has 1 + ``more`` of them among its own first."""
    h, m = frequent
    count = np.zeros(len(shingles), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, shingles), len(h) - 1)
        count = np.where(h[at] == shingles, m[at], 0)
    return shingles[np.lexsort((shingles, count))[: len(shingles) + (-4 * len(shingles) // 5) + 1 + more]]


def _by_shingle(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of many rows at once, and which rows are under a shingle of many texts; rows come ordered by shingle and size.

    Such a shingle's texts are only taken as a chain by size, so it may be cut anywhere; its last row then comes again.
    """
    held, rows, going = [], 0, None

    def with_chain(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        token = columns[0]
        count = np.diff(np.append(np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))), len(token)))
        return columns, np.repeat(count > ALL_PAIRS, count) | (token == going if going is not None else False)

    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
        while rows >= at_once:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            token = columns[0][:at_once]
            last = at_once - int(np.searchsorted(token, token[-1]))
            chained = last > ALL_PAIRS or token[-1] == going
            cut = at_once if chained else at_once - last
            yield with_chain([x[:cut] for x in columns])
            going, keep = (token[-1], cut - 1) if chained else (None, cut)
            held, rows = [[x[keep:] for x in columns]], rows - keep
    if rows:
        yield with_chain([np.concatenate(x) for x in zip(*held, strict=True)])


def _candidates_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that connect all texts which may be similar by some shingle: pairs near enough in size, with enough left behind the shingle."""
    for (token, node, sizes), chain in _by_shingle(batches, ROWS_AT_ONCE):
        n, rest = sizes >> 32, sizes & 0xFFFFFFFF
        names, at = np.unique(node, return_inverse=True)
        sets = _Sets(len(names))
        for lag in range(1, min(ALL_PAIRS, len(token))):
            same = (token[lag:] == token[:-lag]) & (5 * n[:-lag] >= 4 * n[lag:])
            pair = same & ~chain[lag:] & (9 * np.minimum(rest[lag:], rest[:-lag]) >= 4 * (n[lag:] + n[:-lag]))
            if lag == 1:
                pair |= same & chain[lag:]
            if not same.any():
                break
            sets.join(at[lag:][pair], at[:-lag][pair])
        moved = np.flatnonzero(sets.root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved], pa.int64()), pa.array(names[sets.root[moved]], pa.int64())], ["u", "v"])


def _summed(u: np.ndarray, v: np.ndarray, shared: np.ndarray, need: np.ndarray) -> list[np.ndarray]:
    """The columns with ``shared`` added up over equal (u, v, need)."""
    order = np.lexsort((need, v, u))
    u, v, shared, need = u[order], v[order], shared[order], need[order]
    first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (need[1:] != need[:-1]))))
    return [u[first], v[first], np.add.reduceat(shared, first), need[first]]


def _pairs_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, shared, need): pairs with different labels, how many of these rows' shingles they share and how many they must in all.

    Of the first ``need`` shingles that two similar sets share, none leaves too little of either behind it, so only such rows count. A task adds up a
    pair's rows before it hands them on, up to PAIRS_HELD pairs at a time: else texts in large groups would come again for each slice.
    Neighbours in the chain of a shingle of many texts come with need 0; under it all pairs that are near enough in size stand.
    """
    held: list[list[np.ndarray]] = []
    last = 0

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["u", "v", "shared", "need"])

    for (token, node, sizes, label), chain in _by_shingle(batches, PAIRED_AT_ONCE):
        n, rest = sizes >> 32, sizes & 0xFFFFFFFF
        found, most = [], min(ALL_PAIRS, len(token)) - 1
        for lag in range(1, most + 1):
            same = (token[lag:] == token[:-lag]) & (5 * n[:-lag] >= 4 * n[lag:])
            if same.any():
                left = 9 * (np.minimum(rest[lag:], rest[:-lag]) + n[:-lag] // SHARED) >= 4 * (n[lag:] + n[:-lag])
                k = np.flatnonzero(same & left & ~chain[lag:] & (label[lag:] != label[:-lag]) & (node[lag:] != node[:-lag]))
                found.append((k, k + lag, 1 + n[k] // SHARED))
                if lag == 1:
                    k = np.flatnonzero(same & chain[lag:] & (node[lag:] != node[:-lag]))
                    found.append((k, k + 1, np.zeros(len(k), np.int64)))
            # where many shingles have many texts, a slice of rows makes up to ALL_PAIRS times as many pairs
            ended = lag == most or not same.any()
            if (many := sum(len(x[0]) for x in found)) and (ended or many > PAIRS_HELD):
                a, b, need = (np.concatenate(x) for x in zip(*found, strict=True))
                held.append(_summed(np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), np.ones(len(a), np.int64), need))
                found = []
                if sum(len(x[0]) for x in held) > last + PAIRS_HELD:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    last = len(held[0][0])
                    if last > PAIRS_HELD:
                        yield out(held[0])
                        held, last = [], 0
            if ended:
                break
    if held:
        yield out(_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _by_shingles(rows: DataFrame, n: int, read) -> DataFrame:
    """Rows of shingle, node, its set's size and what is left of it from the shingle on, and perhaps label, dealt by shingle."""
    frequent, labelled = frequent_shingles(rows, n, read), read is _of_sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets, labels in read(batches):
            firsts = [_rare_first(x, frequent, len(x) // SHARED if labelled else 0) for x in sets]
            taken = np.array([len(x) for x in firsts], np.int64)
            size = np.repeat(np.array([len(x) for x in sets], np.int64), taken)
            before = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
            columns = [_signed(np.concatenate(firsts)), _signed(np.repeat(np.array(nodes, np.uint64), taken)), pa.array(size << 32 | size - before)]
            names = ["token", "node", "sizes"]
            if labelled:
                columns, names = [*columns, pa.array(np.repeat(labels, taken))], [*names, "label"]
            yield pa.RecordBatch.from_arrays(columns, names)

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TEXTS_A_PART)
    made = rows.mapInArrow(run, "token long, node long, sizes long" + ", label long" * labelled)
    return made.repartition(parts, "token").sortWithinPartitions("token", "sizes", "node")


def candidates(texts: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) whose components hold every pair of texts with a similarity of 0.8 or more."""
    return _by_shingles(texts, n, _of_texts).mapInArrow(_candidates_of_partition, "u long, v long")


def pairs(sets: DataFrame, n: int) -> DataFrame:
    """(u, v, chain): every pair of ``sets`` (node, set, label) with different labels and a similarity of 0.8 or more is there,
    or both stand in one chain; edges of chains have chain set."""
    found = _by_shingles(sets, n, _of_sets).mapInArrow(_pairs_of_partition, "u long, v long, shared long, need long")
    found = found.groupBy("u", "v").agg(F.sum(F.when(F.col("need") > 0, F.col("shared"))).alias("shared"), F.min(F.when(F.col("need") > 0, F.col("need"))).alias("need"), F.bool_or(F.col("need") == 0).alias("chain"))
    return found.where("chain or shared >= need").select("u", "v", "chain", F.coalesce(F.expr("shared >= need"), F.lit(False)).alias("enough"))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a similarity of 0.8 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _stars_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) between a star's centre v and the nodes that are alike; a centre's row comes before those of its star."""
    centre = None
    for b in batches:
        found = [[], []]
        for v, u, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            own = np.frombuffer(s.as_py(), np.uint64)
            if u == v:
                centre = own
            elif alike(own, centre):
                found[0].append(u)
                found[1].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (u, v) whose nodes are alike. Edges with one v are a star, dealt in groups of some STAR_ROWS with its set in each."""
    stars = edges.groupBy("v").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = sets.join(edges.join(stars, "v").withColumnRenamed("u", "node"), "node").select("v", part.alias("part"), F.lit(1).alias("kind"), "node", "set")
    heads = sets.join(stars.withColumnRenamed("v", "node"), "node").select(F.col("node").alias("v"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "node", "set")
    dealt = members.unionByName(heads).repartition("v", "part").sortWithinPartitions("v", "part", "kind")
    return dealt.select("v", "node", "set").mapInArrow(_stars_of_partition, "u long, v long")


def linked(sets: list[np.ndarray], labels: list[int] | None = None) -> list[int]:
    """For each set the position of its group's first one, all that are alike being linked, and all of one label.

    Sets that share one of their first shingles are compared unless they are already connected; under a shingle, those
    known to be connected stand together.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    named: dict[int, int] = {}
    for i, x in enumerate(labels or ()):
        root[i] = named.setdefault(x, i)
    counted = np.unique(np.concatenate(sets), return_counts=True)
    under: dict[int, dict[int, list[int]]] = {}
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        apart: set[int] = set()
        for shingle in _rare_first(sets[i], counted).tolist():
            parts: dict[int, list[int]] = {}
            for r, members in under.get(shingle, {}).items():
                parts.setdefault(find(r), []).extend(members)
            for r, members in parts.items():
                if find(r) == find(i):
                    continue
                for j in members:
                    if j in apart or 5 * len(sets[j]) < 4 * len(sets[i]):
                        continue
                    if alike(sets[i], sets[j]):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
                        break
                    apart.add(j)
            own = next((r for r in parts if find(r) == find(i)), None)
            if own is None:
                parts[i] = [i]
            else:
                parts[own].append(i)
            under[shingle] = parts
    return [find(i) for i in range(len(sets))]


def in_bounded_groups(named: DataFrame) -> DataFrame:
    """(group, node, label, set): rows of (whole, node, label, set) in groups of bounded size, and each pair of a whole that is near enough in size in one of them.

    A large whole is split by size, similar sets being in one class or in neighbouring ones, and a class by a hash into parts of some LINK_BYTES;
    each two parts of a class, or of neighbouring ones, are a group.
    """
    sized = named.withColumns({"_bytes": F.length("set"), "_class": F.floor(F.log(F.length("set") / 8.0) / F.log(F.lit(CLASS))).cast("int")})
    classes = settled(sized.groupBy("whole", "_class").agg(F.sum("_bytes").alias("_bytes"), F.count("*").alias("_texts")))
    large = classes.groupBy("whole").agg(F.sum("_bytes").alias("_all")).where(F.col("_all") > 2 * LINK_BYTES).select("whole")
    cells = settled(classes.join(large, "whole").select("whole", "_class", F.least(F.ceil(F.col("_bytes") / LINK_BYTES), F.col("_texts")).cast("int").alias("_parts")))
    if not cells.count():
        return named.select(F.xxhash64("whole").alias("group"), "node", "label", "set")
    beside = lambda step, name: cells.select("whole", (F.col("_class") - step).alias("_class"), F.col("_parts").alias(name))
    cells = cells.join(beside(1, "_above"), ["whole", "_class"], "left").join(beside(-1, "_below"), ["whole", "_class"], "left")
    rows = sized.join(cells, ["whole", "_class"], "left").withColumn("_part", F.pmod(F.xxhash64("node", F.lit(5)), F.coalesce("_parts", F.lit(1))).cast("int"))
    own = "transform(sequence(0, _parts - 1), k -> xxhash64(whole, _class, least(_part, k), _class, greatest(_part, k)))"
    above = "if(_above is null, array(), transform(sequence(0, _above - 1), k -> xxhash64(whole, _class, _part, _class + 1, k)))"
    below = "if(_below is null, array(), transform(sequence(0, _below - 1), k -> xxhash64(whole, _class - 1, k, _class, _part)))"
    return rows.select(F.explode(F.expr(f"if(_parts is null, array(xxhash64(whole)), concat({own}, {above}, {below}))")).alias("group"), "node", "label", "set")


def _links_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from the nodes of each group to those that they are alike with, first ones; rows come ordered by group, one is held at a time."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True))
    for _, part in groupby(rows, key=lambda r: r[0]):
        nodes, labels, sets = zip(*((u, x, np.frombuffer(s.as_py(), np.uint64)) for _, u, x, s in part), strict=True)
        found = [(u, nodes[r]) for u, r in zip(nodes, linked(list(sets), list(labels)), strict=True) if u != nodes[r]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, own, node, root, component_id) for every row of ``docs``, root naming its group; links: a similarity of 0.8 or more."""
    marked = settled(marked_rows(docs))
    nodes = settled(marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("one"), F.first("fp").alias("fp"), F.count("*").alias("copies")))
    n, rows = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    texts = docs.select(F.col("text").cast("string"))
    near = settled(link_forest(nodes.where("fp != 0").select("fp", "node"), n).where("u != v").distinct())
    edges = settled(candidates(texts, n).unionByName(near))
    few = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    few = settled(few.join(nodes, "node").select(F.col("one.doc_id").alias("_id"), F.col("one.own").alias("_own")))
    keyed = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("own"))
    known = few.count()
    # one text of each node that has a candidate; tables of nodes are sent to all tasks only while they are a few MB
    wanted = keyed.join(F.broadcast(few) if known <= BROADCAST else few, keyed["doc_id"].eqNullSafe(few["_id"]) & (keyed["own"] == few["_own"]), "left_semi")
    sets = settled(shingle_sets(wanted.select("text")))
    sure = settled(verified(near, sets))
    labels = components(sure).withColumnRenamed("u", "node").withColumnRenamed("root", "label")
    sets = sets.join(F.broadcast(labels) if known <= BROADCAST else labels, "node", "left").select("node", "set", F.coalesce("label", "node").alias("label"))
    found = settled(pairs(sets, known))
    sure = sure.unionByName(verified(found.where("enough").select("u", "v"), sets.select("node", "set")))
    whole = components(found.where("chain").select("u", "v"))
    whole = settled(whole.unionByName(whole.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "node").withColumnRenamed("root", "whole"))
    named = sets.join(F.broadcast(whole) if known <= BROADCAST else whole, "node").select("whole", "node", "label", "set")
    more = in_bounded_groups(named).repartition("group").sortWithinPartitions("group").mapInArrow(_links_of_partition, "u long, v long")
    roots = components(sure.unionByName(more))
    named = settled(nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "copies", F.col("one.doc_id").alias("first"), F.coalesce("root", "node").alias("root")))
    ids = settled(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")))
    named = settled(spread_join(named, ids, "root", "members", n).select("node", "copies", "root", "component_id"))
    return spread_join(marked, named, "node", "copies", rows).select("doc_id", "own", "node", "root", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: of the smallest doc_id (nulls last), then of the smallest text hash.

    A row is known by its doc_id and its text, so rows that share a doc_id but no group all stay, and of repeated rows one; if these
    differ in other columns, the first by their JSON text.
    """
    key = ["doc_id", "own"]
    rows = settled(near_copies(docs).groupBy(*key).agg(F.min("root").alias("root"), F.count("*").alias("n")))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("best"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["_id"]) & (a["own"] == b["_own"])
    stay = best.select(F.col("best.doc_id").alias("_id"), F.col("best.own").alias("_own"))
    gone = rows.join(stay, same(rows, stay), "left_anti").select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("own"))
    kept = keyed.join(gone, same(keyed, gone), "left_anti")
    many = settled(rows.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("own").alias("_own")))
    if many.count():
        again = kept.join(many, same(kept, many), "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(many, same(kept, many), "left_anti").select("row").unionByName(again.select("row"))
    return kept.select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
