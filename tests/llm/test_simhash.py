import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from spanmill.llm import common, simhash
from spanmill.llm.simhash import components, deduplicate, fingerprint, link_forest, near_copies, near_duplicates, op5_simhash, trie_forest


def brute_print(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(values, budget=4):
    """Smallest position reachable, by comparing all."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def random_prints(n, rng):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64) if rng.random() < 0.3 or not out else rng.choice(sorted(out)[:20])
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \t", "one", "A b C", "a b c d", "Ünï A\x0bB c\x0cd\x85e f g h", "x " * 50, "É 　 z q w"])
def test_fingerprint(text):
    assert fingerprint(text) == brute_print(text)


def test_fingerprint_random(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7)
    rng = random.Random(1)
    for _ in range(50):
        t = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(60)))
        assert fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("limit", [5, 200_000])
def test_trie(monkeypatch, limit):
    monkeypatch.setattr(simhash, "FRONTIER", limit)
    keys = random_prints(400, random.Random(2))
    one = np.array([0]), np.array([len(keys)]), np.array([0]), np.array([len(keys)])
    got = trie_forest(np.array(keys, np.uint64), one, 0, 4)
    assert got.tolist() == groups(keys)


@pytest.mark.parametrize(("chunk", "n"), [(50_000, 400), (20, 400), (50_000, 40_000_000)])
def test_join_loses_no_link(spark, monkeypatch, chunk, n):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk)
    keys = random_prints(400, random.Random(3))
    df = spark.createDataFrame([(signed(k),) for k in keys], "fp long")
    roots = {r.u: r.root for r in components(link_forest(df, n)).collect()}
    want = groups(keys)
    same = {}
    for k, g in zip(keys, want, strict=True):
        same.setdefault(g, set()).add(roots.get(signed(k), signed(k)))
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


@pytest.mark.parametrize("few", [0, 1000])
def test_components_chain(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_EDGES", few)
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)] + [(200, x) for x in range(201, 260)]
    random.Random(4).shuffle(e)
    got = {r.u: r.root for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100} | {x: 200 for x in range(201, 260)}


def test_documents(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "Beta", "c", "dd", "e"]) + str(rng.randrange(50)) for _ in range(80)) for _ in range(12)]
    texts = base + [t.upper() for t in base[:4]] + [base[5] + " tail"] + [None, "", "  ", "short one", "Short  ONE"] + [base[0]] * 30
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "lonely null"), (None, base[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    got = near_duplicates(df)
    assert got.count() == len(rows)
    prints = [brute_print(t) for _, t in rows]
    root = groups(prints)
    want = {}
    for (i, _), g in zip(rows, root, strict=True):
        if i is not None:
            want[g] = min(want.get(g, i), i)
    expect = sorted(((i, signed(p), want.get(g)) for (i, _), p, g in zip(rows, prints, root, strict=True)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == expect
    assert near_duplicates(df.limit(0)).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))] for _ in range(150)]
    texts = [" ".join(b) for b in base]
    for b in base[:60]:
        for share in (0.003, 0.012, 0.1):
            texts.append(" ".join(x if rng.random() > share else rng.choice(vocabulary) for x in b))
    texts += [texts[0].upper()] * 20 + [None, "", " ", "one two", "One  two"]
    rows = list(enumerate(texts)) + [(None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("sketch", F.lit(1))
    got = {r.doc_id: r.component_id for r in near_copies(df).collect()}
    assert len(got) == len(rows) and got.pop(None) == got[1]
    sets = [shingles(t) for t in texts]
    near = missed = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] & sets[j] and (s := jaccard(sets[i], sets[j])) >= 0.5:
                if s >= 0.8:
                    near += 1
                    missed += got[i] != got[j]
    assert near > 100 and not missed
    for i, c in got.items():  # each text of a group has a link
        assert i == c or any(jaccard(sets[i], sets[k]) >= 0.8 for k, d in got.items() if d == c and k != i)
    kept = deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in got.items() if i == c)
    assert near_copies(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, long), (4, "q r s t u v"), (4, long + " more"), (4, "q r s t u v"), (None, long)]
    rows += [(None, "only null ids"), (None, "Only null ids"), (None, "only null ids"), (5, None), (6, ""), (6, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("own", F.lit("x"))
    kept = deduplicate(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [(i, t) for i, t in got if i is not None] == [(1, "a b c d e f"), (3, long), (4, "q r s t u v"), (5, None)]
    assert [(t or "").lower() for i, t in got if i is None] == ["only null ids"]
    assert deduplicate(df.limit(0)).count() == 0


def added(rng, n, more):
    a = [f"v{rng.randrange(10**6)}" for _ in range(n)]
    return " ".join(a), " ".join(a + [f"v{rng.randrange(10**6)}" for _ in range(more)])


def held_against_brute_force(spark, texts):
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets, want = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_added_passages_and_short_texts(spark):
    rng = random.Random(11)
    pairs = [added(rng, n, more) for n, more in ((100, 15), (400, 80), (1000, 200), (40, 5), (10, 1)) for _ in range(15)]
    want = held_against_brute_force(spark, [t for pair in pairs for t in pair])
    assert len(set(want)) == len(pairs)


def test_less_similar_texts_are_not_linked(spark):
    rng = random.Random(12)
    texts = []
    for n in [40] * 30 + [35] * 30:  # one word changed: 0.756 and 0.722
        a = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(a), " ".join([*a[: n // 2], "other", *a[n // 2 + 1 :]])]
    for n, more in ((44, 10), (44, 11)):  # exactly 0.8, and just below
        texts += added(rng, n, more)
    want = held_against_brute_force(spark, texts)
    assert len(set(want)) == len(texts) - 1


@pytest.mark.parametrize(("rows", "pairs", "star"), [(300_000, 64, 2000), (50, 3, 4)])
def test_hot_group_of_near_copies(spark, monkeypatch, rows, pairs, star):
    """A third of all rows are near copies of one text, by chains of edits too; with small limits everything is cut."""
    for name, value in (("ROWS_AT_ONCE", rows), ("PAIRED_AT_ONCE", rows), ("ALL_PAIRS", pairs), ("STAR_ROWS", star), ("CHUNK_ROWS", rows)):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(simhash, "FEW_EDGES", 500_000 if rows > 50 else 0)
    rng = random.Random(13)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    texts, chain = [], list(base)
    for i in range(40):
        x = list(base if i % 2 else chain)
        x[rng.randrange(120)] = f"n{i}"
        chain = x if i % 2 == 0 else chain
        texts.append(" ".join(x))
    texts += [" ".join([*base[:60], *(f"v{rng.randrange(10**6)}" for _ in range(60))]) for _ in range(10)]
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 90))) for _ in range(60)] + [texts[3]] * 20
    want = held_against_brute_force(spark, texts)
    assert len(set(want)) < 80


def test_query(spark, tmp_path):
    rng = random.Random(14)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate([*base, *(t + " x" for t in base), *[base[0].upper()] * 20, None, "", "w " * 30_000])] + [(3, base[3]), (None, base[1])]
    spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [brute_print(t) for _, t in rows]
    least = {}
    for (i, _), g in zip(rows, root := groups(prints), strict=True):
        least[g] = min(least.get(g, 1 << 60), 1 << 60 if i is None else i)
    want = [(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, root, strict=True)]
    assert sorted(map(tuple, op5_simhash(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_repeated_rows_that_differ_elsewhere(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, x, {"k": x}) for x in ("c", "a", "b")] + [(2, text + " more", "0", None), (3, "other words here", "z", None), (3, "other words here", "y", None), (None, None, "q", None), (None, None, "p", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,string>")
    for parts in (1, 5):
        got = sorted((str(r.doc_id), r.source) for r in simhash.deduplicate(df.repartition(parts)).collect())
        assert got == [("1", "a"), ("3", "y"), ("None", "p")]


def pair_batches(copies, shingles):
    """Rows of one group of similar sets under many shingles, in order, and what pairs of it must come to."""
    size, rest = 1000, 1000 - np.arange(shingles)
    token, node = np.repeat(np.arange(shingles), copies), np.tile(np.arange(copies), shingles)
    columns = [token, node, np.repeat(size << 32 | rest, copies), node]
    return [pa.RecordBatch.from_arrays([pa.array(c[at : at + 500]) for c in columns], ["token", "node", "sizes", "label"]) for at in range(0, len(token), 500)]


@pytest.mark.parametrize("held", [250_000, 10])
def test_a_pair_comes_once_from_a_task(monkeypatch, held):
    """However many slices a task's rows make; and shingles that stand too far behind to count make none."""
    monkeypatch.setattr(simhash, "PAIRED_AT_ONCE", 400)
    monkeypatch.setattr(simhash, "PAIRS_HELD", held, raising=False)
    need, counted = 1 + 1000 // simhash.SHARED, [r for r in range(1000, 784, -1) if 9 * (r + 1000 // simhash.SHARED) >= 8 * 1000]
    got, rows = {}, 0
    for b in simhash._pairs_of_partition(iter(pair_batches(20, 216))):
        for u, v, shared, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows += 1
            assert least == need
            got[u, v] = got.get((u, v), 0) + shared
    assert got == {(u, v): len(counted) for u in range(20) for v in range(u)}
    assert rows == len(got) or held == 10


@pytest.mark.parametrize("copies", [20, 60])
def test_a_slice_of_frequent_shingles_makes_no_more_pairs_at_once(monkeypatch, copies):
    """A slice's pairs are up to 64 times its rows: they are added up meanwhile, with the same sums."""
    monkeypatch.setattr(simhash, "PAIRS_HELD", 1_000)
    summed, most = simhash._summed, []
    monkeypatch.setattr(simhash, "_summed", lambda u, *x: most.append(len(u)) or summed(u, *x))
    got = {}
    for b in simhash._pairs_of_partition(iter(pair_batches(copies, 216))):
        for u, v, shared in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
            got[u, v] = got.get((u, v), 0) + shared
    counted = [r for r in range(1000, 784, -1) if 9 * (r + 1000 // simhash.SHARED) >= 8 * 1000]
    assert got == {(u, v): len(counted) for u in range(copies) for v in range(u)}
    # a shift of the slice by one row makes no more pairs than it has rows
    assert max(most) <= 3 * (1_000 + copies * 216)


@pytest.mark.parametrize("limit", [500, 2_000, 20_000])
def test_a_large_chain_is_looked_at_in_groups(spark, monkeypatch, limit):
    """Texts of one chain come in groups of bounded size, and no link between them is lost."""
    monkeypatch.setattr(simhash, "LINK_BYTES", limit)
    rng = random.Random(21)
    base = [f"v{rng.randrange(10**6)}" for _ in range(900)]
    texts = []
    for i in range(90):
        n = rng.choice([40, 48, 60, 75, 200, 240, 290])
        x = base[:n] if i % 3 else base[n : 2 * n]
        for _ in range(rng.randrange(3)):
            x = [*x[: (at := rng.randrange(n))], f"n{rng.randrange(10**6)}", *x[at + 1 :]]
        texts.append(" ".join(x))
    sets = [simhash.shingle_set(simhash._tokens(t)) for t in texts]
    rows = [(7, i, 0 if i < 3 else i, x.tobytes()) for i, x in enumerate(sets)]
    groups_ = simhash.settled(simhash.in_bounded_groups(spark.createDataFrame(rows, "whole long, node long, label long, set binary")))
    edges = groups_.repartition("group").sortWithinPartitions("group").mapInArrow(simhash._links_of_partition, "u long, v long")
    root = {r.u: r.root for r in components(edges).collect()}
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if want[i] != want[j] and (i < 3 or simhash.alike(sets[i], sets[j])):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert 2 < len(set(want)) < 80
    # texts 0 to 2 are known to be connected: edges need not say so again
    known = {root.get(i, i) for i in range(3)}
    assert [0 if root.get(i, i) in known else root.get(i, i) for i in range(len(sets))] == want
    sizes = groups_.groupBy("group").agg(F.sum(F.length("set")).alias("n"), F.max(F.length("set")).alias("most")).collect()
    assert all(r.n <= 2 * limit + 12 * r.most for r in sizes) and len(sizes) > 10


def test_groups_hold_every_pair_near_in_size(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LINK_BYTES", 6_000)
    rng = random.Random(22)
    sizes = [rng.choice([1, 2, 4, 5, 8, 10, 40, 50, 51, 64, 80, 100, 125, 156, 157]) for _ in range(150)]
    rows = [(i % 2 if i < 140 else 9, i, i, bytes(8 * n)) for i, n in enumerate(sizes)]
    got = simhash.in_bounded_groups(spark.createDataFrame(rows, "whole long, node long, label long, set binary")).select("group", "node").collect()
    together, of = set(), {}
    for r in got:
        of.setdefault(r["group"], []).append(r.node)
    for members in of.values():
        assert len(members) == len(set(members))
        together |= {(a, b) for a in members for b in members}
    whole = {i: w for w, i, _, _ in rows}
    assert {(a, b) for a in whole for b in whole if whole[a] == whole[b] and 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])} <= together
    assert len({g for g, m in of.items() if whole[m[0]] == 9}) == 1
    assert all(whole[a] == whole[b] for a, b in together)


def test_words_of_one_text_are_held_at_a_time():
    import tracemalloc

    texts = [" ".join(f"w{i * 7919 + k}" for k in range(400)) for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(range(500)), pa.array(texts)], ["doc_id", "own", "text"])
    next(simhash._marks(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    out = next(simhash._marks(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all words of the batch are 200,000 objects of some 40 bytes
    assert out.num_rows == 500 and peak < 2_000_000
    assert out.column(3)[3].as_py() == int(np.array([simhash._print(simhash._tokens(texts[3]), 5)], np.uint64).view(np.int64)[0])
