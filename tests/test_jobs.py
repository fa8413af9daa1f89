import json
import os
import random
import subprocess
import sys
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from jobs import pileup_stream, quality_gate
from jobs.config import settings
from jobs.registry import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
START = datetime(2024, 3, 1, tzinfo=timezone.utc)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def some_events(n, seed=1):
    rng = random.Random(seed)
    kinds = ["purchase", "click", "view"]
    return [(i, START + timedelta(seconds=rng.randrange(12 * 86_400)), rng.randrange(4), rng.choice(kinds), round(rng.expovariate(0.05), 2)) for i in range(n)]


def by_definition(events):
    """Features of each site from all reads at once."""
    out = {}
    for i, at, user, kind, _ in events:
        if kind != "purchase":
            continue
        held = [(k, v) for _, t, u, k, v in events if k != "purchase" and u == user and t <= at < t + timedelta(hours=v)]
        if held:
            a, b = [v for k, v in held if k == "click"], [v for k, v in held if k != "click"]
            mean = lambda x: sum(x) / len(x) if x else 0.0
            var = sum((x - mean(a)) ** 2 for x in a) / len(a) if len(a) > 1 else 0.0
            high = sum(v >= 20 for _, v in held)
            out[i] = (str(at.date()), user, len(held), len(a), len(a) / len(held), mean(a), var, mean(b), mean(a) - mean(b), len(held) / high if high else 0.0)
    return out


def features(spark, out):
    rows = spark.read.parquet(f"{out}/features").collect()
    assert len(rows) == len({r.site for r in rows})
    return {r.site: (str(r.day), r.user_id, r.total_depth, r.alt_depth, r.allele_balance, r.mean_alt, r.var_alt, r.mean_ref, r.mean_diff, r.depth_ratio) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4] and got[k][4:] == pytest.approx(w[4:], abs=1e-6)


def add(spark, rows, folder):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_pileup_of_growing_input(spark, tmp_path):
    source, out, mark = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/mark"
    events = some_events(700)
    add(spark, events[:300], source)
    assert pileup_stream.run(spark, source, out, mark) == {"batches": 1, "events": 300}
    same(features(spark, out), by_definition(events[:300]))
    # two more files, one batch each; old sites get new reads, new sites old reads
    add(spark, events[300:500], source)
    add(spark, events[500:], source)
    config = settings(pileup_stream.__file__) | {"files_per_batch": 1}
    assert pileup_stream.run(spark, source, out, mark, config) == {"batches": 2, "events": 400}
    first = features(spark, out)
    same(first, by_definition(events))
    # nothing new: nothing changes
    assert pileup_stream.run(spark, source, out, mark, config) == {"batches": 0, "events": 0}
    assert features(spark, out) == first
    # another order of arrival gives the same
    add(spark, events[::-1], f"{tmp_path}/other")
    pileup_stream.run(spark, f"{tmp_path}/other", f"{tmp_path}/out2", f"{tmp_path}/mark2")
    same(features(spark, f"{tmp_path}/out2"), by_definition(events))


def test_a_batch_that_failed_runs_again(spark, tmp_path, monkeypatch):
    source, out, mark = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/mark"
    events = some_events(400, 2)
    add(spark, events[:200], source)
    pileup_stream.run(spark, source, out, mark)
    add(spark, events[200:], source)
    whole = pileup_stream.merged

    def broken(parts):
        raise RuntimeError("lost")

    monkeypatch.setattr(pileup_stream, "merged", broken)  # after its events and parts are written
    with pytest.raises(Exception, match="lost"):
        pileup_stream.run(spark, source, out, mark)
    monkeypatch.setattr(pileup_stream, "merged", whole)
    assert pileup_stream.run(spark, source, out, mark)["events"] == 200
    same(features(spark, out), by_definition(events))


def test_pileup_of_odd_rows(spark, tmp_path):
    at = START + timedelta(days=1)
    rows = [(1, at, 1, "purchase", 1.0), (2, at, 1, "click", None), (3, at, 1, "click", -5.0), (4, at, 1, "view", 0.0), (5, None, 1, "click", 3.0), (6, at, None, "click", 3.0), (7, at, 1, None, 3.0), (None, at, 1, "click", 3.0), (8, at - timedelta(days=400), 1, "click", 24.0 * 500)]
    source = f"{tmp_path}/events"
    add(spark, rows[:1], source)
    pileup_stream.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/mark")  # a site, and no reads at all
    add(spark, rows[1:], source)
    pileup_stream.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/mark")
    assert {k: v[:4] for k, v in features(spark, f"{tmp_path}/out").items()} == {1: ("2024-03-02", 1, 1, 1)}
    # events that take no part, and a folder without rows
    add(spark, [(1, None, None, None, None)], f"{tmp_path}/none")
    assert pileup_stream.run(spark, f"{tmp_path}/none", f"{tmp_path}/out3", f"{tmp_path}/mark3") == {"batches": 1, "events": 0}


LANGS = ["de", "en", None]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("abcdefghij"[: 2 + i % 8] + " é") for _ in range(rng.randrange(80))), LANGS[i % 2] if i % 50 else None) for i in range(400)]
    docs += [(900, None, "en"), (901, "", "fr"), (902, "x" * 200_000, "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("label", F.lit("x")).write.parquet(f"{d}/documents.parquet")
    known = [(i, int(rng.random() < 0.15 * (i % 8))) for i in range(0, 400, 2)] + [(4, 0), (4, 1), (901, None), (None, 1), (12345, 1)]
    spark.createDataFrame(known, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def test_quality_gate(spark, texts, tmp_path):
    out = f"{tmp_path}/out"
    counts = quality_gate.run(spark, f"{texts}/documents.parquet", f"{texts}/labels.parquet", out)
    assert counts == {"documents": 403, "decisions": 403, "languages": 4}
    read = lambda: sorted((str(r) for x in ("decisions", "report") for r in spark.read.parquet(f"{out}/{x}").collect()))
    first = read()
    quality_gate.run(spark, f"{texts}/documents.parquet", f"{texts}/labels.parquet", out)
    assert read() == first
    rows = spark.read.parquet(f"{out}/decisions").collect()
    report = {r.lang: r for r in spark.read.parquet(f"{out}/report").collect()}
    for lang in LANGS:
        val = [(r.text_score, r.label) for r in rows if r.lang == lang and r.split == "val"]

        def f1(t, of):
            tp, hit = sum(y for s, y in of if s >= t), sum(s >= t for s, _ in of)
            p, q = tp / hit if hit else 0.0, tp / max(1, sum(y for _, y in of))
            return 2 * p * q / (p + q + 1e-9)

        if val:
            best = max(sorted({s for s, _ in val}), key=lambda t: (round(f1(t, val), 12), -t))
            assert report[lang].threshold == best and report[lang].val_f1 == pytest.approx(f1(best, val))
        test = [(r.text_score, r.label) for r in rows if r.lang == lang and r.split == "test"]
        assert report[lang].n == len(test) and report[lang].f1 == pytest.approx(f1(report[lang].threshold, test), abs=1e-6)
    assert report["fr"].threshold == 0.5 and report["fr"].val_f1 is None
    for r in rows:
        assert r.passed == (r.text_score >= report[r.lang].threshold) and (r.split == "none") == (r.label is None)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, texts, tmp_path, name):
    add(spark, some_events(500, 4), f"{tmp_path}/events.parquet")
    before = {k: v for k, v in spark.conf.getAll.items()}
    d = str(tmp_path) if "pileup" in name else texts
    df = QUERIES[name](spark, d)
    assert {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"} == {k: v for k, v in before.items() if k != "spark.checkpoint.dir"}
    got = sorted(str(tuple(str(x) for x in r)) for r in df.select(*sorted(df.columns)).collect())
    con = duckdb.connect()
    for t in (["events"] if "pileup" in name else ["documents", "labels"]):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    if t == "events":
        con.sql("set timezone = 'UTC'")
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(str(tuple(str(x) for x in r)) for r in rel.select(*[f'"{c}"' for c in sorted(rel.columns)]).fetchall())
    assert got == want and got


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"alt_type": "view"}))
    assert settings(pileup_stream.__file__, str(path)) == settings(pileup_stream.__file__) | {"alt_type": "view"}
    path.write_text(json.dumps({"alt": 1}))
    with pytest.raises(KeyError, match="alt"):
        settings(pileup_stream.__file__, str(path))


def test_command_line(spark, tmp_path):
    source = f"{tmp_path}/events"
    events = some_events(150, 5)
    add(spark, events, source)
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"files_per_batch": 1}))
    done = subprocess.run(
        [sys.executable, "-m", "jobs.pileup_stream", "--events", source, "--out", f"{tmp_path}/out", "--config", str(path)],
        cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"},
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 150 events" in done.stderr
    same(features(spark, f"{tmp_path}/out"), by_definition(events))


def test_texts_of_many_different_characters(spark):
    """Scores of whole texts don't cost a pass for each different character; they are those of their characters' entropy."""
    import math
    import time
    from collections import Counter

    wide = "".join(chr(0x4E00 + i) for i in range(20_000))
    texts = [None, "", "a", "aab", "\x00\x00b", "𝒳𝒳y", wide, *[wide[i:] + wide for i in range(1, 20)]]
    config = settings(quality_gate.__file__) | {"digits": 12}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x"))
    began = time.perf_counter()
    got = {r.doc_id: r.text_score for r in quality_gate.scored(df, config).collect()}
    assert time.perf_counter() - began < 20
    for i, t in enumerate(texts):
        n = len(t or "")
        h = math.log2(n) - sum(k * math.log2(k) for k in Counter(t).values()) / n if n else 0
        assert abs(got[i] - 1 / (1 + math.exp(-(h - config["centre"]) * config["slope"]))) < 1e-9
