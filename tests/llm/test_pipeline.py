import random

import corpus_pipeline
from pyspark.sql import functions as F
from spanmill.llm import toxicity
from spanmill.llm.mixing import mix
from spanmill.llm.pieces import load
from spanmill.llm.pii import masked
from spanmill.llm.simhash import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, rows, labels):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    some = ["amber", "birch", "cedar", "dune", "ember", "fjord", "grove", "heath"]
    rows = [(i, " ".join(rng.choice(some) + rng.choice("abcdefghij") + rng.choice("klmnopqr") for _ in range(rng.randrange(20, 60))) + (" vilest" if i % 9 == 0 else "") + (f" me{i}@x.org" if i % 7 == 0 else ""), f"s{i % 4}") for i in range(500)]
    rows += [(1000 + i, rows[10][1], "s1") for i in range(60)] + [(2000, None, None), (2001, "", "s0"), (None, "no id at all here", "s2")]
    write(spark, tmp_path, rows, [(i, 1, int(i % 9 == 0)) for i in range(0, 500, 2)])
    d = str(tmp_path)
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = before, docs
        if name != "sentencepiece":
            assert docs.columns == before.columns
    texts = lambda df: sorted(str((r.doc_id, r.text)) for r in df.collect())
    before, after = seen["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{d}/labels.parquet"))
    assert texts(after) == sorted(str((r.doc_id, r.text)) for r in before.collect() if model.score(r.text) < 0.5)
    bad = [r for r in after.collect() if "vilest" in (r.text or "")]
    assert len(bad) <= 3 and after.count() >= before.count() - 70
    before, after = seen["near_duplicates"]
    first = {r.doc_id: r.component_id for r in near_copies(before).collect()}
    assert first[None] is None
    assert texts(after) == sorted(str((r.doc_id, r.text)) for r in before.collect() if first[r.doc_id] == r.doc_id)
    before, after = seen["personal_data"]
    assert texts(after) == sorted(str((r.doc_id, masked(r.text))) for r in before.collect())
    before, after = seen["mixing"]
    copies = {(r.doc_id, r.text): r.copies for r in mix(before).collect()}
    assert texts(after) == sorted(str(k) for k, n in copies.items() for _ in range(n))
    before, after = seen["sentencepiece"]
    codec = load(__import__("public_tokenizers").path(corpus_pipeline.MODEL))
    want = sorted(str((r.doc_id, codec.encode(r.text).tolist())) for r in before.collect())
    assert sorted(str((r.doc_id, list(r.ids))) for r in after.collect()) == want and after.where(~F.col("round_trip")).count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, after.collect()))


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHES = "row own node root copies label score n size target taken spans ids best again rank h _id part key kept base".split()


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    """Further columns with the names of inner ones pass through all stages but the last, and change nothing."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("amber birch cedar dune".split()) + rng.choice("abcdefgh") for _ in range(30)), f"s{i % 3}") for i in range(40)]
    rows += [(100, rows[3][1], "s0"), (101, " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000)) + " mail me@x.org", "s1"), (102, None, None)]
    write(spark, tmp_path, rows, [(i, 1, int(i % 9 == 0)) for i in range(0, 40, 2)])
    d = str(tmp_path)
    plain = spark.read.parquet(f"{d}/documents.parquet")
    wide = plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASHES})
    texts = lambda df: sorted(str((r.doc_id, r.text)) for r in df.select("doc_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, before = stage(spark, plain, d), wide
        plain.write.parquet(f"{d}/{name}-plain")
        stage(spark, wide, d).write.parquet(f"{d}/{name}")
        plain, wide = spark.read.parquet(f"{d}/{name}-plain"), spark.read.parquet(f"{d}/{name}")
        assert wide.columns == before.columns and texts(wide) == texts(plain)
        assert all(r[c] == f"{c}{r.doc_id}" for r in wide.collect() for c in CLASHES)
    assert any(len(t) > 700_000 and "me@x.org" not in t for t in texts(wide))
    assert corpus_pipeline.STAGES[-1][1](spark, wide, d).where("round_trip").count() == wide.count()
