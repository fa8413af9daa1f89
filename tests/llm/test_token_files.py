import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from spanmill.llm import common, token_files
from spanmill.llm.token_files import Encoder, op10_token_files, read_ids, write_ids
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)  # as the contract has it, with the library's defaults
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("remembered", [1 << 24, 3000])
def test_pieces_give_the_ids_of_the_whole(plain, monkeypatch, remembered):
    monkeypatch.setattr(common.Memo.__init__, "__defaults__", (remembered,))
    rng = random.Random(9)
    bits = ["a", "word", "It's", "'ll", " ", "  ", "\n", "\n\n", "\t", "1234", "é", "ß😀", " ", "　", "\x1c", "\x85", "\x0b", "<|endoftext|>", "...", "$%&", "中文字", "x" * 90, "​", " ", "﻿"]
    texts = [None, "", " ", "\n"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(1500)]
    e = Encoder(PATH)
    got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)]
    for t, g in zip(texts, got, strict=True):
        assert g == plain(t), repr(t)


def test_files(spark, plain, tmp_path):
    rows = [(i * 7 % 101, f"text {i} " * (i % 9)) for i in range(101)] + [(None, "no id"), (5, None), (5, ""), (5, "aa"), (-3, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/ids"
    manifest = write_ids(df, folder, PATH)
    got = sorted(read_ids(manifest, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    digest = lambda t: (len(x := plain(t)), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), *digest(t)) for i, t in rows)
    empty = write_ids(df.limit(0), folder + "2", PATH)
    assert read_ids(empty, folder + "2").count() == 0


def test_special_tokens(plain):
    e = Encoder(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext", "no special one"]
    got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)]
    assert got[0] == [64, 50256, 65, 0] and got == [plain(t) for t in texts]


def by_hand(plain, rows):
    out, at = [], 0
    for i, t in sorted(rows):
        ids = plain(t)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("local", [True, False])
def test_query(spark, plain, tmp_path, monkeypatch, local):
    rows = [(i * 7 % 101, f"text {i} <|endoftext|> " * (i % 9)) for i in range(101)] + [(900, "y " * 30_000)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op10_token_files(spark, str(tmp_path)).collect())) == by_hand(plain, rows)
    # slices of a few ids, from a mapped file and from one read range by range
    monkeypatch.setattr(token_files, "IDS_AT_ONCE", 40)
    folder = f"{tmp_path}/ids"
    manifest = write_ids(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{folder}", PATH)
    if not local:
        from pyarrow import fs

        monkeypatch.setattr(fs, "LocalFileSystem", str)
    found = [r for x in token_files._read(f"file://{folder}")([pa.RecordBatch.from_pylist([r.asDict() for r in manifest.collect()])]) for r in x.to_pylist()]
    assert sorted(tuple(r.values()) for r in found) == by_hand(plain, rows)
