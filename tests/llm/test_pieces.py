import random

import public_tokenizers
import pytest
from spanmill.llm import pieces
from spanmill.llm import common
from spanmill.llm.common import Chosen, Memo
from spanmill.llm.pieces import Codec, decode, encode, load, op2_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


def best_by_all(codec, scores, chunk):
    """Best score by dynamic programming over all substrings."""
    best = [0.0] + [float("-inf")] * len(chunk)
    for j in range(1, len(chunk) + 1):
        for i in range(j):
            if chunk[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[chunk[i:j]])
        if chunk[j - 1] not in codec.single:
            best[j] = max(best[j], best[j - 1] + codec.unknown)
    return best[-1]


def toy(crossing=False):
    p = [("<unk>", 0.0), ("a", -1.5), ("b", -2.0), ("ab", -3.0), ("▁", -1.0), ("▁a", -2.2), ("ba", -3.1), ("aba", -4.0), ("▁▁", -1.9)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    if crossing:
        p.append(("a▁b", -0.5))
    ids = {b: 9 + b for b in range(256)}
    return Codec(p, ids, frozenset([0]), 0), {x: s for i, (x, s) in enumerate(p) if i and i not in ids.values()}


@pytest.mark.parametrize("crossing", [False, True])
def test_best_path(crossing):
    codec, scores = toy(crossing)
    assert codec.whole == crossing
    names = dict(enumerate(list(scores)))
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("aab  c") for _ in range(rng.randrange(1, 14)))
        whole = "▁" + text.replace(" ", "▁")
        ids = codec.encode(text)
        got = 0.0
        for i in ids.tolist():
            got += codec.unknown if 9 <= i < 265 else scores[{**{k + 1: v for k, v in names.items()}, 265: "a▁b"}.get(i)]
        assert abs(got - best_by_all(codec, scores, whole)) < 1e-9
        assert codec.decode(ids.tolist()) == text


def test_model_round_trip():
    codec = load(PATH)
    rng = random.Random(2)
    for _ in range(800):
        text = "".join(rng.choice(["hello", "World", " ", "  ", "\n", "é", "ß", "😀", "123", "\x00", "中", ",", "."]) for _ in range(rng.randrange(12)))
        ids = codec.encode(text).tolist()
        assert codec.decode(ids) == text
    for chunk in ("▁unbelievable", "▁Straßenbahn", "▁the", "▁a😀b", "▁▁▁x"):
        assert codec.viterbi(chunk)


def test_whole_equals_chunks(monkeypatch):
    codec = load(PATH)
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join(rng.choice(["alpha", "b,c", "", "Dd\nee", "é9"]) for _ in range(8))
        chunks = codec.encode(text).tolist()
        monkeypatch.setattr(codec, "whole", True)
        monkeypatch.setattr(codec, "known", pieces.Memo())
        assert codec.encode(text).tolist() == chunks
        monkeypatch.undo()


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(pieces, "TEXTS_AT_ONCE", 2)
    rows = [(1, "hello world", "s"), (2, None, None), (3, "", "t"), (3, "", "t"), (None, "a" * 20_000 + " ▁", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as ids", "2 as n_tokens")
    out = encode(df, PATH)
    got = decode(out, PATH).collect()
    assert len(got) == 5 and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert sorted(r.text for r in got) == sorted(["hello world", "", "", "", "a" * 20_000 + "  "])
    assert encode(df.limit(0), PATH).count() == 0


def test_memo():
    memo = Memo(2_000)
    for i in range(40):
        memo.keep(f"k{i}", b"y" + b"x" * i)
        assert (memo.get("k0") or memo.again("k0")) == b"y"  # asked for again and again, so it stays
        assert len(memo) + len(memo.older) <= 12
    assert memo.get("k5") is None and memo.again("k5") is None


def test_query(spark, tmp_path):
    """Against an encoder that remembers nothing and takes every text whole."""
    rng = random.Random(5)
    words = ["alpha", "b,c", "", "Dd\nee", "é9", "12.5", "中文", "😀"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9))), f"s{i % 3}") for i in range(60)]
    rows += [(7, rows[7][1], "s1"), (61, None, None), (62, "", "s0"), (None, "no id", "s2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 as ids").write.parquet(f"{tmp_path}/documents.parquet")
    codec = load(PATH)
    want = [(i, s, codec.viterbi("▁" + t.replace(" ", "▁")) if t else [], True) for i, t, s in rows]
    got = op2_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.source, list(r.ids), r.round_trip)) for r in got) and all(r.n_tokens == len(r.ids) for r in got)


def by_definition(text, known, lowest, byte_ids):
    """Ids of the best segmentation of a whole text, from nothing but the model's pieces and scores: all substrings at all places."""
    if not text:
        return []
    text = "▁" + text.replace(" ", "▁")
    best = [(0.0, None)] + [None] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 64), j):  # longest first, so that ties stay with the longer last piece
            if best[i] and (hit := known.get(text[i:j])) and (best[j] is None or best[i][0] + hit[1] > best[j][0]):
                best[j] = (best[i][0] + hit[1], (i, [hit[0]]))
        if text[j - 1] not in known and best[j - 1] and (best[j] is None or best[j - 1][0] + lowest - 10.0 > best[j][0]):
            best[j] = (best[j - 1][0] + lowest - 10.0, (j - 1, [byte_ids[b] for b in text[j - 1].encode()]))
    out, j = [], len(text)
    while j:
        j, ids = best[j][1]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def test_query_by_definition(spark, tmp_path):
    """The query's ids and a segmenter that shares no code with it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    every = range(sp.get_piece_size())
    own = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_unknown(i))]
    known, lowest = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in own}, min(sp.get_score(i) for i in own)
    assert max(map(len, known)) <= 64
    byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
    rng = random.Random(8)
    words = ["the", "unbelievable", "Straßenbahn", "aaaaaaaa", "x1y2", "  ", "😀😀", "中a文", "\n\n", "information", "▁", "it's", "\x01"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12))) + rng.choice(["", " ", "é", "."])) for i in range(120)] + [(500, "the information " * 900), (501, None)]
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in op2_sentencepiece(spark, str(tmp_path)).collect()}
    assert got == {i: by_definition(t, known, lowest, byte_ids) for i, t in rows}


def test_memo_of_what_comes_again(monkeypatch):
    monkeypatch.setattr(common, "DOOR", 1 << 8)
    memo = Chosen(4_000)
    memo.keep("once", b"1")
    assert memo.get("once") is None and memo.again("once") is None
    memo.keep("once", b"1")
    assert memo.get("once") == b"1"
    for i in range(3_000):  # the table of hashes is emptied, the bound holds
        memo.keep(f"k{i}", b"x")
        memo.keep(f"k{i}", b"x")
        assert memo.came <= 128 and len(memo) + len(memo.older) <= 24
