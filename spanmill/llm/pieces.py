"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a text once. At each position its output links give every piece that ends there, longest
first; each relaxes the best score at its end from the best score at its start. A character that no piece
covers alone costs ``UNKNOWN`` below the lowest score and becomes byte pieces. Ties go to the longer last
piece. Spaces become U+2581, with one in front of the text, as the model's normaliser asks; nothing else changes.

Where no piece holds U+2581 behind another character, the best path passes every place where U+2581 follows
another character, so chunks between such places are solved alone and remembered up to a bound; else the text is solved
whole. Either way every whole text is encoded.

Decoding joins pieces and bytes; bytes that aren't UTF-8 become U+FFFD.

Defined results: a null or empty text has no ids and decodes to an empty text; U+2581 in a text decodes to a
space; rows are independent, so repeated rows give equal results and an empty table an empty one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_BYTES, Chosen, Memo, table

UNKNOWN = 10.0
NEVER = float("-inf")
LONGEST = 64
REMEMBERED = 64 << 20  # bytes
TEXTS_AT_ONCE = 64
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CROSSING = re.compile(f"[^{SPACE}]{SPACE}")


class Codec:
    """Encoder and decoder for pieces [(text, score)], byte ids {byte: id} and ids that no text gives."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], silent: frozenset[int], unknown_id: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        bytes_of = {i: b for b, i in byte_ids.items()}
        own = [i for i in range(len(pieces)) if i not in bytes_of and i not in silent and pieces[i][0]]
        for i in own:
            self.automaton.add_word(pieces[i][0], (i, len(pieces[i][0]), pieces[i][1]))
        self.automaton.make_automaton()
        self.single = {pieces[i][0] for i in own if len(pieces[i][0]) == 1}
        self.unknown = min((pieces[i][1] for i in own), default=0.0) - UNKNOWN
        self.whole = any(_CROSSING.search(pieces[i][0]) for i in own)
        self.text_of = [bytes([bytes_of[i]]) if i in bytes_of else b"" if i in silent else p.replace(SPACE, " ").encode("utf-8") for i, (p, _) in enumerate(pieces)]
        if unknown_id >= 0:
            self.text_of[unknown_id] = " ⁇ ".encode()
        self.known = Memo()

    def viterbi(self, chunk: str) -> list[int]:
        n = len(chunk)
        if self.single.issuperset(chunk):  # each character is a piece, so every place is reached
            scores, last = [0.0] + [NEVER] * n, [None] * (n + 1)
            for end, hit in self.automaton.iter(chunk):
                score = scores[end + 1 - hit[1]] + hit[2]
                if score > scores[end + 1]:
                    scores[end + 1], last[end + 1] = score, hit
            out = []
            while n:
                out.append(last[n][0])
                n -= last[n][1]
            return out[::-1]
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        matches = self.automaton.iter(chunk)
        end, hit = next(matches, (n, None))
        for i in range(n):
            while end == i:
                piece, length, score = hit
                before = best[i + 1 - length]
                if before is not None and (best[i + 1] is None or before + score > best[i + 1]):
                    best[i + 1], back[i + 1] = before + score, (piece, length)
                end, hit = next(matches, (n, None))
            if chunk[i] not in self.single and (best[i + 1] is None or best[i] + self.unknown > best[i + 1]):
                best[i + 1], back[i + 1] = best[i] + self.unknown, (None, 1)
        out, at = [], n
        while at:
            piece, length = back[at]
            if piece is not None:
                out.append(piece)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(chunk[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown_id)
            at -= length
        return out[::-1]

    def remembered(self, chunk: str) -> bytes:
        """The ids of a chunk that the newer memo doesn't hold."""
        found = self.known.again(chunk)
        if found is not None:
            return found
        ids = self.viterbi(chunk)
        found = struct.pack(f"<{len(ids)}i", *ids)
        if len(chunk) <= LONGEST:
            self.known.keep(chunk, found)
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        text = SPACE + text.replace(" ", SPACE)
        chunks = [text] if self.whole else _CHUNK.findall(text)
        coded = list(map(self.known.get, chunks))
        for i, x in enumerate(coded):
            if x is None:
                c = chunks[i]
                coded[i] = self.known.get(c) or self.remembered(c)
        return np.frombuffer(b"".join(coded), "<i4")

    def decode(self, ids) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")


@cache
def load(path: str, remembered: int = MEMO_BYTES) -> Codec:
    """A codec for a SentencePiece model file; ``remembered``: bytes of chunks that it may keep."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    silent = frozenset(i for i in range(n) if sp.is_control(i) or sp.is_unused(i) or sp.is_unknown(i))
    codec = Codec([(names[i], sp.get_score(i)) for i in range(n)], byte_ids, silent, sp.unk_id())
    codec.known = Chosen(remembered)
    return codec


def encode(docs: DataFrame, path: str, *, remembered: int = MEMO_BYTES) -> DataFrame:
    """(doc_id, source, n_tokens, ids, round_trip) of every row; source is null where ``docs`` has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, remembered)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(at, TEXTS_AT_ONCE)
                texts = part.column(2).to_pylist()
                ids = [codec.encode(t) for t in texts]
                back = [codec.decode(x.tolist()) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), lists, pa.array(back)], ["doc_id", "source", "n_tokens", "ids", "round_trip"])

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string").alias("source")
    rows = docs.select(F.col("doc_id").cast("long"), source, F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (with a column ids) with the column text."""

    @F.pandas_udf("string")
    def back(ids):
        codec = load(path)
        return ids.map(lambda x: codec.decode(x.tolist()), na_action="ignore")

    return coded.withColumn("text", back("ids"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(model), remembered=REMEMBERED)
