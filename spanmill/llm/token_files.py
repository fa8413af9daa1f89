"""Token-ID files: flat unsigned integers, 64-bit document offsets, prefix-summed bases.

Documents are ranged by doc_id; each partition is sorted, encoded and streamed into three flat little-endian
files: ids (uint16, or uint32 for a vocabulary beyond 65,536), offsets (uint64, one more than
documents, counted from the file's own start) and doc_ids (int64). A task names its files uniquely and
reports them, with their counts, only when they are complete; so a task that ran twice leaves a file that nobody
reads. The reports become the manifest, whose running sum of counts gives each file's base in the whole.
Readers memory-map local files; other stores are read through their file system.

The library's defaults hold: the string of a special token in a text becomes that token. A text is encoded in pieces which the pre-tokenizer of a byte-level BPE never joins, so the ids are those of
the whole text: runs of letters, digits, other signs or white space where all characters are in Latin
blocks, else runs between white space; a text that holds a special token's string is encoded whole. The pieces' ids are
remembered, up to a bound; new pieces that start with a space go to the library as one text, whose ids part where a token
starts with a space. A file holds some 200,000 documents or 256 MB of text, and is read back in slices.

Defined results: a null or empty text is the end id alone; null doc_ids come first and are stored as the
smallest int64; rows with equal doc_ids are in the order of their texts; an empty table gives an empty
manifest; other columns don't matter.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Chosen, scratch, settled, table

ROWS_PER_FILE, BYTES_PER_FILE = 200_000, 256 << 20
IDS_AT_ONCE = 1 << 20
LONGEST = 64
REMEMBERED = 64 << 20  # bytes of pieces and their ids
TEXTS_AT_ONCE = 64
NULL_ID = -(1 << 63)
MANIFEST = "part int, name string, width int, n_docs long, n_ids long"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_LATIN = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_OTHER = re.compile(f"[^\t-\r -~{_LETTERS}]")
_ODD = re.compile("[\x1c-\x1f\x85\ud800-\udfff]")


class Encoder:
    """Texts to ids with a tokenizers file."""

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end_id], self.kind).tobytes()
        self.ids = Chosen(REMEMBERED)
        spaced = [i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.spaced[spaced] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        coded, kind = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], "H" if self.width == 2 else "I"
        return [struct.pack(f"<{len(x)}{kind}", *x) for x in coded]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that each start with their only white space, a space."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, self.kind)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(pieces):
            return self._plain(pieces)
        raw, cuts = ids.tobytes(), [*(starts * self.width).tolist(), len(ids) * self.width]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _pieces(self, text: str) -> list[str]:
        if any(x in text for x in self.special):
            return [text]
        return _LATIN.findall(text) if not _OTHER.search(text) else [text] if _ODD.search(text) else _PIECES.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids and the end id, as little-endian bytes of ``width`` each."""
        out: list[bytes] = []
        known = self.ids
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            pieces = [self._pieces(t) if t else [] for t in texts[at : at + TEXTS_AT_ONCE]]
            every = [p for x in pieces for p in x]
            coded = list(map(known.get, every))
            missing = [i for i, x in enumerate(coded) if x is None]
            new = {every[i] for i in missing}
            older = {p: x for p in new if (x := known.again(p)) is not None}
            new.difference_update(older)
            spaced = [p for p in new if p[0] == " " and len(p) > 1 and not p[1:2].isspace()]
            plain = list(new.difference(spaced))
            found = dict(zip(plain + spaced, self._plain(plain) + self._joined(spaced), strict=True))
            for i in missing:
                coded[i] = found[every[i]] if every[i] in found else older[every[i]]
            for p, ids in found.items():
                if len(p) <= LONGEST:
                    known.keep(p, ids)
            start = 0
            for x in pieces:
                out.append(b"".join([*coded[start : start + len(x)], self.end]))
                start += len(x)
        return out


@cache
def _encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def _store(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    return store, path


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(path, end_id)
        store, top = _store(folder)
        files, name, ends, total = None, f"part-{part:06d}-{uuid.uuid4().hex}", 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if files is None:
                store.create_dir(top, recursive=True)
                files = [store.open_output_stream(f"{top}/{name}.{x}") for x in ("ids", "offsets", "docs")]
                files[1].write(np.zeros(1, "<u8").tobytes())
            files[2].write(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                coded = encoder.encode(b.column(1).slice(at, TEXTS_AT_ONCE).to_pylist())
                sizes = np.cumsum([len(x) // encoder.width for x in coded]) + total
                total = int(sizes[-1])
                files[0].write(b"".join(coded))
                files[1].write(sizes.astype("<u8").tobytes())
            ends += b.num_rows
        if files is not None:
            for f in files:
                f.close()
            row = {"part": [part], "name": [name], "width": [encoder.width], "n_docs": [ends], "n_ids": [total]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder``; returns the manifest with each file's ``base``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_FILE), -(-size // BYTES_PER_FILE))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    manifest = settled(dealt.mapInArrow(_write(folder, tokenizer, end_id), MANIFEST))
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _array(store, path: str, kind: str):
    """A slicer (first, last) of a file's numbers; local files are mapped into memory, others read range by range."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        whole = np.frombuffer(pa.memory_map(path).read_buffer(), kind)
        return lambda a, b: whole[a:b]
    file, width = store.open_input_file(path), np.dtype(kind).itemsize
    return lambda a, b: np.frombuffer(file.read_at((b - a) * width, a * width), kind)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for b in batches:
            for row in b.to_pylist():
                ids, offsets, docs = (_array(store, f"{top}/{row['name']}.{x}", kind) for x, kind in (("ids", f"<u{row['width']}"), ("offsets", "<u8"), ("docs", "<i8")))
                ends, at = offsets(0, row["n_docs"] + 1).astype(np.int64), 0
                while at < row["n_docs"]:
                    # as many documents as IDS_AT_ONCE ids, one at least
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + IDS_AT_ONCE, "right")) - 1)
                    part, cuts, some = docs(at, to), (ends[at : to + 1] - ends[at]).tolist(), ids(ends[at], ends[to])
                    crc = [zlib.crc32(some[x:y].astype("<u4").tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int64(), mask=part == NULL_ID), pa.array(ends[at:to] + row["base"]), pa.array(np.diff(ends[at : to + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = to

    return run


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "ids")
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(tokenizer)), folder)
