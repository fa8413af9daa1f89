"""BAM files as a Python data source: ``spark.read.format("bam").load(path)`` after ``register(spark)``.

With an index (``path.bai``) a file is split at the record starts that its linear index names, about
``split_bytes`` apart, and the option ``chroms`` (names with commas between) leaves out the ranges of other references; the
option ``regions`` (``chr1:100-200,chr2``) reads only the chunks that the index names for them, and only reads that reach into
them. Without an index a file is read by a single task. Rows have the columns of the SAM reader.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import exists, opened

SCHEMA = "qname string, flag int, chrom string, start bigint, mapq int, cigar string, isize bigint, seq string, quals array<int>, nm bigint, ord struct<file:string,block:bigint,line:bigint>"
SPLIT_BYTES = 64 << 20
CIGAR = re.compile(r"([0-9]+)([MIDNSHP=X])")
# Codes of the BAM format.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
INTEGERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


class Blocks:
    """Bytes of a block-gzipped file from a virtual offset on; ``at`` is the offset of the current block."""

    def __init__(self, f, offset: int = 0):
        self.f, self.next, self.data, self.used = f, offset >> 16, b"", 0
        self.at = self.next
        if offset & 0xFFFF:
            self._more()
            self.used = offset & 0xFFFF

    def _more(self) -> bool:
        self.f.seek(self.next)
        head = self.f.read(12)
        if len(head) < 12:
            return False
        extra = self.f.read(struct.unpack("<H", head[10:12])[0])
        k, size = 0, None
        while k + 4 <= len(extra):
            n = struct.unpack("<H", extra[k + 2 : k + 4])[0]
            if extra[k : k + 2] == b"BC":
                size = struct.unpack("<H", extra[k + 4 : k + 6])[0] + 1
            k += 4 + n
        if head[:2] != b"\x1f\x8b" or size is None:
            raise ValueError("not a block-gzipped file")
        body = self.f.read(size - 12 - len(extra))
        self.data, self.used, self.at, self.next = zlib.decompress(body[:-8], -15), 0, self.next, self.next + size
        return True

    def offset(self) -> int:
        while self.used >= len(self.data):
            if not self._more():
                return 1 << 62
        return self.at << 16 | self.used

    def read(self, n: int) -> bytes:
        out = []
        while n:
            part = self.data[self.used : self.used + n]
            if not part:
                if not self._more():
                    break
                continue
            out.append(part)
            self.used += len(part)
            n -= len(part)
        return b"".join(out)


def header(blocks: Blocks) -> list[str]:
    """Reference names; leaves ``blocks`` at the first record."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        names.append(blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode())
        blocks.read(4)
    return names


def index_offsets(data: bytes) -> list[list[int]]:
    """For each reference the record starts that a .bai file's linear index names, ascending."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    found, k = [], 8
    for _ in range(struct.unpack("<i", data[4:8])[0]):
        (bins,) = struct.unpack_from("<i", data, k)
        k += 4
        for _ in range(bins):
            k += 8 + 16 * struct.unpack_from("<i", data, k + 4)[0]
        (n,) = struct.unpack_from("<i", data, k)
        found.append(sorted(set(struct.unpack_from(f"<{n}Q", data, k + 4)) - {0}))
        k += 4 + 8 * n
    return found


def edit_distance(tags: bytes) -> int | None:
    k = 0
    while k + 3 <= len(tags):
        name, kind = tags[k : k + 2], chr(tags[k + 2])
        k += 3
        if kind in "ZH":
            k = tags.index(b"\0", k) + 1
            continue
        if kind == "B":
            sub, n = chr(tags[k]), struct.unpack_from("<i", tags, k + 1)[0]
            k += 5 + n * SIZES[sub]
            continue
        if name == b"NM" and kind in INTEGERS:
            return struct.unpack_from(INTEGERS[kind], tags, k)[0]
        k += SIZES[kind]
    return None


def record(raw: bytes, names: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, _, _, isize = struct.unpack_from("<iiBBHHHiiii", raw)
    k = 32 + n_name
    cigar = struct.unpack_from(f"<{n_cigar}I", raw, k)
    k += 4 * n_cigar
    packed = raw[k : k + (n_seq + 1) // 2]
    k += len(packed)
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
    quals = list(raw[k : k + n_seq])
    text = "".join(f"{c >> 4}{OPS[c & 15]}" for c in cigar) or "*"
    chrom = names[ref] if ref >= 0 else "*"
    return raw[32 : 31 + n_name].decode(), flag, chrom, pos, mapq, text, isize, seq, quals, edit_distance(raw[k + n_seq :])


def _reaches(row: tuple, spans: dict[str, list[tuple[int, int]]]) -> bool:
    """Whether a read covers a base of some span of its chromosome."""
    own = spans.get(row[2])
    if not own:
        return False
    end = row[3] + max(1, sum(int(n) for n, op in CIGAR.findall(row[5]) if op in "MDN=X"))
    return any(row[3] < b and a < end for a, b in own)


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.chroms = set(options["chroms"].split(",")) if options.get("chroms") is not None else None
        self.regions = options.get("regions")

    def _of_regions(self, names: list[str]):
        from . import index

        with opened(self.path + ".bai") as f:
            contigs = index.read_bai(f.read(), names)
        spans = [x for x in index.parse_regions(self.regions) if x[0] in contigs]
        ranges = index.merged([r for c, a, b in spans for r in contigs[c].ranges(a, b)])
        return [InputPartition(r) for r in index.cut(ranges, [p for c in contigs.values() for p in c.linear if p], self.split)]

    def partitions(self):
        """Byte ranges of some ``split_bytes``; with an index and ``chroms``, only those that may hold reads of these."""
        with opened(self.path) as f:
            blocks = Blocks(f)
            names = header(blocks)
            first = blocks.offset()
        if not exists(self.path + ".bai"):
            return [InputPartition((first, 1 << 62))]
        if self.regions is not None:
            return self._of_regions(names)
        with opened(self.path + ".bai") as f:
            offsets = index_offsets(f.read())
        # a sorted file has one reference behind the other: each runs up to the next one's first record
        starts = [(o[0], i) for i, o in enumerate(offsets) if o]
        stops = {i: stop for (_, i), (stop, _) in zip(starts, [*starts[1:], (1 << 62, -1)], strict=True)}
        if starts != sorted(starts) or not starts:
            return [InputPartition((first, 1 << 62))]
        ranges = []
        for n, (start, i) in enumerate(starts):
            cuts = [start if n else first]
            cuts += [o for o in offsets[i] if o > cuts[0]]
            if self.chroms is not None and names[i] not in self.chroms:
                continue
            kept = cuts[:1]
            for o in cuts[1:]:
                if (o >> 16) - (kept[-1] >> 16) >= self.split:
                    kept.append(o)
            ranges += zip(kept, [*kept[1:], stops[i]], strict=True)
        return [InputPartition(r) for r in ranges]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:  # no range holds what is asked for
            return
        start, end = partition.value
        spans = None
        if self.regions is not None:
            from . import index

            spans = {}
            for c, a, b in index.parse_regions(self.regions):
                spans.setdefault(c, []).append((a, b))
        with opened(self.path) as f:
            names = header(Blocks(f))
            blocks, line = Blocks(f, start), 0
            while blocks.offset() < end:
                size = blocks.read(4)
                if len(size) < 4:
                    return
                row = record(blocks.read(struct.unpack("<i", size)[0]), names)
                if spans is None or _reaches(row, spans):
                    yield (*row, (self.path, start, line))
                line += 1


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str, **options):
    register(spark)
    return spark.read.format("bam").options(**options).load(path)
