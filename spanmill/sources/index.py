"""Indexes of block-gzipped, sorted files: which byte ranges may hold the records of a region.

The binning index of .bai and .tbi files: 6 levels of bins of 2^29 down to 2^14 bases, each with chunks (virtual offsets from, to), and for
each 2^14 bases the smallest offset of a record that reaches into them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from .bam import Blocks

# Shifts of the six levels, and the number of the bin that holds statistics only.
SHIFTS = (29, 26, 23, 20, 17, 14)
STATISTICS = 37_450
LAST = 1 << 29


@dataclass
class Contig:
    chunks: dict[int, list[tuple[int, int]]]
    linear: list[int]

    def ranges(self, start: int, end: int) -> list[tuple[int, int]]:
        """Chunks, merged and ascending, of all records that reach into start..end (0-based, end exclusive)."""
        start, end = max(0, start), min(end, LAST)
        if start >= end:
            return []
        first, found = 0, []
        for shift in SHIFTS:
            for b in range(first + (start >> shift), first + ((end - 1) >> shift) + 1) if len(self.chunks) > (end - 1 >> shift) - (start >> shift) else sorted(self.chunks):
                if first + (start >> shift) <= b <= first + ((end - 1) >> shift):
                    found += self.chunks.get(b, [])
            first += 1 << (29 - shift)
        least = self.linear[min(start >> 14, len(self.linear) - 1)] if self.linear else 0
        return merged([(max(a, least), b) for a, b in found if b > least])

    def everything(self) -> list[tuple[int, int]]:
        return merged([c for b, chunks in self.chunks.items() if b != STATISTICS for c in chunks])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(ranges: list[tuple[int, int]], places: list[int], size: int) -> list[tuple[int, int]]:
    """``ranges`` cut at those of ``places`` (record starts) that lie some ``size`` bytes of the file apart."""
    out, places = [], sorted(set(places))
    for a, b in ranges:
        last = a
        for p in places:
            if last < p < b and (p >> 16) - (last >> 16) >= size:
                out.append((last, p))
                last = p
        out.append((last, b))
    return out


def _contig(data: bytes, k: int) -> tuple[Contig, int]:
    chunks: dict[int, list[tuple[int, int]]] = {}
    (bins,) = struct.unpack_from("<i", data, k)
    k += 4
    for _ in range(bins):
        number, n = struct.unpack_from("<Ii", data, k)
        flat = struct.unpack_from(f"<{2 * n}Q", data, k + 8)
        chunks[number] = list(zip(flat[::2], flat[1::2], strict=True))
        k += 8 + 16 * n
    (n,) = struct.unpack_from("<i", data, k)
    linear, before = [], 0
    for x in struct.unpack_from(f"<{n}Q", data, k + 4):
        before = x or before  # stretches without records have no offset of their own
        linear.append(before)
    return Contig(chunks, linear), k + 4 + 8 * n


def read_bai(data: bytes, names: list[str]) -> dict[str, Contig]:
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    out, k = {}, 8
    for i in range(struct.unpack("<i", data[4:8])[0]):
        contig, k = _contig(data, k)
        if i < len(names):
            out[names[i]] = contig
    return out


def read_tbi(f) -> dict[str, Contig]:
    """Contigs by name, in file order."""
    blocks, parts = Blocks(f), []
    while part := blocks.read(1 << 20):
        parts.append(part)
    data = b"".join(parts)
    if data[:4] != b"TBI\1":
        raise ValueError("not a tabix index")
    n, *_, size = struct.unpack_from("<8i", data, 4)
    names = data[36 : 36 + size].split(b"\0")[:n]
    out, k = {}, 36 + size
    for name in names:
        out[name.decode()], k = _contig(data, k)
    return out


def parse_regions(text: str) -> list[tuple[str, int, int]]:
    """``chr1:100-200,chr2`` (1-based, inclusive) as (chrom, start, end), 0-based with the end exclusive; those of a chromosome merged."""
    by: dict[str, list[tuple[int, int]]] = {}
    for part in filter(None, text.split(",")):
        chrom, colon, span = part.rpartition(":")
        if not colon or not span.replace("-", "").isdigit():
            chrom, span = part, f"1-{LAST}"
        a, _, b = span.partition("-")
        by.setdefault(chrom, []).append((max(0, int(a) - 1), int(b or a)))
    return [(c, a, b) for c, spans in by.items() for a, b in merged(spans)]
