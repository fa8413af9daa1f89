"""Block-gzipped VCF files with a tabix index (``path.tbi``) as a Python data source.

A file is cut at record starts that the index names, about ``split_bytes`` apart, so one file is many tasks. ``regions``
(``chr1:100-200,chr2``) or filters on chrom and pos (where Spark hands filters to Python sources:
``spark.sql.python.filterPushdown.enabled``) leave out what cannot hold a record of them; a contig that the index doesn't know has no
records. Rows have the columns of the text reader, in its order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import index
from .bam import SPLIT_BYTES, Blocks
from .files import exists, opened

SCHEMA = "chrom string, pos bigint, id string, ref string, alt array<string>, qual double, filter string, info string, rest string, ord struct<file:string,block:bigint,line:bigint>"


def lines(blocks: Blocks, end: int) -> Iterator[bytes]:
    """Lines that start before the virtual offset ``end``."""
    while blocks.offset() < end:
        parts = []
        while True:
            k = blocks.data.find(b"\n", blocks.used)
            if k >= 0:
                parts.append(blocks.data[blocks.used : k])
                blocks.used = k + 1
                break
            parts.append(blocks.data[blocks.used :])
            blocks.used = len(blocks.data)
            if blocks.offset() == 1 << 62:
                break
        yield b"".join(parts)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def record(line: bytes) -> tuple:
    f = line.decode().split("\t", 8)
    f += [None] * (9 - len(f))
    alt = [] if f[4] in (".", None) else f[4].split(",")
    return f[0], int(f[1]), f[2], f[3], alt, _number(f[5] or ""), f[6], f[7], f[8]


class VcfReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.regions = index.parse_regions(options["regions"]) if options.get("regions") is not None else None
        self.chroms: set[str] | None = None
        self.low, self.high = 0, index.LAST

    def wanted(self, contigs: dict) -> list[tuple[str, int, int]]:
        every = self.regions if self.regions is not None else [(c, 0, index.LAST) for c in contigs]
        return [(c, max(a, self.low), min(b, self.high)) for c, a, b in every if c in contigs and (self.chroms is None or c in self.chroms) and max(a, self.low) < min(b, self.high)]

    def partitions(self):
        with opened(self.path + ".tbi") as f:
            contigs = index.read_tbi(f)
        places = [p for c in contigs.values() for p in c.linear if p]
        ranges = index.merged([r for c, a, b in self.wanted(contigs) for r in contigs[c].ranges(a, b)])
        return [InputPartition(r) for r in index.cut(ranges, places, self.split)]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:  # no range holds what is asked for
            return
        start, end = partition.value
        spans: dict[str, list[tuple[int, int]]] = {}
        for c, a, b in self.regions or []:
            spans.setdefault(c, []).append((a, b))
        with opened(self.path) as f:
            for n, line in enumerate(lines(Blocks(f, start), end)):
                if not line or line.startswith(b"#"):
                    continue
                row = record(line)
                if self.regions is None or any(a < row[1] <= b for a, b in spans.get(row[0], [])):
                    yield (*row, (self.path, start, n))


class NarrowedReader(VcfReader):
    """For sessions that hand filters to Python sources; in others Spark refuses a reader that takes them."""

    def pushFilters(self, filters: list[Filter]):
        """Narrows what is read; Spark applies the filters again, since only whole chunks are left out."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("chrom",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = named if self.chroms is None else self.chroms & named
            elif f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute == ("pos",):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value - 1)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f


class VcfSource(DataSource):
    @classmethod
    def name(cls):
        return "indexed_vcf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return NarrowedReader(self.options) if self.options.get("filters") == "true" else VcfReader(self.options)


def indexed(path: str) -> bool:
    return path.endswith(".gz") and exists(path + ".tbi")


def read_indexed(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(VcfSource)
    return spark.read.format("indexed_vcf").options(filters=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"), **options).load(path)
