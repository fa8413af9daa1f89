"""What reads show at sites: pairs of a read and a site, a batch at a time.

A CIGAR string has no fixed number of blocks, and Spark interprets every step of a loop over an array; here all blocks of a batch are
one set of arrays. Places are 0-based.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "=ACMGRSVTWYHKDBN"
SHOWN = "is_alt boolean, sig string, base int, ed double, nbq double, fbq double, al int, mm int, sc double, bq double"
UNKNOWN_SIZE = 150  # of a read without a sequence


def shown(flank: int, near: int = 2, around: int = 3) -> Column:
    """struct of ``SHOWN`` from the columns start, cigar, seq, quals of a read and pos0, is_insertion, indel_size, flank, flank_start of a site.

    is_alt: whether some block stands for the indel, at most ``near`` off and of about its length; sig: the operations at most ``around`` off, of
    such reads only; base: number of the base at the site, or -1; ed: distance to the read's end; nbq and fbq: mean quality from ``flank`` - 1 before to
    ``flank`` + 1 after the site, and from ``flank`` before to ``flank`` after; al and mm: aligned and differing bases in the latter; sc: soft clips; bq: mean quality.

    What runs inside the tasks stands here as a whole, so they needn't have this package.
    """
    bases, unknown, width = BASES, UNKNOWN_SIZE, 2 * flank + 2

    @F.arrow_udf(SHOWN)
    def run(start: pa.Array, cigar: pa.Array, seq: pa.Array, quals: pa.Array, pos0: pa.Array, insertion: pa.Array, size: pa.Array, told: pa.Array, told_start: pa.Array) -> pa.Array:
        def letters(texts: pa.Array) -> tuple:
            """(bytes of all texts, start of each, length of each); a character is a byte."""
            a = texts.cast(pa.large_string())
            data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
            if data.size and data.max() > 127:
                return letters(pa.array([x and x.encode("ascii", "replace").decode() for x in texts.to_pylist()], pa.large_string()))
            at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
            return data, at[:-1], at[1:] - at[:-1]

        def picked(data: np.ndarray, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
            """The values at places, 0 where not asked for."""
            out = np.zeros(ok.shape, np.int64)
            out[ok] = data[at[ok]]
            return out

        def upper(x: np.ndarray) -> np.ndarray:
            return np.where((x >= 97) & (x <= 122), x - 32, x)

        n = len(start)
        names = ["is_alt", "sig", "base", "ed", "nbq", "fbq", "al", "mm", "sc", "bq"]
        kinds = [pa.bool_(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        if not n:
            return pa.StructArray.from_arrays([pa.array([], k) for k in kinds], names=names)
        number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
        start, pos, size, told_start, insertion = number(start), number(pos0), number(size), number(told_start), number(insertion).astype(bool)

        # blocks: row, operation, length, start on the reference (r) and on the read (q)
        data, at, length = letters(cigar)
        end = at[-1] + length[-1]
        digit = (data >= 48) & (data <= 57)
        ops = np.flatnonzero(np.isin(data[:end], np.frombuffer(b"MIDNSHP=X", np.uint8)))
        ops = ops[ops >= at[0]]
        row = np.searchsorted(at, ops, "right") - 1
        first = at[row]
        value, ten, going, k = np.zeros(len(ops), np.int64), 1, np.ones(len(ops), bool), 1
        known = None
        while going.any():
            place = ops - k
            going = going & (place >= first)
            going[going] = digit[place[going]]
            value[going] += (data[place[going]].astype(np.int64) - 48) * ten
            known = going if known is None else known
            ten, k = ten * 10, k + 1
        if len(ops):
            ops, row, value = ops[known], row[known], value[known]
        op = data[ops]
        kind = {c: op == ord(c) for c in "MIDNSX="}
        match = kind["M"] | kind["="] | kind["X"]
        here = np.searchsorted(row, row, "left")  # the row's first block

        def before(takes: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(np.where(takes, value, 0))])
            return total[:-1] - total[here]

        r, q = start[row] + before(match | kind["D"] | kind["N"]), before(match | kind["I"] | kind["S"])
        clipped = np.bincount(row, np.where(kind["S"], value, 0), n)

        p = pos[row]
        like = np.abs(value - size[row]) <= np.maximum(1, size[row] // 2)
        beside = lambda w: (kind["I"] & (np.abs(r - p) <= w), kind["D"] & (r - w <= p) & (p <= r + value + w))
        inserted, deleted = beside(near)
        alt = np.bincount(row, like & np.where(insertion[row], inserted, deleted), n) > 0
        inserted, deleted = beside(around)
        kept = np.flatnonzero(alt[row] & (inserted | deleted | kind["S"] | (match & (r + value >= p - around) & (r <= p + around))))
        brief = np.where(match, np.minimum(value, 10), np.where(kind["S"], np.minimum(value, 20), value))
        words: dict = {int(i): [] for i in np.flatnonzero(alt)}
        for i, c, v in zip(row[kept].tolist(), op[kept].tolist(), brief[kept].tolist(), strict=True):
            words[i].append(f"{chr(c)}{v}")
        sig = [None] * n
        for i, w in words.items():
            sig[i] = " ".join(w)

        # the read's place at each place of the window, -1 without one
        low = pos - flank
        close = np.flatnonzero(match & (r < low[row] + width) & (r + value > low[row]))
        off, wide, at_row, on_read = (r - low[row])[close], value[close], row[close], q[close]
        window = np.full((n, width), -1, np.int64)
        for j in range(width):
            holds = (off <= j) & (j < off + wide)
            window[at_row[holds], j] = on_read[holds] + j - off[holds]
        aligned = window >= 0
        site = window[:, flank]

        at = quals.offsets.to_numpy().astype(np.int64)
        data = quals.values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n_quals, sums = at[1:] - at[:-1], np.concatenate([[0], np.cumsum(data)])
        bq = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n_quals, 1)
        rated = aligned & (window < n_quals[:, None])
        quality = picked(data, window + at[:-1, None], rated)
        total, count = quality.sum(1), rated.sum(1)
        less = lambda j: np.where(count > rated[:, j], (total - quality[:, j]) / np.maximum(count - rated[:, j], 1), 0.0)

        data, at, n_seq = letters(seq)
        whole = (n_quals > 0) & (n_seq > 0)
        there = aligned & (window < n_seq[:, None])
        own = picked(data, window + at[:, None], there)
        data, at, length = letters(told)
        place = low[:, None] + np.arange(width) - told_start[:, None]
        both = there & (place >= 0) & (place < length[:, None])
        differ = (both & (upper(own) != picked(data, place + at[:, None], both))).sum(1)

        code = np.full(256, -1, np.int32)
        code[np.frombuffer(bases.encode(), np.uint8)] = np.arange(len(bases))
        size_read = np.where(n_seq > 0, n_seq, unknown)
        columns = [
            alt, sig, np.where(there[:, flank], code[own[:, flank]], -1), np.where(site >= 0, np.minimum(site, np.maximum(size_read - site, 0)), size_read // 2).astype(np.float64),
            less(0), np.where(whole, less(width - 1), 0.0), np.where(whole, count - rated[:, width - 1], 0), np.where(whole, differ, 0), clipped, bq,
        ]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run("start", "cigar", "seq", "quals", "pos0", "is_insertion", "indel_size", "flank", "flank_start")
