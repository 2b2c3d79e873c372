"""Words and n-grams of many texts at once, as 64-bit hashes: shared by operators that count or compare them.

A hash of a word is a polynomial in an odd constant over its bytes, modulo 2^64, taken from one running sum over all texts of a group (the constant has an inverse, so where a
word stands makes no difference), then mixed with its length. Two of n different words or n-grams have one hash with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.near_duplicates import BYTE_CODES, M2, M3, mix

#: A-Z become a-z; no other character changes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
INVERSE = np.uint64(pow(int(M2), -1, 1 << 64))
#: Bytes of text that are worked on at once, about.
GROUP_BYTES = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def byte_table(members: bytes) -> np.ndarray:
    """Which of the 256 bytes are in ``members``."""
    return np.isin(np.arange(256), np.frombuffer(members, np.uint8))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1), kept for the next group."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, GROUP_BYTES), base)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * GROUP_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


class Words:
    """The words of a group of texts: ``hash``, ``start`` and ``stop`` (bytes in ``data``), ``text`` (number of the text) and ``piece`` of each; ``ends[i]``: words before the end of text i."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, is_break: np.ndarray | None = None):
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        self.data = (raw[at[0] : at[-1]].to_pybytes() if raw is not None and at[-1] > at[0] else b"").translate(LOWER)
        data = np.frombuffer(self.data, np.uint8)
        at = at - at[0]
        inside = is_word[data]
        change = np.ones(len(data) + 1, bool)
        change[1:-1] = inside[1:] != inside[:-1]
        change[at] = True  # a word ends where its text does
        edge = np.flatnonzero(change)
        own = inside[edge[:-1]]
        self.start, self.stop = edge[:-1][own], edge[1:][own]
        self.ends = np.searchsorted(self.start, at[1:])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.ends, prepend=0))
        if len(data):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * powers(M2, len(data)))])
            h = (run[self.stop] - run[self.start]) * powers(INVERSE, len(data))[self.start]
            self.hash = mix(h + (self.stop - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        if is_break is not None:
            self.piece = np.cumsum(is_break[data])[self.start] + self.text if len(data) else self.text


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive ones."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for i in range(n):
        out = out * M3 + hashes[i : i + len(out)]
    return mix(out)


def groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``size`` bytes (a longer text is one of its own), and where each begins."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
    at = total = 0
    for i, k in enumerate(sizes.tolist()):
        if i > at and total + k > size:
            yield at, texts.slice(at, i - at)
            at, total = i, 0
        total += k
    if at < len(texts):
        yield at, texts.slice(at)


class Cells:
    """A task's own table of counts, each at most ``most``. It hands over blocks of cells, the used ones of a block alone where they are few: never more than follows from what the task has counted."""

    def __init__(self, n: int, most: int):
        self.table, self.most, self.waiting, self.size = np.zeros(n, np.min_scalar_type(most)), most, [], 0

    def add(self, cells: np.ndarray) -> None:
        self.waiting.append(cells.astype(np.uint32))
        self.size += len(cells)
        if self.size >= WAITING:
            self.flush()

    def flush(self) -> None:
        at, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *self.waiting]), return_counts=True)
        self.table[at] = np.minimum(self.table[at] + n, self.most)
        self.waiting, self.size = [], 0

    def blocks(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        rows = self.table.reshape(-1, BLOCK)
        used = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(used), 256):
            out: list[tuple[bytes, bytes]] = []
            for c in rows[used[i : i + 256]]:
                at = np.flatnonzero(c).astype(np.uint16)
                out.append((at.tobytes(), c[at].tobytes()) if len(at) * (2 + c.itemsize) < len(c) * c.itemsize else (b"", c.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 256], pa.int32()), pa.array([a for a, _ in out], pa.binary()), pa.array([c for _, c in out], pa.binary())], names=["block", "at", "counts"])


#: Cells of a block, and how many wait before they are added.
BLOCK, WAITING = 1 << 12, 1 << 21
CELLS = "block int, at binary, counts binary"


def merged(parts: DataFrame, n: int, most: int) -> np.ndarray:
    """The sum of the tables of all tasks (rows of ``CELLS``), each count at most ``most``. Blocks of one number are added where they meet; the driver gets one of each, a size that is fixed by ``n``."""
    kind = np.min_scalar_type(most)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, at, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                total = sums.setdefault(i, np.zeros(BLOCK, kind))
                at, c = np.frombuffer(at.as_buffer(), np.uint16), np.frombuffer(c.as_buffer(), kind).astype(np.uint64)
                where = at if len(at) else slice(None)
                total[where] = np.minimum(total[where] + c, most)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})

    out = np.zeros(n, kind)
    for r in parts.repartition(16, F.col("block")).mapInArrow(add, "block int, counts binary").toLocalIterator():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, kind)
    return out
