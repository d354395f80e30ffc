"""Packing documents into sequences of a fixed window by best-fit decreasing.

Each document's ids (plus an end id) are cut into full windows and a rest.  Rests are packed in
pools of some million tokens as they stream through a task: the longest first, each into the
open window whose remaining capacity is the smallest that still holds it, found in a segment
tree indexed by remaining capacity.  A pool's emptiest window is cut up at powers of two, which
need no padding.  Nothing is shuffled; a task holds one pool.

Cases: a null or empty text is its end id alone; repeated rows are packed once each; an empty
table gives an empty layout; a null doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only
from .tokens import token_bytes

WINDOW, END_ID, POOL = 4096, 2, 1 << 22
LAYOUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Segment tree over remaining capacities 0..window: the tightest capacity >= need."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window_id: int) -> None:
        self.stacks[capacity].append(window_id)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window id) of the tightest fit, removed from the tree; None if none fits."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to the first right sibling in use
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        got = self.stacks[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, got


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """Window and offset of each length (given in decreasing order), and the windows' fill."""
    tree, where, offset, fill = OpenWindows(window), [], [], []
    for n in lengths:
        got = tree.take(n)
        capacity, w = got or (window, len(fill))
        if got is None:
            fill.append(0)
        where.append(w)
        offset.append(window - capacity)
        fill[w] += n
        if capacity > n:
            tree.put(capacity - n, w)
    return where, offset, fill


Piece = tuple[int | None, int, int, int]  # document's place in the pool, start, length, offset


def pack_pool(sizes: list[int], window: int) -> list[list[Piece]]:
    """Pieces of each sequence for documents of ``sizes`` tokens."""
    full = [[(d, start, window, 0)] for d, n in enumerate(sizes) for start in range(0, n - window + 1, window)]
    rests = sorted(((n % window, d) for d, n in enumerate(sizes) if n % window), key=lambda x: (-x[0], x[1]))
    where, offset, fill = best_fit([n for n, _ in rests], window)
    packed: list[list[Piece]] = [[] for _ in fill]
    for (n, d), w, at in zip(rests, where, offset):
        packed[w].append((d, sizes[d] - n, n, at))
    if fill:
        least = min(range(len(fill)), key=fill.__getitem__)
        packed[least : least + 1] = cut_at_powers(packed[least], fill[least])
    return full + packed


def cut_at_powers(pieces: list[Piece], total: int) -> list[list[Piece]]:
    """The same tokens as sequences whose lengths are the powers of two that make up ``total``."""
    out, queue = [], [p[:3] for p in pieces]
    for size in (1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1):
        sequence, at = [], 0
        while at < size:
            d, start, n = queue.pop(0)
            take = min(n, size - at)
            sequence.append((d, start, take, at))
            if take < n:
                queue.insert(0, (d, start + take, n - take))
            at += take
        out.append(sequence)
    return out


def _pools(batches, tokenizer: str, end_id: int, pool_tokens: int, memory: tuple[int, ...]):
    """Lists of (doc_id, ids as bytes) of at least ``pool_tokens`` tokens, but for the last."""
    encode, end = token_bytes(tokenizer, *memory), np.array([end_id], dtype="<u4").tobytes()
    pool, held = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py()) + end
            pool.append((doc, ids))
            held += len(ids) // 4
            if held >= pool_tokens:
                yield pool
                pool, held = [], 0
    if pool:
        yield pool


def _mapped(documents: DataFrame, tokenizer: str, window: int, end_id: int, pool_tokens: int, memory: tuple[int, ...], emit, schema: str) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        for pool in _pools(batches, tokenizer, end_id, pool_tokens, memory):
            packed = pack_pool([len(ids) // 4 for _, ids in pool], window)
            yield from emit(pool, packed, base)
            base += len(packed)

    return documents.mapInArrow(run, schema)


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, pool_tokens: int = POOL, id_col: str = "doc_id", text_col: str = "text", memory: tuple[int, ...] = ()) -> DataFrame:
    """Layout rows (``LAYOUT``) of every piece; each id of a document lies in exactly one.

    ``memory``: bytes that a worker may keep word ids in, for chunks and for words; less of it costs time only.
    """

    def emit(pool, packed, base):
        rows = []
        for k, sequence in enumerate(packed):
            for d, start, n, at in sequence:
                doc, ids = pool[d]
                rows.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + k, at))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in LAYOUT.split(", ")])

    return _mapped(only(documents, doc_id=id_col, text=text_col), tokenizer, window, end_id, pool_tokens, memory, emit, LAYOUT)


def sequences(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0, pool_tokens: int = POOL, id_col: str = "doc_id", text_col: str = "text", memory: tuple[int, ...] = ()) -> DataFrame:
    """The packed ids: sequence_id, ids array<int> (padded, but for powers of two), n_tokens."""

    def emit(pool, packed, base):
        for first in range(0, len(packed), 256):
            rows = []
            for sequence in packed[first : first + 256]:
                got = np.frombuffer(b"".join(pool[d][1][4 * s : 4 * (s + n)] for d, s, n, _ in sequence), dtype="<u4").astype(np.int32)
                pad = 0 if len(got) & (len(got) - 1) == 0 else window - len(got)
                rows.append((np.concatenate([got, np.full(pad, pad_id, dtype=np.int32)]), len(got)))
            ids = pa.array(base + np.arange(first, first + len(rows)), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int64())], names=["sequence_id", "ids", "n_tokens"])

    return _mapped(only(documents, doc_id=id_col, text=text_col), tokenizer, window, end_id, pool_tokens, memory, emit, "sequence_id long, ids array<int>, n_tokens long")
