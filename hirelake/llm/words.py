"""Word hashes of many UTF-8 texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import held

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x2545F4914F6CDD1D  # odd, so that powers have inverses modulo 2**64
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and their inverses; more of them than usual are made but not kept."""

    def __init__(self):
        self.up, self.down = self._made(CHUNK_BYTES + (1 << 17))

    @staticmethod
    def _made(size: int) -> list[np.ndarray]:
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            out.append(np.multiply.accumulate(factors))
        return out

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return (self.up, self.down) if len(self.up) >= n else self._made(n)


def word_hashes(data: np.ndarray, inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the runs of ``inside`` bytes; A-Z count as a-z.

    ``cut`` has one place more than ``data`` and is set where a run may not cross.
    """
    n = len(data)
    before = np.append(False, inside[:-1]) & ~cut[:n]
    after = np.append(inside[1:], False) & ~cut[1:]
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = held(("words",), _Powers).upto(n)
    sums = np.append(np.uint64(0), np.cumsum(_RANDOM[_LOWER[data]] * up[:n]))
    return begin, end, mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _MIX)


def chunks(texts: pa.Array):
    """(slice, bytes, ends) of the texts, some at a time; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, len(texts))
        yield slice(i, j), data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j
