"""Arrow text batches as flat byte arrays.

Operators that run in ``mapInArrow`` read a text column as one contiguous
UTF-8 buffer with document offsets and work on it with numpy; no Python
object is made per document or word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once (a longer document is worked on alone).
CHUNK_BYTES = 1 << 20

#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = 0x9E3779B97F4A7C15


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` (a function for ``mapInArrow``) that hands its memory back when its task ends.

    Python workers stay between tasks and stages; without this each keeps what
    its largest task had needed, beside whatever the executor runs next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        _powers.cache_clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value per byte value.
BYTE_CODE = mix64((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_ODD))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int, base: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (sizes are rounded up, so that they are kept)."""
    size = max(1 << 16, 1 << (int(n) - 1).bit_length() if n > 1 else 1)
    p, q = _powers(size, base)
    return p[:n], q[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of ``codes[i] * base**i`` modulo 2**64, one more than codes."""
    p, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each range [start, end) of what ``prefix_sums`` read."""
    _, q = powers(len(prefix))
    h = (prefix[end] - prefix[start]) * q[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(_ODD))


class Texts:
    """Some documents of a batch: ``data`` (uint8), ``offsets`` (one more than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int):
        self.data, self.offsets, self.row, self.n = data, offsets, row, len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word (a run of bytes that aren't SPACE)."""
        if not len(self.data):
            z = np.zeros(0, np.int64)
            return z, z, z
        space = SPACE[self.data]
        inside = ~space
        first = inside.copy()
        first[1:] &= space[:-1]
        at = self.offsets[:-1]
        at = at[at < len(self.data)]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= space[1:]
        at = self.offsets[1:] - 1
        at = at[at >= 0]
        last[at] = inside[at]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1

    def bounds(self, doc: np.ndarray) -> np.ndarray:
        """Where each document's part of a sorted per-item document column begins and ends."""
        return np.searchsorted(doc, np.arange(self.n + 1))

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The documents of a batch in runs of at most ``limit`` text bytes (null: empty)."""
    col = batch.column(batch.schema.get_field_index(column)).fill_null("")
    if not len(col):
        return
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield Texts(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], lo)
        lo = hi


def window_hash(codes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive codes of one document, and where they start."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for t in range(k):
        h = h * np.uint64(_ODD) + codes[t:t + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix64(h[at]), at


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices ``values[bounds[i]:bounds[i+1]]`` as a binary column."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer((np.asarray(bounds, np.int64) * width).astype(np.int32)),
        pa.py_buffer(np.ascontiguousarray(values))])
