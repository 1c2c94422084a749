"""Vectorised word hashing over Arrow string arrays.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; A-Z are folded to a-z. Every function
here works on whole texts; callers bound memory by the bytes of text in one call (``slices``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary array; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose text has up to ``budget`` bytes, or one row."""
    _, off = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + budget, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in bytes of every word, and n+1 offsets of the rows into them."""
    word = ~space[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = lens.astype(np.uint64) * _K1
    left = lens.copy()
    left[lens > _LONG] = 0
    live = np.flatnonzero(left)
    at = starts
    while len(live):
        every = len(live) == len(out)
        n = left if every else left[live]
        chunk = eights[at if every else at[live]] & _TAIL[np.minimum(n, 8)]
        h = ((out if every else out[live]) ^ chunk) * _K1
        h ^= h >> np.uint64(32)
        if every:
            out = h
        else:
            out[live] = h
        left = left - 8
        at = at + 8
        live = live[n > 8]
    for i in np.flatnonzero(lens > _LONG):
        s = int(starts[i])
        out[i] = np.frombuffer(hashlib.blake2b(data[s : s + int(lens[i])].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return mix(out)


def words(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows and n+1 offsets of the rows into them."""
    data, off = buffers(col)
    if lower:
        data = _LOWER[data]
    starts, lens, rows = word_spans(data, off)
    return hash_spans(data, starts, lens), rows


def shingles(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each row and n+1 offsets. A row of fewer words, but one at
    least, has its whole sequence as its one shingle; a row without words has none."""
    h, rows = words(col)
    n = np.diff(rows)
    owner = np.repeat(np.arange(len(n)), n)
    if len(h) == 0:
        return h, np.zeros(len(n) + 1, np.int64)
    acc = mix(h + _K2)
    for j in range(1, k):
        nxt = np.zeros_like(h)
        nxt[:-j or None] = h[j:]
        ok = np.arange(len(h)) + j < rows[owner + 1]
        acc = np.where(ok, mix(acc * _K1 + nxt), acc)
    first = np.arange(len(h)) - rows[owner]
    keep = (first + k <= n[owner]) | (first == 0)
    acc, owner = acc[keep], owner[keep]
    order = np.lexsort((acc, owner))
    acc, owner = acc[order], owner[order]
    new = np.ones(len(acc), dtype=bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    acc, owner = acc[new], owner[new]
    return acc, np.searchsorted(owner, np.arange(len(n) + 1))


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32), pa.int32()), pa.array(values, kind))


def planes(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    width = x.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(len(x).to_bytes(8, "little") + x.view(np.uint8).reshape(-1, width).T.tobytes())


def unplanes(body: bytes, dtype: type) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, 8).reshape(width, n).T).reshape(-1).view(dtype)
