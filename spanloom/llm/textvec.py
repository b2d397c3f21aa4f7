"""Vectorised tokenising and hashing over Arrow string buffers.

Words are runs of bytes that are not ASCII white space. A word's 64-bit hash is a random-table polynomial
over its bytes, computed for a whole buffer by a handful of numpy passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
SOLID = ~WS
_BYTE = np.random.RandomState(20240607).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U64)
_POW = np.cumprod(np.full(4096, _P, U64), dtype=U64)


def powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.full(max(n, 2 * len(_POW)), _P, U64), dtype=U64)
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h *= _M1
    h ^= h >> U64(33)
    h *= _M2
    h ^= h >> U64(33)
    return h


def strings(arr: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, starting at 0) of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if lower:
        arr = pc.utf8_lower(arr)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


@dataclass
class Words:
    start: np.ndarray  # byte positions in buf
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of row r are bounds[r]:bounds[r + 1]


def words(buf: np.ndarray, off: np.ndarray, hashes: bool = True) -> Words:
    rows, n = len(off) - 1, len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, U64), np.zeros(rows + 1, np.int64))
    solid = SOLID[buf]
    # starts and ends in turn; a row that ends in a word before a row that starts with one has both there
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    cut = np.unique(off[(off > 0) & (off < n)])
    cut = np.repeat(cut[solid[cut - 1] & solid[cut]], 2)
    if len(cut):
        edge = np.insert(edge, np.searchsorted(edge, cut), cut)
    if solid[0]:
        edge = np.insert(edge, 0, 0)
    if solid[-1]:
        edge = np.append(edge, n)
    start, end = edge[::2].copy(), edge[1::2].copy()
    bounds = np.searchsorted(start, off)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    return Words(start, end, row, _hash_words(buf, start, end) if hashes else np.zeros(0, U64), bounds)


_LOW = np.asarray([(1 << 8 * k) - 1 for k in range(9)], U64)


def _hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, eight bytes at a time; all spans take a step together while they last."""
    if not len(start):
        return np.zeros(0, U64)
    padded = np.append(buf, np.zeros(8, np.uint8))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place
    left = end - start
    h = mix(left.astype(U64) * _P + (eight[start] & _LOW[np.minimum(left, 8)]))
    on = np.flatnonzero(left > 8)
    step = 8
    while len(on):
        h[on] = mix(h[on] * _P + (eight[start[on] + step] & _LOW[np.minimum(left[on] - step, 8)]))
        step += 8
        on = on[left[on] > step]
    return h


_PLACE = (np.zeros(0, U64), np.zeros(0, U64))


def place_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**(i + 1) and P**-i for places below n, kept for the next buffer."""
    global _PLACE
    if n > len(_PLACE[0]):
        n = max(n, 1 << 21)
        back = U64(pow(int(_P), -1, 2**64))
        down = np.full(n, back, U64)
        down[0] = 1
        _PLACE = np.cumprod(np.full(n, _P, U64), dtype=U64), np.cumprod(down, dtype=U64)
    return _PLACE


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for spans in ascending order that don't overlap and hold no white space outside their words."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    total = np.concatenate(([0], np.cumsum(size)))
    local = np.arange(total[-1]) - np.repeat(total[:-1], size)
    x = _BYTE[buf[np.repeat(start, size) + local]]
    x *= powers(int(size.max()))[local]
    return mix(np.add.reduceat(x, total[:-1]) + size.astype(U64))


def gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """Hash of buf[i:i+n] for every i (len(buf) - n + 1 of them), unmixed polynomial."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    p, out = powers(n), np.zeros(m, U64)
    x = _BYTE[buf]
    for j in range(n):
        out += x[j : j + m] * p[j]
    return out


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle; a row with 1..k-1 words has one shingle of them all."""
    count = np.diff(w.bounds)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    p = powers(k)
    h = np.zeros(n, U64)
    for j in range(k):
        h[: n - j] += w.hash[j:] * p[j]
    pos = np.arange(n) - np.repeat(w.bounds[:-1], count)
    ok = pos + k <= count[w.row]
    short = (pos == 0) & (count[w.row] < k)
    if short.any():
        for i in np.flatnonzero(short):
            c = int(count[w.row[i]])
            h[i] = (w.hash[i : i + c] * p[:c]).sum(dtype=U64) + U64(c)
        ok |= short
    return w.row[ok], mix(h[ok])


def unique_sets(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row: (values, bounds)."""
    if not len(h):
        return h, np.zeros(rows + 1, np.int64)
    order = np.lexsort((h, row)) if len(row) and np.any(np.diff(row) < 0) else None
    if order is not None:
        row, h = row[order], h[order]
    else:
        bounds = np.searchsorted(row, np.arange(rows + 1))
        h = h.copy()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[keep], h[keep]
    return h, np.searchsorted(row, np.arange(rows + 1))


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), pa.array(values, kind))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes; lengths stay."""
    out = _LOWER[buf]
    if len(buf) > 1:
        second = np.flatnonzero(buf[:-1] == 0xC3) + 1
        after = buf[second]
        out[second[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)]] += 32
    return out


PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def strip_marks(buf: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Spans without up to ``most`` ASCII marks at either end; a span of marks alone keeps its last one."""
    start, end = start.copy(), end.copy()
    for _ in range(most):
        start += (end - start > 1) & PUNCT[buf[start]] if len(start) else 0
        end -= (end - start > 1) & PUNCT[buf[end - 1]] if len(start) else 0
    return start, end
