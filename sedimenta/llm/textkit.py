"""Vectorised splitting and hashing of whole texts, straight from Arrow buffers.

Hashes are 64-bit: polynomial over the bytes of a word, then mixed. Equal words have equal hashes at
any place, size or run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RI = pow(_R, -1, 1 << 64)
_pows = [np.ones(1, U), np.ones(1, U)]
SLICE_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pows[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for i, base in enumerate((_R, _RI)):
            p = np.full(size, base, U)
            p[0] = 1
            _pows[i] = np.cumprod(p)
    return _pows[0], _pows[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = col.buffers()
    offs = np.frombuffer(o, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(d, np.uint8)[offs[0] : offs[-1]] if d is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, col: str = "text", most: int = SLICE_BYTES):
    """Row runs of at most `most` bytes of text (one row at least): memory follows one text, not the batch."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(col)
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end, start = np.cumsum(size), 0
    while start < len(size):
        base = end[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(end, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _table(word) -> np.ndarray:
    """Byte table: A-Z to a-z, bytes outside words to a space."""
    t = np.full(256, 32, np.uint8)
    for b in range(256):
        if word(b):
            t[b] = b + 32 if 65 <= b <= 90 else b
    return t


SPACED = _table(lambda b: b not in (32, 9, 10, 11, 12, 13))
"""Lower-cased words between ASCII white space."""
ALNUM = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
"""Lower-cased words of ASCII letters, digits and all that is not ASCII."""


def span_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(x)
    p, q = _powers(n)
    run = np.zeros(n + 1, U)
    np.cumsum((x.astype(U) + U(1)) * p[:n], out=run[1:])
    return mix((run[ends] - run[starts]) * q[starts] + U(0x51ED270B) * (ends - starts).astype(U))


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """(starts, ends, doc, hashes) of all words, in order; no word spans two documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    x = table[data]
    w = x != 32
    first = w.copy()
    first[1:] &= ~w[:-1]
    head = offs[:-1][offs[:-1] < n]
    first[head] = w[head]
    last = w.copy()
    last[:-1] &= ~w[1:]
    tail = offs[1:][offs[1:] > 0] - 1
    last[tail] = w[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, span_hashes(x, starts, ends)


_ODD = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; the last k - 1 starts have none."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for i in range(k):
        out += mix(h[i : i + m] + U(_ODD[i % 8])) * U((_ODD[(i + 3) % 8] + 2 * i) & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(out + U(k))


def doc_grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, index of the first word) of the runs of k words that lie in one document."""
    g = grams(h, k)
    at = np.flatnonzero(doc[: len(g)] == doc[k - 1 :]) if len(g) else np.zeros(0, np.int64)
    return g[at], at


def winnow(g: np.ndarray, group: np.ndarray, w: int) -> np.ndarray:
    """Indices of the minimum of each window of w consecutive hashes of a group, rightmost in ties;
    a group of fewer than w gives its minimum. Any run of w consecutive hashes that two groups share
    keeps the same one in both."""
    n = len(g)
    if not n:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    edge = np.searchsorted(group, group, "right")  # end of each one's group
    for step in range(1, w):
        cand = np.minimum(np.arange(n) + step, n - 1)
        ok = np.arange(n) + step < edge
        better = ok & (g[cand] <= g[best])
        best = np.where(better, cand, best)
    start = np.searchsorted(group, group, "left")
    whole = (np.arange(n) + w <= edge) | (np.arange(n) == start)
    return np.unique(best[whole])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lens > 0
    s, n = starts[keep], lens[keep]
    at = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=at[1:])
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    out[0] = s[0]
    return np.cumsum(out)
