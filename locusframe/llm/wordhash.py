"""Vectorised words, shingles and SuperMinHash signatures over Arrow text batches (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
#: Bytes of text that one vectorised pass takes; a longer document is a pass of its own.
PASS_BYTES = 1 << 20


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (a public 64-bit mixer)."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudorandom 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * _GOLD)


_BYTE = stream(256, 1)
_POS = stream(1024, 2) | U(1)
_FAR = stream(1024, 3) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]


def classes_of(separators: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(separators)] = True
    return out


#: Words are runs of anything but space and \t \n \v \f \r.
WHITE = classes_of(b" \t\n\x0b\x0c\r")


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of passes over a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PASS_BYTES, side="right")) - 1)
        end = min(end, n, at + 4096)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and hash of each word (letters A-Z lowered), and each document's first word (n + 1 values)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    per_doc = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return starts, ends, np.zeros(0, U), per_doc
    at = np.flatnonzero(inside)
    lengths = ends - starts
    heads = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=heads[1:])
    pos = np.arange(len(at), dtype=np.int64) - np.repeat(heads, lengths)
    value = _BYTE_LOWER[data[at]] * _POS[pos & 1023]
    if lengths.max() > 1024:
        value = value * _FAR[(pos >> 10) & 1023]
    return starts, ends, mix(np.add.reduceat(value, heads) + lengths.astype(U) * _GOLD), per_doc


def shingles_of(hashes: np.ndarray, per_doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (document, hash), sorted; fewer than k words make one shingle of all words."""
    counts = np.diff(per_doc)
    n = len(hashes)
    docs, out = [], []
    full = np.flatnonzero(counts >= k)
    if len(full):
        acc = hashes[: n - k + 1].copy()
        for j in range(1, k):
            acc = mix(acc * U(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j])
        many = counts[full] - k + 1
        heads = np.zeros(len(full), np.int64)
        np.cumsum(many[:-1], out=heads[1:])
        at = np.arange(many.sum(), dtype=np.int64) - np.repeat(heads, many) + np.repeat(per_doc[:-1][full], many)
        docs.append(np.repeat(full, many))
        out.append(acc[at])
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        acc = hashes[per_doc[d] : per_doc[d] + 1].copy()
        for j in range(1, counts[d]):
            acc = mix(acc * U(0xD6E8FEB86659FD93) + hashes[per_doc[d] + j])
        docs.append(np.array([d]))
        out.append(mix(acc + U(int(counts[d]))))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U)
    d, s = np.concatenate(docs), np.concatenate(out)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[keep], s[keep]


def super_minhash(doc: np.ndarray, element: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures, n_docs x m (64-bit values: step number above, random fraction below).

    Every element walks a random permutation of the m slots, one slot a step, and offers (step, fraction)
    to it; a slot keeps the least offer.  Offers of later steps are larger, so a document stops as soon as
    all its slots hold offers of steps already done.  A document without elements keeps all ones.
    """
    top = np.iinfo(np.uint64).max
    sig = np.full((n_docs, m), top, dtype=U)
    if len(element) == 0:
        return sig
    flat = sig.reshape(-1)
    base, x = doc * m, mix(element ^ U(0xA5A5A5A55A5A5A5A))
    perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(x), m)).copy()
    row = np.arange(len(x))
    for j in range(m):
        z = mix(x + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (U(j) + (((z & U(0xFFFFFFFF)) * U(m - j)) >> U(32))).astype(np.int64)
        slot = perm[row, k]
        perm[row, k] = perm[row, j]
        np.minimum.at(flat, base + slot, (U(j) << U(32)) | (z >> U(32)))
        if j + 1 < m and (j < 8 or j % 8 == 0):
            done = sig.max(axis=1) < (U(j + 1) << U(32))
            keep = ~done[base // m]
            left = int(keep.sum())
            if left == 0:
                break
            if left < 0.7 * len(x):
                base, x, perm = base[keep], x[keep], perm[keep]
                row = np.arange(len(x))
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """n x bands keys, each over m / bands signature values and the band's number."""
    n, m = sig.shape
    rows = m // bands
    out = np.empty((n, bands), dtype=U)
    for b in range(bands):
        acc = np.full(n, b + 1, dtype=U) * _GOLD
        for r in range(rows):
            acc = mix(acc * U(0xD6E8FEB86659FD93) + sig[:, b * rows + r])
        out[:, b] = acc
    return out
