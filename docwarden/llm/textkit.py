"""Words and shingles of whole Arrow batches with numpy: no Python loop over words, and the same hashes in every process."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: After lower-casing, 0-9, a-z and all bytes over 0x7F belong to words.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
GAPS = {"spaced": _SPACE, "plain": _PLAIN}
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            p = np.full(PIECE + 1, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = column.buffers()[2]
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; words don't span documents."""
    inside = ~gaps[data]
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial, piece by piece."""
    up, down = _tables()
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + PIECE, "right")))
        hi = end[j - 1]
        if hi - lo > PIECE:  # one word that is longer than a piece
            part = data[lo:hi].astype(np.uint64) + np.uint64(1)
            h = np.uint64(0)
            for k in range(0, len(part), PIECE):
                x = part[k : k + PIECE]
                h = (h * BASE) ^ mixed(np.add.reduce(x * up[: len(x)], dtype=np.uint64, keepdims=True))[0]
            out[i] = h
        else:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            a, b = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mixed(out)


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each k-word shingle, repeats included; a document of fewer words, but not none, has its whole sequence as one."""
    m = len(hashes)
    value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m >= k:
        ok = doc[: m - k + 1] == doc[k - 1 :]
        value = np.zeros(m - k + 1, np.uint64)
        for i in range(k):
            value = value * np.uint64(0xFF51AFD7ED558CCD) + hashes[i : m - k + 1 + i]
        value, owner = mixed(value[ok]), doc[: m - k + 1][ok]
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] = extra[has] * np.uint64(0xFF51AFD7ED558CCD) + hashes[first[has] + i]
        value = np.concatenate([value, mixed(extra ^ count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def distinct_shingles(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's shingles in order, without repeats."""
    if not len(value):
        return value, owner
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def without_repeats(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's shingles without repeats, in the order in which they stand: one plain sort finds those that repeat, the rest is left alone."""
    if not len(value):
        return value, owner
    mark = mixed(value ^ (owner.astype(np.uint64) * BASE))
    line = np.sort(mark)
    twice = line[1:][line[1:] == line[:-1]]
    if not len(twice):
        return value, owner
    some = np.flatnonzero(np.isin(mark, twice))
    some = some[np.argsort(mark[some], kind="stable")]
    new = np.ones(len(some), bool)
    new[1:] = (value[some][1:] != value[some][:-1]) | (owner[some][1:] != owner[some][:-1])
    keep = np.ones(len(value), bool)
    keep[some[~new]] = False
    return value[keep], owner[keep]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text, so that memory doesn't follow the rows' length; a row is never split."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
