"""Document fingerprints: a digest of improbable features (after Roussev's similarity digests), held in chained Bloom filters.

Windows of WIDTH bytes that begin with a word, or anywhere in a word that is longer than a window, are ranked by how far their byte entropy lies from that of usual text. In each run of RUN
neighbouring windows the rarest is chosen; windows that are chosen by at least LEAST_RUNS runs are features. Their hashes go, in text order, into
Bloom filters of BITS bits, a new one after each FILL features. Two digests are compared filter by filter: common bits, less those that chance
gives, over the most that could be common.

Edited texts need the next document's beginning. Documents are dealt once, by ranges of (doc_id, text hash), sorted within, and walked in Arrow
batches with one document held over; each range also gets the first document of the next, so no neighbour is far away. Text is shuffled once, and no
task holds more than a batch. The ranges' bounds come from a sort of the keys alone; they reach the tasks as one value of 16 bytes a range.

Defined results: a null text is empty; an empty or wordless text without a whole window has its bytes as its only feature, an empty one has an empty
chain, and two empty chains are alike (1.0), an empty and a full one not (0.0); rows of one doc_id are ordered by the text's hash, repeated rows
follow each other; null doc_ids come last; a single row is its own next document; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm import textkit as tk
from docwarden.llm.common import Scratch

WIDTH = 32
RUN, LEAST_RUNS = 8, 4
BITS, HASHES, FILL = 2048, 5, 160
#: Bytes of entropy that is usual for windows of text, in bits; below LEAST_ENTROPY a window says nothing.
USUAL_ENTROPY, LEAST_ENTROPY = 3.5, 1.0
#: Ranges are of RANGE_BYTES of text, but SPREAD at least if they have SMALL_RANGE bytes; FAN bounds are looked at in each step of finding a range.
RANGE_BYTES, SMALL_RANGE, SPREAD, FAN = 64 << 20, 2 << 20, 256, 128


def entropies(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte entropy of the WIDTH bytes from each given place on. Places must be in order, and their windows within the data.

    Sums of c * log2(c) change by one step as a window moves on by a byte: what leaves is counted ahead of it, what comes is counted behind it."""
    n = len(data)
    if not len(at):
        return np.zeros(0)
    order = np.argsort(data, kind="stable")
    keys = data[order].astype(np.int64) * (4 * n + 4 * WIDTH) + order
    rank = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = np.searchsorted(keys, keys + WIDTH, "left") - rank
    behind[order] = rank - np.searchsorted(keys, keys - WIDTH, "right") + 1
    c = np.arange(WIDTH + 1, dtype=float)
    g = c * np.log2(np.maximum(c, 1))
    step = np.diff(g, prepend=0.0)
    # Leaving the window [i, i + WIDTH): the count of data[i] in it; entering at i + WIDTH: its count in (i, i + WIDTH].
    change = step[behind[WIDTH:]] - step[ahead[: n - WIDTH]]
    first = g[np.bincount(data[:WIDTH], minlength=256)].sum()
    sums = np.concatenate([[first], first + np.cumsum(change)])[at]
    return np.log2(WIDTH) - sums / WIDTH


def chosen(rarity: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each window is the rarest (the first of equals) of at least LEAST_RUNS runs of RUN neighbouring windows of its document."""
    n = len(rarity)
    left, right = np.full(n, RUN), np.full(n, RUN)
    for k in range(RUN - 1, 0, -1):
        same = doc[k:] == doc[:-k]
        np.putmask(left[k:], ~same | (rarity[:-k] >= rarity[k:]), k)
        np.putmask(right[:-k], ~same | (rarity[k:] > rarity[:-k]), k)
    # A document of fewer windows than RUN is a single run.
    first = np.searchsorted(doc, doc, "left")
    room = np.searchsorted(doc, doc, "right") - first
    place = np.arange(n) - first
    left = np.where(left > place, np.minimum(RUN, place + 1), left)
    right = np.where(right > room - 1 - place, np.minimum(RUN, room - place), right)
    only = (room < RUN) & (left == place + 1) & (right == room - place)
    return (left + right - RUN >= LEAST_RUNS) | only


def digests(texts: list[str]) -> list[np.ndarray]:
    """A chain of Bloom filters of each text: rows of BITS / 8 bytes."""
    data, at = tk.text_bytes(pa.array(texts, pa.large_string()))
    n = len(texts)
    start, end, doc = tk.words(data, at, tk.GAPS["spaced"])
    # Text without spaces is a word longer than a window: all windows within it count.
    spots = np.maximum(end - start - WIDTH + 1, 1)
    doc, start = np.repeat(doc, spots), np.repeat(start, spots) + np.arange(spots.sum()) - np.repeat(np.cumsum(spots) - spots, spots)
    fits = start + WIDTH <= at[1:][doc]
    start, doc = start[fits], doc[fits]
    entropy = entropies(data, start)
    rarity = np.where(entropy < LEAST_ENTROPY, -1.0, np.round(np.abs(entropy - USUAL_ENTROPY), 6))
    pick = chosen(rarity, doc) & (rarity >= 0)
    spot, stop, owner = start[pick], start[pick] + WIDTH, doc[pick]
    bare = np.setdiff1d(np.flatnonzero(np.diff(at)), owner)
    spot, stop, owner = np.concatenate([spot, at[bare]]), np.concatenate([stop, at[bare + 1]]), np.concatenate([owner, bare])
    order = np.argsort(owner, kind="stable")
    spot, stop, owner = spot[order], stop[order], owner[order]
    value = np.concatenate([tk.word_hashes(data, spot[k : k + 4096], stop[k : k + 4096]) for k in range(0, len(spot), 4096)]) if len(spot) else np.zeros(0, np.uint64)
    # Repeats within a document are inserted once, where they stand first.
    _, once = np.unique(np.stack([owner.astype(np.uint64), value]), axis=1, return_index=True) if len(value) else (None, np.zeros(0, np.int64))
    once.sort()
    value, owner = value[once], owner[once]
    count = np.bincount(owner, minlength=n)
    chain = -(-count // FILL)
    begin = np.concatenate([[0], np.cumsum(chain)])
    link = begin[owner] + (np.arange(len(owner)) - np.concatenate([[0], np.cumsum(count)])[owner]) // FILL
    bits = np.zeros(begin[-1] * BITS, bool)
    for _ in range(HASHES):
        bits[link * BITS + (value % np.uint64(BITS)).astype(np.int64)] = True
        value = value >> np.uint64(11)
    filters = np.packbits(bits.reshape(-1, BITS), axis=1)
    return [filters[a:b] for a, b in zip(begin, begin[1:])]


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the shorter chain's filters of the best normalised overlap with any of the other's, weighted by their bits."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    ones_a, ones_b = _ONES[a].sum(1), _ONES[b].sum(1)
    best = np.zeros(len(a))
    for shift in range(1 - len(a), len(b)):
        i = np.arange(max(0, -shift), min(len(a), len(b) - shift))
        if len(i):
            x, y = ones_a[i], ones_b[i + shift]
            common = _ONES[a[i] & b[i + shift]].sum(1)
            chance, most = x * y / BITS, np.minimum(x, y)
            best[i] = np.maximum(best[i], np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1))
    return float((best * ones_a).sum() / ones_a.sum() * (ones_a.sum() / max(ones_a.sum(), ones_b.sum())) ** 0.5)


def written(chain: np.ndarray) -> str:
    return ".".join(base64.b64encode(f.tobytes()).decode() for f in chain)


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def own_place() -> Column:
    """What orders documents: doc_id, nulls least, then the text's hash."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"), F.col("text_key").alias("k"))


def bounds_of(keys: DataFrame, ranges: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The first place of each of about so many ranges, in descending order, as one row; and how many."""
    place = own_place().alias("place")
    dealt = keys.select(place).repartitionByRange(ranges, F.col("place").desc())
    heads = scratch.cut(dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.max("place").alias("place")), "heads")
    return scratch.cut(heads.agg(F.sort_array(F.collect_list("place"), False).alias("bounds")), "bounds"), heads.count()


def range_of(bounds: Column, count: int, place: Column) -> Column:
    """The last of the descending bounds that isn't below the place, counted from 0, found in steps of FAN bounds."""
    step = 1
    while step * FAN < count:
        step *= FAN
    found = F.lit(0)
    while step:
        level = F.transform(F.sequence(F.lit(0), F.lit((count - 1) // step)), lambda i: F.get(bounds, i * F.lit(step))) if step > 1 else bounds
        some = F.slice(level, found + 1, F.lit(FAN))
        found = found + F.greatest(F.lit(1), F.size(F.filter(some, lambda x: x >= place))) - 1
        found, step = (found * FAN, step // FAN) if step > 1 else (found, 0)
    return found


SCHEMA = "doc_id long, text_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document; edited: its last third replaced by the first characters of the next document, by descending doc_id, in a ring."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    if total is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    ranges = int(max(1, total // RANGE_BYTES, min(SPREAD, total // SMALL_RANGE)))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    bounds, count = bounds_of(keyed.select("doc_id", "text_key"), ranges, scratch)
    # Each row gets the bounds as a value; the subquery runs once.
    placed = keyed.withColumns({"place": own_place(), "bounds": bounds.scalar()})
    bounds = F.col("bounds")
    placed = placed.withColumn("part", range_of(bounds, count, F.col("place")).cast("int"))
    # The first document of a range also goes to the range before it, in a ring.
    first = F.get(bounds, F.col("part")) == F.col("place")
    one = lambda part, extra: F.struct(part.cast("int").alias("part"), F.lit(extra).alias("extra"))
    copies = F.when(first, F.array(one(F.col("part"), 0), one(F.pmod(F.col("part") - 1, F.lit(count)), 1))).otherwise(F.array(one(F.col("part"), 0)))
    dealt = placed.select("doc_id", "text_key", "text", F.explode(copies).alias("x")).select("x.part", "x.extra", "doc_id", "text_key", "text")
    dealt = dealt.repartition(ranges, "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), F.col("text_key").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for whole in batches:
            for batch in tk.slices(whole, "text", 2 << 20):
                rows = list(zip(*(batch.column(x).to_pylist() for x in ("part", "extra", "doc_id", "text_key", "text"))))
                made = digests([r[4] for r in rows])
                line = ([held] if held else []) + [(*r, f) for r, f in zip(rows, made)]
                pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[1] and a[0] == b[0]]
                new = [edited(a[4], b[4]) for a, b in pairs]
                out = [
                    (a[2], a[3], len(a[4]), hashlib.sha256(t.encode()).hexdigest(), written(a[5]), written(f), likeness(a[5], f), likeness(a[5], b[5]))
                    for (a, b), t, f in zip(pairs, new, digests(new))
                ]
                held = line[-1]
                if out:
                    kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.float64()] * 2
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.mapInArrow(run, SCHEMA)
