"""Near-duplicate documents by HyperMinHash (Yu and Weber, 2017).

Each text's distinct word shingles are hashed once. The top bits choose a bucket, and the bucket's smallest remaining hash is kept as a register
of leading-zero count and mantissa bits. Empty buckets borrow a full one's register along a fixed probing order. Bands of registers find
candidates, a collision-corrected share of equal registers estimates their likeness, and full shingle sets confirm it.

Texts with one shingle set form a class; only its representative takes part, so copies cost one row each. Within a band's bucket every class is
tested against the bucket's head, the member whose buckets are fullest: of variants of one text, that text. Then all classes that stand outside of
their bucket's largest component are tested against all of the bucket, in groups of bounded size: both sides are dealt into tiles with their
registers and full sets, and only links leave a group. So no pair of different components that is estimated alike stays untested, and neither
candidates nor failures are written out. A link is lost only if its pair shares no band or is estimated below Shape.least.

Defined results: a null text and one without words have no shingles, are linked with nothing and are kept; a repeated row (same doc_id and text)
stays a row of its own, in the same component; a null doc_id takes part in links but is never a component_id while another id is there, and is
kept only if it is linked with nothing. Columns beyond doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm import textkit as tk
from docwarden.llm.common import Scratch, small
from docwarden.llm.components import components

MANTISSA = 10
#: Sets that are smaller can only be alike by being equal: 3 of 4 is the first other share of 0.75.
ALONE = 3
#: Bounds of a group that tests pairs: shingles of those that ask and of those that are asked, and classes of each.
TILE, PART, CLASSES = 1 << 18, 1 << 20, 1024


class Shape(NamedTuple):
    """Buckets that shingles are hashed into, registers of a band, bands, and the least estimate that is confirmed. A signature holds the registers
    of the bands."""

    buckets: int
    band: int
    bands: int
    least: float

    @property
    def width(self) -> int:
        return self.band * self.bands


#: A pair of likeness 0.75 is missed by all bands with a chance of 5e-6; the least estimate lies over five standard deviations under 0.75.
DOCUMENTS = Shape(128, 4, 32, 0.5)

SIGNED = "doc_id long, text_key long, n_shingles long, cls binary, registers binary"


@functools.cache
def _probes(buckets: int) -> np.ndarray:
    """For each bucket, all buckets in the fixed random order in which it borrows."""
    rng = np.random.default_rng(7)
    return np.array([rng.permutation(buckets) for _ in range(buckets)])


def registers(value: np.ndarray, owner: np.ndarray, n_docs: int, buckets: int) -> np.ndarray:
    """n_docs x buckets registers (uint16) of distinct shingles: 6 bits of leading zeros, MANTISSA bits after the leading one."""
    none, bits = np.uint64(0xFFFFFFFFFFFFFFFF), buckets.bit_length() - 1
    low = np.full(n_docs * buckets, none, np.uint64)
    h = tk.mixed(value ^ np.uint64(0x5851F42D4C957F2D))
    at = owner * buckets + (h >> np.uint64(64 - bits)).astype(np.int64)
    rest = h << np.uint64(bits)
    np.minimum.at(low, at, rest)
    held = np.flatnonzero(low != none)  # of short texts few buckets are
    x, zeros = low[held], np.zeros(len(held), np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        small = x < (np.uint64(1) << np.uint64(64 - step))
        zeros[small] += np.uint64(step)
        x[small] <<= np.uint64(step)
    mantissa = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(len(low), np.uint16)
    out[held] = (np.minimum(zeros, 63) << np.uint64(MANTISSA)) | mantissa
    full = np.zeros(len(low), bool)
    full[held] = True
    out, full = out.reshape(n_docs, buckets), full.reshape(n_docs, buckets)
    row, bucket = np.nonzero(full.any(1)[:, None] & ~full)
    probes = _probes(buckets) if len(row) else None
    for k in range(buckets if len(row) else 0):  # each empty bucket goes along its probing order until it meets a full one
        lender = probes[bucket, k]
        lent = full[row, lender]
        out[row[lent], bucket[lent]] = out[row[lent], lender[lent]]
        row, bucket = row[~lent], bucket[~lent]
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray, buckets: int) -> np.ndarray:
    """Share of registers that agree by chance for disjoint sets of n and m shingles: equal zero counts and equal mantissas."""
    k = np.arange(0, 40)[None, :]
    upper, lower = 2.0 ** -k, 2.0 ** -(k + 1)
    p = [np.exp(-x[:, None] / buckets * lower) - np.exp(-x[:, None] / buckets * upper) for x in (n, m)]
    return (p[0] * p[1]).sum(1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, buckets: int) -> np.ndarray:
    agree, chance = (a == b).mean(1), expected_collisions(n.astype(float), m.astype(float), buckets)
    return (agree - chance) / (1 - chance)


def _matrix(column: pa.Array, shape: Shape) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, shape.width)


def signatures(value: np.ndarray, owner: np.ndarray, n: int, shape: Shape) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of n sets of distinct shingles: their sizes, 128 bits that name the set (None for an empty set), and registers of those of at least ALONE."""
    count = np.bincount(owner, minlength=n)
    sums = np.zeros((n, 2), np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        first = np.searchsorted(owner, has)
        for i, seed in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
            sums[has, i] = np.add.reduceat(tk.mixed(value ^ np.uint64(seed)), first)
        sums[has, 1] ^= tk.mixed(count[has].astype(np.uint64))
    signed = count >= ALONE
    asked, rank = signed[owner], np.cumsum(signed) - 1
    regs = np.zeros((n, shape.width), np.uint16)
    regs[signed] = registers(value[asked], rank[owner[asked]], int(signed.sum()), shape.buckets)[:, : shape.width]
    return count, _rows_of(sums, count > 0), _rows_of(regs, signed)


def _rows_of(matrix: np.ndarray, known: np.ndarray) -> pa.Array:
    """Each row's bytes; null where it isn't known."""
    n, width = len(matrix), matrix.shape[1] * matrix.itemsize
    data, at = pa.py_buffer(np.ascontiguousarray(matrix).tobytes()), pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
    return pc.if_else(pa.array(known), pa.Array.from_buffers(pa.binary(), n, [None, at, data]), pa.scalar(None, pa.binary()))


def sign(docs: DataFrame) -> DataFrame:
    """A row per document: number of distinct shingles, class (128 bits of the set; null without shingles) and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                n = batch.num_rows
                data, at = tk.text_bytes(batch.column("text"))
                data = tk._LOWER[data]
                start, end, doc = tk.words(data, at, tk.GAPS["spaced"])
                value, owner = tk.without_repeats(*tk.shingles(tk.word_hashes(data, start, end), doc, n))
                count, cls, sig = signatures(value, owner, n, DOCUMENTS)
                yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(count, pa.int64()), cls, sig], ["doc_id", "text_key", "n_shingles", "cls", "registers"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def banded(classes: DataFrame, shape: Shape) -> DataFrame:
    """A row per class and band: a 64-bit key of the band and its registers. Sets of fewer than ALONE shingles are alike only if they are equal.

    cid is a short name of the class: two classes that happen to share it are candidates of each other's candidates, and nothing worse."""
    width = 2 * shape.band  # bytes of a band's registers
    keys = [F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(shape.bands)]
    return classes.where(F.col("n") >= ALONE).select(F.explode(F.array(*keys)).alias("key"), F.xxhash64("cls").alias("cid"), F.col("n").cast("int").alias("n"))


def shingle_sets(texts: DataFrame, gaps: str = "spaced") -> DataFrame:
    """(cls, shingles) of (cls, text): each text's distinct shingles, in order, as the bytes of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                n = batch.num_rows
                data, at = tk.text_bytes(batch.column("text"))
                data = tk._LOWER[data]
                start, end, doc = tk.words(data, at, tk.GAPS[gaps])
                value, owner = tk.distinct_shingles(*tk.shingles(tk.word_hashes(data, start, end), doc, n))
                stop = np.searchsorted(owner, np.arange(n + 1))
                yield pa.record_batch([batch.column("cls"), pa.array([value[i:j].tobytes() for i, j in zip(stop, stop[1:])], pa.binary())], ["cls", "shingles"])

    return texts.select("cls", "text").mapInArrow(run, "cls binary, shingles binary")


def alike(own: np.ndarray, others: np.ndarray, owner: np.ndarray, sizes: np.ndarray, least: int = 75) -> np.ndarray:
    """Whether each other set (values others, dealt by owner) has 100 * intersection >= least * union with own (in order)."""
    at = np.minimum(np.searchsorted(own, others), len(own) - 1)
    both = np.bincount(owner[own[at] == others], minlength=len(sizes))
    return 100 * both >= least * (len(own) + sizes - both)


def _tested(work: DataFrame, sets: DataFrame, shape: Shape) -> DataFrame:
    """Links (a, b) of work (pack, tile, asks, cid, component): in each group, a pack, those of a tile that ask meet all of it of other components.

    Pairs whose estimate is too low are passed over, all others are decided by their full sets. Of the links that lead to one component
    an asker reports the first; the others add nothing. A group's sets are bounded by TILE and PART, and no pair leaves it but links."""
    import pandas as pd

    def run(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("tile", kind="stable")
        names, tiles, asks, code = got.cls.tolist(), got.tile.to_numpy(), got.asks.to_numpy(), got.component.to_numpy()
        regs = np.frombuffer(b"".join(got.registers), np.uint16).reshape(-1, shape.width)
        values = [np.frombuffer(x, np.uint64) for x in got.shingles]
        n = np.array([len(x) for x in values])
        links = []
        cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1), len(got)]
        for lo, hi in zip(cuts, cuts[1:]):
            for k in lo + np.flatnonzero(asks[lo:hi]):
                near = lo + np.flatnonzero((code[lo:hi] != code[k]) & (4 * np.minimum(n[lo:hi], n[k]) >= 3 * np.maximum(n[lo:hi], n[k])))
                near = near[(regs[near] == regs[k]).mean(1) >= shape.least]  # an estimate is never above this share
                if not len(near):
                    continue
                est = estimate(regs[near], regs[k][None, :], n[near], np.full(len(near), n[k]), shape.buckets)
                near = near[np.argsort(-est, kind="stable")[: (est >= shape.least).sum()]]
                while len(near):
                    some, near = near[:64], near[64:]
                    found = some[alike(values[k], np.concatenate([values[i] for i in some]), np.repeat(np.arange(len(some)), n[some]), n[some])]
                    _, first = np.unique(code[found], return_index=True)
                    links += [(bytes(names[k]), bytes(names[i])) for i in found[first]]
                    near = near[~np.isin(code[near], code[found])]
        return pd.DataFrame(links, columns=["a", "b"])

    rows = work.join(sets, "cid").select("pack", "tile", "asks", "component", "cls", "registers", "shingles")
    return rows.groupBy("pack").applyInPandas(run, "a binary, b binary")


def _packed(work: DataFrame) -> DataFrame:
    """(Written) work (tile, asks, cid, component, n) dealt into packs of bounded size: small tiles together, a large one in parts. Those that are
    asked stand in one part, those that ask in all."""
    of = work.where("not asks").groupBy("tile").agg(F.sum("n").alias("sum"), F.count("*").alias("count"))
    packs = 1 + (of.agg(F.sum(F.greatest(F.col("sum") / PART, F.col("count") / CLASSES))).first()[0] or 0) // 1
    sizes = of.select("tile", F.ceil(F.greatest(F.col("sum") / PART, F.col("count") / CLASSES)).cast("int").alias("parts"))
    part = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))))
    pack = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("tile"), F.lit(int(packs)))).otherwise(F.xxhash64("tile", "part"))
    return work.join(sizes, "tile").withColumn("part", part).withColumn("pack", pack).select("pack", "tile", "asks", "cid", "component")


def link(signed: DataFrame, fetch: Callable[[DataFrame], DataFrame], shape: Shape, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes (cls, n, at, registers) of signed rows (cls, n_shingles, at, registers), and (node, component) of those that are linked.

    at says where a class's text stands; fetch turns (cls, at) into (cls, text)."""
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min("n_shingles").alias("n"), F.min("at").alias("at"), F.first("registers").alias("registers"))
    classes = scratch.cut(classes, "classes")
    bands = banded(classes, shape)
    sized = bands.join(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    sized = scratch.cut(sized, "sized")
    # The head of a bucket is the member whose buckets are fullest: the text that most of a group of variants is made from.
    crowd = scratch.cut(sized.groupBy("cid").agg(F.sum("size").alias("crowd"), F.min("n").alias("head_n")), "crowd")
    heads = sized.join(crowd, "cid").groupBy("key").agg(F.max_by("cid", "crowd").alias("head"))
    starred = sized.select("key", "cid", "n").join(heads, "key").where("cid <> head").select("head", "cid", "n").distinct()
    starred = starred.join(crowd.select(F.col("cid").alias("head"), "head_n"), "head").where(4 * F.least("n", "head_n") >= 3 * F.greatest("n", "head_n"))
    starred = scratch.cut(starred, "starred")
    # The full sets of all classes that share a bucket, read once.
    named = classes.withColumn("cid", F.xxhash64("cls"))
    wanted = scratch.cut(crowd.select("cid").join(named.select("cid", "cls", "at"), "cid"), "wanted")
    sets = shingle_sets(fetch(wanted.select("cls", "at"))).dropDuplicates(["cls"]).withColumn("cid", F.xxhash64("cls")).join(named.select("cls", "registers"), "cls")
    sets = scratch.cut(sets, "sets")
    asking = starred.select(F.col("head").alias("tile"), F.lit(True).alias("asks"), F.col("head").alias("cid")).distinct()
    asked = starred.select(F.col("head").alias("tile"), F.lit(False).alias("asks"), "cid", F.col("cid").alias("component"), "n")
    work = asked.unionByName(asking.withColumns({"component": F.col("cid"), "n": F.lit(0)}))
    links = scratch.cut(_tested(_packed(work), sets, shape), "star")
    found = scratch.cut(components(links, scratch), "found")
    # What the heads left apart: buckets that still hold several components. All that stand outside of their bucket's largest one ask all of it.
    parts_of = found.select(F.xxhash64("node").alias("cid"), F.xxhash64("component").alias("component"))
    placed = sized.where("size > 2").select("key", "cid", "n").join(parts_of, "cid", "left").select("key", "cid", "n", F.coalesce("component", "cid").alias("component"))
    placed = scratch.cut(placed, "placed")
    scratch.drop("sized", "starred", "crowd")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("component", "c").alias("main"), F.count("*").alias("parts"), F.sum("c").alias("size"))
    placed = scratch.cut(placed.join(parts.where("parts > 1").select("key", "main", "size"), "key"), "split")
    outside = placed.where("component <> main").groupBy("cid", "n", "component").agg(F.max_by("main", "size").alias("home"))
    # Askers of one home are dealt into tiles, so that a tile's askers mostly share their buckets.
    tiles = outside.groupBy("home").agg(F.greatest(F.ceil(F.sum("n") / TILE), F.ceil(F.count("*") / CLASSES)).cast("int").alias("tiles"))
    tiled = scratch.cut(outside.join(tiles, "home").withColumn("tile", F.xxhash64("home", F.pmod(F.xxhash64("cid"), F.col("tiles")))).select("tile", "cid", "n", "component"), "tiled")
    met = placed.join(placed.where("component <> main").select("key", "cid").join(tiled.select("cid", "tile"), "cid").select("key", "tile").distinct(), "key")
    asked = met.select("tile", F.lit(False).alias("asks"), "cid", "component", "n").distinct()
    work = scratch.cut(asked.unionByName(tiled.withColumn("asks", F.lit(True))), "work")
    more = scratch.cut(_tested(_packed(work), sets, shape), "more")
    scratch.drop("placed", "split", "tiled", "work", "sets", "wanted")
    if not more.isEmpty():
        found = scratch.cut(components(links.union(more), scratch), "found_all")
    return classes, found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component_id and kept of every document; see the module's text."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.cut(sign(docs), "signed")

    def fetch(wanted: DataFrame) -> DataFrame:
        own = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), F.col("text").cast("string"))
        return own.join(small(wanted), F.col("d").eqNullSafe(F.col("at.doc_id")) & (F.col("k") == F.col("at.text_key"))).select("cls", "text")

    classes, found = link(signed.withColumn("at", F.struct("doc_id", "text_key")), fetch, DOCUMENTS, scratch)
    least = scratch.cut(signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least_id")), "least")
    named = found.join(least.withColumnRenamed("cls", "node"), "node")
    lowest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = scratch.cut(named.join(lowest, "component").select(F.col("node").alias("cls"), "component_id"), "ids")
    out = signed.join(ids, "cls", "left").join(least, "cls", "left")
    own = F.coalesce("component_id", "least_id", "doc_id")
    scratch.close("signed", "least", "ids")
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"))
