"""Repeated passages across documents: paragraph MinHash banding, and winnowed windows for passages within longer paragraphs.

Each line of at least LEAST_WORDS words (one shingle) is a paragraph. Paragraphs of the same shingle set form a class; bands of three registers, tuned for
recall, find candidate classes, exact Jaccard of five-word shingles (0.75 or more) confirms them, and components cluster them. A passage that stands
within longer paragraphs leaves their sets too different for that. So of each run of neighbouring WINDOW-word hashes the least is kept, which any two
texts that share PASSAGE words or more have in common. Kept windows that meet are confirmed by a digest of their words. Those that follow each other in
a text are joined to spans, which reach as far as their words agree with the first occurrence's, and windows that share a span are clustered by
components as well.

Of each cluster's text the first occurrence (by doc_id, text_key and place) is kept and all others are removals; where a kept span and a removal of one
text overlap, the words are the kept one's. Exact repeats and hubs cost a row each; hot paragraphs and windows are found by partial aggregates and
joined with their heads; the join of a very common window's places is one task's, where AQE doesn't split it.

Defined results: null, empty and short texts have no paragraphs and give no rows; a repeated row (same doc_id and text) is one occurrence; a null
doc_id sorts first; doc_ids are integers, or texts that are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docwarden.llm import textkit as tk
from docwarden.llm.common import Scratch, small
from docwarden.llm.components import components
from docwarden.llm.neardup import ALONE, Shape, link, signatures

#: The words of one shingle.
LEAST_WORDS = 5
#: A pair of likeness 0.75 is missed by all bands with a chance of 2e-4, one of 0.8 with 1e-5.
PARAGRAPHS = Shape(64, 3, 16, 0.4)
#: RUN is not above WINDOW, so kept windows that follow each other in a passage leave no gap.
WINDOW, PASSAGE = 26, 50
RUN = PASSAGE - WINDOW + 1
#: Words beyond an outermost shared kept window that can still be shared: with RUN of them another window would have been kept.
REACH = RUN - 1

UNITS = "doc_id long, text_key long, line int, first_word int, n_words int, n_shingles long, cls binary, registers binary, kept array<struct<first_word int, print long>>"

KEPT = pa.list_(pa.struct([("first_word", pa.int32()), ("print", pa.int64())]))


def units(docs: DataFrame) -> DataFrame:
    """Paragraphs (cls, registers; kept null) of each document, with their places, and a row with all its kept windows (cls null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text", 2 << 20):
                yield from _units(batch)

    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string")).where("text is not null")
    return docs.mapInArrow(run, UNITS)


def _units(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, at = tk.text_bytes(batch.column("text"))
    data = tk._LOWER[data]
    start, end, doc = tk.words(data, at, tk.GAPS["spaced"])
    if not len(start):
        return
    hashes = tk.word_hashes(data, start, end)
    base = np.searchsorted(doc, np.arange(batch.num_rows))  # first word of each document
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line_of = breaks[start] - breaks[at[:-1]][doc]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (line_of[1:] != line_of[:-1])
    para = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    long = np.flatnonzero(size >= LEAST_WORDS)
    if len(long):
        rank = np.full(len(first), -1)
        rank[long] = np.arange(len(long))
        chosen = rank[para] >= 0
        value, owner = tk.without_repeats(*tk.shingles(hashes[chosen], rank[para][chosen], len(long)))
        count, cls, sig = signatures(value, owner, len(long), PARAGRAPHS)
        f = first[long]
        yield _rows(batch, doc[f], line_of[f], f - base[doc[f]], size[long], count, cls, sig, None)
    value, owner, spot = windows(hashes, doc)
    if len(value):
        stop = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        has = np.flatnonzero(np.diff(stop))
        pairs = pa.StructArray.from_arrays([pa.array(spot - base[owner], pa.int32()), pa.array(value.view(np.int64))], ["first_word", "print"])
        none = np.zeros(len(has), int)
        yield _rows(batch, has, none, none, none, none, None, None, pa.ListArray.from_arrays(pa.array(np.append(stop[has], len(value)), pa.int32()), pairs))


def _rows(batch: pa.RecordBatch, doc: np.ndarray, line: np.ndarray, first: np.ndarray, n: np.ndarray, count: np.ndarray, cls: pa.Array | None, sig: pa.Array | None, kept: pa.Array | None) -> pa.RecordBatch:
    k, of = len(doc), pa.array(doc)
    columns = [batch.column("doc_id").take(of), batch.column("text_key").take(of), pa.array(line, pa.int32()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(count, pa.int64())]
    columns += [x if x is not None else pa.nulls(k, pa.binary()) for x in (cls, sig)]
    columns.append(kept if kept is not None else pa.nulls(k, KEPT))
    return pa.record_batch(columns, ["doc_id", "text_key", "line", "first_word", "n_words", "n_shingles", "cls", "registers", "kept"])


def windows(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of the kept windows: of each RUN neighbouring WINDOW-word hashes of a document the least, the last of equals."""
    m = len(hashes) - WINDOW + 1
    if m < 1:
        return (np.zeros(0, np.uint64),) * 3
    value, done = hashes, 1
    powers = {1: np.array([0xFF51AFD7ED558CCD], np.uint64)}  # arrays wrap without a warning
    while 2 * done <= WINDOW:  # a window's hash from those of its halves
        value = value[: len(value) - done] * powers[done] + value[done:]
        powers[2 * done] = powers[done] * powers[done]
        done *= 2
    value = tk.mixed(value[:m] * np.uint64(31) + value[WINDOW - done : WINDOW - done + m])
    ok = doc[:m] == doc[WINDOW - 1 :]
    value, owner, spot = value[ok], doc[:m][ok], np.flatnonzero(ok)
    if len(value) < RUN:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    low, where, width = value.copy(), np.arange(len(value)), 1
    while width < RUN:  # least of runs of doubling width
        step = min(width, RUN - width)
        a, b = low[: len(low) - step], low[step:]
        right = b <= a
        where = np.where(right, where[step:], where[: len(where) - step])
        low, width = np.where(right, b, a), width + step
    whole = owner[: len(low)] == owner[RUN - 1 :]
    kept = np.unique(where[whole])
    return value[kept], owner[kept], spot[kept]


def contexts(texts: DataFrame) -> DataFrame:
    """Of texts (doc_id, text_key, text, spots) each asked window: 128 bits of its words' SHA-256, and hashes of the 1, 2 .. REACH words before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text", 2 << 20):
                yield from _contexts(batch)

    return texts.select("doc_id", "text_key", "text", "spots").mapInArrow(run, "doc_id long, text_key long, first_word int, exact binary, before binary, after binary")


def _contexts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, at = tk.text_bytes(batch.column("text"))
    data = tk._LOWER[data]
    start, end, doc = tk.words(data, at, tk.GAPS["spaced"])
    hashes, raw = tk.word_hashes(data, start, end), data.tobytes()
    base = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    lists = batch.column("spots")
    which = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    spot = lists.flatten().to_numpy().astype(np.int64)
    first, stop = base[which] + spot, base[which] + spot + WINDOW
    exact = [hashlib.sha256(b" ".join(raw[start[i] : end[j - 1]].split())).digest()[:16] for i, j in zip(first, stop)]
    exact = pa.array(exact, pa.binary())
    for i in range(0, len(spot), 1 << 20):
        part = slice(i, i + (1 << 20))
        room, of = spot[part], pa.array(which[part])
        sides = [_side(hashes, -1, first[part] - 1, room), _side(hashes, 1, stop[part], base[which[part] + 1] - stop[part])]
        yield pa.record_batch([batch.column("doc_id").take(of), batch.column("text_key").take(of), pa.array(room, pa.int32()), exact[part], *sides], ["doc_id", "text_key", "first_word", "exact", "before", "after"])


def _side(hashes: np.ndarray, step: int, edge: np.ndarray, room: np.ndarray) -> pa.Array:
    """Of each window the hashes, four bytes each, of the first 1, 2 .. words from edge on, REACH of them or as many as there is room for."""
    room = np.minimum(room, REACH)
    value, out = np.zeros(len(edge), np.uint64), np.zeros((len(edge), REACH), np.uint64)
    for k in range(REACH):
        word = hashes[np.clip(edge + k * step, 0, len(hashes) - 1)]
        out[:, k] = value = tk.mixed(value * np.uint64(0xFF51AFD7ED558CCD) + word)
    inside = np.arange(REACH)[None, :] < room[:, None]
    at = pa.py_buffer((4 * np.concatenate([[0], np.cumsum(room)])).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(edge), [None, at, pa.py_buffer((out[inside] >> np.uint64(32)).astype(np.uint32).tobytes())])


def repeated(docs: DataFrame) -> DataFrame:
    """Occurrences of repeated passages: doc_id, text_key, kind (paragraph or passage), first_word, n_words, component_id and kept."""
    scratch = Scratch(docs.sparkSession)
    all_units = scratch.cut(units(docs), "units")
    paragraphs = scratch.cut(_paragraphs(docs, all_units.where("cls is not null"), scratch), "paragraphs")
    scratch.close("units", "paragraphs")
    passages = scratch.cut(_passages(docs, all_units.where("kept is not null").select("doc_id", "text_key", F.explode("kept").alias("w")).select("doc_id", "text_key", "w.*"), scratch), "passages")
    scratch.close("paragraphs", "passages")
    return paragraphs.union(passages)


PLACE = ("doc_id", "text_key", "first_word")


def _reaches(met: DataFrame) -> DataFrame:
    """left and right: how many words before and after agree with the first occurrence's. A hash is of all words up to its own, so the last one that
    agrees is found by halving."""
    met = met.withColumns({"left": F.lit(0), "right": F.lit(0)})
    for step in (1 << k for k in reversed(range(REACH.bit_length()))):
        met = met.withColumns({n: F.when(_same(side, F.col(n) + step), F.col(n) + step).otherwise(F.col(n)) for side, n in (("before", "left"), ("after", "right"))})
    return met


def _same(side: str, n: Column) -> Column:
    """Whether there are n words on that side and their hash is the first occurrence's."""
    own, first = (F.substring(x, 4 * n - 3, F.lit(4)) for x in (F.col(side), F.col(f"first.{side}")))
    return (F.octet_length(side) >= 4 * n) & (own == first)


def _paragraphs(docs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    def fetch(wanted: DataFrame) -> DataFrame:
        # By document first: one that holds several wanted paragraphs is joined once and split once.
        asked = wanted.groupBy(F.col("at.doc_id").alias("d"), F.col("at.text_key").alias("k")).agg(F.collect_list(F.struct("cls", F.col("at.line").alias("line"))).alias("asked"))
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
        own = own.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).withColumn("lines", F.split("text", "\n", -1))
        return own.select(F.explode(F.transform("asked", lambda x: F.struct(x["cls"].alias("cls"), F.get("lines", x["line"]).alias("text")))).alias("x")).select("x.cls", "x.text")

    place = F.struct(*PLACE)
    _, found = link(lines.where(F.col("n_shingles") >= ALONE).select("cls", "n_shingles", "registers", F.struct("doc_id", "text_key", "line").alias("at")), fetch, PARAGRAPHS, scratch)
    # A paragraph's cluster: its component, or its class alone where that has several occurrences.
    occurs = lines.join(small(found.withColumnRenamed("node", "cls")), "cls", "left").select(*PLACE, "n_words", F.coalesce("component", "cls").alias("cluster"))
    occurs = scratch.cut(occurs, "occurs")
    many = occurs.groupBy("cluster").agg(F.min(place).alias("head"), F.max(place).alias("last")).where(~F.col("head").eqNullSafe(F.col("last"))).drop("last")
    return occurs.join(many, "cluster").select("doc_id", "text_key", F.lit("paragraph").alias("kind"), "first_word", "n_words", F.xxhash64("cluster").alias("component_id"), place.eqNullSafe(F.col("head")).alias("kept")).distinct()


def _passages(docs: DataFrame, prints: DataFrame, scratch: Scratch) -> DataFrame:
    place = F.struct(*PLACE)
    at = F.xxhash64(*PLACE)  # a place's hash is enough to tell whether there are several
    low, high = F.min(at).alias("low"), F.max(at).alias("high")
    often = prints.groupBy("print").agg(low, high).where("low <> high").select("print")
    spots = prints.join(often, "print").groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.sort_array(F.collect_set("first_word")).alias("spots"))  # a document's own windows
    spots = scratch.cut(spots, "spots")
    scratch.drop("units")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    # Of rows with one doc_id and text, one is read.
    asked = own.join(spots, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    seen = scratch.cut(contexts(asked), "seen")
    heads = seen.groupBy("exact").agg(low, high, F.min(F.struct(*PLACE, "before", "after")).alias("first")).where("low <> high").drop("low", "high")
    hits = _reaches(seen.join(heads, "exact")).withColumn("head", F.struct(*[F.col(f"first.{c}").alias(c) for c in PLACE]))
    hits = scratch.cut(hits.select(*PLACE, "exact", "head", place.eqNullSafe(F.col("head")).alias("kept"), "left", "right"), "hits")
    scratch.drop("seen", "spots")
    # A first occurrence reaches as far as the farthest of the others does.
    others = hits.where("not kept")
    firsts = others.groupBy("exact", *[F.col(f"head.{c}").alias(c) for c in PLACE]).agg(F.max("left").alias("left"), F.max("right").alias("right"))
    hits = others.drop("head").unionByName(firsts.withColumn("kept", F.lit(True)))
    hits = hits.repartition("doc_id", "text_key").distinct()  # the windows below need this partitioning, repeated rows go without another
    of = W.partitionBy("doc_id", "text_key").orderBy("first_word")
    follows = F.col("first_word") - F.lag("first_word").over(of) <= RUN
    chained = hits.withColumns({"goes_on": F.coalesce(follows, F.lit(False)), "same": F.coalesce(follows & (F.lag("kept").over(of) == F.col("kept")), F.lit(False)), "name": F.xxhash64("exact")})
    up_to = of.rowsBetween(W.unboundedPreceding, 0)
    chained = chained.withColumns({"span": F.sum((~F.col("same")).cast("int")).over(up_to), "chain": F.sum((~F.col("goes_on")).cast("int")).over(up_to)})
    # Each window of a chain is tied to the chain's least one, so that components have few steps to go.
    chained = chained.withColumn("least", F.min("name").over(W.partitionBy("doc_id", "text_key", "chain")))
    chained = scratch.cut(chained.select(*PLACE, "name", "kept", "left", "right", "least", "span"), "chained")
    tied = components(chained.select(F.col("name").alias("a"), F.col("least").alias("b")), scratch)
    spans = chained.groupBy("doc_id", "text_key", "span", "kept").agg(
        F.min("first_word").alias("first"), F.max("first_word").alias("last"), F.min_by("left", "first_word").alias("left"), F.max_by("right", "first_word").alias("right"), F.min("name").alias("name"),
    ).select("doc_id", "text_key", "kept", "name", (F.col("first") - F.col("left")).alias("first"), (F.col("last") + WINDOW + F.col("right")).alias("end"))
    by = W.partitionBy("doc_id", "text_key").orderBy("first", "end")
    kept_end = F.max(F.when(F.col("kept"), F.col("end"))).over(by.rowsBetween(W.unboundedPreceding, -1))
    kept_first = F.min(F.when(F.col("kept"), F.col("first"))).over(by.rowsBetween(1, W.unboundedFollowing))
    spans = spans.withColumns({"_a": F.when(F.col("kept"), F.col("first")).otherwise(F.greatest("first", kept_end)), "_b": F.when(F.col("kept"), F.col("end")).otherwise(F.least("end", kept_first))}).where("_a < _b")
    return spans.join(tied, F.col("name") == F.col("node"), "left").select("doc_id", "text_key", F.lit("passage").alias("kind"), F.col("_a").cast("int").alias("first_word"), (F.col("_b") - F.col("_a")).cast("int").alias("n_words"), F.coalesce("component", "name").alias("component_id"), "kept")
