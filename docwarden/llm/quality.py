"""Document quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader (McMahan et al., 2013).

A word stands twice: lower-cased, and as its shape (runs of capitals, small letters, digits and each sign collapsed). Unigrams and bigrams of both
are hashed into one table of weights; a text's score is the logistic of the bias and of each kind's mean weight, one sparse dot product.

Training sees at most TRAIN_ROWS labelled rows, those with the least hash of their doc_id, and no held-out one (crc32 of the doc_id's text divisible
by 5); texts of more than TRAIN_BYTES bytes are scored, but not learned from. They meet in one task, which these bounds keep small. Only the table of weights, 2**BITS numbers, goes through the driver. Scoring is one
pass over whole texts and shuffles nothing.

Defined results: a null or empty text has no features and gets the bias's score; a null doc_id is neither held out nor learned from; a repeated
row is scored again; labels without quality are skipped, contradicting ones are all learned from; without labels every score is 0.5; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm import textkit as tk

BITS = 18
TRAIN_ROWS, TRAIN_BYTES = 5000, 100_000
PASSES = 4
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.8, 1.0, 1e-4, 1e-4
KINDS = 4

#: Classes of bytes for shapes: capitals, small letters and all that is not ASCII, digits; other signs stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: table rows, and how many of each text (in the texts' order)."""
    data, at = tk.text_bytes(column)
    n = len(column)
    start, end, doc = tk.words(data, at, tk.GAPS["spaced"])
    if not len(start):
        return [(np.zeros(0, np.int64), np.zeros(n, np.int64))] * KINDS
    shape = _SHAPE[data]
    kept = np.ones(len(shape), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[start] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    plain, shaped = tk.word_hashes(tk._LOWER[data], start, end), tk.word_hashes(shape[kept], place[start], place[end])
    joint = doc[1:] == doc[:-1]
    counts = np.bincount(doc, minlength=n)
    pairs = np.bincount(doc[1:][joint], minlength=n)
    out = []
    for seed, h in enumerate((plain, shaped)):
        two = tk.mixed(h[:-1] * np.uint64(31) + h[1:])[joint]
        for value, many, kind in ((h, counts, 0), (two, pairs, 1)):
            out.append(((tk.mixed(value + np.uint64(97 * (2 * seed + kind + 1))) >> np.uint64(64 - BITS)).astype(np.int64), many))
    return out


def scores(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(column), bias)
    for rows, many in features(column):
        sums = np.concatenate([[0.0], np.cumsum(weights[rows])])
        stop = np.cumsum(many)
        total += (sums[stop] - sums[stop - many]) / np.maximum(many, 1)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fitted(texts: list[str], labels: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal, one example at a time in a fixed order that changes with each pass."""
    examples = []
    for k in range(0, len(texts), 64):
        column = pa.array(texts[k : k + 64], pa.string())
        parts = [(rows, np.cumsum(many), many) for rows, many in features(column)]
        for i in range(len(column)):
            rows = np.concatenate([r[stop[i] - many[i] : stop[i]] for r, stop, many in parts])
            value = np.concatenate([np.full(many[i], 1 / max(many[i], 1)) for _, _, many in parts])
            spot, where = np.unique(rows, return_inverse=True)
            examples.append((np.append(spot, 1 << BITS), np.append(np.bincount(where, value, len(spot)), 1.0)))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for k in range(passes):
        for i in np.random.default_rng(k).permutation(len(examples)):
            spot, x = examples[i]
            w = weight(z[spot], n[spot])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[i]) * x
            z[spot] += g - (np.sqrt(n[spot] + g * g) - np.sqrt(n[spot])) / ALPHA * w
            n[spot] += g * g
    w = weight(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """The model from a bounded sample of labelled documents that aren't held out."""
    import pandas as pd

    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("d"), F.col("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("d"), "d", "quality").limit(rows)
    # The sample is at most `rows` rows of two numbers.
    short = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    rows_of = short.join(F.broadcast(sample), F.col("doc_id") == F.col("d")).orderBy(F.xxhash64("d"), F.xxhash64("text"), "quality").limit(rows)

    def fit(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["d", "quality"], kind="stable")
        weights, bias = fitted(got.text.fillna("").tolist(), got.quality.to_numpy())
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    model = rows_of.select("d", "text", "quality").groupBy().applyInPandas(fit, "weights binary, bias double").collect()
    return (np.frombuffer(model[0]["weights"], np.float32), model[0]["bias"]) if model else (np.zeros(1 << BITS, np.float32), 0.0)


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, held_out, score and predicted of each document."""
    model = trained(docs, labels)
    # Weights go to executors once, as Spark's broadcast of a fixed 2**BITS numbers.
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select("doc_id", *keep, F.col("text").cast("string").alias("_text"))
    names = [f.name for f in chosen.schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for whole in batches:
            for batch in tk.slices(whole, "_text"):
                score = scores(batch.column("_text"), weights, bias)
                yield pa.record_batch([*[batch.column(x) for x in names], pa.array(score)], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = chosen.mapInArrow(run, StructType([*chosen.schema.fields[:-1], StructField("score", DoubleType())]))
    return out.select("doc_id", *keep, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
