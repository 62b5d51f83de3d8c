"""Vectors of texts through a pluggable embedder, a callable from texts to unit vectors; offline, hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.functions.expressions import blank_to_null
from docwarden.operators.batches import appended

PREFIX = "Represent this sentence for retrieval: "
BATCH, DIMENSIONS = 32, 64


def hashed_ngrams(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of three-character windows, hashed into so many places; all of a batch's windows at once."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in texts]
    sizes = np.array([len(x) for x in points])
    line, owner = np.concatenate(points), np.repeat(np.arange(len(texts)), sizes)
    whole = owner[2:] == owner[:-2]
    h = ((line[:-2] * np.uint64(0x1F1F1F1F) + line[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + line[2:]) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31)))[whole]
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    out = np.bincount(owner[2:][whole] * dimensions + ((h >> np.uint64(20)) % np.uint64(dimensions)).astype(np.int64), sign, len(texts) * dimensions).reshape(len(texts), dimensions)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@functools.cache
def sentence_model(name: str):
    """A worker's one copy of a sentence model; its library is only needed by those who name a model."""
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


def embedder_of(name: str) -> Callable[[list[str]], np.ndarray]:
    """The embedder that a configuration names: "hashed", or a sentence model, loaded once in each worker."""
    return hashed_ngrams if name == "hashed" else functools.partial(_by_model, name)


def _by_model(name: str, texts: list[str]) -> np.ndarray:
    return np.asarray(sentence_model(name).encode(texts, batch_size=BATCH, normalize_embeddings=True))


def embed(rows: DataFrame, text: str, fallback: str, embedder: Callable[[list[str]], np.ndarray] = hashed_ngrams, model_name: str = "hashed") -> DataFrame:
    """rows with embedding and used_fallback: a blank text is embedded by its fallback, and has no vector if that is blank as well."""
    own = blank_to_null(F.col(text))
    ready = rows.withColumns({"_text": F.coalesce(own, blank_to_null(F.col(fallback))), "used_fallback": own.isNull()})
    prefix = PREFIX if "bge" in model_name.lower() else ""

    def vectors(columns: dict[str, list]) -> list:
        texts = columns["_text"]
        at, out = [k for k, t in enumerate(texts) if t is not None], [None] * len(texts)
        for k in range(0, len(at), BATCH):
            part = at[k : k + BATCH]
            for i, v in zip(part, embedder([prefix + texts[i] for i in part])):
                out[i] = v.astype(np.float32)
        return out

    return appended(ready, "embedding", "array<float>", vectors, ["_text"]).drop("_text")
