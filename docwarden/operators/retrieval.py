"""Linking claims to code: exact cosine top-k and the rule cascade over it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docwarden.functions.expressions import matches_guess

TOP_K, FLOOR, MARGIN = 5, 0.55, 0.05
#: Vectors of a tile: claims, and code chunks.
ASKED, STORED = 2048, 8192
NEAR = "claim_id long, guess string, chunk_id long, symbol_name string, score double"


def units(vectors: pd.Series) -> np.ndarray:
    """A matrix of unit rows; a zero vector stays zero."""
    m = np.array(vectors.tolist(), np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def nearest(asked: pd.DataFrame, stored: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k likest of a tile's stored vectors for each asked one, ties by chunk_id."""
    if asked.empty or stored.empty:
        return pd.DataFrame(columns=[x.split()[0] for x in NEAR.split(", ")])
    u, out = units(stored.vector), []
    ids = stored.chunk_id.to_numpy()
    for at in range(0, len(asked), 256):
        part = asked.iloc[at : at + 256]
        score = np.round(units(part.vector) @ u.T, 6) + 0.0
        least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(part), -2.0)
        row, col = np.nonzero(score >= least[:, None])
        order = np.lexsort((ids[col], -score[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        out.append(pd.DataFrame({"claim_id": part.claim_id.to_numpy()[row], "guess": part.guess.to_numpy()[row], "chunk_id": ids[col], "symbol_name": stored.symbol_name.to_numpy()[col], "score": score[row, col]}))
    return pd.concat(out)


def top_k(claims: DataFrame, code: DataFrame, k: int = TOP_K, asked: int = ASKED, stored: int = STORED) -> DataFrame:
    """The k likest code chunks of each claim within its repository: claim_id, guess, chunk_id, symbol_name, score, rank (ties by chunk_id).

    claims: (claim_id, repo_id, guess, vector); code: (chunk_id, repo_id, symbol_name, vector). A query set against all chunks, in tiles: both sides
    of a repository are dealt into parts by their counts, a tile is one matrix product, and its k best are kept before tiles meet."""
    claims, code = claims.select("claim_id", "repo_id", "guess", "vector"), code.select("chunk_id", "repo_id", "symbol_name", "vector")
    many = lambda df, most, name: df.groupBy("repo_id").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    parts = many(claims, asked, "a_parts").join(many(code, stored, "b_parts"), "repo_id")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = claims.join(parts, "repo_id").withColumn("a", own("claim_id", "a_parts")).withColumn("b", all_of("b_parts")).drop("a_parts", "b_parts")
    b = code.join(parts, "repo_id").withColumn("b", own("chunk_id", "b_parts")).withColumn("a", all_of("a_parts")).drop("a_parts", "b_parts")
    near = a.groupBy("repo_id", "a", "b").cogroup(b.groupBy("repo_id", "a", "b")).applyInPandas(lambda x, y: nearest(x, y, k), NEAR)
    order = [F.col("score").desc(), F.col("chunk_id")]
    return near.withColumn("rank", F.row_number().over(W.partitionBy("claim_id").orderBy(*order))).where(F.col("rank") <= k).select("claim_id", "guess", "chunk_id", "symbol_name", "score", "rank")


def cascade(candidates: Column, guess: Column, floor: float = FLOOR, margin: float = MARGIN) -> Column:
    """(match_status, chunk_id) from candidates, array<struct<score, chunk_id, symbol_name>> in order of score.

    A symbol named by the claim wins: exactly spelled, else in any case; a single one whatever its score, several by margin. Otherwise the best
    candidate must lie over the floor, and over the next one by the margin."""
    exact = F.filter(candidates, lambda c: matches_guess(c["symbol_name"], guess))
    loose = F.filter(candidates, lambda c: matches_guess(F.lower(c["symbol_name"]), F.lower(guess)))
    none = F.slice(candidates, 1, 0)
    named = F.when(F.coalesce(guess, F.lit("")) == "", none).when(F.size(exact) > 0, exact).otherwise(loose)
    out = lambda status, c=None: F.struct(F.lit(status).alias("match_status"), (F.lit(None).cast("long") if c is None else c["chunk_id"]).alias("chunk_id"))
    at = lambda x, i: F.get(x, F.lit(i))
    clear = lambda x: (F.size(x) == 1) | (F.round(at(x, 0)["score"] - at(x, 1)["score"], 6) > margin)
    return (
        F.when(F.size(candidates) < 1, out("no_match"))
        .when((F.size(named) > 0) & clear(named), out("matched", at(named, 0)))
        .when(F.size(named) > 0, out("ambiguous"))
        .when(at(candidates, 0)["score"] <= floor, out("no_match"))
        .when(clear(candidates), out("matched", at(candidates, 0)))
        .otherwise(out("ambiguous"))
    )


def retrieved(claims: DataFrame, code: DataFrame, k: int = TOP_K, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """claim_id, match_status, matched_chunk_id, top_k of every claim; a claim without vector or candidates has no match."""
    best = top_k(claims.where(F.col("vector").isNotNull()), code.where(F.col("vector").isNotNull()), k)
    order = lambda x: F.array_sort(x, lambda a, b: F.when(a["rank"] < b["rank"], -1).otherwise(1))
    lists = best.groupBy("claim_id").agg(order(F.collect_list(F.struct("rank", "score", "chunk_id", "symbol_name"))).alias("top_k"))
    joined = claims.select("claim_id", "guess").join(lists, "claim_id", "left")
    found = cascade(F.coalesce("top_k", F.array().cast("array<struct<rank:int,score:double,chunk_id:long,symbol_name:string>>")), F.col("guess"), floor, margin)
    return joined.select("claim_id", found.alias("f"), "top_k").select("claim_id", "f.match_status", F.col("f.chunk_id").alias("matched_chunk_id"), "top_k")


def shares(rows: DataFrame, column: str, values: tuple[str, ...], *more: Column) -> DataFrame:
    """Counts and percentages (one decimal, 0 for an empty input) of a column's values, and more aggregates, in one row."""
    total = F.count("*")
    each = [c for v in values for c in (F.count_if(F.col(column) == v).alias(v.lower()), F.round(F.coalesce(F.try_divide(100.0 * F.count_if(F.col(column) == v), total), F.lit(0.0)), 1).alias(f"{v.lower()}_pct"))]
    return rows.agg(total.alias("total"), *each, *more)
