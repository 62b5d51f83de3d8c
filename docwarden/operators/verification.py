"""Checking claims against resolved symbols: one pass of expressions, with the environment scan as a semi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.functions.expressions import verified_default, verified_return, verified_signature
from docwarden.operators.retrieval import shares


def verify_input(claims: DataFrame, docs: DataFrame, retrieval: DataFrame, code: DataFrame) -> DataFrame:
    """Claims with their section, and what was retrieved for them where there is any."""
    c = claims.join(docs.select(F.col("id").alias("doc_chunk_id"), F.col("file_path").alias("doc_file"), "heading"), "doc_chunk_id")
    r = retrieval.select(F.col("claim_id").alias("id"), "match_status", F.col("matched_code_chunk_id").alias("chunk_id"))
    k = code.select(F.col("id").alias("chunk_id"), "file_path", "symbol_name", "symbol_type", "resolved")
    return c.join(r, "id", "left").join(k, "chunk_id", "left")


def env_readers(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(var_name, repo_id, file_path) of files (repo_id, file_path, text) that read a claimed variable. Variables are drawn out of the sources once
    and joined by name."""
    names = F.regexp_extract_all(F.col("text"), F.lit(r"""(?:os\.environ\.get\(|os\.getenv\(|os\.environ\[)\s*["']([^"']*)["']"""), F.lit(1))
    used = files.select("repo_id", "file_path", F.explode(F.array_distinct(names)).alias("var_name"))
    return used.join(claims.select("repo_id", "var_name").distinct(), ["repo_id", "var_name"])


def verified(rows: DataFrame, readers: DataFrame) -> DataFrame:
    """rows: (id, repo_id, claim_type, match_status, chunk_id, file_path, resolved, value) -> id, chunk_id, status, actual_value, claimed_value, method."""
    var = F.col("value.var_name")
    same = lambda r: (F.col("repo_id") == F.col(f"{r}_repo")) & (var == F.col(f"{r}_var"))
    named = lambda r: readers.select(F.col("repo_id").alias(f"{r}_repo"), F.col("var_name").alias(f"{r}_var"), F.col("file_path").alias(f"{r}_file"))
    first = named("any").groupBy("any_repo", "any_var").agg(F.min("any_file").alias("any_file"))
    rows = rows.join(named("own").distinct(), same("own") & (F.col("file_path") == F.col("own_file")), "left").join(first, same("any"), "left")
    out = lambda s, a=None, c=None: F.struct(F.lit(s).alias("status"), (F.lit(None).cast("string") if a is None else a).alias("actual_value"), (F.lit(None).cast("string") if c is None else c).alias("claimed_value"))
    params = F.coalesce("resolved.parameters", F.array().cast("array<struct<name:string,kind:string,has_default:boolean,default_repr:string,is_literal:boolean>>"))
    seen = F.coalesce("own_file", "any_file")
    found = F.when(var.isNull(), out("Unverifiable")).when(seen.isNotNull(), out("Verified", F.concat(var, F.lit(" referenced in "), seen), var)).otherwise(out("Unverifiable", F.lit("not found via static scan"), var))
    kind = F.col("claim_type")
    status = (
        F.when((kind == "behavior") | (F.coalesce("match_status", F.lit("no_match")) != "matched") | F.col("chunk_id").isNull(), out("Unverifiable"))
        .when(F.col("value").isNull(), out("Unverifiable"))
        .when(F.coalesce("resolved.resolution_method", F.lit("failed")) == "failed", out("Unverifiable", F.lit("could not resolve symbol")))
        .when(kind == "signature", verified_signature(F.col("value.param_names"), params))
        .when(kind == "default_value", verified_default(F.col("value.param_name"), F.col("value.default"), params))
        .when(kind == "env_var", found)
        .when(kind == "return_type", verified_return(F.col("value.return_type"), F.col("resolved.return_annotation")))
        .otherwise(out("Unverifiable"))
    )
    tried = (kind != "behavior") & (F.coalesce("match_status", F.lit("no_match")) == "matched") & F.col("chunk_id").isNotNull() & F.col("value").isNotNull()
    method = F.when(tried, F.coalesce("resolved.resolution_method", F.lit("failed")))
    return rows.select("id", "chunk_id", status.alias("s"), method.alias("method")).select("id", "chunk_id", "s.*", "method")


def statistics(found: DataFrame) -> DataFrame:
    """Counts and shares of the statuses, and how the symbols were resolved, in one row."""
    n = lambda how: F.count_if(F.coalesce(F.col("method") == how, F.lit(False)))
    return shares(found, "status", ("Verified", "Contradicted", "Unverifiable"), n("dynamic").alias("dynamic_resolutions"), n("static").alias("static_resolutions"), n("failed").alias("resolution_failures"))
