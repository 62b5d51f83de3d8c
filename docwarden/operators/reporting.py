"""Drift reports: ordered rows, sections, totals, and their renderings."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docwarden.functions.expressions import unverifiable_reason


def severity(status: Column) -> Column:
    return F.when(status == "Contradicted", 0).when(status == "Unverifiable", 1).when(status == "Verified", 2).otherwise(99)


def ordered(entries: DataFrame) -> DataFrame:
    """entries (claim_id, doc_file, doc_start_line, status, ...) with severity, file_severity, issues, file_ord and entry_ord, all from 1."""
    of_file = W.partitionBy("doc_file")
    rows = entries.withColumn("severity", severity(F.col("status")))
    rows = rows.withColumn("entry_ord", F.row_number().over(of_file.orderBy("severity", F.col("doc_start_line").asc_nulls_last(), "claim_id")))
    files = rows.groupBy("doc_file").agg(F.min("severity").alias("file_severity"), F.count_if(F.col("status").isin("Contradicted", "Unverifiable")).alias("issues"))
    # One row per file meets in one task.
    files = files.withColumn("file_ord", F.row_number().over(W.orderBy("file_severity", "doc_file")))
    return rows.join(files, "doc_file")


def report_rows(verification: DataFrame, claims: DataFrame, docs: DataFrame, code: DataFrame) -> DataFrame:
    d = docs.select(F.col("id").alias("doc_chunk_id"), F.col("file_path").alias("doc_file"), F.col("heading").alias("doc_heading"), F.col("start_line").alias("doc_start_line"), F.col("end_line").alias("doc_end_line"))
    c = claims.select(F.col("id").alias("claim_id"), "doc_chunk_id", "claim_text", "claim_type")
    k = code.select(F.col("id").alias("matched_code_chunk_id"), F.col("file_path").alias("code_file"), "symbol_name", F.col("start_line").alias("code_start_line"), F.col("end_line").alias("code_end_line"))
    return verification.select("claim_id", "matched_code_chunk_id", "status", "actual_value", "claimed_value").join(c, "claim_id").join(d, "doc_chunk_id").join(k, "matched_code_chunk_id", "left")


def with_reasons(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", F.when(F.col("status") == "Unverifiable", unverifiable_reason(F.col("claim_type"), F.col("symbol_name"), F.col("actual_value"), F.col("claimed_value"))))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.lower("status") == s).alias(s) for s in ("verified", "contradicted", "unverifiable")])


def sections(rows: DataFrame, verbose: bool = False) -> DataFrame:
    """A row per file that has something to show: doc_file, file_ord, issues and its entries in order."""
    shown = ordered(rows)
    shown = shown if verbose else shown.where("status <> 'Verified'")
    return shown.groupBy("doc_file", "file_ord", "issues").agg(F.array_sort(F.collect_list(F.struct("entry_ord", "status", "claim_id"))).alias("entries"))


def text_lines(rows: DataFrame, name: str, verbose: bool = False) -> Iterator[str]:
    """The report as text, line by line; rows come one after the other in order, never as one list."""
    t = totals(rows).first()
    yield from (f"Drift report: {name}", f"{t.verified} verified, {t.contradicted} contradicted, {t.unverifiable} unverifiable", "")
    shown, last = with_reasons(ordered(rows)), None
    shown = shown if verbose else shown.where("status <> 'Verified'")
    for r in shown.orderBy("file_ord", "entry_ord").toLocalIterator():
        if r.doc_file != last:
            yield from ("", f"{r.doc_file} ({r.issues} issues)")
            last = r.doc_file
        detail = f" - {r.reason}" if r.reason else f" - documented {r.claimed_value}, actual {r.actual_value}" if r.status == "Contradicted" else ""
        yield f"  [{r.status}] {r.claim_text}{detail}"
    if last is None:
        yield "No drift detected"


def json_lines(rows: DataFrame, name: str) -> Iterator[str]:
    """The report as one JSON text, verified entries included, piece by piece."""
    yield f'{{"repo": {json.dumps(name)}, "totals": {json.dumps(totals(rows).first().asDict())}, "files": {{'
    last, entries = None, with_reasons(ordered(rows)).orderBy("file_ord", "entry_ord").toLocalIterator()
    for r in entries:
        new = r.doc_file != last
        if new:
            yield ("" if last is None else "], ") + f"{json.dumps(r.doc_file)}: ["
        yield ("" if new else ", ") + json.dumps(r.asDict(recursive=True), default=str)
        last = r.doc_file
    yield "}}" if last is None else "]}}"


def text_report(rows: DataFrame, name: str, verbose: bool = False) -> str:
    return "\n".join(text_lines(rows, name, verbose))


def json_report(rows: DataFrame, name: str) -> str:
    return "\n".join(json_lines(rows, name))
