"""Evaluation: fault targets and faults, detection, labelled scoring, deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.operators.merge import latest


def target_rows(retrieval: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, match_status, claim_type) of retrieved claims."""
    return retrieval.select("claim_id", F.col("matched_code_chunk_id").alias("chunk_id"), "match_status").join(claims.select(F.col("id").alias("claim_id"), "claim_type"), "claim_id")


def fault_targets(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n chunks of rows (claim_id, chunk_id, claim_type, match_status): signature and default claims first, one row a chunk, by seeded hash."""
    fit = rows.where("match_status = 'matched' and claim_type <> 'behavior'").withColumn("preferred", F.col("claim_type").isin("signature", "default_value"))
    first = latest(fit, ["chunk_id"], [F.col("preferred").desc(), F.col("claim_id")])
    return first.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("chunk_id").cast("string")))).orderBy(F.col("preferred").desc(), "draw", "chunk_id").limit(n)


def detection(rows: DataFrame) -> DataFrame:
    """Per fault of rows (fault_id, ord, status): detected if any row is Contradicted; outcome that, else the last status, else a text for none."""
    hit = F.coalesce(F.bool_or(F.col("status") == "Contradicted"), F.lit(False))
    last = F.max_by("status", F.when(F.col("status").isNotNull(), F.col("ord")))
    return rows.groupBy("fault_id").agg(hit.alias("detected"), F.when(hit, "Contradicted").otherwise(F.coalesce(last, F.lit("No matching claim verified"))).alias("outcome"))


def detection_rate(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n_faults"), F.count_if("detected").alias("detected"), F.count_if(~F.col("detected")).alias("missed"), F.round(F.coalesce(F.try_divide(100.0 * F.count_if("detected"), F.count("*")), F.lit(0.0)), 1).alias("detection_rate"))


def sample_for_labels(rows: DataFrame, key: str, n: int = 50, seed: int = 42) -> DataFrame:
    """At most n rows by seeded hash: a limit that is the feature."""
    return rows.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("draw", key).limit(n)


def extraction_score(labelled: DataFrame, counts: DataFrame) -> DataFrame:
    """Seven counters of expected against actual claim counts: labelled (id, expected), counts (id); unusable rows have a null expected."""
    actual = labelled.join(counts.groupBy("id").agg(F.count("*").alias("actual")), "id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    use, e, a = F.col("expected").isNotNull(), F.col("expected"), F.col("actual")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return actual.agg(n(use).alias("labeled"), n(~use).alias("skipped"), n(e == a).alias("exact"), n(F.abs(e - a) <= 1).alias("within_one"), n((e == 0) & (a == 0)).alias("zero_correct"), n((e > 0) & (a > 0)).alias("nonzero_correct"), n(e == 0).alias("zero_total"))


def metrics_summary(faults: dict | None, extraction: dict | None) -> str:
    """Both evaluations as text."""
    out = ["Evaluation summary"]
    if faults:
        out.append(f"Faults: {faults['detected']} of {faults['n_faults']} detected ({faults['detection_rate']:.1f}%)")
    if extraction:
        n = max(1, extraction["labeled"])
        out.append(f"Extraction: {extraction['labeled']} labelled, {100 * extraction['exact'] / n:.1f}% exact, {100 * extraction['within_one'] / n:.1f}% within one")
    return "\n".join(out)
