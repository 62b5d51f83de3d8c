"""The whole check of a repository against its documentation, stage by stage, over a Store."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.functions.expressions import code_embedding_text, doc_embedding_text, query_text, truncated_heading
from docwarden.operators import chunking, claims, embedding, reporting, retrieval, verification
from docwarden.operators.batches import appended
from docwarden.operators.merge import replaced, upserted
from docwarden.sources import files
from docwarden.sources.store import Store
from docwarden.streaming.ingest import change_counts, changes


def stage(run: Callable) -> Callable:
    """Releases what a stage has cached when it ends: tables are written anew under the same path, so an old cache would be taken for new rows."""

    @functools.wraps(run)
    def held(*args, **kwargs):
        frames: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            frames.append(df.cache())
            return df

        try:
            return run(keep, *args, **kwargs)
        finally:
            for df in frames:
                df.unpersist(True)

    return held


def repo_id(path: str) -> int:
    """A stable id of a repository's path: 63 bits of its SHA-256."""
    return int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "big") >> 1


def known(store: Store, path: str) -> int | None:
    """The id of a repository that was added."""
    return None if store.of("repos", repo_id(path)).where(F.col("path") == path).isEmpty() else repo_id(path)


def init(store: Store, name: str, path: str) -> int:
    """Adds the repository, or renames it; commits that were seen before stay."""
    rid = repo_id(path)
    old = store.of("repos", rid)
    if not old.where(F.col("path") != path).isEmpty():
        raise ValueError(f"the id of {path} belongs to another repository")
    new = store.spark.createDataFrame([(rid, name, path, None, None)], old.schema)
    store.replace("repos", rid, upserted(old, new, ["path"], ["name"]))
    return rid


def _seen(store: Store, rid: int, root: str, kind: str, picked: DataFrame, own: DataFrame, full: bool) -> DataFrame:
    """The files as they are now, with content_hash. Those that git says are unchanged since the commit that was last seen keep the cache's hash and
    aren't read; without such a commit all are."""
    last = store.of("repos", rid).select(f"last_{kind}_sha").first()
    paths, all_of_them = (set(), True) if full or last is None else files.changed_since(root, last[0])
    if all_of_them:
        return files.read(picked)
    changed = store.spark.createDataFrame([(p,) for p in sorted(paths)], "file_path string")
    same = picked.join(own.select("file_path", "content_hash"), "file_path").join(changed, "file_path", "left_anti")
    rest = picked.join(same.select("file_path"), "file_path", "left_anti").select(*picked.columns)
    return files.read(rest).unionByName(same.withColumn("text", F.lit(None).cast("string")), allowMissingColumns=True)


@stage
def chunk(keep: Callable, store: Store, rid: int, root: str, kind: str, full: bool = False) -> dict:
    """Chunks the files whose content changed (all with full); those that can't be parsed keep their chunks. Counts of the change and of what is there."""
    table = f"{kind}_chunks"
    pick = files.code_files if kind == "code" else files.doc_files
    cache, old = store.of("file_cache", rid), store.of(table, rid)
    own = cache.where(F.col("file_type") == kind)
    now = keep(_seen(store, rid, root, kind, pick(files.listed(store.spark, root, rid)), own, full).withColumn("file_type", F.lit(kind)))
    found = keep(changes(own.limit(0) if full else own, now))
    counts = change_counts(found).first().asDict()
    touched = now.join(found.where("change in ('added', 'modified')").select("repo_id", "file_path"), ["repo_id", "file_path"])
    key = F.xxhash64("repo_id", "file_path", "symbol_name" if kind == "code" else "heading", "start_line")
    none = F.lit(None)
    if kind == "code":
        rows = keep(chunking.chunk_code(touched))
        bad = rows.where("parse_error").select("repo_id", "file_path")
        rows = rows.where("not parse_error").withColumn("id", key)
        counts["unparsable"] = bad.count()
    else:
        rows = keep(chunking.chunk_docs(touched).withColumn("id", key).withColumn("heading", truncated_heading(F.col("heading"))))
        bad = rows.limit(0).select("repo_id", "file_path")
    rows = rows.withColumns({"embedding": none.cast("array<float>"), "embedding_id": none.cast("string")}).select(*old.columns)
    gone = found.where("change <> 'unchanged'").join(bad, ["repo_id", "file_path"], "left_anti")
    if full:
        gone = gone.select("repo_id", "file_path").union(old.select("repo_id", "file_path")).distinct()
    counts["chunks"] = store.replace(table, rid, replaced(old, rows, ["repo_id", "file_path"], gone))
    counts |= chunk_counts(store.of(table, rid), kind)
    sha = files.head_sha(root)
    fresh = now.select("repo_id", "file_path", "file_type", "content_hash", F.lit(sha).alias("last_processed_commit_sha"), F.current_timestamp().alias("last_processed_at"))
    store.replace("file_cache", rid, cache.where(F.col("file_type") != kind).unionByName(fresh))
    store.replace("repos", rid, store.of("repos", rid).withColumn(f"last_{kind}_sha", F.lit(sha)))
    return counts


def chunk_counts(rows: DataFrame, kind: str) -> dict:
    """Symbols by kind; sections, preambles and code blocks."""
    if kind == "code":
        return {"kinds": {r.symbol_type: r.n for r in symbol_counts(rows).collect()}}
    return section_counts(rows).first().asDict()


def symbol_counts(rows: DataFrame) -> DataFrame:
    """A row for each kind of symbol, of which there are six."""
    return rows.groupBy("symbol_type").agg(F.count("*").alias("n"))


def section_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("heading_level") > 0).alias("sections"), F.count_if(F.col("heading_level") == 0).alias("preambles"), F.coalesce(F.sum(F.size("code_blocks")), F.lit(0)).cast("long").alias("blocks"))


@stage
def embed(keep: Callable, store: Store, rid: int, embedder: Callable = embedding.hashed_ngrams) -> dict:
    """Vectors of chunks that have none."""
    counts = {}
    for kind in ("code", "doc"):
        rows = store.of(f"{kind}_chunks", rid)
        text = code_embedding_text(F.col("symbol_type"), F.col("symbol_name"), F.col("docstring"), F.col("source_text")) if kind == "code" else doc_embedding_text(F.col("heading"), F.col("text"))
        need = rows.where(F.col("embedding").isNull()).drop("embedding", "embedding_id").withColumns({"_own": text, "_else": F.coalesce(F.col("symbol_name" if kind == "code" else "heading"), "file_path")})
        done = keep(embedding.embed(need, "_own", "_else", embedder).withColumn("embedding_id", F.concat(F.lit(f"{kind}_chunk_"), F.col("id").cast("string"))))
        counts |= {f"{kind}_embedded": done.where("embedding is not null").count(), f"{kind}_fallback": done.where("used_fallback").count()}
        store.replace(f"{kind}_chunks", rid, rows.where(F.col("embedding").isNotNull()).unionByName(done.select(*rows.columns)))
    return counts


def claim_counts(rows: DataFrame) -> DataFrame:
    """A row for each claim type that occurs."""
    return rows.groupBy("claim_type").agg(F.count("*").alias("n"))


@stage
def extract(keep: Callable, store: Store, rid: int, model: Callable[[str], str] = claims.rule_model, limit: int | None = None) -> dict:
    """Claims of all sections (of the first `limit` by id, if asked for); what no longer yields claims loses its old ones."""
    docs = store.of("doc_chunks", rid).select("repo_id", F.col("id").alias("doc_chunk_id"), "heading", "text")
    docs = docs.orderBy("doc_chunk_id").limit(limit) if limit else docs
    got = keep(claims.extract_claims(docs, model))
    good = got.where("error is null").withColumn("id", F.xxhash64("doc_chunk_id", "claim_text", "claim_type", "referenced_symbol_guess")).drop("error").dropDuplicates(["id"])
    counts = {r.claim_type: r.n for r in claim_counts(good).collect()}
    counts["failed_sections"] = got.where("error is not null").count()
    store.replace("claims", rid, good)
    return counts


def retrieve(store: Store, rid: int, k: int = retrieval.TOP_K, embedder: Callable = embedding.hashed_ngrams) -> dict:
    guess = F.col("referenced_symbol_guess")
    asked = store.of("claims", rid).withColumns({"_q": query_text(F.col("claim_text"), guess), "_none": F.lit(None).cast("string")})
    vectors = embedding.embed(asked, "_q", "_none", embedder).select(F.col("id").alias("claim_id"), "repo_id", guess.alias("guess"), F.col("embedding").alias("vector"))
    code = store.of("code_chunks", rid).select(F.col("id").alias("chunk_id"), "repo_id", "symbol_name", F.col("embedding").alias("vector"))
    found = retrieval.retrieved(vectors, code, k or retrieval.TOP_K)
    tops = F.transform("top_k", lambda c: F.struct(c["chunk_id"].alias("code_chunk_id"), c["symbol_name"].alias("symbol_name"), c["score"].alias("score")))
    rows = found.select(F.col("claim_id").alias("id"), F.lit(rid).cast("long").alias("repo_id"), "claim_id", F.col("matched_chunk_id").alias("matched_code_chunk_id"), "match_status", tops.alias("top_k"), F.current_timestamp().alias("retrieved_at"))
    store.replace("retrieval_results", rid, rows)
    return retrieval.shares(store.of("retrieval_results", rid), "match_status", ("matched", "ambiguous", "no_match")).first().asDict()


def rule_value(prompt: str) -> str:
    """Offline stand-in for a model that reads a claim's value."""
    import json
    import re

    text = prompt.split("\n\n", 1)[-1]
    if m := re.search(r"`?(\w+)`? defaults to `?([^\s`.,]+)", text):
        return json.dumps({"param_name": m[1], "default": m[2]})
    if m := re.search(r"(?:environment variable|env var) `?([A-Z_]{3,})", text):
        return json.dumps({"var_name": m[1]})
    if m := re.search(r"returns `?([\w\[\], ]+)", text):
        return json.dumps({"return_type": m[1].strip()})
    if m := re.search(r"`\w+\(([^)]*)\)`", text):
        names = [p.split("=")[0].split(":")[0].strip() for p in m[1].split(",") if p.strip()]
        return json.dumps({"param_names": names, "param_count": len(names)})
    return "{}"


def claimed_values(rows: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """rows with value: two attempts at most; behavior and unmatched claims aren't asked for."""
    fields = ("param_names", "param_count", "param_name", "default", "var_name", "return_type")

    def one(text: str, kind: str, wanted: bool) -> dict | None:
        for _ in range(2 if wanted else 0):
            try:
                if (got := claims.parse_value(model(claims.value_prompt(text, kind)), kind)) is not None:
                    return {f: got.get(f) for f in fields}
            except Exception:  # a model's failure leaves the claim unverifiable
                return None
        return None

    def every(columns: dict[str, list]) -> list:
        return [one(t, k, m == "matched" and k != "behavior") for t, k, m in zip(columns["claim_text"], columns["claim_type"], columns["match_status"])]

    return appended(rows, "value", claims.VALUE, every, ["claim_text", "claim_type", "match_status"])


@stage
def verify(keep: Callable, store: Store, rid: int, root: str, model: Callable[[str], str] = rule_value) -> dict:
    mine = lambda name: store.of(name, rid)
    code = chunking.resolve_symbols(mine("code_chunks").drop("embedding"))
    rows = verification.verify_input(mine("claims"), mine("doc_chunks"), mine("retrieval_results"), code)
    rows = keep(claimed_values(rows.select("id", "repo_id", "claim_text", "claim_type", "match_status", "chunk_id", "file_path", "resolved"), model))
    sources = files.read(files.env_files(store.spark, root, rid))
    readers = verification.env_readers(rows.where("value.var_name is not null").select("repo_id", "value.var_name"), sources)
    out = keep(verification.verified(rows, readers))
    store.replace("verification_results", rid, out.select("id", F.lit(rid).cast("long").alias("repo_id"), F.col("id").alias("claim_id"), F.col("chunk_id").alias("matched_code_chunk_id"), "status", "actual_value", "claimed_value", F.current_timestamp().alias("verified_at")))
    return verification.statistics(out).first().asDict()


def report_rows(store: Store, rid: int) -> DataFrame:
    mine = lambda name: store.of(name, rid)
    return reporting.report_rows(mine("verification_results"), mine("claims"), mine("doc_chunks"), mine("code_chunks"))


def prechecks(store: Store, rid: int) -> dict:
    """Rows that the stages need: sections, embedded symbols, claims of known sections, and outcomes of retrieval for them."""
    docs, claimed = store.of("doc_chunks", rid), store.of("claims", rid)
    return counts_of(docs, store.of("code_chunks", rid), claimed, store.of("retrieval_results", rid)).first().asDict()


def counts_of(docs: DataFrame, code: DataFrame, claimed: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The four counts in one row, as counts of rows that say what they are."""
    of = claimed.join(docs.select(F.col("id").alias("doc_chunk_id")), "doc_chunk_id", "left_semi")
    found = retrieved.join(of.select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
    parts = (docs, "sections"), (code.where(F.col("embedding_id").isNotNull()), "embedded"), (of, "claims"), (found, "retrieved")
    rows = functools.reduce(DataFrame.union, [df.select(F.lit(name).alias("what")) for df, name in parts])
    return rows.agg(*[F.count_if(F.col("what") == name).alias(name) for _, name in parts])


def run_all(store: Store, rid: int, root: str, full: bool = False, model: Callable[[str], str] | None = None, embedder: Callable = embedding.hashed_ngrams) -> dict:
    out = {"code": chunk(store, rid, root, "code", full), "docs": chunk(store, rid, root, "doc", full), "embed": embed(store, rid, embedder)}
    out |= {"claims": extract(store, rid, model or claims.rule_model), "retrieval": retrieve(store, rid, embedder=embedder)}
    return out | {"verification": verify(store, rid, root, model or rule_value)}
