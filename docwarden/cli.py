"""Command line: python -m docwarden.cli COMMAND [options]."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docwarden.operators import chunking, claims, embedding, evaluation, faults, reporting
from docwarden.plans import pipeline
from docwarden.sources import files, model, store


def session() -> SparkSession:
    return SparkSession.builder.appName("docwarden").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _known(s: store.Store, path: str) -> int:
    rid = pipeline.known(s, path)
    if rid is None:
        stop(f"{path} is not known: run init first")
    return rid


def stop(text: str, code: int = 1) -> None:
    """Ends the command: 1 for an error, 0 where there is nothing to do."""
    print(text, file=sys.stderr)
    sys.exit(code)


def _needs(s: store.Store, rid: int, what: str, text: str, code: int = 1) -> None:
    if not pipeline.prechecks(s, rid)[what]:
        stop(text, code)


def _models(conf: dict, asks: bool = True) -> tuple:
    """The configured model (None: rules) and embedder. A model that isn't there ends the command."""
    name, host = conf["model"], conf["model_host"].rstrip("/")
    if name == "rules" or not asks:
        return None, embedding.embedder_of(conf["embedder"])
    if not model.reachable(host):
        stop(f"no model service at {host}")
    if not model.available(name, host):
        stop(f"no model {name} at {host}")
    return model.Model(name, host), embedding.embedder_of(conf["embedder"])


def embed(s, a, conf):
    counts = pipeline.embed(s, rid := _known(s, a.path), _models(conf, False)[1])
    if s.of("code_chunks", rid).isEmpty() and s.of("doc_chunks", rid).isEmpty():
        print("warning: nothing to embed, run chunk-code and chunk-docs first", file=sys.stderr)
    return counts


def extract(s, a, conf):
    rid = _known(s, a.path)
    _needs(s, rid, "sections", "no sections: run chunk-docs first")
    counts = pipeline.extract(s, rid, _models(conf)[0] or claims.rule_model, a.limit)
    if counts["failed_sections"] and set(counts) == {"failed_sections"}:
        print("warning: every section failed", file=sys.stderr)
    return counts


def retrieve(s, a, conf):
    rid = _known(s, a.path)
    _needs(s, rid, "claims", "no claims: run extract-claims first", 0)
    _needs(s, rid, "embedded", "no embedded code: run embed first")
    return pipeline.retrieve(s, rid, a.top_k, _models(conf, False)[1])


def verify(s, a, conf):
    rid = _known(s, a.path)
    _needs(s, rid, "retrieved", "nothing was retrieved: run retrieve first")
    return pipeline.verify(s, rid, a.path, _models(conf)[0] or pipeline.rule_value)


def init(s, a, conf):
    if not os.path.isdir(os.path.join(a.path, ".git")):
        print(f"{a.path} is no git repository", file=sys.stderr)
        sys.exit(1)
    if files.head_sha(a.path) is None:
        print("warning: no commits yet", file=sys.stderr)
    return {"repo_id": pipeline.init(s, a.name or os.path.basename(a.path), a.path)}


def report(s, a, conf):
    rows = pipeline.report_rows(s, _known(s, a.path))
    if rows.isEmpty():
        print("warning: no verification results", file=sys.stderr)
    lines = reporting.json_lines(rows, a.path) if a.format == "json" else reporting.text_lines(rows, a.path, a.verbose)
    if not a.output:
        return "\n".join(lines)
    os.makedirs(os.path.dirname(os.path.abspath(a.output)), exist_ok=True)
    with open(a.output, "w") as f:
        f.writelines(f"{x}\n" for x in lines)
    return f"report of {a.path}: {a.output}"


def eval_faults(s, a, conf):
    """Injects faults into a copy and scores what is found there: its code is chunked anew, sections and claims are the original's, under new ids,
    so that only the faults can make a difference. The copy stands beside the tables, where all tasks see it."""
    rid = _known(s, a.path)
    rows = evaluation.target_rows(s.of("retrieval_results", rid), s.of("claims", rid))
    code = chunking.resolve_symbols(s.of("code_chunks", rid).drop("embedding")).withColumnRenamed("id", "chunk_id")
    chosen = evaluation.fault_targets(rows, a.n_faults).select("chunk_id").join(code, "chunk_id").orderBy("chunk_id")
    plan = faults.planned([r.asDict(recursive=True) for r in chosen.collect()])
    result, (llm, embedder) = {"n_faults": 0, "detected": 0, "missed": 0, "detection_rate": 0.0}, _models(conf)
    copy = faults.copied(a.path, os.path.join(os.path.abspath(conf["store_dir"]), f"trial-{uuid.uuid4().hex}"))
    new = pipeline.repo_id(copy)
    try:
        plan = [f for f in plan if faults.apply(f, copy, a.path)]
        if plan:
            new = pipeline.init(s, "trial", copy)
            pipeline.chunk(s, new, copy, "code", True)
            docs, claimed = faults.cloned(s.of("doc_chunks", rid), s.of("claims", rid), new)
            s.replace("doc_chunks", new, docs)
            s.replace("claims", new, claimed)
            pipeline.embed(s, new, embedder)
            pipeline.retrieve(s, new, embedder=embedder)
            pipeline.verify(s, new, copy, llm or pipeline.rule_value)
            # A symbol's id depends on the repository: faults are matched to the copy's chunks by file and symbol.
            found = s.spark.createDataFrame([(f["fault_id"], f["fault_type"], f["file_path"], f["symbol_name"]) for f in plan], "fault_id int, fault_type string, file_path string, symbol_name string")
            found = found.join(s.of("code_chunks", new).select(F.col("id").alias("chunk_id"), "file_path", "symbol_name"), ["file_path", "symbol_name"], "left")
            result = evaluation.detection_rate(evaluation.detection(faults.outcomes(found, s.of("verification_results", new), s.of("claims", new)))).first().asDict()
    finally:
        s.forget(new)
        shutil.rmtree(copy, ignore_errors=True)
    store.write_eval(result, conf["eval_dir"], "faults")
    return result


def score(s, a, conf):
    rid = _known(s, a.path)
    counts = s.of("claims", rid).select(F.col("doc_chunk_id").alias("id"))
    result = evaluation.extraction_score(store.read_labels(s.spark, a.labeled), counts).first().asDict()
    store.write_eval(result, conf["eval_dir"], "extraction")
    return result


def summary(s, a, conf):
    found = [store.latest_eval(conf["eval_dir"], k) for k in ("faults", "extraction")]
    return evaluation.metrics_summary(*found) if any(found) else "no evaluation results yet"


def run_all(s, a, conf):
    began = time.time()
    out = pipeline.run_all(s, _known(s, a.path), a.path, a.full, *_models(conf))
    return out | {"seconds": round(time.time() - began, 1)}


COMMANDS = {
    "init": init,
    "chunk-code": lambda s, a, c: pipeline.chunk(s, _known(s, a.path), a.path, "code", a.full),
    "chunk-docs": lambda s, a, c: pipeline.chunk(s, _known(s, a.path), a.path, "doc", a.full),
    "embed": embed,
    "extract-claims": extract,
    "retrieve": retrieve,
    "verify": verify,
    "report": report,
    "run-all": run_all,
    "eval-faults": eval_faults,
    "export-labels": lambda s, a, c: {"exported": store.write_labels(evaluation.sample_for_labels(s.of("doc_chunks", _known(s, a.path)), "id"), a.output or "data/labels.csv")},
    "score-extraction": score,
    "eval-summary": summary,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="docwarden")
    p.add_argument("--config", default="config.yaml")
    subs = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = subs.add_parser(name)
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--name")
        c.add_argument("--full", action="store_true")
        c.add_argument("--limit", type=int)
        c.add_argument("--top-k", type=int, default=5)
        c.add_argument("--format", choices=("text", "json"), default="text")
        c.add_argument("--verbose", action="store_true")
        c.add_argument("--output")
        c.add_argument("--n-faults", type=int, default=15)
        c.add_argument("--labeled", required=name == "score-extraction")
    a = p.parse_args(argv)
    a.path = os.path.abspath(a.path)
    conf = store.load_config(a.config)
    out = COMMANDS[a.command](store.Store(spark or session(), conf["store_dir"]), a, conf)
    print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
