"""Fault injection into a copy of a repository: one mutated parameter name or default per chosen chunk."""

from __future__ import annotations

import os
import random
import re
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def copied(root: str, to: str) -> str:
    return shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git"))


def planned(targets: list[dict], seed: int = 42) -> list[dict]:
    """A fault for each target (chunk_id, file_path, symbol_name, start_line, end_line, resolved) that has parameters; targets are at most the
    few dozen that were asked for."""
    rng, out = random.Random(seed), []
    for t in targets:
        params = (t["resolved"] or {}).get("parameters") or []
        if not params:
            continue
        literal = [p for p in params if p["has_default"] and p["is_literal"]]
        kind = rng.choice(("rename_param", "change_default"))
        kind = kind if literal or kind == "rename_param" else "rename_param"
        p = rng.choice(literal if kind == "change_default" else params)
        out.append({"fault_id": len(out), "fault_type": kind, "param": p["name"], "default": p["default_repr"], **{k: t[k] for k in ("chunk_id", "file_path", "symbol_name", "start_line", "end_line")}})
    return out


def mutated(value: str) -> str:
    if value in ("True", "False"):
        return str(value != "True")
    if re.fullmatch(r"\d+", value):
        return str(int(value) + 42)
    return f"{value[:-1]}_mutated{value[-1]}" if re.fullmatch(r"""(["']).*\1""", value) else "None"


def faulted(text: str, fault: dict) -> str:
    """The file's text with the fault in the lines of its symbol; all other lines stay as they are."""
    lines = text.split("\n")
    a, b = fault["start_line"] - 1, fault["end_line"]
    old, name = "\n".join(lines[a:b]), re.escape(fault["param"])
    if fault["fault_type"] == "rename_param":
        new = re.sub(rf"\b{name}\b", f"{fault['param']}_mutated", old)
    else:
        put = mutated(fault["default"])
        new = re.sub(rf"(\b{name}\b\s*(?::[^=]+?)?=\s*){re.escape(fault['default'])}", lambda m: m[1] + put, old, count=1)
    return "\n".join([*lines[:a], new, *lines[b:]])


def apply(fault: dict, copy: str, original: str) -> bool:
    """Writes a fault into the copy's file; the original is never written."""
    if os.path.realpath(copy) == os.path.realpath(original):
        raise ValueError("faults go into a copy only")
    path = os.path.join(copy, fault["file_path"])
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        old = f.read()
    new = faulted(old, fault)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(new)
    return new != old


def cloned(docs: DataFrame, claims: DataFrame, repo_id: int) -> tuple[DataFrame, DataFrame]:
    """Sections and claims of a repository under the id of its copy: new ids, made from the old ones, and claims that point at the new sections."""
    new = lambda c: F.xxhash64(F.lit(repo_id), c)
    own = lambda df: df.withColumn("repo_id", F.lit(repo_id).cast("long"))
    ids = docs.select(F.col("id").alias("old"), new("id").alias("new"))
    moved = claims.join(ids, F.col("doc_chunk_id") == F.col("old")).withColumn("doc_chunk_id", F.col("new")).drop("old", "new")
    return own(docs.withColumn("id", new("id"))), own(moved.withColumn("id", new("id")))


def outcomes(faults: DataFrame, verification: DataFrame, claims: DataFrame) -> DataFrame:
    """(fault_id, ord, status) of the claims of a fault's type on its symbol; a fault without such claims keeps one row without status."""
    kind = F.when(F.col("fault_type") == "rename_param", "signature").otherwise("default_value")
    rows = verification.join(claims.select(F.col("id").alias("claim_id"), "claim_type"), "claim_id").select(F.col("matched_code_chunk_id").alias("c"), "claim_type", "status", F.col("claim_id").alias("ord"))
    return faults.join(rows, (F.col("chunk_id") == F.col("c")) & (F.col("claim_type") == kind), "left").select("fault_id", "ord", "status")
