"""Repository trees as DataFrames. Spark's file readers skip names that begin with _ or ., so paths are listed here and read in tasks."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions.expressions import EXCLUDED, is_code_file, is_doc_file


def excluded(name: str) -> bool:
    """Directories that discovery doesn't enter."""
    return name in EXCLUDED or name.endswith(".egg-info")


def private(name: str) -> bool:
    """Directories that the environment scan doesn't enter; it does read tests and what was built."""
    return name.startswith(".") or name in ("venv", "env", "__pycache__")


def listed(spark: SparkSession, root: str, repo_id: int, skip: Callable[[str], bool] = excluded) -> DataFrame:
    """(repo_id, root, file_path) of all files under root, in order, without links and directories to skip."""
    root = os.path.abspath(root)
    rows = []
    for at, dirs, names in os.walk(root, followlinks=False):
        dirs[:] = sorted(d for d in dirs if not skip(d))
        rows += [(repo_id, root, os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/")) for n in sorted(names)]
    return spark.createDataFrame(rows, "repo_id long, root string, file_path string")


def code_files(files: DataFrame) -> DataFrame:
    return files.where(is_code_file(F.col("file_path")))


def doc_files(files: DataFrame) -> DataFrame:
    return files.where(is_doc_file(F.col("file_path")))


def env_files(spark: SparkSession, root: str, repo_id: int) -> DataFrame:
    """Python files for the environment scan."""
    return listed(spark, root, repo_id, private).where(F.col("file_path").endswith(".py"))


def read(files: DataFrame) -> DataFrame:
    """files with text (bytes that aren't UTF-8 replaced) and content_hash (SHA-256 of the bytes); the tree must be visible to executors."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in files.schema)}, text string, content_hash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            for k in range(0, len(got), 64):  # a few files at a time
                part = got.iloc[k : k + 64]
                raw = [open(os.path.join(r, p), "rb").read() for r, p in zip(part.root, part.file_path)]
                yield part.assign(text=[x.decode("utf-8", "replace") for x in raw], content_hash=[hashlib.sha256(x).hexdigest() for x in raw])

    return files.mapInPandas(run, schema)


def _git(root: str, *args: str) -> str | None:
    got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return got.stdout if got.returncode == 0 else None


def head_sha(root: str) -> str | None:
    return (_git(root, "rev-parse", "HEAD") or "").strip() or None


def changed_since(root: str, sha: str | None) -> tuple[set[str], bool]:
    """Paths that changed since a commit, uncommitted and untracked ones included; and whether all has to be scanned instead."""
    diff = _git(root, "diff", "--name-status", "-z", sha, "HEAD") if sha else None
    status = _git(root, "status", "--porcelain", "-z") if diff is not None else None
    if diff is None or status is None:
        return set(), True
    paths, parts = set(), diff.split("\0")[:-1]
    while parts:
        kind = parts.pop(0)
        paths |= {parts.pop(0) for _ in range(2 if kind[:1] in "RC" else 1)}
    entries = status.split("\0")[:-1]
    while entries:
        x = entries.pop(0)
        paths.add(x[3:])
        if x[0] in "RC" and entries:
            paths.add(entries.pop(0))
    return paths, False
