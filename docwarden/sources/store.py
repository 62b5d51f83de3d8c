"""Tables as Parquet folders, and the small inputs of the command line: configuration, labels, evaluation results."""

from __future__ import annotations

import json
import logging
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docwarden.schema import TABLES

DEFAULTS = {"store_dir": "data/tables", "eval_dir": "data/eval", "report_dir": "data/reports", "model": "rules", "model_host": "http://localhost:11434", "embedder": "hashed"}


def load_config(path: str = "config.yaml") -> dict:
    """Defaults, overlaid with the file's keys; a file that can't be parsed ends the program."""
    import yaml

    if not os.path.exists(path):
        logging.warning("no %s, using defaults", path)
        return dict(DEFAULTS)
    try:
        got = yaml.safe_load(Path(path).read_text())
    except yaml.YAMLError as e:
        raise SystemExit(1) from e
    return DEFAULTS | got if isinstance(got, dict) else dict(DEFAULTS)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and tasks share, as the session names it; one of our own only where it names none, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not got:
        got = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


class Store:
    """A folder per table, and within it one per repository. A write replaces the folders of the repositories it names and leaves the others alone;
    files are reached through Hadoop's file systems, so the root may be on any of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/") if "://" in root else f"file://{os.path.abspath(root)}"

    def _path(self, name: str, repo_id: int | None = None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" + ("" if repo_id is None else f"/repo_id={repo_id}"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def schema(self, name: str) -> StructType:
        return StructType.fromDDL(TABLES[name])

    def read(self, name: str) -> DataFrame:
        path, fs = self._path(name)
        schema = self.schema(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select(*schema.names)

    def of(self, name: str, repo_id: int) -> DataFrame:
        """A repository's rows: only its folder is read."""
        return self.read(name).where(F.col("repo_id") == repo_id)

    def replace(self, name: str, repo_id: int, df: DataFrame) -> int:
        """A repository's rows, replaced as a whole when the new ones are written; how many there are now."""
        rows = df.select(*[F.lit(repo_id).cast("long").alias("repo_id") if f.name == "repo_id" else F.col(f.name).cast(f.dataType) for f in self.schema(name)])
        some = not rows.isEmpty()
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{self.root}/{name}")
        if not some:  # such a write touches no folder
            path, fs = self._path(name, repo_id)
            fs.delete(path, True)
        return self.of(name, repo_id).count()

    def forget(self, repo_id: int) -> None:
        """Removes a repository from every table."""
        for name in TABLES:
            path, fs = self._path(name, repo_id)
            fs.delete(path, True)

    def files(self, name: str, repo_id: int) -> list[tuple[str, int]]:
        """Names and times of the files that hold a repository's rows."""
        path, fs = self._path(name, repo_id)
        return sorted((x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(path)) if fs.exists(path) else []


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, expected) of a labelled CSV; expected is null where the row is unusable."""
    path = path if "://" in path else f"file://{os.path.abspath(path)}"
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if not {"doc_chunk_id", "expected_claim_count"} <= set(rows.columns):
        return spark.createDataFrame([], "id long, expected int")
    return rows.select(F.col("doc_chunk_id").try_cast("long").alias("id"), F.when(F.col("doc_chunk_id").try_cast("long").isNotNull(), F.trim("expected_claim_count").try_cast("int")).alias("expected"))


def write_labels(rows: DataFrame, path: str) -> int:
    """A sample for labelling (it is at most a few dozen rows) as one CSV with its last three columns blank."""
    import csv

    got = rows.select("id", "heading", "text").collect()
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["doc_chunk_id", "heading", "text", "expected_claim_count", "expected_claim_types", "notes"])
        w.writerows([(r.id, r.heading, r.text, "", "", "") for r in got])
    return len(got)


def write_eval(result: dict, folder: str, kind: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{kind}_{int(time.time())}.json")
    Path(path).write_text(json.dumps(result, indent=2, default=str))
    return path


def latest_eval(folder: str, kind: str) -> dict | None:
    found = sorted(Path(folder).glob(f"{kind}_*.json")) if os.path.isdir(folder) else []
    return json.loads(found[-1].read_text()) if found else None
