"""Shared plumbing of the corpus operators: shared storage, bounded broadcasts, let-bindings and text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: shuffle files that are done with go, and a join one side of which was shuffled into partitions of at most 64 MB each
#: looks up that side by hash and sorts neither; larger ones are sorted and can spill.
WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB"}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words between ASCII white space, and words of letters and digits (ASCII ones, and all that is not ASCII).
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; only where that is unset (tests), one of our own."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not got:
        got = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", got)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(got)
    return got


class Scratch:
    """Parquet tables in the shared folder. Each `cut` writes a frame once and reads it back, so that a lost executor costs no recomputation of
    what lies before it; `drop` removes a table that is no longer needed, `close` all but those named."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = path = f"{self.root}/{name}-{len(self.paths)}"
        # What the table was made from is not asked for again: its shuffle files go when it is written, and not when the driver collects garbage.
        was = {key: self.spark.conf.get(key, None) for key in WRITES}
        for key, value in WRITES.items():
            self.spark.conf.set(key, value)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for key, value in was.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self, *but: str) -> None:
        self.drop(*[x for x in self.paths if x not in but])


def small(df: DataFrame, rows: int = 200_000, most: int = 32 << 20) -> DataFrame:
    """Marks a frame for broadcast if it has at most so many rows and bytes; else the join stays a shuffled one, which AQE splits where it is skewed.
    The frame should be cheap to count: a written table or a few partial sums."""
    wide = [F.octet_length(f.name) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum((F.coalesce(x, F.lit(0)) for x in wide), F.lit(8 * len(df.columns)))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= most else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row: a lambda's variable is never inlined, a projected column inside a lambda may be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def plain_words(text: Column) -> Column:
    """The words of letters and digits of a text, lower-cased, as an array."""
    return F.filter(F.split(lowered(text), PLAIN_GAP, -1), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
