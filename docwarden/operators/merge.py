"""Changes to stored tables as set operations: snapshots, upserts, replacements and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and change: added, modified, deleted or unchanged."""
    both = old.select(*key, F.col(value).alias("_old"), F.lit(1).alias("_o")).join(new.select(*key, F.col(value).alias("_new"), F.lit(1).alias("_n")), key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return both.select(*key, change.alias("change"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def upserted(old: DataFrame, new: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """old with new rows added and, of known keys, only the columns of update replaced."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    known = F.col(f"o.{key[0]}").isNotNull()
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in update + key else F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, key: list[str], touched: DataFrame | None = None) -> DataFrame:
    """old without the rows of touched keys (those of new, unless given), and new."""
    return old.join((new if touched is None else touched).select(*key).distinct(), key, "left_anti").unionByName(new)


def cascade_deleted(tables: list[tuple[DataFrame, str, str | None]], roots: DataFrame) -> list[DataFrame]:
    """Rows that stay when the roots' keys go: tables as (rows, own key, column that points at the table before), from parent to child."""
    gone, out = roots, []
    for rows, key, parent in tables:
        column = parent or key
        keys = gone.toDF("_gone").distinct()
        out.append(rows.join(keys, F.col(column) == F.col("_gone"), "left_anti"))
        gone = rows.join(keys, F.col(column) == F.col("_gone"), "left_semi").select(key)
    return out
