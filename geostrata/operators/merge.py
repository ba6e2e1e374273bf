"""Versions of elements: combining changes, applying them, reading as of a time.

Rows carry tile, elem_type, id, changetype and seq, the number of the change file (0 for the base). The key is (tile,
elem_type, id): one file may remove an element from a tile and add it to another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NORMAL, DELETE, REMOVE, UNCHANGED, MODIFY, CREATE = range(6)
KEY = ["tile", "elem_type", "id"]


def newest(rows: DataFrame, key: list[str] = KEY, order: str = "seq") -> DataFrame:
    """U1, U3. Of each key the row with the highest order; one aggregate for any number of files, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*key, "_row.*").select(*rows.columns)


def combine(left: DataFrame, right: DataFrame, key: list[str] = KEY) -> DataFrame:
    """U1. Of each key the right row if there is one, else the left."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    return newest(both, key, "_side").drop("_side")


def live(rows: DataFrame) -> DataFrame:
    """F13. Without deleted and removed rows; the others are plain elements."""
    return rows.where(~F.col("changetype").isin(DELETE, REMOVE)).withColumn("changetype", F.lit(NORMAL))


def overlay(base: DataFrame, changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Each key's newest change, and the rows of base that no change has. A key is once in base, so only the changes are aggregated; base meets their keys."""
    last = newest(changes, key)
    return base.join(last.select(*key), key, "left_anti").select(*base.columns).unionByName(last.select(*base.columns))


def apply_changes(base: DataFrame, changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """U2."""
    return live(overlay(base, changes, key))


def snapshot(manifest: DataFrame, timestamp: int | None = None) -> DataFrame:
    """F5. The files whose end_date isn't after the timestamp."""
    return manifest if timestamp is None else manifest.where(F.col("end_date") <= timestamp)


def as_of(base: DataFrame, changes: DataFrame, manifest: DataFrame, timestamp: int | None = None, key: list[str] = KEY) -> DataFrame:
    """T4, J8, S11. The elements as of a time, from the base and all change files up to it. The manifest is as long as there are files."""
    files = F.broadcast(snapshot(manifest, timestamp).select(F.col("state").alias("seq")))
    then = lambda rows: rows.join(files, "seq", "left_semi").select(*base.columns)
    return live(overlay(then(base), then(changes), key))


def union_ids(*ids: DataFrame) -> DataFrame:
    """U4."""
    out = ids[0]
    for x in ids[1:]:
        out = out.unionByName(x)
    return out.distinct()
