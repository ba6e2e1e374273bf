"""Counts and extremes of nodes, ways and relations: global or by change type. Partial sums are Spark's own; -1 shows that there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _span(column: str, name: str) -> list[Column]:
    none = F.lit(-1).cast("long")
    return [F.coalesce(F.min(column).cast("long"), none).alias(f"min_{name}"), F.coalesce(F.max(column).cast("long"), none).alias(f"max_{name}")]


def _common() -> list[Column]:
    return [F.count("*").alias("count"), *_span("id", "id"), *_span("timestamp", "ts")]


def _grouped(df: DataFrame, by: str | None, columns: list[Column]) -> DataFrame:
    return df.groupBy(by).agg(*columns) if by else df.agg(*columns)


def nodes(df: DataFrame, by: str | None = None) -> DataFrame:
    """A1."""
    return _grouped(df, by, [*_common(), *_span("lon", "lon"), *_span("lat", "lat")])


def ways(df: DataFrame, way_nodes: DataFrame, by: str | None = None) -> DataFrame:
    """A2. Also the references: how many, the most of a way, the extremes (of the references themselves)."""
    refs = way_nodes.groupBy(F.col("way_id").alias("id")).agg(F.count("*").alias("n"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    zero = F.lit(0).cast("long")
    columns = [*_common(), F.coalesce(F.sum("n"), zero).alias("num_refs"), F.coalesce(F.max("n"), zero).alias("longest"), F.coalesce(F.min("lo"), F.lit(-1)).cast("long").alias("min_ref"), F.coalesce(F.max("hi"), F.lit(-1)).cast("long").alias("max_ref")]
    return _grouped(df.join(refs, "id", "left"), by, columns)


def relations(df: DataFrame, rel_members: DataFrame, by: str | None = None) -> DataFrame:
    """A4. Also the members: how many, the most of a relation, how many relations have none."""
    members = rel_members.groupBy(F.col("rel_id").alias("id")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    columns = [*_common(), F.coalesce(F.sum("n"), zero).alias("num_members"), F.coalesce(F.max("n"), zero).alias("longest"), F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)).cast("long").alias("empties")]
    return _grouped(df.join(members, "id", "left"), by, columns)


def by_changetype(changes: DataFrame) -> DataFrame:
    """A5. For each element type and change type."""
    return changes.groupBy("elem_type", "changetype").agg(*_common())


def data_date(df: DataFrame) -> DataFrame:
    """A10. The latest timestamp, and the same to the nearest day."""
    latest = F.max("timestamp").cast("long")
    return df.agg(latest.alias("max_ts"), (F.floor(latest / 86400 + 0.5) * 86400).cast("long").alias("day_ts"))
