"""Orders and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_version(df: DataFrame) -> DataFrame:
    """O1. By id, version, change type; rows without a version first."""
    return df.orderBy("id", F.col("version").asc_nulls_first(), "changetype")


def by_type_and_id(df: DataFrame) -> DataFrame:
    """O3."""
    return df.orderBy("elem_type", "id")


def sorted_tags(tags: Column) -> Column:
    """O5. By key, then value."""
    return F.array_sort(tags)


def numbered(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Each row's place in the order of keys, from 0, without bringing all rows to one task: ranges are counted, and each
    starts where the ones before it end."""
    from pyspark.sql import Window

    from geostrata.plans.scratch import written

    dealt = written(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) - 1
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_start") + place).cast("long")).drop("_p", "_start")


def blocks(df: DataFrame, size: int = 8000) -> DataFrame:
    """W9. Blocks of so many elements in order of type and id."""
    return numbered(df, ["elem_type", "id"]).withColumn("block", F.floor(F.col("n") / size).cast("long"))
