"""Element-level differences of two data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFO = ("version", "changeset", "timestamp", "user_id")


def tags_differ(a: Column, b: Column) -> Column:
    """F31. Other lengths, or a tag of one that the other lacks; order and repeats don't count."""
    return (F.size(a) != F.size(b)) | (F.size(F.array_except(a, b)) > 0)


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """J15. elem_type, id and kind of each element of either side: OnlyLeft, OnlyRight, or the first that holds of
    DifferentInfo, DifferentTags, DifferentData, DifferentQuadtree, ChangedUserName, Same.

    Both sides have elem_type, id, tags, data (a value that stands for place, references or members), quadtree, user and
    any of the info columns. Nulls equal nulls.
    """
    info = [c for c in INFO if c in left.columns and c in right.columns]
    l, r = left.withColumn("_l", F.lit(True)).alias("l"), right.withColumn("_r", F.lit(True)).alias("r")  # noqa: E741
    both = l.join(r, (F.col("l.elem_type") == F.col("r.elem_type")) & (F.col("l.id") == F.col("r.id")), "full_outer")
    differs = lambda c: ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    any_info = F.lit(False)
    for c in info:
        any_info = any_info | differs(c)
    none = F.array().cast(left.schema["tags"].dataType)
    tags = tags_differ(F.coalesce("l.tags", none), F.coalesce("r.tags", none))
    kind = (
        F.when(F.col("_r").isNull(), "OnlyLeft").when(F.col("_l").isNull(), "OnlyRight").when(any_info, "DifferentInfo").when(tags, "DifferentTags")
        .when(differs("data"), "DifferentData").when(differs("quadtree"), "DifferentQuadtree").when(differs("user"), "ChangedUserName").otherwise("Same")
    )
    return both.select(F.coalesce("l.elem_type", "r.elem_type").alias("elem_type"), F.coalesce("l.id", "r.id").alias("id"), kind.alias("kind"), F.col("l.user").alias("left_user"), F.col("r.user").alias("right_user"))


def lines(left: DataFrame, right: DataFrame, compared: DataFrame) -> DataFrame:
    """W13. line: a JSON object for each difference but renamed users, by its kind: the element of one side, or both in an array."""
    key = ["elem_type", "id"]
    row = lambda df, name: df.select(*key, F.to_json(F.struct(*df.columns)).alias(name))
    found = compared.where(~F.col("kind").isin("Same", "ChangedUserName")).select(*key, "kind")
    both = found.join(row(left, "l"), key, "left").join(row(right, "r"), key, "left")
    said = F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).otherwise(F.concat(F.lit("["), "l", F.lit(","), "r", F.lit("]")))
    return both.select(*key, F.concat(F.lit('{"'), "kind", F.lit('":'), said, F.lit("}")).alias("line"))


def counts(compared: DataFrame) -> DataFrame:
    """A15. All are counted, whatever a report shows."""
    return compared.groupBy("elem_type", "kind").agg(F.count("*").alias("n"))


def renamed_users(compared: DataFrame) -> DataFrame:
    return compared.where("kind = 'ChangedUserName'").select("left_user", "right_user").distinct()


def report(compared: DataFrame, most: int) -> DataFrame:
    """O7. The first differences by type and id."""
    return compared.where("kind <> 'Same'").orderBy("elem_type", "id").limit(most)
