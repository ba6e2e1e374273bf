"""Quadtree keys of ways, nodes and relations from their geometry and references.

Inputs: nodes(id, lon, lat), way_nodes(way_id, seq, node_id), rel_members(rel_id, seq, mem_type, mem_ref).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions import quadtree as q
from geostrata.plans.scratch import release, written


def node_ways(nodes: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """J1. Each node with the ways that use it, each once, in order; an empty array if none does."""
    used = way_nodes.groupBy("node_id").agg(F.array_sort(F.collect_set("way_id")).alias("ways"))
    return nodes.join(used, nodes["id"] == used["node_id"], "left").select("id", F.coalesce("ways", F.array().cast("array<long>")).alias("ways"))


def way_range(way_nodes: DataFrame, low: int = 0, high: int = 0) -> DataFrame:
    """F12. The references of ways from low to below high, for a build in parts; 0 is no upper bound."""
    out = way_nodes.where(F.col("way_id") >= low) if low else way_nodes
    return out.where(F.col("way_id") < high) if high else out


def missing_way_nodes(nodes: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """J2. References to nodes that aren't there."""
    return way_nodes.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("way_id", "node_id").distinct()


def way_bbox(nodes: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """A6. The box of each way's nodes. One shuffle on the node, one on the way with minima and maxima combined before it."""
    at = nodes.select(F.col("id").alias("node_id"), "lon", "lat")
    return way_nodes.select("way_id", "node_id").join(at, "node_id").groupBy("way_id").agg(F.min("lon").alias("minlon"), F.min("lat").alias("minlat"), F.max("lon").alias("maxlon"), F.max("lat").alias("maxlat"))


def way_quadtrees(nodes: DataFrame, way_nodes: DataFrame, level: int = q.ELEMENT_LEVEL, buffer: float = q.BUFFER) -> DataFrame:
    return way_bbox(nodes, way_nodes).select("way_id", q.calculate("minlon", "minlat", "maxlon", "maxlat", level, buffer).alias("quadtree"))


def node_quadtrees(nodes: DataFrame, way_nodes: DataFrame, way_qts: DataFrame, level: int = q.ELEMENT_LEVEL, buffer: float = q.BUFFER) -> DataFrame:
    """J3, A3. A node that ways use lies in the cell common to those ways, whatever its own place; others in their point's cell."""
    of_ways = way_nodes.select("way_id", "node_id").join(way_qts, "way_id").groupBy("node_id").agg(q.common_agg("quadtree").alias("way_qt"))
    both = nodes.join(of_ways, nodes["id"] == of_ways["node_id"], "left")
    own = F.when(F.col("way_qt").isNull() | (F.col("way_qt") < 0), q.calculate_point("lon", "lat", level, buffer)).otherwise(F.col("way_qt"))
    return both.select("id", own.alias("quadtree"))


def relation_quadtrees(relations: DataFrame, rel_members: DataFrame, node_qts: DataFrame, way_qts: DataFrame) -> DataFrame:
    """J4, J5, I1. The cell common to all members; relations in relations are followed until nothing changes.

    Missing members don't count. Relations without members are the root from the start, and draw their parents there;
    those none of whose members is known end as the root. Cells only widen, so cycles end.
    """
    m = rel_members.select("rel_id", "mem_type", "mem_ref").distinct()
    known = node_qts.select(F.lit(0).alias("mem_type"), F.col("id").alias("mem_ref"), "quadtree").unionByName(way_qts.select(F.lit(1).alias("mem_type"), F.col("way_id").alias("mem_ref"), "quadtree"))
    direct = m.join(known, ["mem_type", "mem_ref"]).groupBy("rel_id").agg(q.common_agg("quadtree").alias("qt"))
    ids = relations.select(F.col("id").alias("rel_id"))
    some = m.select("rel_id").distinct().withColumn("some", F.lit(True))
    start = ids.join(direct, "rel_id", "left").join(some, "rel_id", "left").select("rel_id", F.when(F.col("some").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("qt", F.lit(q.EMPTY).cast("long"))).alias("qt"))
    inner = written(m.where("mem_type = 2 and mem_ref <> rel_id").select("rel_id", "mem_ref"), "relation-links")
    last = now = written(start, "relation-cells")
    if not inner.isEmpty():
        while True:
            new = written(_widened(_widened(now.withColumn("was", F.col("qt")), inner), inner), "relation-cells")
            release(last)
            last, now = new, new.select("rel_id", "qt")
            if new.where("qt <> was").isEmpty():
                break
    return now.select(F.col("rel_id").alias("id"), F.greatest("qt", F.lit(0).cast("long")).alias("quadtree"))


def _widened(cells: DataFrame, inner: DataFrame) -> DataFrame:
    """cells(rel_id, qt, was) with each relation's cell widened by those of the relations in it: one link further."""
    below = inner.join(cells.select(F.col("rel_id").alias("mem_ref"), "qt"), "mem_ref").groupBy("rel_id").agg(q.common_agg("qt").alias("inner"))
    return cells.join(below, "rel_id", "left").select("rel_id", F.when(F.col("inner").isNull(), F.col("qt")).otherwise(q.common("qt", "inner")).alias("qt"), "was")


def quadtrees(nodes: DataFrame, way_nodes: DataFrame, relations: DataFrame, rel_members: DataFrame, level: int = q.ELEMENT_LEVEL, buffer: float = q.BUFFER, prelim: DataFrame | None = None) -> DataFrame:
    """I3, I4. elem_type, id and quadtree of everything. prelim: way cells that an earlier run wrote."""
    ways = prelim if prelim is not None else written(way_quadtrees(nodes, way_nodes, level, buffer), "way-cells")
    points = written(node_quadtrees(nodes, way_nodes, ways, level, buffer), "node-cells")
    rels = relation_quadtrees(relations, rel_members, points, ways)
    out = lambda df, kind, key: df.select(F.lit(kind).alias("elem_type"), F.col(key).alias("id"), "quadtree")
    return written(out(points, 0, "id").unionByName(out(ways, 1, "way_id")).unionByName(out(rels, 2, "id")), "cells")


def attach(elements: DataFrame, qts: DataFrame) -> DataFrame:
    """J6. elements(elem_type, id, ...) with their cells. Relations without one are the root; nodes and ways without one
    keep null, which unattached() reports."""
    keyed = qts.select("elem_type", "id", F.col("quadtree").alias("_qt"))
    return elements.join(keyed, ["elem_type", "id"], "left").withColumn("quadtree", F.when(F.col("elem_type") == 2, F.greatest(F.coalesce("_qt", F.lit(0).cast("long")), F.lit(0).cast("long"))).otherwise(F.col("_qt"))).drop("_qt")


def unattached(attached: DataFrame) -> DataFrame:
    return attached.where("quadtree is null").select("elem_type", "id")
