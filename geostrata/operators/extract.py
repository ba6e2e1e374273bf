"""Extracts by box or polygon with all that they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions import quadtree as q
from geostrata.plans.scratch import written

Ring = list[tuple[float, float]]


def in_polygon(lon, lat, ring: Ring) -> Column:
    """F7. Whether an odd number of edges lies east of the point; the ring closes itself. One plain expression for each edge, so it stays in generated code."""
    x, y = q.as_degrees(lon), q.as_degrees(lat)
    odd = F.lit(0)
    for (bx, by), (ax, ay) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if ay != by:  # a level edge crosses no level line
            east = x < F.lit(ax - bx) * (y - F.lit(by)) / F.lit(ay - by) + F.lit(bx)
            odd = odd + F.when(((F.lit(by) > y) != (F.lit(ay) > y)) & east, 1).otherwise(0)
    return odd % 2 == 1


def corners_in_polygon(box: Column, ring: Ring) -> Column:
    """F8. All corners of a box; a concave ring may still cut the box."""
    out = F.lit(True)
    for lon in ("minlon", "maxlon"):
        for lat in ("minlat", "maxlat"):
            out = out & in_polygon(box[lon], box[lat], ring)
    return out


def ring_bbox(ring: Ring) -> tuple[int, int, int, int]:
    """A14."""
    unit = lambda v: int(v * 1e7 + (0.5 if v > 0 else -0.5))
    xs, ys = [unit(x) for x, _ in ring], [unit(y) for _, y in ring]
    return min(xs), min(ys), max(xs), max(ys)


def node_test(box: tuple[int, int, int, int] | None, ring: Ring | None) -> Column:
    """F10. In the box and in the ring."""
    out = q.contains_point(q.literal_bbox(box), "lon", "lat") if box else F.lit(True)
    return out & in_polygon("lon", "lat", ring) if ring else out


def triage(tiles: DataFrame, box: tuple[int, int, int, int], ring: Ring | None = None, margin: float = 0.05) -> DataFrame:
    """F9. tile and what to do with it: all of it, test each element, or nothing."""
    wanted = q.literal_bbox(box)

    def action(cell: Column) -> Column:
        within = q.contains(wanted, cell)
        if ring:
            within = within & corners_in_polygon(cell, ring)
        return F.when(within, "all").when(q.overlaps(wanted, cell), "each").otherwise("none")

    return tiles.select("tile", q.let(q.cell_bbox("tile", margin), action).alias("action"))


def ways_of(node_ids: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """J10. Ways with a selected node."""
    return way_nodes.join(node_ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.col("way_id").alias("id")).distinct()


def extra_nodes(way_ids: DataFrame, node_ids: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """J11. Nodes of the selected ways that aren't selected themselves."""
    of = way_nodes.join(way_ids.select(F.col("id").alias("way_id")), "way_id", "left_semi").select(F.col("node_id").alias("id")).distinct()
    return of.join(node_ids, "id", "left_anti")


def relations_of(elements: DataFrame, rel_members: DataFrame) -> DataFrame:
    """J12. Relations with a selected member; and those with such a relation, until no more come. elements: elem_type, id."""
    m = rel_members.select("rel_id", F.col("mem_type").alias("elem_type"), F.col("mem_ref").alias("id"))
    found = written(m.join(elements.select("elem_type", "id"), ["elem_type", "id"], "left_semi").select(F.col("rel_id").alias("id")).distinct(), "relations")
    links = m.where("elem_type = 2").select("rel_id", "id")
    new = found
    while not new.isEmpty():
        new = written(links.join(new, "id", "left_semi").select(F.col("rel_id").alias("id")).distinct().join(found, "id", "left_anti"), "relations")
        found = found.union(new)
    return found


def select(nodes: DataFrame, way_nodes: DataFrame, rel_members: DataFrame, box: tuple[int, int, int, int] | None = None, ring: Ring | None = None) -> DataFrame:
    """elem_type and id of everything in an extract: nodes inside, ways with one of them, all nodes of those ways, and relations with any of these."""
    inside = written(nodes.where(node_test(box, ring)).select("id"), "nodes-inside")
    ways = written(ways_of(inside, way_nodes), "ways-inside")
    points = inside.union(extra_nodes(ways, inside, way_nodes))
    typed = lambda df, kind: df.select(F.lit(kind).alias("elem_type"), "id")
    both = typed(points, 0).union(typed(ways, 1))
    # A member counts only as selected by place, or as part of a way that is.
    return both.union(typed(relations_of(both, rel_members), 2))


def with_members(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """F11. rows with only the selected members in their relations, in order; a relation may be left with none."""
    m = rows.where("elem_type = 2").select("id", F.posexplode("members").alias("seq", "m")).select("id", "seq", "m", F.col("m.mem_type").alias("mem_type"), F.col("m.mem_ref").alias("mem_ref"))
    keys = selected.select(F.col("elem_type").alias("mem_type"), F.col("id").alias("mem_ref"))
    kept = m.join(keys, ["mem_type", "mem_ref"], "left_semi").groupBy(F.lit(2).alias("elem_type"), "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "m"))), lambda x: x["m"]).alias("_members"))
    none = F.array().cast(rows.schema["members"].dataType)
    return rows.join(kept, ["elem_type", "id"], "left").withColumn("members", F.when(F.col("elem_type") == 2, F.coalesce("_members", none)).otherwise(F.col("members"))).select(*rows.columns)


def prune_members(rel_members: DataFrame, selected: DataFrame) -> DataFrame:
    """F11. The members that are selected, numbered anew, and how many their relation had."""
    from pyspark.sql import Window

    keys = selected.select(F.col("elem_type").alias("mem_type"), F.col("id").alias("mem_ref"))
    size = rel_members.groupBy("rel_id").agg(F.count("*").alias("had"))
    kept = rel_members.join(keys, ["mem_type", "mem_ref"], "left_semi").join(size, "rel_id")
    order = Window.partitionBy("rel_id").orderBy("seq")
    return kept.select("rel_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "mem_type", "mem_ref", "had")
