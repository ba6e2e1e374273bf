"""Change files into change tiles: the latest versions, what they touch, new cells, and the rows for each tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions import quadtree as q
from geostrata.operators import build, merge, tiles
from geostrata.operators.merge import CREATE, DELETE, MODIFY, NORMAL, REMOVE, UNCHANGED
from geostrata.plans.scratch import written


def latest(changes: DataFrame, pos: str = "pos") -> DataFrame:
    """A7. Of each element in a change file the highest version; of equal versions the first in the file. No version is lowest."""
    order = Window.partitionBy("seq", "elem_type", "id").orderBy(F.col("version").desc_nulls_last(), F.col(pos).asc())
    return changes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def touched_ids(change: DataFrame, change_way_nodes: DataFrame | None = None, change_members: DataFrame | None = None) -> DataFrame:
    """elem_type and id of all that a change file changes or refers to."""
    out = change.select("elem_type", "id")
    if change_way_nodes is not None:
        out = out.union(change_way_nodes.select(F.lit(0), "node_id"))
    if change_members is not None:
        out = out.union(change_members.select("mem_type", "mem_ref"))
    return out.distinct()


def extra_nodes(change: DataFrame, change_way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """J14. Nodes that changed ways use and the change file doesn't hold, from the base."""
    live = change.where((F.col("elem_type") == 1) & (F.col("changetype") != DELETE)).select(F.col("id").alias("way_id"))
    need = change_way_nodes.join(live, "way_id", "left_semi").select(F.col("node_id").alias("id")).distinct()
    held = change.where("elem_type = 0").select("id")
    return nodes.join(need.join(held, "id", "left_anti"), "id", "left_semi")


def existing(base: DataFrame, changes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """J13. elem_type, id, quadtree and tile of each element as the files before left it; later files override, a Delete
    ends it, a Remove only says that it left a tile. Both: elem_type, id, quadtree, tile, changetype, seq."""
    key = ["elem_type", "id"]

    def own(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("changetype") != REMOVE).select(*key, "quadtree", "tile", "changetype", "seq")
        return rows if ids is None else rows.join(ids, key, "left_semi")

    last = merge.overlay(own(base), own(changes), key)
    return last.where(F.col("changetype") != DELETE).select("elem_type", "id", "quadtree", "tile")


def actions(change: DataFrame, before: DataFrame, cells: DataFrame, tile_table: DataFrame) -> DataFrame:
    """I5. The rows for each tile: tile, elem_type, id, changetype, quadtree, and action (kept, removed, deleted, or why none).

    change: elem_type, id, changetype; before: existing(); cells: elem_type, id and new cell. Ways take the new cell, nodes
    and relations widen the old one by it. An element that moves to another tile leaves a Remove row of cell 0 in the old.
    Extra nodes (Normal) are written only if their cell changed. Combinations without a rule are ignored, such as a Create
    of what already has a tile, a Modify without any cell, or a Delete of what isn't there.
    """
    old = before.select("elem_type", "id", F.col("quadtree").alias("was"), F.col("tile").alias("alloc"))
    new = cells.select("elem_type", "id", F.col("quadtree").alias("now"))
    joined = change.join(old, ["elem_type", "id"], "left").join(new, ["elem_type", "id"], "left")
    widened = F.when(F.col("now").isNull(), F.col("was")).when((F.col("elem_type") == 1) | F.col("was").isNull(), F.col("now")).otherwise(q.common("was", "now"))
    with_q = written(joined.withColumn("q", widened), "new-cells")  # met twice below
    to = tiles.assign(with_q, tile_table, "q").select(F.col("quadtree").alias("_q"), F.col("tile").alias("na"))
    x = with_q.join(to, F.col("q") == F.col("_q"), "left")
    kind, here, cell = F.col("changetype"), F.col("alloc").isNotNull(), F.col("na").isNotNull()
    moved = F.col("na") != F.col("alloc")

    def row(tile, changetype, qt, action) -> F.Column:
        return F.struct(tile.cast("long").alias("tile"), changetype.cast("int").alias("changetype"), qt.cast("long").alias("quadtree"), F.lit(action).alias("action"))

    zero, nothing = F.lit(0), F.lit(None)
    gone = row(F.col("alloc"), F.lit(REMOVE), zero, "removed")
    put = lambda changetype: F.when(here & moved, F.array(row(F.col("na"), changetype, F.col("q"), "kept"), gone)).otherwise(F.array(row(F.col("na"), changetype, F.col("q"), "kept")))
    none = lambda why: F.array(row(nothing, kind, nothing, why))
    rows = (
        F.when((kind == NORMAL) & (F.col("elem_type") == 0) & here & cell, F.when(F.col("q") == F.col("was"), none("unneeded")).otherwise(put(F.lit(UNCHANGED))))
        .when((kind == DELETE) & here, F.array(row(F.col("alloc"), kind, zero, "deleted")))
        .when(kind == DELETE, none("create_delete"))
        .when((kind == MODIFY) & cell, put(kind))
        .when((kind == CREATE) & ~here & cell, put(kind))
        .otherwise(none("ignored"))
    )
    return x.select("elem_type", "id", F.explode(rows).alias("r")).select("r.tile", "elem_type", "id", "r.changetype", "r.quadtree", "r.action")


def new_cells(change: DataFrame, change_nodes: DataFrame, change_way_nodes: DataFrame, level: int = q.ELEMENT_LEVEL, buffer: float = q.BUFFER, change_members: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """New cells of changed elements: elem_type, id, quadtree. change_nodes (id, lon, lat) holds changed and extra nodes.

    Ways that the file doesn't hold keep their cells, even if a node of theirs moved. Relations take the cells of members
    in the change or before it; those without members, or with none but themselves, are the root.
    """
    live = change.where(F.col("changetype") != DELETE)
    of = live.where("elem_type = 1").select(F.col("id").alias("way_id"))
    uses = change_way_nodes.join(of, "way_id", "left_semi")
    ways = written(build.way_quadtrees(change_nodes, uses, level, buffer), "way-cells")
    points = build.node_quadtrees(change_nodes, uses, ways, level, buffer)
    out = points.select(F.lit(0).alias("elem_type"), "id", "quadtree").union(ways.select(F.lit(1), "way_id", "quadtree"))
    if change_members is None:
        return out
    known = out if before is None else out.union(before.join(out, ["elem_type", "id"], "left_anti").select("elem_type", "id", "quadtree"))
    rels = live.where("elem_type = 2").select("id")
    own = change_members.join(rels.select(F.col("id").alias("rel_id")), "rel_id", "left_semi").where("not (mem_type = 2 and mem_ref = rel_id)")
    found = build.relation_quadtrees(rels, own, known.where("elem_type = 0").select("id", "quadtree"), known.where("elem_type = 1").select(F.col("id").alias("way_id"), "quadtree"))
    return out.union(found.select(F.lit(2), "id", "quadtree"))


def pending(states: DataFrame, last: int, most: int | None = None) -> DataFrame:
    """T1, O6. The states after the last one, in order; the first so many."""
    out = states.where(F.col("state") > last).orderBy("state")
    return out.limit(most) if most else out


def initial_state(states: DataFrame, timestamp: int) -> DataFrame:
    """S20. The last state that isn't after the timestamp."""
    return states.where(F.col("timestamp") <= timestamp).agg(F.max_by(F.struct("state", "timestamp"), "timestamp").alias("s")).select("s.*")
