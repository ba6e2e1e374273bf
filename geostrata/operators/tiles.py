"""Tiles: weights and totals of cells, greedy packing, assignment, clustered layout and the tile index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions import quadtree as q
from geostrata.plans.scratch import written

#: Rows of a table that may be broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tile_weights(qts: DataFrame, level: int = q.GROUP_LEVEL) -> DataFrame:
    """A8. How many elements each cell has; nodes and ways rounded to level, relations not. Negatives don't count."""
    cell = F.when(F.col("elem_type") == 2, F.col("quadtree")).otherwise(q.round_to("quadtree", level))
    return qts.where("quadtree >= 0").groupBy(cell.alias("tile")).agg(F.count("*").alias("weight"))


def tile_totals(weights: DataFrame) -> DataFrame:
    """A9. Each cell on the way up from a weighted one: its own weight and its subtree's."""
    up = _upward(weights.select("weight", F.col("tile").alias("own")), "own")
    return up.groupBy("tile").agg(F.sum(F.when(F.col("own") == F.col("tile"), F.col("weight")).otherwise(0)).alias("weight"), F.sum("weight").alias("total"))


def _upward(rows: DataFrame, cell: str) -> DataFrame:
    """rows with tile: a row each for the cell and all its ancestors. Levels are a fixed list, so that the ancestors are compiled expressions and not arrays of their own."""
    levels = rows.select("*", F.explode(F.array(*map(F.lit, range(q.MAX_DEPTH + 1)))).alias("_level"))
    return levels.where(F.col("_level") <= q.depth(cell)).withColumn("tile", q.round_to(cell, "_level")).drop("_level")


def pack_tiles(weights: DataFrame, target: int = 40_000, least: int | None = None) -> DataFrame:
    """I2. tile and weight: cells that together hold everything, of about target elements each.

    Only cells whose subtree has least elements or more can become tiles, so no others come to the driver; their number
    follows from elements / least, not from the cells in use.
    """
    least = target // 2 if least is None else least
    cells = tile_totals(weights)
    own = cells.where(F.col("total") >= least).orderBy("tile").toPandas()
    total = weights.agg(F.sum("weight")).first()[0] or 0
    found = greedy(own["tile"].to_numpy(np.int64), own["weight"].to_numpy(np.int64), own["total"].to_numpy(np.int64), int(total), target, least)
    return weights.sparkSession.createDataFrame(sorted(found.items()), "tile long, weight long")


def greedy(tile: np.ndarray, weight: np.ndarray, total: np.ndarray, everything: int, target: int, least: int, step: int = 50) -> dict[int, int]:
    """tile (ascending: parents first), own weights and subtree totals of the cells with at least least; the tiles chosen.

    In rounds: the topmost cells with elements of their own whose total lies within step of the target become tiles; so
    do those whose total is theirs alone and those with only small children, once they reach the lower bound. If a round
    finds none, the bounds widen to where the next one will be found. What is left is the root's.
    """
    n, out = len(tile), {}
    total = total.copy()
    depth = (tile & 31).astype(np.int64)
    up = np.maximum(depth - 1, 0)
    above = (tile >> (63 - 2 * up) << (63 - 2 * up)) + up  # each cell's parent, which the totals bring along
    parent = np.where(depth > 0, np.searchsorted(tile, above), -1)
    alive, left = np.ones(n, bool), everything
    low, high = target - step, target + step
    while left > 0:
        if left < low:
            out[0] = out.get(0, 0) + left
            break
        largest = np.zeros(n, np.int64)  # the largest child
        below = np.flatnonzero(alive & (parent >= 0))
        np.maximum.at(largest, parent[below], total[below])
        special = (total == weight) | (largest <= least)
        may = alive & (weight > 0)
        far = np.where(special, 0, -(-(total - high) // step))
        need = np.maximum(np.maximum(far, -(-(low - total) // step)), 0)
        need[~may | (total < least)] = np.iinfo(np.int64).max
        rounds = need.min() if n else np.iinfo(np.int64).max
        if rounds == np.iinfo(np.int64).max:
            out[0] = out.get(0, 0) + left
            break
        low, high = max(least, low - step * int(rounds)), high + step * int(rounds)
        take = need <= rounds
        covered = np.zeros(n, bool)  # below a taken one
        for d in range(1, int(depth.max()) + 1):
            own = np.flatnonzero((depth == d) & alive)
            covered[own] = covered[parent[own]] | take[parent[own]]
        for k in np.flatnonzero(take & ~covered):
            out[int(tile[k])] = out.get(int(tile[k]), 0) + int(total[k])
            left -= int(total[k])
            p = parent[k]
            while p >= 0:
                total[p] -= total[k]
                p = parent[p]
        alive &= ~(covered | (take & ~covered))
    return out


def listing(packed: DataFrame) -> DataFrame:
    """W12. line: 'cell;weight;total' of each tile, with the weight of its subtree's tiles."""
    own = tile_totals(packed.select("tile", "weight")).join(packed.select("tile"), "tile", "left_semi")
    return own.select("tile", F.concat_ws(";", "tile", "weight", "total").alias("line"))


def read_tiles(rows: DataFrame, hits: DataFrame, most: int = 1000) -> DataFrame:
    """The rows of some tiles. A few are named in the filter, which reaches the files' row groups (they are clustered by tile); more meet by a join."""
    hits = written(hits.select("tile"), "hit-tiles")  # met up to three times
    few = [r["tile"] for r in hits.limit(most + 1).collect()]
    return rows.where(F.col("tile").isin(few)) if len(few) <= most else rows.join(small(hits), "tile", "left_semi")


def _by_level(rows: DataFrame, tiles: DataFrame, cell: str) -> DataFrame | None:
    """rows with tile: the deepest tile that is the cell or an ancestor, else the root. The tiles are broadcast once, and rows meet them level by level from the deepest, where they are; None if there are too many to broadcast."""
    named = tiles.select(F.col("tile").alias("_tile")).distinct()
    sizes = dict(named.where("_tile > 0").groupBy(q.depth("_tile").alias("depth")).count().collect())
    if sum(sizes.values()) > BROADCAST_ROWS:
        return None
    out = rows.withColumn("tile", F.lit(None).cast("long"))
    for n in sorted(sizes, reverse=True):
        up = F.when(F.col("tile").isNull() & (F.col(cell) >= 0) & (q.depth(cell) >= n), q.round_to(cell, n))
        out = out.join(F.broadcast(named), up == F.col("_tile"), "left").withColumn("tile", F.coalesce("tile", "_tile")).drop("_tile")
    return out.withColumn("tile", F.coalesce("tile", F.lit(0).cast("long")))


def assign(cells: DataFrame, tiles: DataFrame, column: str = "quadtree") -> DataFrame:
    """J7. quadtree and tile: the deepest tile that is the cell or an ancestor, else the root, for each different cell."""
    one = cells.select(F.col(column).alias("quadtree")).where("quadtree >= 0").distinct()
    found = _by_level(one, tiles, "quadtree")
    if found is not None:
        return found
    hit = _upward(one, "quadtree").join(tiles.select("tile").distinct(), "tile", "left_semi").groupBy("quadtree").agg(F.max("tile").alias("tile"))  # the deepest is the highest
    return one.join(hit, "quadtree", "left").select("quadtree", F.coalesce("tile", F.lit(0).cast("long")).alias("tile"))


def with_tiles(elements: DataFrame, tiles: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """elements(quadtree, ...) with their tiles; those without a cell (null or negative) are in the root. cells: a table whose quadtree holds all of elements' but the root, if it is cheaper to read."""
    of = assign(elements if cells is None else cells, tiles).select(F.col("quadtree").alias("_cell"), "tile")
    return elements.join(of, F.col("quadtree") == F.col("_cell"), "left").drop("_cell").withColumn("tile", F.coalesce("tile", F.lit(0).cast("long")))


def cluster(elements: DataFrame, partitions: int | None = None) -> DataFrame:
    """O2. elements(tile, elem_type, id, ...) dealt by ranges of tile and id, each in order. The root's rows may fill several ranges."""
    keys = ["tile", "elem_type", "id"]
    dealt = elements.repartitionByRange(partitions, *keys) if partitions else elements.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def ordinals(elements: DataFrame) -> DataFrame:
    """Each tile's number in order, from 0. Tiles are counted first, so the single ordered step sees tiles, not elements."""
    one = elements.select("tile").distinct()
    return one.select("tile", (F.row_number().over(Window.orderBy("tile")) - 1).cast("long").alias("ordinal"))


def tile_index(elements: DataFrame) -> DataFrame:
    """W8, S22. tile, elem_type, id: where each element is."""
    return elements.select("tile", "elem_type", "id")


def index_hits(index: DataFrame, ids: DataFrame) -> DataFrame:
    """J9. The tiles that hold any of ids(elem_type, id)."""
    return index.join(ids, ["elem_type", "id"], "left_semi").select("tile").distinct()


def prune(tiles: DataFrame, box: tuple[int, int, int, int], margin: float = 0.05) -> DataFrame:
    """F4. The tiles whose cells, widened by margin, overlap the box."""
    return tiles.where(q.let(q.cell_bbox("tile", margin), lambda cell: q.overlaps(cell, q.literal_bbox(box))))


def to_depth(tiles: DataFrame, most: int) -> DataFrame:
    """F6."""
    return tiles.where(q.depth("tile") <= most)


def block_weight(elem_type: Column) -> Column:
    """A12. Aggregate: nodes + 8 ways + 20 relations."""
    return F.sum(F.when(elem_type == 0, 1).when(elem_type == 1, 8).otherwise(20)).cast("long")


def snapshot_sizes(elements: DataFrame) -> DataFrame:
    """A13. How many tiles and objects there are."""
    return elements.agg(F.countDistinct("tile").alias("num_tiles"), F.count("*").alias("num_objects"))
