"""One query for each operator, over the fixture tables. Results are scalar columns, times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.fixtures import view
from geostrata.functions import quadtree as q
from geostrata.functions import text
from geostrata.operators import build, diff, extract, merge, order, summary, tiles, update
from geostrata.plans.scratch import exists, written

BOX = (-1000000000, -585000000, -600000000, -500000000)
RING = [(-110.0, -59.0), (-20.0, -59.0), (-20.0, -48.0), (-60.0, -54.0), (-110.0, -48.0), (-80.0, -53.5)]
DEPTH = 7  # of the fixed tile set
AS_OF = 1705276800  # 2024-01-15
DAY_ONE = 1704067200  # 2024-01-01: change file n ends n days later
PREFIX = "https://planet.example.org/day/"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- scalar functions -------------------------------------------------------------------------------------------------
@query
def coord_fixed_point(spark, d):
    n = view(spark, d, "nodes").select("id", q.as_degrees("lon").alias("lon_deg"), q.as_degrees("lat").alias("lat_deg"))
    return n.select("id", "lon_deg", "lat_deg", q.as_integer("lon_deg").alias("lon"), q.as_integer("lat_deg").alias("lat"))


@query
def mercator_roundtrip(spark, d):
    m = q.mercator(q.as_degrees("lat"))
    return view(spark, d, "nodes").select("id", F.round(m, 9).alias("y"), F.round(q.inverse_mercator(m), 7).alias("lat_back"))


def _tile_numbers(df: DataFrame) -> DataFrame:
    return df.select("id", (F.col("id") % 20).cast("int").alias("z")).withColumn("n", F.pow(F.lit(2), "z").cast("long")).select("id", "z", (F.col("id") * 7919 % F.col("n")).cast("int").alias("x"), (F.col("id") * 104729 % F.col("n")).cast("int").alias("y"))


@query
def tile_zoom_bbox(spark, d):
    t = _tile_numbers(view(spark, d, "ways"))
    box, old = q.tile_bbox("x", "y", "z"), q.tile_bbox("x", "y", "z", 0.1, legacy=True)
    return t.select("id", "x", "y", "z", F.round(q.metres_per_pixel("z"), 6).alias("metres"), box.alias("b"), old.alias("o")).select("id", "x", "y", "z", "metres", "b.*", F.col("o.minlon").alias("old_minlon"), F.col("o.maxlat").alias("old_maxlat"))


def _points(spark, d):
    return view(spark, d, "nodes").select("id", q.calculate_point("lon", "lat").alias("quadtree"))


@query
def qt_point(spark, d):
    return _points(spark, d)


@query
def qt_round(spark, d):
    p = _points(spark, d)
    return p.select("id", *[q.round_to("quadtree", n).alias(f"r{n}") for n in (0, 1, 5, 10, 17, 20)])


@query
def qt_depth_quad(spark, d):
    return _points(spark, d).select("id", q.depth("quadtree").alias("depth"), q.quad("quadtree", 0).alias("quad0"), q.quad("quadtree", 9).alias("quad9"), q.is_empty("quadtree").alias("empty"))


@query
def qt_string(spark, d):
    return _points(spark, d).select("id", q.as_letters("quadtree").alias("letters"))


@query
def qt_to_xyz(spark, d):
    return _points(spark, d).select("id", q.as_xyz("quadtree").alias("t")).select("id", "t.*")


@query
def qt_from_xyz(spark, d):
    return _tile_numbers(view(spark, d, "ways")).select("id", q.from_xyz("x", "y", "z").alias("quadtree"))


@query
def qt_bbox(spark, d):
    return _way_cells(spark, d).select("way_id", q.cell_bbox("quadtree").alias("b"), q.cell_bbox("quadtree", 0.05).alias("w")).select("way_id", "b.*", F.col("w.minlon").alias("wide_minlon"), F.col("w.maxlat").alias("wide_maxlat"))


def _pairs(spark, d):
    """Each way with the way 7 further on."""
    w = _way_cells(spark, d)
    other = w.select((F.col("way_id") - 7).alias("way_id"), F.col("quadtree").alias("other"))
    return w.join(other, "way_id")


@query
def qt_is_parent(spark, d):
    return _pairs(spark, d).select("way_id", q.is_parent("quadtree", "other").alias("related"), q.is_parent(q.round_to("quadtree", 3), "quadtree").alias("own"))


@query
def qt_common_pair(spark, d):
    return _pairs(spark, d).select("way_id", q.common("quadtree", "other").alias("common"))


@query
def timestamp_formats(spark, d):
    t = view(spark, d, "ways").select("id", "timestamp")
    iso, alt, day = text.timestamp_string(F.col("timestamp")), text.timestamp_string(F.col("timestamp"), "-"), text.date_string(F.col("timestamp"))
    shape = F.when(F.col("id") % 4 == 0, iso).when(F.col("id") % 4 == 1, F.concat(iso, F.lit("Z"))).when(F.col("id") % 4 == 2, alt).otherwise(day)
    return t.select("id", iso.alias("iso"), alt.alias("alt"), day.alias("day"), text.parse_timestamp(shape).alias("parsed"))


@query
def replication_url(spark, d):
    s = view(spark, d, "ways").select("id", (F.col("id") * 7919 % 9999999).alias("state"))
    return s.select("id", text.diff_url(PREFIX, F.col("state")).alias("diff"), text.state_url(PREFIX, F.when(F.col("id") % 5 > 0, F.col("state"))).alias("state_url"))


# --- boxes ------------------------------------------------------------------------------------------------------------
def _way_boxes(spark, d):
    return build.way_bbox(view(spark, d, "nodes"), view(spark, d, "way_nodes"))


def _way_cells(spark, d):
    return build.way_quadtrees(view(spark, d, "nodes"), view(spark, d, "way_nodes"))


@query
def way_bbox(spark, d):
    return _way_boxes(spark, d)


@query
def way_quadtrees(spark, d):
    return _way_cells(spark, d)


def _box():
    return q.bbox("minlon", "minlat", "maxlon", "maxlat")


@query
def bbox_contains(spark, d):
    return _way_boxes(spark, d).select("way_id", q.contains(q.literal_bbox(BOX), _box()).alias("inside"))


@query
def bbox_overlaps(spark, d):
    return _way_boxes(spark, d).select("way_id", q.overlaps(q.literal_bbox(BOX), _box()).alias("overlaps"))


@query
def bbox_contains_point(spark, d):
    return view(spark, d, "nodes").select("id", q.contains_point(q.literal_bbox(BOX), "lon", "lat").alias("inside"))


# --- cells of everything ----------------------------------------------------------------------------------------------
@query
def node_ways(spark, d):
    n = build.node_ways(view(spark, d, "nodes"), view(spark, d, "way_nodes"))
    return n.select("id", F.size("ways").cast("long").alias("n_ways"), F.array_join(F.col("ways").cast("array<string>"), ",").alias("ways"))


@query
def node_quadtrees(spark, d):
    nodes, wn = view(spark, d, "nodes"), view(spark, d, "way_nodes")
    return build.node_quadtrees(nodes, wn, build.way_quadtrees(nodes, wn))


def _all_cells(spark, d):
    return build.quadtrees(*[view(spark, d, n) for n in ("nodes", "way_nodes", "relations", "rel_members")])


_KNOWN: dict[tuple[str, str], DataFrame] = {}


def _known_cells(spark, d):
    """The cells of a fixture folder, built once a session for the queries whose operators start from cells."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _KNOWN or not exists(_KNOWN[key]):
        _KNOWN[key] = _all_cells(spark, d)
    return _KNOWN[key]


@query
def relation_quadtrees(spark, d):
    return _all_cells(spark, d).where("elem_type = 2").select("id", "quadtree")


def _elements(spark, d):
    """elem_type, id, version, timestamp of everything."""
    part = lambda name, kind: view(spark, d, name).select(F.lit(kind).alias("elem_type"), "id", "version", "timestamp")
    return part("nodes", 0).unionByName(part("ways", 1)).unionByName(part("relations", 2))


@query
def attach_quadtrees(spark, d):
    return build.attach(_elements(spark, d), _all_cells(spark, d)).select("elem_type", "id", "quadtree")


@query
def unattached_elements(spark, d):
    return build.unattached(build.attach(_elements(spark, d), _all_cells(spark, d)))


@query
def way_range(spark, d):
    return build.way_range(view(spark, d, "way_nodes"), 500, 9000)


@query
def missing_way_nodes(spark, d):
    some = view(spark, d, "nodes").where("id % 11 <> 3")
    return build.missing_way_nodes(some, view(spark, d, "way_nodes"))


# --- summaries --------------------------------------------------------------------------------------------------------
@query
def count_nodes(spark, d):
    return summary.nodes(view(spark, d, "nodes"))


@query
def count_ways(spark, d):
    return summary.ways(view(spark, d, "ways"), view(spark, d, "way_nodes"))


@query
def count_relations(spark, d):
    return summary.relations(view(spark, d, "relations"), view(spark, d, "rel_members"))


@query
def count_by_changetype(spark, d):
    return summary.by_changetype(view(spark, d, "changes"))


@query
def max_timestamp(spark, d):
    return summary.data_date(view(spark, d, "nodes"))


# --- tiles ------------------------------------------------------------------------------------------------------------
def _tiles(spark, d, cells=None):
    """A fixed tile set: the cells of depth DEPTH at most that elements round to."""
    return written(tiles.tile_weights(cells if cells is not None else _known_cells(spark, d), DEPTH), "tiles")


@query
def tile_weights(spark, d):
    return tiles.tile_weights(_known_cells(spark, d))


@query
def tile_totals(spark, d):
    return tiles.tile_totals(tiles.tile_weights(_known_cells(spark, d)))


@query
def tile_assign(spark, d):
    cells = _known_cells(spark, d)
    return tiles.assign(cells, _tiles(spark, d, cells))


def _tiled(spark, d):
    cells = _known_cells(spark, d)
    return tiles.with_tiles(build.attach(_elements(spark, d), cells), _tiles(spark, d, cells), cells)


@query
def tile_sorted(spark, d):
    t = tiles.cluster(_tiled(spark, d).select("tile", "elem_type", "id"))
    return order.numbered(t, ["tile", "elem_type", "id"], "place")


@query
def tile_index_hits(spark, d):
    return tiles.index_hits(tiles.tile_index(_tiled(spark, d)), view(spark, d, "changes").select("elem_type", "id").distinct())


@query
def tile_prune_bbox(spark, d):
    return tiles.prune(_tiles(spark, d).select("tile"), BOX)


@query
def tile_depth(spark, d):
    return tiles.to_depth(_tiles(spark, d).select("tile"), 4)


@query
def block_weight(spark, d):
    return _tiled(spark, d).groupBy("tile").agg(tiles.block_weight(F.col("elem_type")).alias("weight"), F.count("*").alias("len"))


@query
def tile_ordinal(spark, d):
    return tiles.ordinals(_tiled(spark, d)).withColumn("bucket", F.floor(F.col("ordinal") / 16).cast("long"))


@query
def snapshot_sizes(spark, d):
    return tiles.snapshot_sizes(_tiled(spark, d))


@query
def tile_groups(spark, d):
    return tiles.pack_tiles(tiles.tile_weights(_known_cells(spark, d)), 1000)


@query
def tile_groups_listing(spark, d):
    return tiles.listing(tiles.pack_tiles(tiles.tile_weights(_known_cells(spark, d)), 1000))


@query
def tile_groups_assign(spark, d):
    cells = _known_cells(spark, d)
    packed = tiles.pack_tiles(tiles.tile_weights(cells), 1000)
    return tiles.with_tiles(cells, packed).groupBy("tile").agg(F.count("*").alias("n"))


@query
def tile_triage(spark, d):
    return extract.triage(_tiles(spark, d).select("tile"), BOX, RING)


# --- extracts ---------------------------------------------------------------------------------------------------------
@query
def filter_nodes_bbox(spark, d):
    return view(spark, d, "nodes").where(extract.node_test(BOX, None)).select("id")


@query
def filter_nodes_poly(spark, d):
    return view(spark, d, "nodes").where(extract.node_test(extract.ring_bbox(RING), RING)).select("id")


@query
def filter_ways(spark, d):
    return extract.ways_of(filter_nodes_bbox(spark, d), view(spark, d, "way_nodes"))


@query
def filter_completion(spark, d):
    inside, wn = filter_nodes_bbox(spark, d), view(spark, d, "way_nodes")
    return extract.extra_nodes(extract.ways_of(inside, wn), inside, wn)


def _selected(spark, d):
    return extract.select(view(spark, d, "nodes"), view(spark, d, "way_nodes"), view(spark, d, "rel_members"), BOX)


@query
def filter_all(spark, d):
    return _selected(spark, d)


@query
def filter_relations(spark, d):
    return _selected(spark, d).where("elem_type = 2").select("id")


@query
def extract_members(spark, d):
    """The relations of an extract with the members that it holds."""
    mem = view(spark, d, "rel_members").groupBy(F.lit(2).alias("elem_type"), F.col("rel_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "mem_type", "mem_ref"))).alias("members"))
    chosen = written(_selected(spark, d), "selected")
    kept = extract.with_members(mem.join(chosen, ["elem_type", "id"], "left_semi"), chosen)
    return kept.select("id", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["mem_type"].cast("string"), m["mem_ref"].cast("string"))), ",").alias("members"))


@query
def filter_members(spark, d):
    return extract.prune_members(view(spark, d, "rel_members"), written(_selected(spark, d), "selected"))


# --- merging ----------------------------------------------------------------------------------------------------------
def _base(spark, d):
    return _elements(spark, d).select("elem_type", "id", F.lit(0).alias("changetype"), "version", "timestamp", F.lit(0).cast("long").alias("seq"))


def _changes(spark, d, where="true"):
    c = update.latest(view(spark, d, "changes")).where(where)
    return c.select("elem_type", "id", "changetype", "version", "timestamp", "seq")


@query
def combine_changes(spark, d):
    return merge.combine(_changes(spark, d, "seq = 3"), _changes(spark, d, "seq = 4"), ["elem_type", "id"])


@query
def apply_changes(spark, d):
    return merge.apply_changes(_base(spark, d), _changes(spark, d, "seq = 3"), ["elem_type", "id"])


def _manifest(spark, d):
    files = view(spark, d, "changes").select(F.col("seq").alias("state")).distinct().union(spark.range(1).select(F.col("id").alias("state")))
    return files.select("state", (F.lit(DAY_ONE) + F.col("state") * 86400).alias("end_date"))


@query
def merge_asof(spark, d):
    return merge.as_of(_base(spark, d), _changes(spark, d), _manifest(spark, d), AS_OF, ["elem_type", "id"])


@query
def merge_tiles_asof(spark, d):
    """By tile: elements that a change moves leave a Remove in the tile of the base, once."""
    base, moved = _log(spark, d)
    old = base.select("elem_type", "id", F.col("tile").alias("was"))
    gone = moved.join(old, ["elem_type", "id"]).where("was <> tile and changetype <> 1").select("elem_type", "id", F.lit(0).cast("long").alias("quadtree"), F.col("was").alias("tile"), F.lit(merge.REMOVE).alias("changetype"), "seq")
    return merge.as_of(base, moved.unionByName(gone), _manifest(spark, d), AS_OF).select("tile", "elem_type", "id", "quadtree", "seq")


@query
def snapshot_select(spark, d):
    return merge.snapshot(_manifest(spark, d), AS_OF)


@query
def id_union(spark, d):
    return merge.union_ids(_elements(spark, d).select("elem_type", "id"), view(spark, d, "changes").select("elem_type", "id"))


# --- updates ----------------------------------------------------------------------------------------------------------
@query
def change_latest(spark, d):
    return update.latest(view(spark, d, "changes")).select("seq", "elem_type", "id", "version", "changetype", "timestamp")


@query
def change_latest_ties(spark, d):
    c = view(spark, d, "changes").withColumn("version", 6 + F.col("seq"))
    return update.latest(c).select("seq", "elem_type", "id", "version", "changetype", "pos")


def _change(spark, d, seq=1):
    """One change file, written, as queries meet it several times."""
    return written(update.latest(view(spark, d, "changes")).where(F.col("seq") == seq), "change")


@query
def change_ids(spark, d):
    c = _change(spark, d)
    of = view(spark, d, "way_nodes").join(c.where("elem_type = 1").select(F.col("id").alias("way_id")), "way_id", "left_semi")
    mem = view(spark, d, "rel_members").join(c.where("elem_type = 2").select(F.col("id").alias("rel_id")), "rel_id", "left_semi")
    return update.touched_ids(c, of, mem)


@query
def extra_nodes(spark, d):
    return update.extra_nodes(_change(spark, d), view(spark, d, "way_nodes"), view(spark, d, "nodes")).select("id", "lon", "lat")


def _log(spark, d):
    """Placed rows: the base at each element's cell, and all changes of elements that it holds, at a cell less deep."""
    cells = _known_cells(spark, d)
    base = tiles.with_tiles(cells, _tiles(spark, d, cells)).select("elem_type", "id", "quadtree", "tile", F.lit(0).alias("changetype"), F.lit(0).cast("long").alias("seq"))
    base = written(base, "base")
    later = update.latest(view(spark, d, "changes")).select("elem_type", "id", "changetype", "seq")
    level = F.least(3 + F.col("seq").cast("int"), F.lit(q.ELEMENT_LEVEL))
    moved = later.join(base.select("elem_type", "id", "quadtree"), ["elem_type", "id"]).withColumn("quadtree", q.round_to("quadtree", level))
    return base, written(moved.select("elem_type", "id", "quadtree", q.round_to("quadtree", 4).alias("tile"), "changetype", "seq"), "moved")


@query
def existing_state(spark, d):
    return update.existing(*_log(spark, d))


@query
def update_tiles_read(spark, d):
    """What an update reads: the rows of the tiles that the index gives for all that change file 1 changes or refers to."""
    placed = written(_tiled(spark, d).select("tile", "elem_type", "id"), "placed")
    read = tiles.read_tiles(placed, tiles.index_hits(tiles.tile_index(placed), change_ids(spark, d)))
    return read.groupBy("tile", "elem_type").agg(F.count("*").alias("n"))


@query
def update_actions(spark, d):
    """Change file 2: changed nodes move, the nodes of changed ways come along, new cells follow, and rows go to tiles."""
    cells = _known_cells(spark, d)
    tile_table = _tiles(spark, d, cells).select("tile")
    before = tiles.with_tiles(cells, tile_table).select("elem_type", "id", "quadtree", "tile")
    change = _change(spark, d, 2).select("elem_type", "id", "changetype", "pos")
    wn = view(spark, d, "way_nodes")
    nodes = view(spark, d, "nodes")
    more = update.extra_nodes(change, wn, nodes)
    shift = (F.col("pos") % 2001 - 1000) * 10000
    # A created node has no place of its own in the fixtures: it takes one by its number.
    at = change.where("elem_type = 0 and changetype <> 1").join(nodes.select("id", "lon", "lat"), "id", "left")
    placed = at.select("id", (F.coalesce("lon", (F.col("id") % 1000 * 1000000).cast("int")) + shift).cast("int").alias("lon"), (F.coalesce("lat", (F.col("id") % 500 * 1000000).cast("int")) + shift).cast("int").alias("lat"))
    new = update.new_cells(change, placed.union(more.select("id", "lon", "lat")), wn)
    whole = change.select("elem_type", "id", "changetype").union(more.select(F.lit(0), "id", F.lit(0)))
    return update.actions(whole, before, new, tile_table)


def _states(spark, d):
    return view(spark, d, "changes").select("seq").distinct().select(F.col("seq").alias("state"), (F.lit(DAY_ONE) + F.col("seq") * 86400).alias("timestamp"))


@query
def pending_diffs(spark, d):
    return update.pending(_states(spark, d), 12, 5)


@query
def initial_state(spark, d):
    return update.initial_state(_states(spark, d), AS_OF + 3600)


# --- differences ------------------------------------------------------------------------------------------------------
def _sides(spark, d):
    """The ways, and the same with some of them gone, new or changed."""
    tags = F.array(F.struct(F.lit("priority").alias("key"), F.col("priority").alias("val")), F.struct(F.lit("status").alias("key"), F.col("status").alias("val")))
    user = F.concat(F.lit("user"), (F.col("user_id") % 100).cast("string"))
    w = view(spark, d, "ways").select(F.lit(1).alias("elem_type"), "id", "version", "timestamp", "user_id", tags.alias("tags"), (F.col("id") * 31 % 1000).cast("string").alias("data"), (F.col("id") % 64).alias("quadtree"), user.alias("user"))
    n = F.col("id") % 23
    right = w.where(n != 1).select(
        "elem_type", F.when(n == 2, F.col("id") + 500000000).otherwise(F.col("id")).alias("id"), (F.col("version") + F.when(n == 3, 1).otherwise(0)).alias("version"), "timestamp", "user_id",
        F.when(n == 4, F.slice("tags", 1, 1)).when(n == 8, F.reverse("tags")).otherwise(F.col("tags")).alias("tags"), F.when(n == 5, "moved").otherwise(F.col("data")).alias("data"),
        (F.col("quadtree") + F.when(n == 6, 1).otherwise(0)).alias("quadtree"), F.when(n == 7, F.concat("user", F.lit("x"))).otherwise(F.col("user")).alias("user"),
    )
    return w, right


@query
def element_diff(spark, d):
    return diff.compare(*_sides(spark, d)).select("elem_type", "id", "kind")


@query
def diff_counts(spark, d):
    return diff.counts(diff.compare(*_sides(spark, d)))


@query
def renamed_users(spark, d):
    return diff.renamed_users(diff.compare(*_sides(spark, d)))


@query
def diff_report(spark, d):
    return diff.report(diff.compare(*_sides(spark, d)), 100).select("elem_type", "id", "kind")


@query
def tag_diff(spark, d):
    left, right = _sides(spark, d)
    both = left.select("id", F.col("tags").alias("a")).join(right.select("id", F.col("tags").alias("b")), "id")
    return both.select("id", diff.tags_differ(F.col("a"), F.col("b")).alias("differ"))


# --- orders -----------------------------------------------------------------------------------------------------------
@query
def elements_sorted(spark, d):
    c = view(spark, d, "changes").select("id", "version", "changetype")
    return order.numbered(order.by_version(c), ["id", "version", "changetype"], "place")


@query
def reblock_8000(spark, d):
    return order.blocks(_elements(spark, d).select("elem_type", "id")).select("elem_type", "id", "block")


@query
def sorted_tags(spark, d):
    left, _ = _sides(spark, d)
    tags = order.sorted_tags(F.reverse("tags"))
    return left.select("id", F.array_join(F.transform(tags, lambda t: F.concat(t["key"], F.lit("="), t["val"])), ";").alias("tags"))
