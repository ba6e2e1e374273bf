"""Commands over Parquet folders: python -m geostrata.cli COMMAND ... Names of folders may be any address that Spark reads."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import quadtree as q
from geostrata.operators import build, extract, merge, order, summary, tiles, update
from geostrata.sources import files, osc, pbf


def _map_files(path: str) -> list[str]:
    """A map file, or those of a folder that a writer left."""
    return sorted(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".pbf")) if os.path.isdir(path) else [path]


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    """elem_type, id and quadtree from files of cells or a Parquet folder."""
    return pbf.read(spark, *_map_files(path), cells=True) if path.endswith(".pbf") else spark.read.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rows of pbf.SCHEMA from map files, a change file or a Parquet folder."""
    if path.endswith(".pbf"):
        return pbf.read(spark, *_map_files(path))
    if path.endswith((".osc", ".osc.gz")):
        return osc.read(spark, path)
    return spark.read.parquet(path)


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, way_nodes, relations and rel_members of rows."""
    way_nodes = rows.where("elem_type = 1").select(F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id"))
    mem = rows.where("elem_type = 2").select(F.col("id").alias("rel_id"), F.posexplode("members").alias("seq", "m")).select("rel_id", "seq", "m.mem_type", "m.mem_ref")
    return rows.where("elem_type = 0").select("id", "lon", "lat"), way_nodes, rows.where("elem_type = 2").select("id"), mem


def count(spark, a) -> None:
    rows = load(spark, a.path)
    nodes, way_nodes, _, mem = parts(rows)
    by = "changetype" if a.path.endswith((".osc", ".osc.gz")) else None
    of = lambda kind: rows.where(F.col("elem_type") == kind).select("id", "timestamp", "lon", "lat", "changetype")
    for df in (summary.nodes(of(0), by), summary.ways(of(1), way_nodes, by), summary.relations(of(2), mem, by)):
        df.show(truncate=False)


def calcqts(spark, a) -> None:
    nodes, way_nodes, rels, mem = parts(load(spark, a.path))
    prelim = spark.read.parquet(a.existing) if a.existing else None
    if a.prelim:
        build.way_quadtrees(nodes, way_nodes, a.level, a.buffer).write.parquet(a.prelim)
        prelim = spark.read.parquet(a.prelim)
    cells = build.quadtrees(nodes, way_nodes, rels, mem, a.level, a.buffer, prelim)
    if a.out.endswith(".pbf"):
        pbf.write(cells.repartitionByRange("elem_type", "id").sortWithinPartitions("elem_type", "id").select("elem_type", "id", "quadtree"), a.out)
    else:
        cells.write.parquet(a.out)


def sortblocks(spark, a) -> None:
    cells = load_cells(spark, a.qts)
    rows = build.attach(load(spark, a.path).drop("quadtree", "tile"), cells).withColumn("tags", order.sorted_tags(F.col("tags")))
    packed = tiles.pack_tiles(tiles.tile_weights(cells, a.level), a.target, a.least)
    tiles.cluster(tiles.with_tiles(rows, packed).withColumn("seq", F.lit(0).cast("long"))).write.parquet(f"{a.out}/base")
    packed.write.parquet(f"{a.out}/tiles")
    tiles.listing(spark.read.parquet(f"{a.out}/tiles")).orderBy("tile").select("line").coalesce(1).write.text(f"{a.out}/groups")
    files.Manifest([{"Filename": "base", "EndDate": a.end_date, "NumTiles": packed.count(), "State": a.state}]).save(f"{a.out}/filelist.json")


def setup(spark, a) -> None:
    """A folder for a map, with settings: where change files lie or come from, levels, and the state to begin after."""
    os.makedirs(a.path, exist_ok=True)
    diffs = a.diffs or f"{a.path}/diffs"
    os.makedirs(diffs, exist_ok=True)
    files.Settings(a.state, diffs, a.source, not a.exact_time, a.level, a.buffer).save(f"{a.path}/settings.json")


def write_index(spark, a) -> None:
    tiles.tile_index(spark.read.parquet(f"{a.path}/{a.name}")).write.mode("overwrite").parquet(f"{a.path}/{a.name}-index")


def update_initial(spark, a) -> None:
    """Settings and the base's index. With a source and a time, the state to begin after is the last one up to it."""
    state = files.find_initial(a.source, a.timestamp) if a.source and a.timestamp else a.state
    files.Settings(state, a.diffs, a.source, True, a.level, a.buffer).save(f"{a.path}/settings.json")
    a.name = "base"
    write_index(spark, a)


def _log(spark, path: str, manifest: files.Manifest, ids: DataFrame | None = None, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The base's rows and those of all change files. ids: of files with an index, only the tiles that hold any of these; wanted: only these tiles."""
    out = []
    for e in manifest.entries:
        x, index = spark.read.parquet(f"{path}/{e['Filename']}"), f"{path}/{e['Filename']}-index"
        if ids is not None and os.path.exists(index):
            x = tiles.read_tiles(x, tiles.index_hits(spark.read.parquet(index), ids))
        out.append(x if wanted is None else tiles.read_tiles(x, wanted))
    later = out[0].limit(0)
    for x in out[1:]:
        later = later.unionByName(x, allowMissingColumns=True)
    return out[0], later


def run_update(spark, a) -> None:
    """Apply the change files of the settings' folder in order of their numbers (N.osc or N.osc.gz), fetched before from the settings' source if there is one. Each reads the tiles that the index gives for what it touches."""
    from geostrata.plans.scratch import release, written
    from geostrata.streaming.updates import apply_pending

    settings, manifest = files.Settings.load(f"{a.path}/settings.json"), files.Manifest.load(f"{a.path}/filelist.json")
    if settings.SourcePrfx:
        files.download(settings.SourcePrfx, settings.DiffsLocation, max(manifest.last_state, settings.InitialState), most=a.limit)
    found = {int(n.split(".")[0]): f"{settings.DiffsLocation}/{n}" for n in os.listdir(settings.DiffsLocation) if n.split(".")[0].isdigit()}
    packed = spark.read.parquet(f"{a.path}/tiles")

    def plan(state: int) -> int:
        change = written(update.latest(osc.read(spark, found[state]).withColumn("seq", F.lit(state).cast("long"))), "change")
        nodes, way_nodes, _, mem = parts(change)
        ids = written(update.touched_ids(change, way_nodes, mem), "touched")
        base, later = _log(spark, a.path, manifest, ids)
        own = lambda rows: rows.where(F.col("changetype") != merge.REMOVE).select("tile", "elem_type", "id", "changetype", "quadtree", "seq", "lon", "lat").join(ids, ["elem_type", "id"], "left_semi")
        old = written(merge.live(merge.overlay(own(base), own(later), ["elem_type", "id"])), "before")
        more = update.extra_nodes(change, way_nodes, old.where("elem_type = 0")).select("id", "lon", "lat")
        before = old.select("elem_type", "id", "quadtree", "tile")
        cells = update.new_cells(change, nodes.where("lon is not null").union(more), way_nodes, settings.MaxQtLevel, settings.QtBuffer, mem, before)
        whole = change.select("elem_type", "id", "changetype").union(more.select(F.lit(0), "id", F.lit(0)))
        rows = update.actions(whole, before, cells, packed).where("tile is not null").drop("action")
        full = change.drop("changetype", "pos", "seq").unionByName(more.select(F.lit(0).alias("elem_type"), "id", "lon", "lat"), allowMissingColumns=True)
        target = f"{a.path}/{state}{'-demo' if a.demo else '.parquet'}"
        tiles.cluster(rows.join(full, ["elem_type", "id"], "left").withColumn("seq", F.lit(state).cast("long"))).write.mode("overwrite").parquet(target)
        placed = spark.read.parquet(target)
        if not a.demo:
            tiles.tile_index(placed).write.mode("overwrite").parquet(f"{target}-index")
        n = placed.select("tile").distinct().count()
        for table in (change, ids, old):
            release(table)
        return n

    times = {r["state"]: r["at"] for r in _times(spark, settings.DiffsLocation)}
    now = lambda s: times.get(s) or time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())
    apply_pending(list(found), manifest, plan, now, a.limit, a.demo, lambda m: m.save(f"{a.path}/filelist.json"))


def _times(spark, folder: str) -> list:
    """The times of states, where the folder lists them."""
    if not os.path.exists(f"{folder}/state.csv"):
        return []
    return files.read_states(spark, f"{folder}/state.csv").select("state", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("at")).collect()


def drop_last(spark, a) -> None:
    manifest = files.Manifest.load(f"{a.path}/filelist.json")
    manifest.drop_last(a.count)
    manifest.save(f"{a.path}/filelist.json")


def diff_files(spark, a) -> None:
    """Differences of two data sets as JSON lines, and the users that changed their names."""
    from geostrata.operators import diff

    sides = [load(spark, p).drop("tile", "changetype") for p in (a.path, a.right)]
    told = [x.withColumn("data", F.to_json(F.struct("lon", "lat", "refs", "members"))) for x in sides]
    found = diff.compare(*told)
    diff.lines(*sides, found).orderBy("elem_type", "id").select("line").write.text(a.out)
    diff.counts(found).show()
    diff.renamed_users(found).show(truncate=False)


def mergechanges(spark, a) -> None:
    """The elements as of a time, by box or ring if asked for; --objects makes the cut exact and complete, else whole tiles are kept."""
    manifest = files.Manifest.load(f"{a.path}/filelist.json")
    if a.timestamp:
        manifest.entries = [e for e in manifest.entries if e["EndDate"] <= a.timestamp]
    box = ring = wanted = None
    if a.filter:  # only the tiles that the box meets are read; the root takes what fits nowhere else
        where = open(a.filter).read() if os.path.exists(a.filter) else a.filter
        box, ring = files.parse_filter(where)
        wanted = tiles.prune(spark.read.parquet(f"{a.path}/tiles").select("tile").union(spark.range(1).select("id")), box).distinct()
    base, later = _log(spark, a.path, manifest, wanted=wanted)
    rows = merge.live(merge.overlay(base, later.unionByName(base.limit(0), allowMissingColumns=True).select(*base.columns)))
    if box and a.objects:
        from geostrata.plans.scratch import written

        nodes, way_nodes, _, mem = parts(rows)
        chosen = written(extract.select(nodes, way_nodes, mem, box, ring), "selected")
        rows = extract.with_members(rows.join(chosen, ["elem_type", "id"], "left_semi"), chosen)
    out = order.by_type_and_id(rows) if a.sort else tiles.cluster(rows)
    if a.out.endswith(".pbf"):
        pbf.write(out.select(*[c.split()[0] for c in pbf.SCHEMA.split(", ")[:8]], "tags", "lon", "lat", "refs", "members", "quadtree", (F.lit(None).cast("long") if a.sort else F.col("tile")).alias("tile")), a.out)
    else:
        out.write.parquet(a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geostrata")
    sub = p.add_subparsers(required=True)

    def command(name, f, *options):
        c = sub.add_parser(name, help=f.__doc__)
        c.add_argument("path")
        for o, kind, default in options:
            c.add_argument(o, **({"action": "store_true"} if kind is bool else {"type": kind, "default": default}))
        c.set_defaults(run=f)

    shape = (("--level", int, q.ELEMENT_LEVEL), ("--buffer", float, q.BUFFER))
    command("count", count)
    command("calcqts", calcqts, ("--out", str, "qts"), ("--prelim", str, None), ("--existing", str, None), *shape)
    command("sortblocks", sortblocks, ("--qts", str, "qts"), ("--out", str, "tiles"), ("--target", int, 40_000), ("--least", int, None), ("--level", int, q.GROUP_LEVEL), ("--end-date", str, ""), ("--state", int, 0))
    command("write-index-file", write_index, ("--name", str, "base"))
    command("update-initial", update_initial, ("--state", int, 0), ("--diffs", str, ""), ("--source", str, ""), ("--timestamp", str, ""), *shape)
    command("setup", setup, ("--state", int, 0), ("--diffs", str, ""), ("--source", str, ""), ("--exact-time", bool, None), *shape)
    command("diff", diff_files, ("--right", str, ""), ("--out", str, "differences"))
    command("update", run_update, ("--limit", int, None), ("--demo", bool, None))
    command("update-drop-last", drop_last, ("--count", int, 1))
    command("mergechanges", mergechanges, ("--out", str, "merged"), ("--filter", str, ""), ("--timestamp", str, ""), ("--objects", bool, None), ("--sort", bool, None))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
