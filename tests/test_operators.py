"""Operators on hand-made maps, sources and the log of changes."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from geostrata import fixtures
from geostrata.functions import quadtree as q
from geostrata.operators import build, diff, extract, merge, order, summary, tiles, update
from geostrata.sources import files, osc, pbf
from geostrata.streaming import updates


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, lon int, lat int")


def way_nodes(spark, **ways):
    return spark.createDataFrame([(int(w[1:]), k, n) for w, ns in ways.items() for k, n in enumerate(ns)] or [], "way_id long, seq long, node_id long")


def members(spark, *rows):
    return spark.createDataFrame([(r, k, t, m) for k, (r, t, m) in enumerate(rows)], "rel_id long, seq long, mem_type int, mem_ref long")


def test_nodes_follow_their_ways_and_relations_their_members(spark):
    n = nodes(spark, (1, 100, 100), (2, 900000000, 100), (3, -900000000, -100), (4, 500, 500))
    wn = way_nodes(spark, w1=[1, 2, 1], w2=[1, 3], w3=[4], w4=[9])
    ways = build.way_quadtrees(n, wn)
    w = dict(ways.select("way_id", "quadtree").collect())
    assert set(w) == {1, 2, 3}
    p = dict(build.node_quadtrees(n, wn, ways).collect())
    assert p[2] == w[1] and p[3] == w[2] and p[4] == w[3] and p[1] == 0
    rels = spark.createDataFrame([(k,) for k in range(1, 9)], "id long")
    m = members(spark, (1, 1, 3), (2, 2, 1), (3, 2, 2), (4, 2, 3), (5, 2, 6), (6, 2, 5), (6, 1, 3), (7, 1, 77), (2, 2, 2))
    r = dict(build.relation_quadtrees(rels, m, build.node_quadtrees(n, wn, ways), ways).collect())
    assert r[1] == r[2] == r[3] == r[4] == r[5] == r[6] == w[3] and r[7] == 0 and r[8] == 0
    assert build.missing_way_nodes(n, wn).collect() == [(4, 9)]
    assert dict(build.node_ways(n, wn).collect())[1] == [1, 2]


def test_nodes_of_changes_are_numbered_by_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "SPAN", 64)
    lines = [(k % 301, 1 + k % 7) for k in range(900)] + [(10**7, 1), (5, None)]
    items = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int")
    sizes, placed = fixtures.numbered_nodes(items)
    ids = sorted({4 * a + b for a, b in lines if b})
    assert dict(placed.collect()) == {n: k for k, n in enumerate(ids)} and sizes.agg(F.sum("n")).first()[0] == len(ids)
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).selectExpr("id o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(7).selectExpr("id c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(40).selectExpr("id event_id", "id user_id", "timestamp_ntz'2024-01-02 00:00:00' ts", "'click' event_type").write.parquet(f"{tmp_path}/events.parquet")
    changes = fixtures.view(spark, str(tmp_path), "changes")
    hot = lambda k: (k % 101 if k % 4 < 2 else k) * 37
    want = {k: ids[hot(k) % len(ids)] if k % 10 <= 5 else hot(k) % 50 + 1 if k % 10 <= 8 else hot(k) % 7 + 1 for k in range(40)}
    assert {r["pos"]: r["id"] for r in changes.collect()} == want
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(n_id" not in plan and plan.count("windowspecdefinition(_span#") == 2  # of nodes, each span its own; of spans


def test_what_queries_meet_several_times_is_written(spark, monkeypatch):
    from geostrata import queries
    from geostrata.plans.scratch import exists

    monkeypatch.setattr(queries, "view", lambda spark, d, name: spark.createDataFrame([(1, 0, 5, 4, 7, 1)], "seq long, elem_type int, id long, changetype int, version long, pos long"))
    monkeypatch.setattr(queries, "_known_cells", lambda spark, d: spark.createDataFrame([(0, 5, (3 << 61) + 1)], "elem_type int, id long, quadtree long"))
    assert exists(queries._change(spark, "")) and all(map(exists, queries._log(spark, "")))
    assert [tuple(r) for r in queries._log(spark, "")[1].collect()] == [(0, 5, (3 << 61) + 1, (3 << 61) + 1, 4, 1)]


def test_attaching_reports_what_is_out_of_step(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "elem_type int, id long")
    c = spark.createDataFrame([(0, 1, 5)], "elem_type int, id long, quadtree long")
    a = build.attach(e, c)
    assert build.unattached(a).collect() == [(1, 2)] and a.where("elem_type = 2").first()["quadtree"] == 0


def test_tiles(spark):
    deep = (1 << 61) + (2 << 59) + 2
    e = spark.createDataFrame([(0, 1, deep), (0, 2, (1 << 61) + 1), (1, 3, 0), (2, 4, -1), (0, 5, None)], "elem_type int, id long, quadtree long")
    t = spark.createDataFrame([((1 << 61) + 1,)], "tile long")
    out = {r["id"]: r["tile"] for r in tiles.with_tiles(e, t).collect()}
    assert out == {1: (1 << 61) + 1, 2: (1 << 61) + 1, 3: 0, 4: 0, 5: 0}
    w = tiles.tile_weights(e, 1)
    assert dict(w.collect()) == {(1 << 61) + 1: 2, 0: 1}
    totals = {r["tile"]: (r["weight"], r["total"]) for r in tiles.tile_totals(w).collect()}
    assert totals == {0: (1, 3), (1 << 61) + 1: (2, 2)}
    packed = tiles.pack_tiles(w, 100)
    assert packed.agg(F.sum("weight")).first()[0] == 3
    clustered = tiles.cluster(tiles.with_tiles(e, t), 2).select("tile", "elem_type", "id").collect()
    assert len(clustered) == 5


def test_tiles_of_cells_by_broadcast_and_by_shuffle(spark, monkeypatch):
    """Both ways against a plain look at the ancestors, and with one row a cell: no ancestors but those of a few tiles are listed."""
    rng = random.Random(4)
    cell = lambda n: (rng.getrandbits(2 * n) << 63 - 2 * n) + n if n else 0
    up = lambda c, n: (c >> 63 - 2 * n << 63 - 2 * n) + n if n else 0
    cells = [cell(rng.randint(0, 20)) for _ in range(300)] + [0, -1, -2, None]
    named = {up(c, rng.randint(0, c & 31)) for c in cells[:200]} | {cell(2) for _ in range(5)}
    e = spark.createDataFrame([(k, c) for k, c in enumerate(cells + cells)], "id long, quadtree long")
    t = spark.createDataFrame([(c,) for c in sorted(named) * 2], "tile long")
    best = lambda c: max((up(c, n) for n in range((c & 31) + 1) if up(c, n) in named), key=lambda x: x & 31, default=0) if c is not None and c >= 0 else 0
    for most in (500_000, 0):
        monkeypatch.setattr(tiles, "BROADCAST_ROWS", most)
        assert sorted(map(tuple, tiles.assign(e, t).collect())) == sorted({(c, best(c)) for c in cells if c is not None and c >= 0})
        assert {r["id"]: r["tile"] for r in tiles.with_tiles(e, t).collect()} == {k: best(c) for k, c in enumerate(cells + cells)}
        assert {r["id"]: r["tile"] for r in tiles.with_tiles(e, t, e.where("quadtree > 0")).collect()} == {k: best(c) for k, c in enumerate(cells + cells)}
        assert tiles.with_tiles(e, t.limit(0)).where("tile <> 0").isEmpty()
        assert ("Generate" in tiles.assign(e, t)._jdf.queryExecution().toString()) == (not most)
    w = {c: n + 1 for n, c in enumerate(cells) if c is not None and c >= 0}
    totals = {}
    for c, n in w.items():
        for k in range((c & 31) + 1):
            own, all_of = totals.get(up(c, k), (0, 0))
            totals[up(c, k)] = (own + n * (up(c, k) == c), all_of + n)
    found = tiles.tile_totals(spark.createDataFrame(list(w.items()), "tile long, weight long"))
    assert {r["tile"]: (r["weight"], r["total"]) for r in found.collect()} == totals
    assert "lambdafunction" not in found._jdf.queryExecution().toString()


def test_extracts_are_complete(spark):
    n = nodes(spark, (1, 0, 0), (2, 999, 999), (3, 5000, 5000))
    wn = way_nodes(spark, w1=[1, 3], w2=[3])
    m = members(spark, (1, 0, 1), (2, 2, 1), (3, 2, 2), (4, 0, 2), (5, 2, 3))
    out = {tuple(r) for r in extract.select(n, wn, m, (-10, -10, 10, 10)).collect()}
    assert out == {(0, 1), (0, 3), (1, 1), (2, 1), (2, 2), (2, 3), (2, 5)}
    kept = extract.prune_members(members(spark, (1, 0, 2), (1, 0, 1)), spark.createDataFrame([(0, 1)], "elem_type int, id long")).collect()
    assert [tuple(r) for r in kept] == [(1, 0, 0, 1, 2)]
    t = spark.createDataFrame([(0,), ((3 << 61) + 1,)], "tile long")
    assert {r["action"] for r in extract.triage(t, (-1800000000, -900000000, 1800000000, 900000000)).collect()} <= {"all", "each"}


def test_merging_keeps_the_newest_of_each_tile(spark):
    s = "tile long, elem_type int, id long, changetype int, seq long"
    base = spark.createDataFrame([(1, 0, 1, 0, 0), (1, 0, 2, 0, 0)], s)
    change = spark.createDataFrame([(1, 0, 1, 2, 1), (2, 0, 1, 4, 1), (1, 0, 2, 1, 2), (1, 0, 2, 5, 3)], s)
    m = spark.createDataFrame([(0, 10), (1, 20), (2, 30), (3, 40)], "state long, end_date long")
    at = lambda ts: {(r["tile"], r["id"]) for r in merge.as_of(base, change, m, ts).collect()}
    assert at(10) == {(1, 1), (1, 2)} and at(20) == {(2, 1), (1, 2)} and at(39) == {(2, 1)} and at(None) == {(2, 1), (1, 2)}


def test_the_base_is_neither_sorted_nor_aggregated(spark):
    s = "tile long, elem_type int, id long, changetype int, seq long"
    base, change = (spark.range(1000).selectExpr("id % 7 as tile", "0 as elem_type", "id", f"{k} as changetype", f"cast({k} as long) as seq") for k in (0, 4))
    plan = merge.apply_changes(base, change.where("id < 10").limit(5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") <= 2 and "LeftAnti" in plan
    assert merge.apply_changes(spark.createDataFrame([], s), spark.createDataFrame([], s)).collect() == []


def test_existing_state_reads_changes_over_the_base(spark):
    s = "elem_type int, id long, quadtree long, tile long, changetype int, seq long"
    base = spark.createDataFrame([(0, k, 10 + k, 1, 0, 0) for k in range(6)], s)
    log = spark.createDataFrame([(0, 1, 0, 1, 2, 1), (0, 1, 50, 2, 4, 1), (0, 2, 0, 1, 1, 1), (0, 3, 60, 2, 4, 1), (0, 3, 70, 3, 4, 2), (0, 9, 80, 2, 5, 2), (0, 4, 0, 1, 2, 3)], s)
    got = {(r["id"], r["quadtree"], r["tile"]) for r in update.existing(base, log).collect()}
    assert got == {(0, 10, 1), (1, 50, 2), (3, 70, 3), (4, 14, 1), (5, 15, 1), (9, 80, 2)}
    ids = spark.createDataFrame([(0, 3), (0, 5), (0, 7)], "elem_type int, id long")
    assert {r["id"] for r in update.existing(base, log, ids).collect()} == {3, 5}


def test_an_update_reads_the_tiles_of_the_index_alone(spark, tmp_path):
    rows = spark.range(10_000).selectExpr("id div 100 as tile", "cast(0 as int) as elem_type", "id")
    tiles.cluster(rows, 10).write.parquet(f"{tmp_path}/base")
    base = spark.read.parquet(f"{tmp_path}/base")
    ids = spark.createDataFrame([(0, 5), (0, 5050), (0, 77777)], "elem_type int, id long")
    hits = tiles.index_hits(tiles.tile_index(base), ids)
    read = tiles.read_tiles(base, hits)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(tile" in plan and "Join" not in plan
    assert {r["tile"] for r in read.collect()} == {0, 50} and read.count() == 200
    assert sorted(map(tuple, tiles.read_tiles(base, hits, most=1).collect())) == sorted(map(tuple, read.collect()))


def test_relations_of_an_extract_hold_its_members_alone(spark):
    rows = spark.createDataFrame([(2, 1, [("a", 0, 5), ("b", 1, 6), ("c", 0, 5)]), (2, 2, [("x", 2, 9)]), (2, 3, None), (0, 5, None)], "elem_type int, id long, members array<struct<role:string,mem_type:int,mem_ref:long>>")
    out = {(r["elem_type"], r["id"]): r["members"] and [tuple(m) for m in r["members"]] for r in extract.with_members(rows, spark.createDataFrame([(0, 5), (2, 1)], "elem_type int, id long")).collect()}
    assert out == {(2, 1): [("a", 0, 5), ("c", 0, 5)], (2, 2): [], (2, 3): [], (0, 5): None}


def test_listing_and_way_ranges(spark):
    packed = spark.createDataFrame([(0, 5), ((1 << 61) + 1, 7), ((1 << 61) + (1 << 59) + 2, 9)], "tile long, weight long")
    got = {r["line"] for r in tiles.listing(packed).collect()}
    assert got == {"0;5;21", f"{(1 << 61) + 1};7;16", f"{(1 << 61) + (1 << 59) + 2};9;9"}
    wn = way_nodes(spark, w1=[1], w5=[2], w9=[3])
    ids = lambda *a: sorted(r["way_id"] for r in build.way_range(wn, *a).collect())
    assert ids() == [1, 5, 9] and ids(5) == [5, 9] and ids(0, 5) == [1] and ids(2, 9) == [5]


def test_latest_versions_and_their_ties(spark):
    c = spark.createDataFrame([(1, 0, 7, 2, 4, 0), (1, 0, 7, 3, 4, 1), (1, 0, 7, 3, 1, 2), (1, 0, 8, None, 4, 3), (2, 0, 7, 1, 4, 4)], "seq long, elem_type int, id long, version long, changetype int, pos long")
    assert sorted((r["seq"], r["id"], r["pos"]) for r in update.latest(c).collect()) == [(1, 7, 1), (1, 8, 3), (2, 7, 4)]


def test_actions(spark):
    a, b, deep = (1 << 61) + 1, (2 << 61) + 1, (1 << 61) + (1 << 59) + 2
    t = spark.createDataFrame([(0,), (a,), (b,)], "tile long")
    before = spark.createDataFrame([(0, 1, deep, a), (0, 2, deep, a), (1, 3, deep, a), (0, 4, a, a), (0, 8, deep, a)], "elem_type int, id long, quadtree long, tile long")
    change = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (1, 3, 4), (0, 4, 1), (0, 5, 1), (0, 6, 5), (0, 8, 5), (0, 9, 4)], "elem_type int, id long, changetype int")
    cells = spark.createDataFrame([(0, 1, deep), (0, 2, b), (1, 3, b), (0, 6, deep), (0, 8, b)], "elem_type int, id long, quadtree long")
    out = {(r["id"], r["tile"], r["changetype"], r["action"]) for r in update.actions(change, before, cells, t).collect()}
    assert out == {(1, None, 0, "unneeded"), (2, 0, 3, "kept"), (2, a, 2, "removed"), (3, b, 4, "kept"), (3, a, 2, "removed"), (4, a, 1, "deleted"), (5, None, 1, "create_delete"), (6, a, 5, "kept"), (8, None, 5, "ignored"), (9, None, 4, "ignored")}


def test_differences(spark):
    s = "elem_type int, id long, version long, tags array<struct<key:string,val:string>>, data string, quadtree long, user string"
    t = [("a", "1"), ("b", "2")]
    left = spark.createDataFrame([(0, 1, 1, t, "x", 0, "u"), (0, 2, 1, t, "x", 0, "u"), (0, 3, 1, t, "x", 0, "u"), (0, 4, None, None, "x", 0, "u")], s)
    right = spark.createDataFrame([(0, 1, 1, t[::-1], "x", 0, "v"), (0, 2, 2, [], "x", 0, "u"), (0, 5, 1, t, "x", 0, "u"), (0, 4, None, [], "y", 1, "u")], s)
    c = diff.compare(left, right)
    assert dict((r["id"], r["kind"]) for r in c.collect()) == {1: "ChangedUserName", 2: "DifferentInfo", 3: "OnlyLeft", 4: "DifferentData", 5: "OnlyRight"}
    assert [tuple(r) for r in diff.renamed_users(c).collect()] == [("u", "v")]
    import json

    lines = {r["id"]: json.loads(r["line"]) for r in diff.lines(left, right, c).collect()}
    assert set(lines) == {2, 3, 4, 5} and lines[3]["OnlyLeft"]["tags"] == [{"key": "a", "val": "1"}, {"key": "b", "val": "2"}] and lines[5]["OnlyRight"]["id"] == 5
    assert [x["version"] for x in lines[2]["DifferentInfo"]] == [1, 2] and [x["data"] for x in lines[4]["DifferentData"]] == ["x", "y"]
    assert diff.report(c, 2).count() == 2 and diff.counts(c).agg(F.sum("n")).first()[0] == 5


def test_empty_summaries_show_minus_one(spark):
    n = spark.createDataFrame([], "id long, timestamp long, lon int, lat int")
    assert summary.nodes(n).first()["min_id"] == -1 and summary.nodes(n).first()["count"] == 0


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("elem_type"), F.col("id"))
    got = [(r["elem_type"], r["id"]) for r in order.numbered(df, ["elem_type", "id"]).orderBy("n").collect()]
    assert got == sorted(got) and order.blocks(df, 100).select("block").distinct().count() == 10


ROWS = [
    (0, 5, 0, 3, 9, 1000, 7, "me", [("a", "b"), ("a", "c")], 123, -456, None, None, 77, 3),
    (0, -6, 0, 1, 9, 1001, 7, "you", [], -1799999999, 899999999, None, None, -2, 3),
    (1, 8, 0, None, None, None, None, None, [("k", "v")], None, None, [5, -6, 5], None, 77, 3),
    (1, 9, 0, 2, 3, 4, 5, "é", [], None, None, [], None, None, 3),
    (2, 1, 0, 1, 1, 1, 1, "x", [], None, None, None, [("outer", 1, 8), ("", 2, 1)], 0, 3),
]


@pytest.mark.parametrize("compression", ["none", "zlib", "lzma"])
def test_pbf_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame(ROWS, pbf.SCHEMA).coalesce(1)
    assert pbf.write(df, str(tmp_path), 2, compression) == 3
    (name,) = [f for f in os.listdir(tmp_path) if f.endswith(".pbf")]
    back = pbf.read(spark, f"{tmp_path}/{name}", partition_bytes=1)
    assert sorted(back.collect(), key=lambda r: (r["elem_type"], r["id"])) == sorted(df.collect(), key=lambda r: (r["elem_type"], r["id"]))
    assert back.where("elem_type = 1").count() == 2


def test_headers_and_indexes(spark, tmp_path):
    import json

    rows = [(0, k, 0, 1, 1, 1, 1, "u", [("k", "v")], k, k, None, None, None, k // 10) for k in range(1, 60)]
    df = spark.createDataFrame(rows, pbf.SCHEMA).coalesce(1)
    assert pbf.write(df, str(tmp_path), 100, bbox=pbf.PLANET, state=7, timestamp=1000, url="https://x/", sorted_=True) == 6
    (name,) = [f"{tmp_path}/{f}" for f in os.listdir(tmp_path) if f.endswith(".pbf")]
    head = pbf.read_header(name)
    assert (head["bbox"], head["state"], head["timestamp"], head["url"], head["writer"], head["optional"]) == (pbf.PLANET, 7, 1000, "https://x/", "geostrata", ["Sort.Type_then_ID"])
    with open(name, "rb") as f:
        at = [(p, s + n - p) for p, kind, s, n in pbf.frames(f) if kind == "OSMData"]
    assert [(t, p, n) for t, p, n, _ in head["index"]] == [(k, *x) for k, x in enumerate(at)] and not any(x[3] for x in head["index"])
    back = pbf.read(spark, name, partition_bytes=1)
    assert back.where("tile in (1, 4)").count() == 20 and back.where("tile = 2").rdd.getNumPartitions() == 1 and back.where("id in (3, 44)").count() == 2
    few = pbf.read(spark, name, columns=["refs"]).first()
    assert few["tags"] == [] and few["user"] is None and few["lon"] == few["id"]
    reader = pbf.PbfReader({"path": name, "partitionbytes": "1"})
    list(reader.pushFilters([pbf.In(("tile",), (1, 4))]))
    assert [p.spans for p in reader.partitions()] == [[(s, n)] for k, (s, n) in enumerate([(s, n) for p, kind, s, n in pbf.frames(open(name, "rb")) if kind == "OSMData"]) if k in (1, 4)]
    with open(f"{name}-filelocs.json", "w") as f:
        json.dump([[5, 100, 20]], f)
    assert pbf.parse_header(pbf.message(23, b"-filelocs.json"), 0, name)["index"] == [(5, 100, 20, False)]
    old = pbf.message(22, pbf.message(1, pbf.number(1, 1) + pbf.number(2, 0) + pbf.number(3, 1)) + pbf.number(3, pbf.zigzag(9)))
    assert pbf.parse_header(old, 50)["index"] == [((1 << 61) + 1, 50, 9, False)]
    with pytest.raises(pbf.PbfError):
        pbf.parse_header(pbf.number(77, 1))


def test_files_of_cells(spark, tmp_path):
    df = spark.createDataFrame([(0, 5, 77), (0, 6, -2), (1, 5, 0), (2, 9, 1 << 61)], "elem_type int, id long, quadtree long").coalesce(1)
    assert pbf.write(df, str(tmp_path)) == 1
    (name,) = [f"{tmp_path}/{f}" for f in os.listdir(tmp_path) if f.endswith(".pbf")]
    assert sorted(map(tuple, pbf.read(spark, name, cells=True).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(pbf.PbfError):
        pbf.decode_cells(pbf.message(2, pbf.message(3, pbf.number(1, 5))))


def test_pbf_refuses_what_it_cannot_read():
    with pytest.raises(pbf.PbfError, match="brotli"):
        pbf.unblob(pbf.message(8, b"x"))
    with pytest.raises(pbf.PbfError):
        pbf.decode(pbf.number(17, 1000))
    assert [r[1] for r in pbf.decode(pbf.encode([{"elem_type": 0, "id": 4, "lon": 0, "lat": 0, "changetype": 4}, {"elem_type": 0, "id": 5, "lon": 0, "lat": 0, "changetype": 1}], as_change=True), ids={5})] == [5]


OSC = """<osmChange version="0.6"><create><node id="1" version="1" timestamp="2024-01-01T00:00:00Z" uid="3" user="u" changeset="4" lon="1.5" lat="-2"><tag k="a" v="b"/></node></create>
<modify><way id="2" version="2" timestamp="2024-01-01T00:00:01Z"><nd ref="1"/><nd ref="5"/></way></modify>
<modify><relation id="3" version="3"><member type="way" ref="2" role="r"/><tag k="t" v="u"/><tag k="v" v="w"/></relation></modify><delete><node id="9" version="4" lon="0" lat="0"/></delete></osmChange>"""


@pytest.mark.parametrize("packed", [False, True])
def test_change_files(spark, tmp_path, packed):
    path = f"{tmp_path}/x.osc" + ".gz" * packed
    with (gzip.open if packed else open)(path, "wt") as f:
        f.write(OSC)
    out = {(r["elem_type"], r["id"]): r for r in osc.read(spark, path).collect()}
    assert {k: r["changetype"] for k, r in out.items()} == {(0, 1): 5, (1, 2): 4, (2, 3): 4, (0, 9): 1}
    assert (out[0, 1]["lon"], out[0, 1]["lat"], out[0, 1]["timestamp"], out[0, 1]["user"]) == (15000000, -20000000, 1704067200, "u")
    assert out[1, 2]["refs"] == [1, 5] and out[2, 3]["members"][0].asDict() == {"role": "r", "mem_type": 1, "mem_ref": 2} and len(out[2, 3]["tags"]) == 2


@pytest.mark.parametrize("odd", ["<node id='1' colour='x'/>", "<node id='1'><nd ref='2'/></node>", "<area id='1'/>", "<node id='1'>text</node>", "<relation id='1'><member type='area' ref='1' role=''/></relation>", "<way id='1'><nd/></way>", "<node/>", "<node id='1'><tag k='x'/></node>"])
def test_change_files_with_unknown_parts_are_errors(odd):
    with pytest.raises(osc.OscError):
        osc.check(f"<osmChange><create>{odd}</create></osmChange>".encode())
    assert osc.check(OSC.encode()) == 4 == osc.check(gzip.compress(OSC.encode()))


def test_replication(tmp_path):
    times = {k: f"2024-01-{k:02d}T00:00:00Z" for k in range(1, 10)}
    said = lambda k: f"sequenceNumber={k}\ntimestamp={times[k]}\n".replace(":", "\\:").encode()
    pages = {"p/state.txt": said(9)} | {"p/" + files.diff_name(k, ".state.txt"): said(k) for k in times} | {"p/" + files.diff_name(k): b"data%d" % k for k in times}
    assert files.diff_name(1234567) == "001/234/567.osc.gz"
    assert [s for s, _ in files.download("p/", str(tmp_path), 6, pages.__getitem__)] == [7, 8, 9]
    assert (tmp_path / "8.osc.gz").read_bytes() == b"data8" and (tmp_path / "state.csv").read_text().splitlines()[0] == "7,2024-01-07T00-00-00"
    assert sorted(os.listdir(tmp_path)) == ["7.osc.gz", "8.osc.gz", "9.osc.gz", "state.csv"] and files.download("p/", str(tmp_path), 9, pages.__getitem__) == []
    assert [files.find_initial("p/", t, pages.__getitem__) for t in ("2024-01-03T12:00:00", "2024-01-04T00:00:00Z", "2023-01-01T00:00:00", "2025-01-01T00:00:00")] == [3, 4, 0, 9]


def test_the_log_is_applied_in_order(spark, tmp_path):
    m = files.Manifest([{"Filename": "base", "EndDate": "2024-01-01T00:00:00", "NumTiles": 1, "State": 0}])
    seen = []
    plan = lambda s: seen.append(s) or 1
    assert updates.apply_pending([3, 1, 2, 0], m, plan, str, most=2) == [1, 2] and m.last_state == 2
    assert updates.apply_pending([1, 3], m, plan, str, demo=True) == [3] and m.last_state == 2
    m.drop_last()
    assert m.last_state == 1 and seen == [1, 2, 3]
    saved = []

    def failing(state):
        if state == 4:
            raise RuntimeError("state 4")
        return 1

    with pytest.raises(RuntimeError):
        updates.apply_pending([2, 3, 4], m, failing, str, save=lambda x: saved.append(x.last_state))
    assert saved == [2, 3]
    m.drop_last(2)
    m.save(f"{tmp_path}/f.json")
    assert files.Manifest.load(f"{tmp_path}/f.json") == m
    s = files.Settings(MaxQtLevel=17)
    s.save(f"{tmp_path}/s.json")
    assert files.Settings.load(f"{tmp_path}/s.json") == s
    assert files.parse_state("#x\nsequenceNumber=42\ntimestamp=2024-01-01T00\\:00\\:00Z\n") == (42, "2024-01-01T00:00:00Z")
    with open(f"{tmp_path}/state.csv", "w") as f:
        f.write("1,2024-01-01T00-00-00\n2,2024-01-02T00-00-00\n")
    states = files.read_states(spark, f"{tmp_path}/state.csv")
    assert update.pending(states, 1).first()["state"] == 2 and tuple(update.initial_state(states, 1704070000).first()) == (1, 1704067200)


def test_streams_give_the_same_as_batches(spark, tmp_path):
    for k, rows in enumerate([[(1, 0, 7, 4, 2, 5, 0), (1, 0, 7, 4, 3, 6, 1)], [(2, 0, 7, 1, 4, 7, 0), (2, 0, 8, 5, 1, 8, 1)]]):
        spark.createDataFrame(rows, updates.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        updates.stream_latest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    base = spark.createDataFrame([(0, 7, 0, 1, 1), (0, 9, 0, 1, 1)], "elem_type int, id long, changetype int, version long, timestamp long")
    assert {r["id"] for r in updates.current(spark, f"{tmp_path}/out", base).collect()} == {8, 9}


def test_files_of_a_state_may_come_in_many_batches(spark, tmp_path):
    """Each file is a batch of its own; the state of all elements is that of all rows at once, also after a replay."""
    import random
    import shutil

    rng = random.Random(3)
    rows = [(rng.randint(1, 3), 0, rng.randrange(12), rng.choice([1, 4, 5]), rng.randint(1, 6), k, k) for k in range(60)]
    for k in range(6):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], updates.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        updates.stream_latest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", 1).awaitTermination(60)
    base = spark.createDataFrame([(0, k, 0, 1, 1) for k in range(15)], "elem_type int, id long, changetype int, version long, timestamp long")
    whole = update.latest(spark.createDataFrame(rows, updates.SCHEMA)).select("elem_type", "id", "changetype", "version", "timestamp", "seq")
    want = sorted(map(tuple, merge.apply_changes(base.withColumn("seq", F.lit(0).cast("long")), whole, ["elem_type", "id"]).collect()))
    now = lambda: sorted(map(tuple, updates.current(spark, f"{tmp_path}/out", base).collect()))
    assert now() == want and len(os.listdir(f"{tmp_path}/out")) == 6
    last = sorted(os.listdir(f"{tmp_path}/check/commits"))[-1]
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{tmp_path}/check/commits/{name}"):
            os.remove(f"{tmp_path}/check/commits/{name}")
    shutil.rmtree(f"{tmp_path}/out/batch=5")
    updates.stream_latest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", 1).awaitTermination(60)
    assert now() == want


def test_root_is_an_ancestor_of_all(spark):
    assert spark.range(1).select(q.is_parent(F.lit(0).cast("long"), F.lit((3 << 61) + 1))).first()[0]
