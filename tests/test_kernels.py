"""Cells against a plain walk, properties of common ancestors, polygons, times, greedy packing."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geostrata.functions import quadtree as q
from geostrata.functions import text
from geostrata.operators import extract, tiles
from geostrata.sources import files


def walk(box, level=18, buffer=0.05):
    """Both axes together, quadrant by quadrant."""
    x0, y0, x1, y1 = (v * 0.0000001 for v in box)
    if x0 > x1 or y0 > y1:
        return -1
    x1, y1 = (x1 + 1e-7 if x0 == x1 else x1), (y1 + 1e-7 if y0 == y1 else y1)
    m = lambda y: math.log(math.tan(math.pi * (1 + y / 90.0) / 4.0)) / math.pi
    a, b, c, d = x0 / 180.0, x1 / 180.0, m(y0), m(y1)
    out = 0
    for k in range(level):
        if min(a, c) < -1 - buffer or max(b, d) > 1 + buffer:
            break
        west, east = b < buffer and abs(b) < abs(a), a > -buffer and abs(b) >= abs(a)
        south, north = d < buffer and abs(d) < abs(c), c > -buffer and abs(d) >= abs(c)
        if b <= 0 or a >= 0:
            west, east = b <= 0, a >= 0
        if d <= 0 or c >= 0:
            south, north = d <= 0 and not c >= 0, c >= 0
        if not ((west or east) and (south or north)):
            break
        quad = (0 if west else 1) + (0 if north else 2)
        a, b = (2 * (v + (0.5 if west else -0.5)) for v in (a, b))
        c, d = (2 * (v + (-0.5 if north else 0.5)) for v in (c, d))
        out += (quad << (61 - 2 * k)) + 1
    return out


def boxes(n):
    rng = random.Random(4)
    out = [(0, 0, 0, 0), (-10, -10, 10, 10), (1, 0, 0, 0), (-1800000000, -850000000, 1800000000, 850000000), (1799999999, 0, 1800000000, 1), (-5, 100, 90000000, 200), (0, -100, 100, 0)]
    for _ in range(n):
        x, y = rng.randint(-1790000000, 1790000000), rng.randint(-840000000, 840000000)
        w = 10 ** rng.randint(0, 9)
        out.append((x, y, min(x + rng.randint(0, w), 1800000000), min(y + rng.randint(0, w), 850000000)))
    return out


@pytest.mark.parametrize("level", [0, 5, 18])
def test_cells_of_boxes(spark, level):
    b = boxes(500)
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(b)], "k int, a int, b int, c int, d int")
    got = dict(df.select("k", q.calculate("a", "b", "c", "d", level)).collect())
    assert got == {k: walk(x, level) for k, x in enumerate(b)}


def test_cells_take_no_steps_by_level(spark):
    """Edges, middles and what sticks out of them, by 18 steps and without them. Only intervals without an order are walked."""
    rng, ends = random.Random(3), [None, float("nan"), 1.06, 1.05, -1.05, 0.0, -0.0, 5e-324, -1e-17]
    for k in range(30):
        at = rng.randint(-(2**k), 2**k) / 2**k
        ends += [at, at + 2e-12 * 7 ** rng.randint(0, 12), at - 2e-12 * 7 ** rng.randint(0, 12), rng.uniform(-1, 1)]
    df = spark.createDataFrame([(a, b) for a in ends for b in (a, *rng.sample(ends, 40), *((a + d for d in (1e-9, 1e-5, 0.01, 0.3)) if a is not None else ()))], "a double, b double")
    for level, buffer in ((18, 0.05), (20, 0.0), (1, 0.05), (2, 0.3)):
        both = df.select("a", "b", q._axis(F.col("a"), F.col("b"), level, buffer).alias("x"), q._walked(F.col("a"), F.col("b"), level, buffer).alias("y"))
        assert both.where("not (x <=> y)").collect() == []


def cut(qt, n):
    return qt if (qt & 31) <= n else ((qt >> (63 - 2 * n)) << (63 - 2 * n)) + n if n else 0


def fold(a, b):
    if a < 0 or b < 0 or a == b:
        return b if a < 0 else a
    n = min(a & 31, b & 31)
    while cut(a, n) != cut(b, n):
        n -= 1
    return cut(a, n)


def cells(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        d = rng.randint(0, 20)
        stem = rng.choice([0, 1, 2]) << 58
        out.append(((stem | rng.getrandbits(2 * d) << (63 - 2 * d)) >> (63 - 2 * d) << (63 - 2 * d) if d else 0) + d)
    return out + [-1, -2]


def test_common_ancestors(spark):
    rng = random.Random(1)
    own = cells(400, 2)
    groups = {g: [rng.choice(own) for _ in range(rng.randint(1, 5))] for g in range(300)}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g int, qt long")
    want = {}
    for g, xs in groups.items():
        live = [x for x in xs if x >= 0]
        out = live[0] if live else -2
        for x in live:
            out = fold(out, x)
        want[g] = out
    assert dict(df.groupBy("g").agg(q.common_agg("qt")).collect()) == want
    pairs = spark.createDataFrame([(k, rng.choice(own), rng.choice(own)) for k in range(400)], "k int, a long, b long")
    for r in pairs.select("k", "a", "b", q.common("a", "b").alias("c"), q.is_parent("a", "b").alias("p")).collect():
        assert r["c"] == fold(r["a"], r["b"])


def test_keys_go_to_numbers_and_back(spark):
    own = [x for x in cells(300, 3) if x >= 0]
    df = spark.createDataFrame([(x,) for x in own], "qt long").withColumn("t", q.as_xyz("qt")).withColumn("b", q.cell_bbox("qt"))
    for r in df.select("qt", q.from_xyz("t.x", "t.y", "t.z").alias("back"), q.as_letters("qt").alias("s"), q.round_to("qt", 3).alias("r"), F.size(q.ancestors("qt")).alias("n"), "b.*").collect():
        assert r["back"] == r["qt"] and len(r["s"]) == r["qt"] & 31 and r["r"] == cut(r["qt"], 3) and r["n"] == (r["qt"] & 31) + 1
        assert r["minlon"] < r["maxlon"] and r["minlat"] < r["maxlat"]
    one = spark.range(1).select(q.from_xyz(F.lit(1), F.lit(1), F.lit(21)).alias("deep"), q.as_letters(F.lit(-2)).alias("none"), q.as_letters(F.lit(0)).alias("root")).first()
    assert tuple(one) == (-2, "NULL", "")


def test_units_saturate_and_round_away_from_zero(spark):
    df = spark.createDataFrame([(0.00000005,), (-0.00000005,), (1000.0,), (-1000.0,), (0.0,)], "v double")
    assert [r[0] for r in df.select(q.as_integer("v")).collect()] == [1, -1, 2147483647, -2147483648, 0]


def ray(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_polygons(spark):
    ring = [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (0.0, 0.0), (-5.0, 5.0)]
    rng = random.Random(5)
    points = [(rng.randint(-70000000, 70000000), rng.randint(-70000000, 70000000)) for _ in range(500)] + [(0, 0), (50000000, 50000000)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, lon int, lat int")
    got = dict(df.select("k", extract.in_polygon("lon", "lat", ring)).collect())
    assert got == {k: ray(x * 0.0000001, y * 0.0000001, ring) for k, (x, y) in enumerate(points)}
    # All corners lie inside, yet the notch cuts the box: the corner test is only a test of corners.
    box = q.literal_bbox((-45000000, -45000000, 45000000, 40000000))
    assert spark.range(1).select(extract.corners_in_polygon(box, ring)).first()[0] and not ray(0.0, 3.0, ring)


def test_times(spark):
    df = spark.createDataFrame([("2024-02-29T12:34:56",), ("2024-02-29T12:34:56Z",), ("2024-02-29T12-34-56",), ("20240229",), ("yesterday",)], "s string")
    assert [r[0] for r in df.select(text.parse_timestamp(F.col("s"))).collect()] == [1709210096] * 3 + [1709164800, None]
    r = spark.range(1).select(text.timestamp_string(F.lit(1709210096)), text.timestamp_string(F.lit(1709210096), "-"), text.date_string(F.lit(1709210096)), text.diff_url("p/", F.lit(1234567)), text.state_url("p/", F.lit(None).cast("long"))).first()
    assert tuple(r) == ("2024-02-29T12:34:56", "2024-02-29T12-34-56", "20240229", "p/001/234/567.osc.gz", "p/state.txt")


def test_filters():
    assert files.parse_filter("1,2,3,4") == ((1, 2, 3, 4), None)
    assert files.parse_filter("-0.5,51,0,52")[0] == (-5000000, 510000000, 0, 520000000)
    assert files.parse_filter("tile:0,0,0")[0][::2] == (-1800000000, 1800000000)
    box, ring = files.parse_filter("name\n1\n 0 0\n 1 0\n 1 2\nEND\nEND\n")
    assert box == (0, 0, 10000000, 20000000) and len(ring) == 3
    with pytest.raises(ValueError):
        files.parse_filter("1,2,3")


def slow_greedy(weights, target, least):
    """Round by round, widening by 50, from the top of the tree."""
    total, weight = {}, {}
    for t, w in weights.items():
        weight[t] = w
        for n in range((t & 31) + 1):
            total[cut(t, n)] = total.get(cut(t, n), 0) + w
    low, high, out = target - 50, target + 50, {}
    inside = lambda a, b: (b & 31) >= (a & 31) and cut(b, a & 31) == a
    while total.get(0, 0) > 0:
        if total[0] < low:
            out[0] = out.get(0, 0) + total[0]
            break
        found = []
        for t in sorted(total):
            if total[t] < low or not weight.get(t) or any(inside(f, t) for f in found):
                continue
            below = [total[c] for c in total if (c & 31) == (t & 31) + 1 and inside(t, c)]
            if total[t] <= high or total[t] == weight[t] or all(x <= least for x in below):
                found.append(t)
        if not found:
            if high > 10 * sum(weights.values()):
                out[0] = out.get(0, 0) + total[0]
                break
            low, high = max(least, low - 50), high + 50
        for t in found:
            out[t] = out.get(t, 0) + total[t]
            gone = total[t]
            for n in range(t & 31):
                total[cut(t, n)] -= gone
            for c in [c for c in total if inside(t, c)]:
                del total[c]
                weight.pop(c, None)
    return {t: w for t, w in out.items() if w}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.sampled_from([(200, 100), (500, 100), (1000, 500), (300, 50)]))
def test_greedy_packing(seed, n, sizes):
    rng = random.Random(seed)
    weights = {}
    for _ in range(n):
        d = rng.randint(0, 6)
        t = (rng.getrandbits(2 * d) << (63 - 2 * d) if d else 0) + d
        weights[t] = weights.get(t, 0) + rng.randint(1, 400)
    total = {}
    for t, w in weights.items():
        for k in range((t & 31) + 1):
            total[cut(t, k)] = total.get(cut(t, k), 0) + w
    target, least = sizes
    own = sorted(t for t in total if total[t] >= least)
    got = tiles.greedy(np.array(own, np.int64), np.array([weights.get(t, 0) for t in own], np.int64), np.array([total[t] for t in own], np.int64), sum(weights.values()), target, least)
    assert sum(got.values()) == sum(weights.values())
    assert {t: w for t, w in got.items() if w} == slow_greedy(weights, target, least)
