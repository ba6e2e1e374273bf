"""Quadtree keys as column expressions: a cell is a BIGINT with two bits a level from bit 62 down and its depth in the
low five bits. Negative keys mean no value. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY, INVALID = -2, -1
MAX_DEPTH = 20
ELEMENT_LEVEL, GROUP_LEVEL, BUFFER = 18, 17, 0.05
#: Fixed value: half of the circumference that web-mercator tiles use, in metres.
EARTH_WIDTH = 20037508.342789244


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _left(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n.cast("int"))


def _right(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a, n.cast("int"))


# --- coordinates -----------------------------------------------------------------------------------------------------
def as_integer(degrees) -> Column:
    """Degrees to units of 1e-7 degrees, halves away from zero; beyond what an INT holds, its ends."""
    v = _c(degrees)
    units = v * F.lit(1e7) + F.when(v > 0, 0.5).otherwise(-0.5)
    return F.greatest(F.least(units, F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int")


def as_degrees(units) -> Column:
    return _c(units).cast("double") * F.lit(0.0000001)


def mercator(latitude, scale: float = 1.0) -> Column:
    return F.ln(F.tan(F.pi() * (1 + _c(latitude) / 90.0) / 4.0)) * F.lit(scale) / F.pi()


def inverse_mercator(y, scale: float = 1.0) -> Column:
    return (F.atan(F.exp(_c(y) * F.pi() / F.lit(scale))) * 4.0 / F.pi() - 1.0) * 90.0


def metres_per_pixel(zoom) -> Column:
    return F.lit(2.0 * EARTH_WIDTH / 256.0) / F.pow(F.lit(2.0), _c(zoom).cast("double"))


def tile_bbox(x, y, z, buffer: float = 0.0, legacy: bool = False) -> Column:
    """Box of a web-mercator tile, widened on all sides by a share of its size; legacy: 2 + buffer tiles from x - buffer."""
    size = metres_per_pixel(z) * 256.0
    span = size * ((2.0 + buffer) if legacy else (1.0 + 2 * buffer))
    west, north = (_c(x) - buffer) * size - EARTH_WIDTH, F.lit(EARTH_WIDTH) - (_c(y) - buffer) * size
    lon = lambda m: as_integer(m * 180.0 / F.lit(EARTH_WIDTH))
    lat = lambda m: as_integer(inverse_mercator(m, EARTH_WIDTH))
    return bbox(lon(west), lat(north - span), lon(west + span), lat(north))


# --- boxes -----------------------------------------------------------------------------------------------------------
def bbox(minlon, minlat, maxlon, maxlat) -> Column:
    return F.struct(*[_c(v).cast("int").alias(n) for n, v in zip(("minlon", "minlat", "maxlon", "maxlat"), (minlon, minlat, maxlon, maxlat), strict=True)])


def literal_bbox(box: tuple[int, int, int, int]) -> Column:
    return bbox(*map(F.lit, box))


def contains(a: Column, b: Column) -> Column:
    return (a["minlon"] <= b["minlon"]) & (a["minlat"] <= b["minlat"]) & (a["maxlon"] >= b["maxlon"]) & (a["maxlat"] >= b["maxlat"])


def contains_point(a: Column, lon, lat) -> Column:
    return _c(lon).between(a["minlon"], a["maxlon"]) & _c(lat).between(a["minlat"], a["maxlat"])


def overlaps(a: Column, b: Column) -> Column:
    """Boxes that touch overlap."""
    return (a["minlon"] <= b["maxlon"]) & (a["maxlon"] >= b["minlon"]) & (a["minlat"] <= b["maxlat"]) & (a["maxlat"] >= b["minlat"])


# --- keys ------------------------------------------------------------------------------------------------------------
def depth(qt) -> Column:
    return _c(qt).bitwiseAND(F.lit(31).cast("long")).cast("int")


def is_empty(qt) -> Column:
    return _c(qt) < 0


def quad(qt, level) -> Column:
    """The quad at a level, from 0; null for no value."""
    return F.when(_c(qt) >= 0, _right(_c(qt), 61 - 2 * _c(level)).bitwiseAND(F.lit(3).cast("long")).cast("int"))


def _cut(qt: Column, level: Column) -> Column:
    bits = F.lit(63) - 2 * level
    return _left(_right(qt, bits), bits) + level.cast("long")


def round_to(qt, level) -> Column:
    """The ancestor at a level; the cell itself if it isn't deeper. No value stays."""
    q, n = _c(qt), _c(level)
    return F.when((q < 0) | (depth(q) <= n), q).otherwise(_cut(q, n))


def as_letters(qt) -> Column:
    """A, B, C, D for north-west, north-east, south-west, south-east; NULL (as text) for no value."""
    q = _c(qt)
    n = F.least(depth(q), F.lit(MAX_DEPTH))
    digits = F.lpad(F.conv(_right(q, 63 - 2 * n).cast("string"), 10, 4), n, F.lit("0"))
    return F.when(q < 0, F.lit("NULL")).otherwise(F.translate(digits, "0123", "ABCD"))


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it: the element of an array of one."""
    return F.get(F.transform(F.array(value), use), 0)


def _folded(shifted, shift: int, mask: int):
    return lambda x: x.bitwiseOR(shifted(x, shift)).bitwiseAND(F.lit(mask))


def _spread(v: Column) -> Column:
    """A zero bit between each two bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = let(v, _folded(F.shiftleft, shift, mask))
    return v


def _gather(v: Column) -> Column:
    """The even bits, next to each other."""
    v = v.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = let(v, _folded(F.shiftright, shift, mask))
    return v


def from_xyz(x, y, z) -> Column:
    """The key of column x, row y (from the north) of level z; empty beyond MAX_DEPTH."""
    n = _c(z).cast("int")
    path = _spread(_c(x).cast("long")).bitwiseOR(F.shiftleft(_spread(_c(y).cast("long")), 1))
    return F.when(n > MAX_DEPTH, F.lit(EMPTY).cast("long")).when(n == 0, F.lit(0).cast("long")).otherwise(_left(path, 63 - 2 * n) + n.cast("long"))


def as_xyz(qt) -> Column:
    """struct x, y, z; null for no value."""
    q = _c(qt)
    n = depth(q)
    path = F.when(n == 0, F.lit(0).cast("long")).otherwise(_right(q, 63 - 2 * n))
    return F.when(q >= 0, F.struct(_gather(path).cast("int").alias("x"), _gather(F.shiftright(path, 1)).cast("int").alias("y"), n.alias("z")))


def cell_bbox(qt, buffer: float = 0.0) -> Column:
    """The cell's box, widened by a share of its size. Cell edges are exact in binary, so they need no loop."""
    return let(as_xyz(qt), lambda xyz: _cell_bbox(xyz, buffer))


def _cell_bbox(xyz: Column, buffer: float) -> Column:
    cells = F.pow(F.lit(2.0), xyz["z"].cast("double"))
    west, wide = F.lit(-180.0) + F.lit(360.0) * xyz["x"] / cells, F.lit(360.0) / cells
    top, high = F.lit(90.0) - F.lit(180.0) * xyz["y"] / cells, F.lit(180.0) / cells
    north, south = inverse_mercator(top, 90.0), inverse_mercator(top - high, 90.0)
    edges = F.struct(west.alias("w"), south.alias("s"), (west + wide).alias("e"), north.alias("n"))

    def widened(b: Column) -> Column:
        dx, dy = (b["e"] - b["w"]) * buffer, (b["n"] - b["s"]) * buffer
        return bbox(as_integer(b["w"] - dx), as_integer(b["s"] - dy), as_integer(b["e"] + dx), as_integer(b["n"] + dy))

    return let(edges, widened)


def is_parent(a, b) -> Column:
    """Whether one of two cells lies in the other, whichever it is."""
    p, q = _c(a), _c(b)
    return F.when(depth(p) <= depth(q), p == round_to(q, depth(p))).otherwise(q == round_to(p, depth(q)))


def _common(low: Column, high: Column, shallowest: Column) -> Column:
    """Keys ascend by path, so all keys between low and high begin as those two do; the shallowest bounds the depth."""
    differ = F.shiftleft(F.shiftright(low.bitwiseXOR(high), 5), 5)
    same = F.when(differ == 0, F.lit(MAX_DEPTH)).otherwise(F.floor((63 - F.length(F.bin(differ))) / 2).cast("int"))
    level = F.least(shallowest.cast("int"), same)
    return F.when(level == 0, F.lit(0).cast("long")).otherwise(_cut(low, level))


def common(a, b) -> Column:
    """The deepest cell that holds both; of no value and a cell, the cell."""
    p, q = _c(a), _c(b)
    return F.when(p < 0, q).when(q < 0, p).when(p == q, p).otherwise(_common(F.least(p, q), F.greatest(p, q), F.least(depth(p), depth(q))))


def common_agg(qt) -> Column:
    """Aggregate: the deepest cell that holds all, leaving out negatives; empty if none. Three built-in partial aggregates, combined before the shuffle."""
    q = F.when(_c(qt) >= 0, _c(qt))
    return F.coalesce(_common(F.min(q), F.max(q), F.min(depth(q))), F.lit(EMPTY).cast("long"))


def calculate(minlon, minlat, maxlon, maxlat, level: int = ELEMENT_LEVEL, buffer: float = BUFFER) -> Column:
    """The deepest cell down to level that holds a box (units of 1e-7 degrees) but for a share buffer of it; -1 if a minimum is above its maximum."""
    x0, y0, x1, y1 = map(as_degrees, (minlon, minlat, maxlon, maxlat))
    x2, y2 = F.when(x0 == x1, x1 + 0.0000001).otherwise(x1), F.when(y0 == y1, y1 + 0.0000001).otherwise(y1)
    four = F.struct((x0 / 180.0).alias("a"), (x2 / 180.0).alias("b"), mercator(y0).alias("c"), mercator(y2).alias("d"))
    return F.when((x0 > x1) | (y0 > y1), F.lit(INVALID).cast("long")).otherwise(let(four, lambda v: _down(v, level, buffer)))


def _side(a: Column, b: Column, buffer: float) -> Column:
    """Which half of a cell from -1 to 1 holds an interval but for a share buffer: 0 the lower, 1 the upper, -1 neither."""
    out = (a < -1.0 - buffer) | (b > 1.0 + buffer)
    lower = (b <= 0) | ((b < buffer) & (F.abs(b) < F.abs(a)))
    upper = (a >= 0) | ((a > -buffer) & (F.abs(b) >= F.abs(a)))
    return F.when(out, -1).when(lower, 0).when(upper, 1).otherwise(-1)


def _walked(low: Column, high: Column, level: int, buffer: float) -> Column:
    """struct path, n: the halves that an interval goes down by, one level after another."""

    def state(a: Column, b: Column, path: Column, n: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), _side(a, b, buffer).alias("h"), path.alias("path"), n.alias("n"))

    def step(s: Column, _: Column) -> Column:
        shift = F.lit(0.5) - s["h"]
        return F.when(s["h"] < 0, s).otherwise(state(2 * (s["a"] + shift), 2 * (s["b"] + shift), 2 * s["path"] + s["h"], s["n"] + 1))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(level)), state(low, high, F.lit(0).cast("long"), F.lit(0)), step)
    return let(end, lambda s: _path(s["path"], s["n"]))


def _path(path: Column, n: Column) -> Column:
    return F.struct(path.cast("long").alias("path"), n.cast("int").alias("n"))


def _axis(low: Column, high: Column, level: int, buffer: float) -> Column:
    """What _walked gives, without its steps.

    The first step may round; from then on all of the walk's values are exact. So the ends' numbers among the smallest
    halves give the level at which a middle first parts them. There one more step tells whether the walk ends, or goes
    along the edge that the interval sticks out of: below by upper halves only, or by lower ones only, while both ends
    are in bounds, and both move away from that edge by twice as much a level. What has no order (null or NaN) is walked.
    """
    if not level:
        return _path(F.lit(0), F.lit(0))
    ends = 2.0 ** (level - 2)  # half of the number of smallest halves in a half

    def number(x: Column) -> Column:
        return F.floor(x * F.lit(ends)) + F.lit(int(ends)).cast("long") if level > 1 else F.lit(0).cast("long")

    def stepped(a: Column, b: Column, h: Column) -> tuple[Column, Column]:
        shift = F.lit(0.5) - h
        return 2 * (a + shift), 2 * (b + shift)

    def state(a: Column, b: Column, path: Column, n: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), path.cast("long").alias("path"), n.cast("int").alias("n"))

    def ended(path: Column, n: Column) -> Column:
        return state(F.lit(None).cast("double"), F.lit(None).cast("double"), path, n)

    def first(s: Column) -> Column:
        """s: h, the half of the first step, a and b after it."""
        numbers = F.struct(s["h"].alias("h"), s["a"].alias("a"), s["b"].alias("b"), number(s["a"]).alias("i"), number(s["b"]).alias("j"))
        return F.when((s["b"] >= 1) | (s["a"] < -1), state(s["a"], s["b"], s["h"], F.lit(1))).otherwise(let(numbers, inside))

    def inside(s: Column) -> Column:
        """s: h, a, b; i and j, the ends' numbers."""

        def at(k: Column) -> Column:  # the place of the highest bit that differs
            cells = F.pow(F.lit(2.0), F.lit(level - 2) - k)
            i = _right(s["i"], k + 1)
            middle = 2 * i + 1 - cells
            return state(s["a"] * cells - middle, s["b"] * cells - middle, s["h"] * cells.cast("long") + i, F.lit(level - 1) - k)

        place = F.floor(F.log2(s["i"].bitwiseXOR(s["j"]) + 0.5)).cast("int")
        return F.when(s["i"] == s["j"], ended(s["h"] * (1 << level - 1) + s["i"], F.lit(level))).otherwise(let(let(place, at), parted))

    def parted(s: Column) -> Column:
        """s: a and b in the cell of level n that parts them, and path, down to it."""

        def on(h: Column) -> Column:
            return F.when(h < 0, ended(s["path"], s["n"])).otherwise(state(*stepped(s["a"], s["b"], h), 2 * s["path"] + h, s["n"] + 1))

        return let(_side(s["a"], s["b"], buffer), on)

    def along(s: Column) -> Column:
        """s: a and b in the cell of level n whose edge they reach; how many steps go on along it, and their path."""
        up = down = F
        for k in range(level):
            far = s["n"] + k >= level
            a, b = 1 - (1 - s["a"]) * 2.0**k, (s["b"] + 1) * 2.0**k - 1  # what follows the edge above, and below
            up = up.when(far | ((s["b"] - 1) * 2.0**k + 1 > 1.0 + buffer) | ((a < 0) & (a <= -buffer)), k)
            down = down.when(far | ((s["a"] + 1) * 2.0**k - 1 < -1.0 - buffer) | ((b > 0) & (b >= buffer)), k)
        upper = let(up, lambda k: _path(_left(s["path"] + 1, k) - 1, s["n"] + k))
        return F.when(s["b"] >= 1, upper).otherwise(let(down, lambda k: _path(_left(s["path"], k), s["n"] + k)))

    def began(h: Column) -> Column:
        a, b = stepped(low, high, h)
        one = F.struct(h.cast("long").alias("h"), a.alias("a"), b.alias("b"))
        whole = let(one, lambda s: F.when(s["a"] < s["b"], first(s)))
        going = let(whole, lambda s: F.when(s["n"].isNull(), _walked(low, high, level, buffer)).when(s["a"].isNull(), _path(s["path"], s["n"])).otherwise(along(s)))
        return F.when(h < 0, _path(F.lit(0), F.lit(0))).otherwise(going)

    return let(_side(low, high, buffer), began)


def _down(v: Column, level: int, buffer: float) -> Column:
    def key(x: Column, y: Column) -> Column:
        n = F.least(x["n"], y["n"])
        south = _left(F.lit(1).cast("long"), y["n"]) - 1 - y["path"]  # rows count from the north
        return from_xyz(_right(x["path"], x["n"] - n), _right(south, y["n"] - n), n)

    ends = F.array(*[F.struct(v[a].alias("a"), v[b].alias("b")) for a, b in ("ab", "cd")])
    return let(F.transform(ends, lambda s: _axis(s["a"], s["b"], level, buffer)), lambda both: key(F.get(both, 0), F.get(both, 1)))


def calculate_point(lon, lat, level: int = ELEMENT_LEVEL, buffer: float = BUFFER) -> Column:
    return calculate(_c(lon), _c(lat), _c(lon) + 1, _c(lat) + 1, level, buffer)


def ancestors(qt) -> Column:
    """The cell and all its ancestors up to the root."""
    q = _c(qt)
    return F.transform(F.sequence(F.lit(0), depth(q)), lambda n: F.when(n == 0, F.lit(0).cast("long")).otherwise(_cut(q, n)))
