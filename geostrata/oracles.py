"""DuckDB SQL for the operator queries, written from the semantics and not from the column expressions: cells are walked
level by level in a recursive table, both axes together."""

from __future__ import annotations

from geostrata.fixtures import duck
from geostrata.queries import AS_OF, BOX, DAY_ONE, DEPTH, PREFIX, RING

W = "WITH RECURSIVE "


def deg(x: str) -> str:
    return f"(CAST({x} AS DOUBLE) * 1e-7)"


def unit(v: str) -> str:
    return f"CAST(greatest(least(trunc({v} * 1e7 + CASE WHEN {v} > 0 THEN 0.5 ELSE -0.5 END), 2147483647), -2147483648) AS INT)"


def merc(y: str, scale: str = "1.0") -> str:
    return f"(ln(tan(pi() * (1 + {y} / 90.0) / 4.0)) * {scale} / pi())"


def unmerc(y: str, scale: str = "1.0") -> str:
    return f"((atan(exp({y} * pi() / {scale})) * 4.0 / pi() - 1.0) * 90.0)"


def cut(qt: str, level: str) -> str:
    return f"(CASE WHEN {level} = 0 THEN 0 ELSE (({qt} >> (63 - 2 * {level})) << (63 - 2 * {level})) + {level} END)"


def rnd(qt: str, level: str) -> str:
    return f"(CASE WHEN {qt} < 0 OR ({qt} & 31) <= {level} THEN {qt} ELSE {cut(qt, level)} END)::BIGINT"


def common(lo: str, hi: str, md: str) -> str:
    xx = f"((xor({lo}, {hi}) >> 5) << 5)"
    lv = f"least({md}, CASE WHEN {xx} = 0 THEN 20 ELSE (63 - length(bin({xx}))) // 2 END)"
    return f"{cut(lo, f'({lv})')}::BIGINT"


def common_agg(qt: str) -> str:
    f = f"FILTER ({qt} >= 0)"
    return f"coalesce({common(f'(min({qt}) {f})', f'(max({qt}) {f})', f'(min({qt} & 31) {f})')}, -2)"


def walked(name: str, boxes: str, keys: str, level: int = 18, buffer: float = 0.05) -> str:
    """Table name(keys, quadtree) from a table of boxes (keys, minlon, minlat, maxlon, maxlat)."""
    b = buffer
    quad = f"""CASE WHEN a < {-1 - b} OR c < {-1 - b} OR b > {1 + b} OR d > {1 + b} THEN -1
        WHEN b <= 0 AND c >= 0 THEN 0 WHEN a >= 0 AND c >= 0 THEN 1 WHEN b <= 0 AND d <= 0 THEN 2 WHEN a >= 0 AND d <= 0 THEN 3
        WHEN b < {b} AND abs(b) < abs(a) AND c > {-b} AND abs(d) >= abs(c) THEN 0
        WHEN a > {-b} AND abs(b) >= abs(a) AND c > {-b} AND abs(d) >= abs(c) THEN 1
        WHEN b < {b} AND abs(b) < abs(a) AND d < {b} AND abs(d) < abs(c) THEN 2
        WHEN a > {-b} AND abs(b) >= abs(a) AND d < {b} AND abs(d) < abs(c) THEN 3 ELSE -1 END"""
    return f"""{name}_0 AS (SELECT {keys}, {deg('minlon')} AS x0, {deg('minlat')} AS y0, {deg('maxlon')} AS x1, {deg('maxlat')} AS y1 FROM {boxes}),
{name}_1 AS (SELECT {keys}, x0 / 180.0 AS a, (CASE WHEN x0 = x1 THEN x1 + 0.0000001 ELSE x1 END) / 180.0 AS b, {merc('y0')} AS c, {merc('(CASE WHEN y0 = y1 THEN y1 + 0.0000001 ELSE y1 END)')} AS d, 0 AS lv,
  CASE WHEN x0 > x1 OR y0 > y1 THEN -1::BIGINT ELSE 0::BIGINT END AS qt FROM {name}_0),
{name}_2 AS (SELECT * FROM {name}_1 UNION ALL
  SELECT {keys}, 2 * (a + CASE WHEN k IN (0, 2) THEN 0.5 ELSE -0.5 END), 2 * (b + CASE WHEN k IN (0, 2) THEN 0.5 ELSE -0.5 END),
         2 * (c + CASE WHEN k IN (2, 3) THEN 0.5 ELSE -0.5 END), 2 * (d + CASE WHEN k IN (2, 3) THEN 0.5 ELSE -0.5 END), lv + 1, qt + (k::BIGINT << (61 - 2 * lv)) + 1
  FROM (SELECT *, {quad} AS k FROM {name}_2 WHERE qt >= 0 AND lv < {level}) WHERE k >= 0),
{name} AS (SELECT {keys}, max_by(qt, lv) AS quadtree FROM {name}_2 GROUP BY {keys})"""


WAY_BOX = "way_box AS (SELECT way_id, min(lon)::INT AS minlon, min(lat)::INT AS minlat, max(lon)::INT AS maxlon, max(lat)::INT AS maxlat FROM way_nodes JOIN nodes ON node_id = nodes.id GROUP BY way_id)"
WAYS = f"{W}{duck('nodes', 'way_nodes')}, {WAY_BOX}"
WAY_CELLS = f"{WAYS}, {walked('wq', 'way_box', 'way_id')}"
POINTS = f"{W}{duck('nodes')}, pbox AS (SELECT id, lon AS minlon, lat AS minlat, lon + 1 AS maxlon, lat + 1 AS maxlat FROM nodes), {walked('p', 'pbox', 'id')}"
CELLS = f"""{W}{duck('nodes', 'way_nodes', 'ways', 'relations', 'rel_members')}, {WAY_BOX},
box AS (SELECT 1 AS kind, way_id AS id, minlon, minlat, maxlon, maxlat FROM way_box UNION ALL SELECT 0, id, lon, lat, lon + 1, lat + 1 FROM nodes),
{walked('raw', 'box', 'kind, id')},
wq AS (SELECT id AS way_id, quadtree FROM raw WHERE kind = 1),
used AS (SELECT node_id, {common_agg('quadtree')} AS qt FROM way_nodes JOIN wq USING (way_id) GROUP BY node_id),
nq AS (SELECT raw.id, CASE WHEN used.qt >= 0 THEN used.qt ELSE quadtree END AS quadtree FROM raw LEFT JOIN used ON raw.id = used.node_id WHERE kind = 0),
direct AS (SELECT rel_id, quadtree AS qt FROM rel_members JOIN wq ON mem_ref = way_id WHERE mem_type = 1 UNION ALL SELECT rel_id, quadtree FROM rel_members JOIN nq ON mem_ref = nq.id WHERE mem_type = 0
  UNION ALL SELECT id, 0 FROM relations WHERE id NOT IN (SELECT rel_id FROM rel_members)),
reach AS (SELECT id AS rel_id, id AS inner_id FROM relations UNION SELECT r.rel_id, m.mem_ref FROM reach r JOIN rel_members m ON m.rel_id = r.inner_id AND m.mem_type = 2 JOIN relations x ON x.id = m.mem_ref),
rq AS (SELECT reach.rel_id AS id, greatest({common_agg('qt')}, 0)::BIGINT AS quadtree FROM reach LEFT JOIN direct ON direct.rel_id = reach.inner_id GROUP BY reach.rel_id),
cells AS (SELECT 0 AS elem_type, id, quadtree FROM nq UNION ALL SELECT 1, way_id, quadtree FROM wq UNION ALL SELECT 2, id, quadtree FROM rq),
elements AS (SELECT 0 AS elem_type, id, version, timestamp FROM nodes UNION ALL SELECT 1, id, version, timestamp FROM ways UNION ALL SELECT 2, id, version, timestamp FROM relations),
att AS (SELECT e.elem_type, e.id, CASE WHEN e.elem_type = 2 THEN greatest(coalesce(quadtree, 0), 0) ELSE quadtree END AS quadtree FROM elements e LEFT JOIN cells c ON e.elem_type = c.elem_type AND e.id = c.id)"""


def weights(level: int) -> str:
    return f"(SELECT CASE WHEN elem_type = 2 THEN quadtree ELSE {rnd('quadtree', str(level))} END AS tile, count(*) AS weight FROM cells WHERE quadtree >= 0 GROUP BY 1)"


TILED = f"""{CELLS}, tiles AS {weights(DEPTH)},
up AS (SELECT quadtree, {cut('quadtree', 'lv')} AS tile, lv FROM (SELECT quadtree, unnest(range(0, (quadtree & 31) + 1)) AS lv FROM (SELECT DISTINCT quadtree FROM cells WHERE quadtree >= 0))),
assigned AS (SELECT u.quadtree, coalesce(max_by(t.tile, u.lv) FILTER (t.tile IS NOT NULL), 0)::BIGINT AS tile FROM up u LEFT JOIN tiles t USING (tile) GROUP BY u.quadtree),
tiled AS (SELECT elem_type, id, att.quadtree, coalesce(tile, 0) AS tile FROM att LEFT JOIN assigned ON att.quadtree = assigned.quadtree)"""

NUMBERS = "SELECT id, z, (id * 7919 % (1::BIGINT << z))::INT AS x, (id * 104729 % (1::BIGINT << z))::INT AS y FROM (SELECT id, (id % 20)::INT AS z FROM ways)"


def tile_box(share: float, span: float) -> dict[str, str]:
    e = "20037508.342789244"
    size = f"(2.0 * {e} / 256.0 / pow(2.0, z) * 256.0)"
    west, north = f"((x - {share}) * {size} - {e})", f"({e} - (y - {share}) * {size})"
    lon = lambda m: unit(f"({m} * 180.0 / {e})")
    lat = lambda m: unit(unmerc(m, e))
    return {"minlon": lon(west), "minlat": lat(f"({north} - {span} * {size})"), "maxlon": lon(f"({west} + {span} * {size})"), "maxlat": lat(north)}


def cell_box(qt: str, share: float) -> dict[str, str]:
    """SQL of a cell's box by summing halves level by level."""
    bits = lambda odd: f"list_sum([(({qt} >> (62 - 2 * i - {0 if odd else 1})) & 1) * pow(0.5, i + 1) for i in range(0, {qt} & 31)])"
    x, y, n = f"coalesce({bits(False)}, 0.0)", f"coalesce({bits(True)}, 0.0)", f"pow(0.5, {qt} & 31)"
    w, e = f"(-180.0 + 360.0 * {x})", f"(-180.0 + 360.0 * {x} + 360.0 * {n})"
    nn, s = unmerc(f"(90.0 - 180.0 * {y})", "90.0"), unmerc(f"(90.0 - 180.0 * {y} - 180.0 * {n})", "90.0")
    dx, dy = f"({e} - {w}) * {share}", f"({nn} - {s}) * {share}"
    return {"minlon": unit(f"({w} - {dx})"), "minlat": unit(f"({s} - {dy})"), "maxlon": unit(f"({e} + {dx})"), "maxlat": unit(f"({nn} + {dy})")}


def in_ring(lon: str, lat: str) -> str:
    x, y = deg(lon), deg(lat)
    edges = zip(RING, [RING[-1], *RING[:-1]], strict=True)
    return "((" + " + ".join(f"CASE WHEN ({by} > {y}) <> ({ay} > {y}) AND {x} < ({ax} - {bx}) * ({y} - {by}) / ({ay} - {by}) + {bx} THEN 1 ELSE 0 END" for (bx, by), (ax, ay) in ((b, a) for b, a in edges) if ay != by) + ") % 2 = 1)"


RING_BOX = tuple(int(f([p[k] for p in RING]) * 1e7) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1)))
in_box = lambda b=BOX: f"lon BETWEEN {b[0]} AND {b[2]} AND lat BETWEEN {b[1]} AND {b[3]}"
PAIRS = f"{WAY_CELLS}, pairs AS (SELECT a.way_id, a.quadtree, b.quadtree AS other FROM wq a JOIN wq b ON b.way_id = a.way_id + 7)"
parent = lambda a, b: f"(CASE WHEN ({a} & 31) <= ({b} & 31) THEN {a} = {rnd(b, f'({a} & 31)')} ELSE {b} = {rnd(a, f'({b} & 31)')} END)"
iso = lambda sep: f"strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%dT%H{sep}%M{sep}%S')"
path = "format('{:03d}/{:03d}/{:03d}', state // 1000000, state % 1000000 // 1000, state % 1000)"
span = lambda c, n: f"coalesce(min({c}), -1)::BIGINT AS min_{n}, coalesce(max({c}), -1)::BIGINT AS max_{n}"
COUNTED = f"count(*) AS count, {span('id', 'id')}, {span('timestamp', 'ts')}"

INSIDE = f"{W}{duck('nodes', 'way_nodes', 'rel_members')}, inside AS (SELECT id FROM nodes WHERE {in_box()}), win AS (SELECT DISTINCT way_id AS id FROM way_nodes WHERE node_id IN (FROM inside)), extra AS (SELECT DISTINCT node_id AS id FROM way_nodes WHERE way_id IN (FROM win) AND node_id NOT IN (FROM inside)), " + """
chosen AS (SELECT 0 AS elem_type, id FROM inside UNION ALL SELECT 0, id FROM extra UNION ALL SELECT 1, id FROM win),
rels AS (SELECT rel_id AS id FROM rel_members m JOIN chosen b ON m.mem_type = b.elem_type AND m.mem_ref = b.id UNION SELECT m.rel_id FROM rels r JOIN rel_members m ON m.mem_type = 2 AND m.mem_ref = r.id),
selected AS (SELECT * FROM chosen UNION ALL SELECT 2, id FROM rels)"""

LATEST = "latest AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY seq, elem_type, id ORDER BY version DESC, pos) AS n FROM changes) WHERE n = 1)"
ELEMENTS = "elements AS (SELECT 0 AS elem_type, id, version, timestamp FROM nodes UNION ALL SELECT 1, id, version, timestamp FROM ways UNION ALL SELECT 2, id, version, timestamp FROM relations)"
BASE = f"{W}{duck('nodes', 'ways', 'relations', 'changes')}, {LATEST}, {ELEMENTS}, base AS (SELECT elem_type, id, 0 AS changetype, version, timestamp, 0::BIGINT AS seq FROM elements), chg AS (SELECT elem_type, id, changetype, version, timestamp, seq FROM latest)"
newest = lambda rows: f"SELECT elem_type, id, changetype, version, timestamp, seq FROM (SELECT *, row_number() OVER (PARTITION BY elem_type, id ORDER BY seq DESC) AS n FROM ({rows})) WHERE n = 1"
alive = lambda rows: f"SELECT elem_type, id, 0 AS changetype, version, timestamp, seq FROM ({rows}) WHERE changetype NOT IN (1, 2)"
MANIFEST = f"manifest AS (SELECT state, {DAY_ONE} + state * 86400 AS end_date FROM (SELECT DISTINCT seq AS state FROM changes UNION ALL SELECT 0))"
ONE = f"{W}{duck('nodes', 'way_nodes', 'rel_members', 'changes')}, {LATEST}, one AS (SELECT * FROM latest WHERE seq = 1)"

SIDES = f"""{W}{duck('ways')},
l AS (SELECT id, version, timestamp, user_id, [{{'key': 'priority', 'val': priority}}, {{'key': 'status', 'val': status}}] AS tags, (id * 31 % 1000)::VARCHAR AS data, id % 64 AS quadtree, 'user' || (user_id % 100) AS "user" FROM ways),
r AS (SELECT CASE WHEN id % 23 = 2 THEN id + 500000000 ELSE id END AS id, version + CASE WHEN id % 23 = 3 THEN 1 ELSE 0 END AS version, timestamp, user_id,
  CASE WHEN id % 23 = 4 THEN tags[1:1] WHEN id % 23 = 8 THEN list_reverse(tags) ELSE tags END AS tags, CASE WHEN id % 23 = 5 THEN 'moved' ELSE data END AS data,
  quadtree + CASE WHEN id % 23 = 6 THEN 1 ELSE 0 END AS quadtree, CASE WHEN id % 23 = 7 THEN "user" || 'x' ELSE "user" END AS "user" FROM l WHERE id % 23 <> 1),
cmp AS (SELECT 1 AS elem_type, coalesce(l.id, r.id) AS id, l."user" AS left_user, r."user" AS right_user,
  CASE WHEN r.id IS NULL THEN 'OnlyLeft' WHEN l.id IS NULL THEN 'OnlyRight' WHEN l.version <> r.version OR l.timestamp <> r.timestamp OR l.user_id <> r.user_id THEN 'DifferentInfo'
       WHEN list_sort(l.tags) <> list_sort(r.tags) THEN 'DifferentTags' WHEN l.data <> r.data THEN 'DifferentData' WHEN l.quadtree <> r.quadtree THEN 'DifferentQuadtree'
       WHEN l."user" <> r."user" THEN 'ChangedUserName' ELSE 'Same' END AS kind FROM l FULL JOIN r ON l.id = r.id)"""

LOG = f"""{TILED}, {duck('changes')}, {LATEST}, placed AS (SELECT c.elem_type, c.id, c.quadtree, coalesce(a.tile, 0) AS tile FROM cells c LEFT JOIN assigned a ON a.quadtree = c.quadtree),
log AS (SELECT elem_type, id, quadtree, tile, 0 AS changetype, 0 AS seq FROM placed UNION ALL SELECT l.elem_type, l.id, {rnd('p.quadtree', 'least(3 + l.seq, 18)')}, {rnd(rnd('p.quadtree', 'least(3 + l.seq, 18)'), '4')}, l.changetype, l.seq FROM latest l JOIN placed p ON p.elem_type = l.elem_type AND p.id = l.id)"""

named = lambda columns: ", ".join(f"{v} AS {k}" for k, v in columns.items())
old_tile = tile_box(0.1, 2.1)

ORACLES = {
    "coord_fixed_point": f"{W}{duck('nodes')} SELECT id, {deg('lon')} AS lon_deg, {deg('lat')} AS lat_deg, {unit(deg('lon'))} AS lon, {unit(deg('lat'))} AS lat FROM nodes",
    "mercator_roundtrip": f"{W}{duck('nodes')} SELECT id, round({merc(deg('lat'))}, 9) AS y, round({unmerc(merc(deg('lat')))}, 7) AS lat_back FROM nodes",
    "tile_zoom_bbox": f"{W}{duck('ways')}, t AS ({NUMBERS}) SELECT id, x, y, z, round(2.0 * 20037508.342789244 / 256.0 / pow(2.0, z), 6) AS metres, {named(tile_box(0.0, 1.0))}, {old_tile['minlon']} AS old_minlon, {old_tile['maxlat']} AS old_maxlat FROM t",
    "qt_point": f"{POINTS} SELECT id, quadtree FROM p",
    "qt_round": f"{POINTS} SELECT id, {', '.join(f'{rnd("quadtree", str(n))} AS r{n}' for n in (0, 1, 5, 10, 17, 20))} FROM p",
    "qt_depth_quad": f"{POINTS} SELECT id, (quadtree & 31)::INT AS depth, ((quadtree >> 61) & 3)::INT AS quad0, ((quadtree >> 43) & 3)::INT AS quad9, quadtree < 0 AS empty FROM p",
    "qt_string": f"{POINTS} SELECT id, coalesce(array_to_string([substr('ABCD', (((quadtree >> (61 - 2 * i)) & 3) + 1)::INT, 1) for i in range(0, quadtree & 31)], ''), '') AS letters FROM p",
    "qt_to_xyz": f"{POINTS} SELECT id, coalesce(list_sum([((quadtree >> (61 - 2 * i)) & 1) << ((quadtree & 31) - 1 - i)::INT for i in range(0, quadtree & 31)]), 0)::INT AS x, coalesce(list_sum([((quadtree >> (62 - 2 * i)) & 1) << ((quadtree & 31) - 1 - i)::INT for i in range(0, quadtree & 31)]), 0)::INT AS y, (quadtree & 31)::INT AS z FROM p",
    "qt_from_xyz": f"{W}{duck('ways')}, t AS ({NUMBERS}) SELECT id, (coalesce(list_sum([((((x >> i) & 1) + 2 * ((y >> i) & 1))::BIGINT << (63 - 2 * z + 2 * i)::INT) for i in range(0, z)]), 0) + z)::BIGINT AS quadtree FROM t",
    "qt_bbox": f"{WAY_CELLS} SELECT way_id, {named(cell_box('quadtree', 0.0))}, {cell_box('quadtree', 0.05)['minlon']} AS wide_minlon, {cell_box('quadtree', 0.05)['maxlat']} AS wide_maxlat FROM wq",
    "qt_is_parent": f"{PAIRS} SELECT way_id, {parent('quadtree', 'other')} AS related, {parent(rnd('quadtree', '3'), 'quadtree')} AS own FROM pairs",
    "qt_common_pair": f"{PAIRS} SELECT way_id, CASE WHEN quadtree < 0 THEN other WHEN other < 0 OR other = quadtree THEN quadtree ELSE {common('least(quadtree, other)', 'greatest(quadtree, other)', 'least(quadtree & 31, other & 31)')} END AS common FROM pairs",
    "timestamp_formats": f"{W}{duck('ways')} SELECT id, {iso(':')} AS iso, {iso('-')} AS alt, strftime(make_timestamp(timestamp * 1000000), '%Y%m%d') AS day, CASE WHEN id % 4 = 3 THEN timestamp - timestamp % 86400 ELSE timestamp END AS parsed FROM ways",
    "replication_url": f"{W}{duck('ways')}, s AS (SELECT id, id * 7919 % 9999999 AS state FROM ways) SELECT id, '{PREFIX}' || {path} || '.osc.gz' AS diff, CASE WHEN id % 5 = 0 THEN '{PREFIX}state.txt' ELSE '{PREFIX}' || {path} || '.state.txt' END AS state_url FROM s",
    "way_bbox": f"{WAYS} SELECT * FROM way_box",
    "way_quadtrees": f"{WAY_CELLS} SELECT way_id, quadtree FROM wq",
    "bbox_contains": f"{WAYS} SELECT way_id, minlon >= {BOX[0]} AND minlat >= {BOX[1]} AND maxlon <= {BOX[2]} AND maxlat <= {BOX[3]} AS inside FROM way_box",
    "bbox_overlaps": f"{WAYS} SELECT way_id, NOT (minlon > {BOX[2]} OR minlat > {BOX[3]} OR maxlon < {BOX[0]} OR maxlat < {BOX[1]}) AS overlaps FROM way_box",
    "bbox_contains_point": f"{W}{duck('nodes')} SELECT id, {in_box()} AS inside FROM nodes",
    "node_ways": f"{W}{duck('nodes', 'way_nodes')} SELECT id, count(DISTINCT way_id) AS n_ways, coalesce(array_to_string(list_sort(list(DISTINCT way_id) FILTER (way_id IS NOT NULL)), ','), '') AS ways FROM nodes LEFT JOIN way_nodes ON node_id = id GROUP BY id",
    "node_quadtrees": f"{CELLS} SELECT id, quadtree FROM nq",
    "relation_quadtrees": f"{CELLS} SELECT id, quadtree FROM rq",
    "attach_quadtrees": f"{CELLS} SELECT elem_type, id, quadtree FROM att",
    "unattached_elements": f"{CELLS} SELECT elem_type, id FROM att WHERE quadtree IS NULL",
    "missing_way_nodes": f"{W}{duck('nodes', 'way_nodes')} SELECT DISTINCT way_id, node_id FROM way_nodes WHERE node_id NOT IN (SELECT id FROM nodes WHERE id % 11 <> 3)",
    "count_nodes": f"{W}{duck('nodes')} SELECT {COUNTED}, {span('lon', 'lon')}, {span('lat', 'lat')} FROM nodes",
    "count_ways": f"{W}{duck('ways', 'way_nodes')}, r AS (SELECT way_id, count(*) AS n, min(node_id) AS lo, max(node_id) AS hi FROM way_nodes GROUP BY way_id) SELECT {COUNTED}, coalesce(sum(n), 0)::BIGINT AS num_refs, coalesce(max(n), 0)::BIGINT AS longest, coalesce(min(lo), -1)::BIGINT AS min_ref, coalesce(max(hi), -1)::BIGINT AS max_ref FROM ways LEFT JOIN r ON way_id = id",
    "count_relations": f"{W}{duck('relations', 'rel_members')}, m AS (SELECT rel_id, count(*) AS n FROM rel_members GROUP BY rel_id) SELECT {COUNTED}, coalesce(sum(n), 0)::BIGINT AS num_members, coalesce(max(n), 0)::BIGINT AS longest, count(*) FILTER (n IS NULL)::BIGINT AS empties FROM relations LEFT JOIN m ON rel_id = id",
    "count_by_changetype": f"{W}{duck('changes')} SELECT elem_type, changetype, {COUNTED} FROM changes GROUP BY elem_type, changetype",
    "max_timestamp": f"{W}{duck('nodes')} SELECT max(timestamp)::BIGINT AS max_ts, (round(max(timestamp) / 86400.0) * 86400)::BIGINT AS day_ts FROM nodes",
    "tile_weights": f"{CELLS} SELECT tile, weight FROM {weights(17)}",
    "tile_totals": f"{CELLS}, tw AS {weights(17)} SELECT tile, sum(CASE WHEN own = tile THEN weight ELSE 0 END)::BIGINT AS weight, sum(weight)::BIGINT AS total FROM (SELECT own, weight, {cut('own', 'lv')}::BIGINT AS tile FROM (SELECT tile AS own, weight, unnest(range(0, (tile & 31) + 1)) AS lv FROM tw)) GROUP BY tile",
    "tile_assign": f"{TILED} SELECT quadtree, tile FROM assigned",
    "tile_sorted": f"{TILED} SELECT tile, elem_type, id, row_number() OVER (ORDER BY tile, elem_type, id) - 1 AS place FROM tiled",
    "tile_index_hits": f"{TILED}, {duck('changes')} SELECT DISTINCT t.tile FROM tiled t JOIN changes c ON t.elem_type = c.elem_type AND t.id = c.id",
    "tile_prune_bbox": f"{CELLS}, tiles AS {weights(DEPTH)}, b AS (SELECT tile, {named(cell_box('tile', 0.05))} FROM tiles) SELECT tile FROM b WHERE minlon <= {BOX[2]} AND minlat <= {BOX[3]} AND maxlon >= {BOX[0]} AND maxlat >= {BOX[1]}",
    "tile_depth": f"{CELLS} SELECT tile FROM {weights(DEPTH)} WHERE (tile & 31) <= 4",
    "block_weight": f"{TILED} SELECT tile, sum(CASE elem_type WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 20 END)::BIGINT AS weight, count(*) AS len FROM tiled GROUP BY tile",
    "tile_ordinal": f"{TILED} SELECT tile, o AS ordinal, o // 16 AS bucket FROM (SELECT tile, row_number() OVER (ORDER BY tile) - 1 AS o FROM (SELECT DISTINCT tile FROM tiled))",
    "snapshot_sizes": f"{TILED} SELECT count(DISTINCT tile) AS num_tiles, count(*) AS num_objects FROM tiled",
    "tile_triage": f"{CELLS}, b AS (SELECT tile, {named(cell_box('tile', 0.05))} FROM {weights(DEPTH)}) SELECT tile, CASE WHEN minlon >= {BOX[0]} AND minlat >= {BOX[1]} AND maxlon <= {BOX[2]} AND maxlat <= {BOX[3]} AND {' AND '.join(in_ring(x, y) for x in ('minlon', 'maxlon') for y in ('minlat', 'maxlat'))} THEN 'all' WHEN minlon <= {BOX[2]} AND minlat <= {BOX[3]} AND maxlon >= {BOX[0]} AND maxlat >= {BOX[1]} THEN 'each' ELSE 'none' END AS action FROM b",
    "filter_nodes_bbox": f"{W}{duck('nodes')} SELECT id FROM nodes WHERE {in_box()}",
    "filter_nodes_poly": f"{W}{duck('nodes')} SELECT id FROM nodes WHERE {in_box(RING_BOX)} AND {in_ring('lon', 'lat')}",
    "filter_ways": f"{INSIDE} SELECT id FROM win",
    "filter_completion": f"{INSIDE} SELECT id FROM extra",
    "filter_all": f"{INSIDE} SELECT elem_type, id FROM selected",
    "filter_relations": f"{INSIDE} SELECT id FROM rels",
    "filter_members": f"{INSIDE}, h AS (SELECT rel_id, count(*) AS had FROM rel_members GROUP BY rel_id) SELECT m.rel_id, row_number() OVER (PARTITION BY m.rel_id ORDER BY seq) - 1 AS seq, mem_type, mem_ref, had FROM rel_members m JOIN h ON m.rel_id = h.rel_id JOIN selected s ON s.elem_type = m.mem_type AND s.id = m.mem_ref",
    "combine_changes": f"{BASE} {newest('SELECT * FROM chg WHERE seq IN (3, 4)')}",
    "apply_changes": f"{BASE} {alive(newest('SELECT * FROM base UNION ALL SELECT * FROM chg WHERE seq = 3'))}",
    "merge_asof": f"{BASE}, {MANIFEST} {alive(newest(f'SELECT * FROM base UNION ALL SELECT * FROM chg WHERE seq IN (SELECT state FROM manifest WHERE end_date <= {AS_OF})'))}",
    "snapshot_select": f"{W}{duck('changes')}, {MANIFEST} SELECT state, end_date FROM manifest WHERE end_date <= {AS_OF}",
    "id_union": f"{BASE} SELECT elem_type, id FROM elements UNION SELECT elem_type, id FROM changes",
    "change_latest": f"{W}{duck('changes')}, {LATEST} SELECT seq, elem_type, id, version, changetype, timestamp FROM latest",
    "change_latest_ties": f"{W}{duck('changes')} SELECT seq, elem_type, id, 6 + seq AS version, changetype, pos FROM (SELECT *, row_number() OVER (PARTITION BY seq, elem_type, id ORDER BY pos) AS n FROM changes) WHERE n = 1",
    "change_ids": f"{ONE} SELECT elem_type, id FROM one UNION SELECT 0, node_id FROM way_nodes WHERE way_id IN (SELECT id FROM one WHERE elem_type = 1) UNION SELECT mem_type, mem_ref FROM rel_members WHERE rel_id IN (SELECT id FROM one WHERE elem_type = 2)",
    "extra_nodes": f"{ONE} SELECT id, lon, lat FROM nodes WHERE id IN (SELECT node_id FROM way_nodes WHERE way_id IN (SELECT id FROM one WHERE elem_type = 1 AND changetype <> 1)) AND id NOT IN (SELECT id FROM one WHERE elem_type = 0)",
    "existing_state": f"{LOG} SELECT elem_type, id, quadtree, tile FROM (SELECT *, row_number() OVER (PARTITION BY elem_type, id ORDER BY seq DESC) AS n FROM log) WHERE n = 1 AND changetype <> 1",
    "merge_tiles_asof": f"{LOG}, gone AS (SELECT l.elem_type, l.id, 0 AS quadtree, p.tile, 2 AS changetype, l.seq FROM log l JOIN placed p ON p.elem_type = l.elem_type AND p.id = l.id WHERE l.seq > 0 AND l.changetype <> 1 AND l.tile <> p.tile), {MANIFEST} SELECT tile, elem_type, id, quadtree, seq::BIGINT AS seq FROM (SELECT *, row_number() OVER (PARTITION BY tile, elem_type, id ORDER BY seq DESC) AS n FROM (SELECT * FROM log UNION ALL SELECT * FROM gone) WHERE seq IN (SELECT state FROM manifest WHERE end_date <= {AS_OF})) WHERE n = 1 AND changetype NOT IN (1, 2)",
    "update_tiles_read": f"{TILED}, {duck('changes')}, {LATEST}, one AS (SELECT * FROM latest WHERE seq = 1), ids AS (SELECT elem_type, id FROM one UNION SELECT 0, node_id FROM way_nodes WHERE way_id IN (SELECT id FROM one WHERE elem_type = 1) UNION SELECT mem_type, mem_ref FROM rel_members WHERE rel_id IN (SELECT id FROM one WHERE elem_type = 2)), hits AS (SELECT DISTINCT tile FROM tiled t JOIN ids i ON i.elem_type = t.elem_type AND i.id = t.id) SELECT tile, elem_type, count(*) AS n FROM tiled WHERE tile IN (FROM hits) GROUP BY tile, elem_type",
    "extract_members": f"{INSIDE} SELECT r.id, coalesce(string_agg(m.mem_type || ':' || m.mem_ref, ',' ORDER BY m.seq) FILTER (s.id IS NOT NULL), '') AS members FROM rels r LEFT JOIN rel_members m ON m.rel_id = r.id LEFT JOIN selected s ON s.elem_type = m.mem_type AND s.id = m.mem_ref GROUP BY r.id",
    "way_range": f"{W}{duck('way_nodes')} SELECT way_id, node_id, seq FROM way_nodes WHERE way_id >= 500 AND way_id < 9000",
    "pending_diffs": f"{W}{duck('changes')} SELECT state, {DAY_ONE} + state * 86400 AS timestamp FROM (SELECT DISTINCT seq AS state FROM changes) WHERE state > 12 ORDER BY state LIMIT 5",
    "initial_state": f"{W}{duck('changes')} SELECT max(state) AS state, max(timestamp) AS timestamp FROM (SELECT seq AS state, {DAY_ONE} + seq * 86400 AS timestamp FROM changes) WHERE timestamp <= {AS_OF + 3600}",
    "element_diff": f"{SIDES} SELECT elem_type, id, kind FROM cmp",
    "diff_counts": f"{SIDES} SELECT elem_type, kind, count(*) AS n FROM cmp GROUP BY ALL",
    "renamed_users": f"{SIDES} SELECT DISTINCT left_user, right_user FROM cmp WHERE kind = 'ChangedUserName'",
    "diff_report": f"{SIDES} SELECT elem_type, id, kind FROM cmp WHERE kind <> 'Same' ORDER BY elem_type, id LIMIT 100",
    "tag_diff": f"{SIDES} SELECT l.id, list_sort(l.tags) <> list_sort(r.tags) AS differ FROM l JOIN r ON l.id = r.id",
    "elements_sorted": f"{W}{duck('changes')} SELECT id, version, changetype, row_number() OVER (ORDER BY id, version, changetype) - 1 AS place FROM changes",
    "reblock_8000": f"{BASE} SELECT elem_type, id, (row_number() OVER (ORDER BY elem_type, id) - 1) // 8000 AS block FROM elements",
    "sorted_tags": f"{W}{duck('ways')} SELECT id, 'priority=' || priority || ';status=' || status AS tags FROM ways",
}

#: Change file 2, with the new cells of ways and points walked as above.
ORACLES["update_actions"] = f"""{TILED}, {duck('changes')}, {LATEST}, chg AS (SELECT elem_type, id, changetype, pos FROM latest WHERE seq = 2),
more AS (SELECT id, lon, lat FROM nodes WHERE id IN (SELECT node_id FROM way_nodes WHERE way_id IN (SELECT id FROM chg WHERE elem_type = 1 AND changetype <> 1)) AND id NOT IN (SELECT id FROM chg WHERE elem_type = 0)),
placed AS (SELECT c.id, (coalesce(lon, id % 1000 * 1000000) + (pos % 2001 - 1000) * 10000)::INT AS lon, (coalesce(lat, id % 500 * 1000000) + (pos % 2001 - 1000) * 10000)::INT AS lat FROM chg c LEFT JOIN nodes USING (id) WHERE elem_type = 0 AND changetype <> 1),
put_at AS (SELECT * FROM placed UNION ALL SELECT * FROM more),
uses AS (SELECT way_id, node_id FROM way_nodes WHERE way_id IN (SELECT id FROM chg WHERE elem_type = 1 AND changetype <> 1)),
nbox AS (SELECT 1 AS kind, way_id AS id, min(lon) AS minlon, min(lat) AS minlat, max(lon) AS maxlon, max(lat) AS maxlat FROM uses JOIN put_at ON put_at.id = node_id GROUP BY way_id UNION ALL SELECT 0, id, lon, lat, lon + 1, lat + 1 FROM put_at),
{walked('nraw', 'nbox', 'kind, id')},
nused AS (SELECT node_id, {common_agg('quadtree')} AS qt FROM uses JOIN nraw ON kind = 1 AND id = way_id GROUP BY node_id),
ncells AS (SELECT 1 AS elem_type, id, quadtree FROM nraw WHERE kind = 1 UNION ALL SELECT 0, id, CASE WHEN qt >= 0 THEN qt ELSE quadtree END FROM nraw LEFT JOIN nused ON node_id = id WHERE kind = 0),
before AS (SELECT c.elem_type, c.id, c.quadtree AS was, coalesce(a.tile, 0) AS alloc FROM cells c LEFT JOIN assigned a ON a.quadtree = c.quadtree),
whole AS (SELECT elem_type, id, changetype FROM chg UNION ALL SELECT 0, id, 0 FROM more),
x AS (SELECT w.*, was, alloc, CASE WHEN n.quadtree IS NULL THEN was WHEN w.elem_type = 1 OR was IS NULL OR was < 0 OR was = n.quadtree THEN n.quadtree WHEN n.quadtree < 0 THEN was
  ELSE {common('least(was, n.quadtree)', 'greatest(was, n.quadtree)', 'least(was & 31, n.quadtree & 31)')} END AS q
  FROM whole w LEFT JOIN before b ON b.elem_type = w.elem_type AND b.id = w.id LEFT JOIN ncells n ON n.elem_type = w.elem_type AND n.id = w.id),
xup AS (SELECT q, {cut('q', 'lv')} AS tile, lv FROM (SELECT q, unnest(range(0, (q & 31) + 1)) AS lv FROM (SELECT DISTINCT q FROM x WHERE q >= 0))),
xt AS (SELECT u.q, coalesce(max_by(t.tile, u.lv) FILTER (t.tile IS NOT NULL), 0)::BIGINT AS na FROM xup u LEFT JOIN tiles t USING (tile) GROUP BY u.q),
y AS (SELECT x.*, na, CASE WHEN changetype = 0 AND elem_type = 0 AND alloc IS NOT NULL AND na IS NOT NULL THEN CASE WHEN x.q = was THEN 'unneeded' ELSE 'put' END
  WHEN changetype = 1 THEN CASE WHEN alloc IS NOT NULL THEN 'deleted' ELSE 'create_delete' END WHEN changetype = 4 AND na IS NOT NULL THEN 'put' WHEN changetype = 5 AND alloc IS NULL AND na IS NOT NULL THEN 'put' ELSE 'ignored' END AS what
  FROM x LEFT JOIN xt ON xt.q = x.q)
SELECT na AS tile, elem_type, id, CASE WHEN changetype = 0 THEN 3 ELSE changetype END AS changetype, q AS quadtree, 'kept' AS action FROM y WHERE what = 'put'
UNION ALL SELECT alloc, elem_type, id, 2, 0, 'removed' FROM y WHERE what = 'put' AND alloc IS NOT NULL AND alloc <> na
UNION ALL SELECT alloc, elem_type, id, 1, 0, 'deleted' FROM y WHERE what = 'deleted'
UNION ALL SELECT NULL, elem_type, id, changetype, NULL, what FROM y WHERE what IN ('unneeded', 'create_delete', 'ignored')"""
