"""PBF map files: a codec for blocks, a Spark data source that reads frames in parallel, and a writer.

Field numbers are the public format's. Beyond it, three extensions carry cells: 20 in elements and dense nodes, 32 to 34
in a block (cell, start and end date), and 10 in a group (the change type of its rows).
"""

from __future__ import annotations

import lzma
import os
import shutil
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = (
    "elem_type int, id long, changetype int, version long, changeset long, timestamp long, user_id long, user string, tags array<struct<key:string,val:string>>, "
    "lon int, lat int, refs array<long>, members array<struct<role:string,mem_type:int,mem_ref:long>>, quadtree long, tile long"
)


class PbfError(ValueError):
    pass


# --- wire format ------------------------------------------------------------------------------------------------------
def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field: an int, or bytes."""
    at, n = 0, len(data)
    while at < n:
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise PbfError(f"unknown wire type {kind}")
        if at > n:
            raise PbfError("a field ends after its message")
        yield tag >> 3, value


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def packed(data: bytes) -> np.ndarray:
    """The numbers of a packed field, at once: each byte's seven bits go to its number's place."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    number = np.concatenate([[0], np.cumsum(last)[:-1]])
    place = np.arange(len(raw)) - starts[number]
    return np.bitwise_or.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def unzigzag(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def deltas(data: bytes) -> np.ndarray:
    return np.cumsum(unzigzag(packed(data)))


def varint(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def zigzag(v: int) -> int:
    return (v << 1) ^ (v >> 63)


def number(field: int, v: int) -> bytes:
    return varint(field << 3) + varint(v)


def message(field: int, data: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(data)) + data


def run(field: int, values, zig: bool = False, delta: bool = False) -> bytes:
    values = list(values)
    if delta:
        values = [b - a for a, b in zip([0, *values], values, strict=False)]
    return message(field, b"".join(varint(zigzag(v) if zig else v) for v in values))


# --- frames -----------------------------------------------------------------------------------------------------------
def frames(f) -> Iterator[tuple[int, str, int, int]]:
    """(position, type, where the blob starts, its size) of each frame; nothing but headers is read."""
    while True:
        position = f.tell()
        head = f.read(4)
        if not head:
            return
        if len(head) < 4:
            raise PbfError("the file ends within a frame")
        header = dict(fields(f.read(struct.unpack(">I", head)[0])))
        size, start = header[3], f.tell()
        yield position, header[1].decode(), start, size
        f.seek(start + size)


def unblob(blob: bytes) -> bytes:
    """A blob's content: raw, zlib or lzma. Brotli (field 8) has no decoder here."""
    got = dict(fields(blob))
    if 1 in got:
        return got[1]
    if 3 in got:
        return zlib.decompress(got[3])
    if 4 in got:
        return lzma.decompress(got[4])
    raise PbfError("brotli blobs can't be read here" if 8 in got else f"unknown compression, fields {sorted(got)}")


def frame(kind: str, content: bytes, compression: str = "zlib", level: int | None = None) -> bytes:
    if compression == "none":
        blob = message(1, content)
    elif compression == "zlib":
        blob = number(2, len(content)) + message(3, zlib.compress(content, 6 if level is None else level))
    elif compression == "lzma":
        blob = number(2, len(content)) + message(4, lzma.compress(content, preset=3 if level is None else level))
    else:
        raise PbfError(f"unknown compression {compression}")
    header = message(1, kind.encode()) + number(3, len(blob))
    return struct.pack(">I", len(header)) + header + blob


# --- blocks -----------------------------------------------------------------------------------------------------------
INFO, HEAVY = ("version", "changeset", "timestamp", "user_id", "user"), ("tags", "refs", "members")


def decode(data: bytes, types: set[int] | None = None, ids: set[int] | None = None, columns: set[str] | None = None) -> list[tuple]:
    """Rows of SCHEMA. types and ids leave out groups and rows before they are decoded further; of info, tags, refs and members only the columns named are decoded."""
    skip = frozenset() if columns is None else frozenset(c for c in HEAVY if c not in columns) | (frozenset() if columns & set(INFO) else {"info"})
    strings: list[str] = []
    groups, tile = [], None
    for field, v in fields(data):
        if field == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif field == 2:
            groups.append(v)
        elif field == 32:
            tile = signed(v)
        elif (field == 17 and v != 100) or (field == 18 and v != 1000) or (field in (19, 20) and v != 0):
            raise PbfError("only the usual granularity and no offsets are supported")
        elif field not in (17, 18, 19, 20, 33, 34):
            raise PbfError(f"unknown field {field} in a block")
    rows: list[tuple] = []
    for g in groups:
        parts = list(fields(g))
        change = next((v for k, v in parts if k == 10), 0)
        for k, v in parts:
            kind = {1: 0, 2: 0, 3: 1, 4: 2}.get(k)
            if kind is None or (types is not None and kind not in types):
                continue
            rows += _dense(v, strings, change, tile, ids, skip) if k == 2 else _single(v, kind, strings, change, tile, ids, skip)
    return rows


def _tags(keys, vals, strings) -> list[dict]:
    return [{"key": strings[a], "val": strings[b]} for a, b in zip(keys, vals, strict=True)]


def _single(data: bytes, kind: int, strings: list[str], change: int, tile, ids, skip) -> list[tuple]:
    got = dict(fields(data))
    own = signed(got[1]) if kind == 0 else got[1]
    if ids is not None and own not in ids:
        return []
    numbers = lambda k: packed(got[k]).tolist() if k in got else []
    info = dict(fields(got[4])) if 4 in got and "info" not in skip else {}
    who = (info.get(1), info.get(3), info.get(2), info.get(4), strings[info[5]] if 5 in info else None) if info else (None,) * 5
    lat, lon = (signed(got[8]), signed(got[9])) if kind == 0 else (None, None)
    refs = None if kind != 1 or "refs" in skip else deltas(got[8]).tolist() if 8 in got else []
    members = None
    if kind == 2 and "members" not in skip:
        members = [{"role": strings[r], "mem_type": t, "mem_ref": m} for r, m, t in zip(numbers(8), deltas(got.get(9, b"")).tolist(), numbers(10), strict=True)]
    qt = signed(got[20]) if 20 in got else None
    tags = [] if "tags" in skip else _tags(numbers(2), numbers(3), strings)
    return [(kind, own, change, *who, tags, lon, lat, refs, members, qt, tile)]


def _dense(data: bytes, strings: list[str], change: int, tile, ids, skip) -> list[tuple]:
    got = dict(fields(data))
    own = deltas(got.get(1, b""))
    n = len(own)
    lat, lon = deltas(got.get(8, b"")), deltas(got.get(9, b""))
    info = dict(fields(got[5])) if 5 in got and "info" not in skip else {}
    column = lambda k, f: f(info[k]).tolist() if k in info else [None] * n
    version, stamp, changeset, uid, sid = column(1, packed), column(2, deltas), column(3, deltas), column(4, deltas), column(5, deltas)
    qts = deltas(got[20]).tolist() if 20 in got else [None] * n
    text = packed(got[10]).tolist() if 10 in got and "tags" not in skip else [0] * n
    out, at = [], 0
    for i, node in enumerate(own.tolist()):
        end = text.index(0, at)
        pairs, at = text[at:end], end + 1
        if ids is None or node in ids:
            out.append((0, node, change, version[i], changeset[i], stamp[i], uid[i], None if sid[i] is None else strings[sid[i]], _tags(pairs[::2], pairs[1::2], strings), int(lon[i]), int(lat[i]), None, None, qts[i], tile))
    return out


class _Strings(dict):
    """Numbers for strings, from 1; 0 is kept for ends of lists."""

    def __missing__(self, s: str) -> int:
        self[s] = out = len(self) + 1
        return out


def encode(rows: list[dict], tile: int | None = None, as_change: bool = False) -> bytes:
    """A block of rows of SCHEMA (as dicts). Nodes are dense; with as_change, runs of one change type are a group each."""
    strings, groups = _Strings(), []
    rows = sorted(rows, key=lambda r: r["elem_type"])
    start = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k]["elem_type"] != rows[start]["elem_type"] or (as_change and rows[k]["changetype"] != rows[start]["changetype"]):
            part = rows[start:k]
            kind = part[0]["elem_type"]
            body = message(2, _pack_dense(part, strings)) if kind == 0 else b"".join(message(2 + kind, _pack_single(r, strings)) for r in part)
            groups.append(body + (number(10, part[0]["changetype"]) if as_change else b""))
            start = k
    table = message(1, b"") + b"".join(message(1, s.encode()) for s in strings)
    out = message(1, table) + b"".join(message(2, g) for g in groups)
    return out + (number(32, zigzag(tile)) if tile is not None else b"")


def _pack_dense(rows: list[dict], strings: _Strings) -> bytes:
    out = run(1, [r["id"] for r in rows], True, True)
    if any(r.get("version") is not None for r in rows):
        v = lambda name: [r.get(name) or 0 for r in rows]
        out += message(5, run(1, v("version")) + run(2, v("timestamp"), True, True) + run(3, v("changeset"), True, True) + run(4, v("user_id"), True, True) + run(5, [strings[r.get("user") or ""] for r in rows], True, True))
    out += run(8, [r["lat"] for r in rows], True, True) + run(9, [r["lon"] for r in rows], True, True)
    if any(r.get("tags") for r in rows):
        out += run(10, [x for r in rows for x in [*(s for t in r.get("tags") or () for s in (strings[t["key"]], strings[t["val"]])), 0]])
    if any(r.get("quadtree") is not None for r in rows):
        out += run(20, [r["quadtree"] if r.get("quadtree") is not None else -2 for r in rows], True, True)
    return out


def _pack_single(r: dict, strings: _Strings) -> bytes:
    tags = r.get("tags") or ()
    out = number(1, r["id"])
    if tags:
        out += run(2, [strings[t["key"]] for t in tags]) + run(3, [strings[t["val"]] for t in tags])
    if r.get("version") is not None:
        out += message(4, number(1, r["version"]) + number(2, r.get("timestamp") or 0) + number(3, r.get("changeset") or 0) + number(4, r.get("user_id") or 0) + number(5, strings[r.get("user") or ""]))
    if r["elem_type"] == 1 and r.get("refs"):
        out += run(8, r["refs"], True, True)
    if r["elem_type"] == 2 and r.get("members"):
        m = r["members"]
        out += run(8, [strings[x["role"]] for x in m]) + run(9, [x["mem_ref"] for x in m], True, True) + run(10, [x["mem_type"] for x in m])
    return out + (number(20, zigzag(r["quadtree"])) if r.get("quadtree") is not None else b"")


PLANET = (-1800000000, -900000000, 1800000000, 900000000)


def header(writer: str = "geostrata", sorted_: bool = False, state: int | None = None, timestamp: int | None = None, bbox: tuple[int, int, int, int] | None = None, index: list[tuple[int, int, bool]] | None = None, url: str | None = None) -> bytes:
    """A header block. index: (tile, length of its frame, whether it is of changes) of each data frame in order."""
    out = b""
    if bbox:
        minlon, minlat, maxlon, maxlat = bbox
        out += message(1, b"".join(number(k, zigzag(v * 100)) for k, v in enumerate((minlon, maxlon, maxlat, minlat), 1)))
    out += b"".join(message(4, s.encode()) for s in ("OsmSchema-V0.6", "DenseNodes")) + (message(5, b"Sort.Type_then_ID") if sorted_ else b"") + message(16, writer.encode())
    for tile, length, change in index or ():
        out += message(22, (number(2, 1) if change else b"") + number(3, zigzag(length)) + number(4, zigzag(tile)))
    out += (number(32, timestamp) if timestamp is not None else b"") + (number(33, state) if state is not None else b"")
    return out + (message(34, url.encode()) if url else b"")


def parse_header(data: bytes, end: int = 0, path: str = "") -> dict:
    """A header block's content. end: where its frame ends, from which an index within it counts; path: the file, whose name
    begins that of an index beside it (rows of tile, position, length in JSON). index: (tile, position, length, change)."""
    import json

    out: dict = {"bbox": None, "required": [], "optional": [], "writer": None, "source": None, "timestamp": None, "state": None, "url": None, "index": []}
    for field, v in fields(data):
        if field == 1:
            b = {k: signed(x) // 100 for k, x in fields(v)}
            out["bbox"] = (b[1], b[4], b[2], b[3])
        elif field in (4, 5):
            out["required" if field == 4 else "optional"].append(v.decode())
        elif field in (16, 17, 34):
            out[{16: "writer", 17: "source", 34: "url"}[field]] = v.decode()
        elif field in (32, 33):
            out["timestamp" if field == 32 else "state"] = v
        elif field == 22:
            item = dict(fields(v))
            length = signed(item[3])
            out["index"].append((_item_tile(item), end, length, bool(item.get(2))))
            end += length
        elif field == 23:
            with open(path + v.decode()) as f:
                out["index"] += [(tile, at, length, False) for tile, at, length in json.load(f)]
        else:
            raise PbfError(f"unknown field {field} in a header")
    return out


def _item_tile(item: dict) -> int:
    """An index item's tile: a number, or, as older files have it, x, y and z."""
    if 4 in item:
        return signed(item[4])
    x, y, z = (dict(fields(item[1])).get(k, 0) for k in (1, 2, 3))
    qt = 0
    for k in range(z):
        at = z - 1 - k
        qt |= ((x >> at & 1) | (y >> at & 1) << 1) << (61 - 2 * k)
    return qt + z


def read_header(path: str) -> dict | None:
    """The header of a file, if it begins with one."""
    with open(path, "rb") as f:
        for _, kind, start, size in frames(f):
            f.seek(start)
            return parse_header(unblob(f.read(size)), start + size, path) if kind == "OSMHeader" else None
    return None


# --- files of cells ---------------------------------------------------------------------------------------------------
def encode_cells(rows: list[tuple[int, int, int]]) -> bytes:
    """A block of (elem_type, id, quadtree): dense nodes with ids and cells alone, ways and relations likewise."""
    nodes = [r for r in rows if r[0] == 0]
    groups = [message(2, run(1, [r[1] for r in nodes], True, True) + run(20, [r[2] for r in nodes], True, True))] if nodes else []
    for kind in (1, 2):
        own = b"".join(message(2 + kind, number(1, r[1]) + number(20, zigzag(r[2]))) for r in rows if r[0] == kind)
        groups += [own] if own else []
    return message(1, message(1, b"")) + b"".join(message(2, g) for g in groups)


def decode_cells(data: bytes) -> list[tuple[int, int, int]]:
    """(elem_type, id, quadtree) of a block; nothing else is decoded. An element without either is an error."""
    out = []
    for field, g in fields(data):
        if field != 2:
            continue
        for k, v in fields(g):
            got = dict(fields(v)) if k in (1, 2, 3, 4) else {}
            if k == 2:
                ids, cells = deltas(got.get(1, b"")).tolist(), deltas(got.get(20, b"")).tolist()
                if not ids or len(ids) != len(cells):
                    raise PbfError("ids and cells of nodes don't match")
                out += [(0, i, c) for i, c in zip(ids, cells, strict=True)]
            elif k in (1, 3, 4):
                if 1 not in got or 20 not in got:
                    raise PbfError("an element without id or cell")
                out.append(({1: 0, 3: 1, 4: 2}[k], got[1], signed(got[20])))
    return out


# --- Spark ------------------------------------------------------------------------------------------------------------
_TAGS = pa.list_(pa.struct([("key", pa.string()), ("val", pa.string())]))
_MEMBERS = pa.list_(pa.struct([("role", pa.string()), ("mem_type", pa.int32()), ("mem_ref", pa.int64())]))
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
TYPES = [(c.split(" ", 1)[0], {"tags": _TAGS, "members": _MEMBERS}.get(c.split(" ", 1)[0]) or _KINDS[c.split(" ", 1)[1]]) for c in SCHEMA.split(", ")]
CELL_TYPES = [("elem_type", pa.int32()), ("id", pa.int64()), ("quadtree", pa.int64())]


def batch_of(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """A block's rows as one Arrow batch, column by column."""
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])


class Frames(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int]]):
        self.path, self.spans = path, spans


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.size = int(options.get("partitionbytes", 64 << 20))
        self.cells = options.get("cells") == "true"
        self.columns = set(options["columns"].split(",")) if options.get("columns") else None
        self.wanted: dict[str, set[int] | None] = {"elem_type": None, "id": None, "tile": None}

    def pushFilters(self, filters):
        """Equal or in: types and ids reach the decoder, which skips other groups and rows; tiles leave frames out where the file has an index. Spark checks again."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute[0] in self.wanted and len(f.attribute) == 1:
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                before = self.wanted[f.attribute[0]]
                self.wanted[f.attribute[0]] = own if before is None else before & own
            yield f

    def partitions(self):
        out = []
        for path in self.paths:
            own: list[tuple[int, int]] = []
            total, tiles = 0, self.wanted["tile"]
            index = (read_header(path) or {}).get("index") if tiles is not None else None
            with open(path, "rb") as f:
                for _, kind, start, size in self._indexed(f, index, tiles) if index else frames(f):
                    if kind == "OSMData":
                        own.append((start, size))
                        total += size
                        if total >= self.size:
                            out.append(Frames(path, own))
                            own, total = [], 0
            if own:
                out.append(Frames(path, own))
        return out

    @staticmethod
    def _indexed(f, index, tiles):
        """Frames of the wanted tiles, found by the index."""
        for tile, position, _, _ in index:
            if tile in tiles:
                f.seek(position)
                yield next(frames(f))

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for start, size in partition.spans:
                f.seek(start)
                data = unblob(f.read(size))
                rows = decode_cells(data) if self.cells else decode(data, self.wanted["elem_type"], self.wanted["id"], self.columns)
                if rows:
                    yield batch_of(rows, CELL_TYPES if self.cells else TYPES)


class PbfSource(DataSource):
    """spark.read.format("mappbf"): paths (comma-joined) on a file system that all executors mount."""

    @classmethod
    def name(cls):
        return "mappbf"

    def schema(self):
        return "elem_type int, id long, quadtree long" if self.options.get("cells") == "true" else SCHEMA

    def reader(self, schema):
        return PbfReader(self.options)


def read(spark, *paths: str, partition_bytes: int = 64 << 20, columns: list[str] | None = None, cells: bool = False) -> DataFrame:
    """Rows of map files. columns: of info, tags, refs and members, only those named are decoded, others are null (Spark tells Python sources no columns). cells: elem_type, id and quadtree alone."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PbfSource)
    return spark.read.format("mappbf").option("partitionBytes", str(partition_bytes)).option("cells", str(cells).lower()).option("columns", ",".join(columns or ())).load(",".join(paths))


def write(df: DataFrame, path: str, block: int = 8000, compression: str = "zlib", level: int | None = None, as_change: bool = False, index: bool = True, **about) -> int:
    """df (rows of SCHEMA, or elem_type, id and quadtree alone) as files in the folder path, one for each partition in its order; the number of blocks.

    index: the header lists each block's tile and length where rows have tiles. about: further fields of header(). The
    folder must be one that all executors mount. Each file is written under another name first, so a task that runs twice
    leaves one whole file.
    """
    cells = set(df.columns) == {"elem_type", "id", "quadtree"}
    os.makedirs(path, exist_ok=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():05d}.osm.pbf"
        own, items, tile = [], [], None
        with open(f"{name}.{task.taskAttemptId()}.data", "w+b") as data, open(f"{name}.{task.taskAttemptId()}", "wb") as f:

            def flush() -> None:
                content = encode_cells([(d["elem_type"], d["id"], d["quadtree"]) for d in own]) if cells else encode(own, tile, as_change)
                items.append((tile, data.write(frame("OSMData", content, compression, level)), as_change))
                own.clear()

            for d in (d for batch in batches for d in batch.to_pylist()):
                if own and (len(own) >= block or d.get("tile") != tile):
                    flush()
                tile = d.get("tile")
                own.append(d)
            if own:
                flush()
            known = index and all(t is not None for t, _, _ in items)
            f.write(frame("OSMHeader", header(index=items if known else None, **about), compression, level))
            data.seek(0)
            shutil.copyfileobj(data, f)
        os.remove(data.name)
        os.replace(f.name, name)
        yield pa.record_batch({"n": pa.array([len(items)], pa.int64())})

    return df.mapInArrow(save, "n long").agg(F.sum("n")).first()[0] or 0
