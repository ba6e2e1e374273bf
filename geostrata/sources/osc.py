"""osmChange files, plain or gzip, by Spark's XML reader with explicit schemas: once for each section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "array<struct<_k:string,_v:string>>"
INFO = "_id long, _version long, _changeset long, _timestamp timestamp, _uid long, _user string"
SECTION = (
    f"node array<struct<{', '.join(x.replace(' ', ':', 1) for x in INFO.split(', '))},_lon:double,_lat:double,tag:{TAG}>>, "
    f"way array<struct<{', '.join(x.replace(' ', ':', 1) for x in INFO.split(', '))},tag:{TAG},nd:array<struct<_ref:long>>>>, "
    f"relation array<struct<{', '.join(x.replace(' ', ':', 1) for x in INFO.split(', '))},tag:{TAG},member:array<struct<_type:string,_ref:long,_role:string>>>>"
)
SECTIONS = {"create": 5, "modify": 4, "delete": 1}
TYPES = ("node", "way", "relation")


#: What a change file may hold: attributes and children of each element.
INFO_NAMES = ("id", "version", "changeset", "timestamp", "uid", "user", "visible")
ALLOWED = {
    "osmChange": (None, ("create", "modify", "delete", "bounds")),
    "bounds": (None, ()),
    "create": ((), TYPES),
    "modify": ((), TYPES),
    "delete": (("if-unused",), TYPES),
    "node": ((*INFO_NAMES, "lon", "lat"), ("tag",)),
    "way": (INFO_NAMES, ("tag", "nd")),
    "relation": (INFO_NAMES, ("tag", "member")),
    "tag": (("k", "v"), ()),
    "nd": (("ref",), ()),
    "member": (("type", "ref", "role"), ()),
}


class OscError(ValueError):
    pass


def check(content: bytes) -> int:
    """How many elements a change file holds; an unknown element, attribute, member type or text is an error. Streamed: memory doesn't grow with the file."""
    import zlib
    from xml.parsers import expat

    above, n = [], 0

    def start(name, attributes):
        nonlocal n
        if name not in ALLOWED or (above and name not in ALLOWED[above[-1]][1]) or (not above and name != "osmChange"):
            raise OscError(f"unexpected element {name} in {above[-1] if above else 'the file'}")
        known = ALLOWED[name][0]
        if known is not None and (odd := sorted(set(attributes) - set(known))):
            raise OscError(f"unexpected attributes {odd} of {name}")
        if name == "member" and attributes.get("type") not in TYPES:
            raise OscError(f"unexpected member type {attributes.get('type')}")
        if (name in TYPES and "id" not in attributes) or (name == "nd" and "ref" not in attributes) or (name == "tag" and not {"k", "v"} <= attributes.keys()):
            raise OscError(f"{name} lacks an attribute")
        n += name in TYPES
        above.append(name)

    def text(data):
        if data.strip():
            raise OscError(f"unexpected text in {above[-1]}: {data[:40]!r}")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda name: above.pop(), text
    unpack = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
    for at in range(0, len(content), 1 << 20):
        part = content[at : at + (1 << 20)]
        parser.Parse(unpack.decompress(part) if unpack else part, False)
    parser.Parse(unpack.flush() if unpack else b"", True)
    return n


def _check(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.record_batch({"path": batch.column("path"), "n": pa.array([check(c) for c in batch.column("content").to_pylist()], pa.int64())})


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of a change file: elem_type, id, changetype, info, tags, place, refs, members, and pos for the rule on equal versions.

    Spark doesn't tell where in the file a row stood, so pos orders by section (create, modify, delete), then type and
    place in the section's list. A malformed file is an error; with strict, so is all that check() doesn't know.
    """
    from geostrata.functions.quadtree import as_integer

    if strict:
        spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_check, "path string, n long").write.format("noop").mode("overwrite").save()
    out = None
    for n, (section, change) in enumerate(SECTIONS.items()):
        rows = spark.read.format("xml").option("rowTag", section).option("mode", "FAILFAST").schema(SECTION).load(path)
        for kind, name in enumerate(TYPES):
            x = rows.select(F.posexplode(name).alias("i", "e"))
            e = lambda c: F.col(f"e.{c}")
            tags = F.transform(F.coalesce(e("tag"), F.array().cast(TAG)), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("val")))
            refs = F.transform(e("nd"), lambda r: r["_ref"]) if kind == 1 else F.lit(None).cast("array<long>")
            members = F.transform(e("member"), lambda m: F.struct(m["_role"].alias("role"), (F.array_position(F.array(*map(F.lit, TYPES)), m["_type"]) - 1).cast("int").alias("mem_type"), m["_ref"].alias("mem_ref"))) if kind == 2 else F.lit(None).cast("array<struct<role:string,mem_type:int,mem_ref:long>>")
            place = (as_integer(e("_lon")), as_integer(e("_lat"))) if kind == 0 else (F.lit(None).cast("int"),) * 2
            part = x.select(F.lit(kind).alias("elem_type"), e("_id").alias("id"), F.lit(change).alias("changetype"), e("_version").alias("version"), e("_changeset").alias("changeset"), F.unix_seconds(e("_timestamp")).alias("timestamp"), e("_uid").alias("user_id"), e("_user").alias("user"), tags.alias("tags"), place[0].alias("lon"), place[1].alias("lat"), refs.alias("refs"), members.alias("members"), (F.lit(n * 3 + kind).cast("long") * (1 << 40) + F.col("i")).alias("pos"))
            out = part if out is None else out.unionByName(part)
    return out
