"""SimHash near-dedup by exact tiled comparison.

Equal fingerprints meet first, by partial aggregation, so the comparison sees each value once. Groups of one population
count (or a part of one) become tiles of packed numbers; a tile meets only tiles whose population counts lie within the
radius, and inside such a pair only sub-tiles whose population counts of the four 16-bit words differ by the radius or
less in sum. Each task returns a spanning forest of the links it finds, never all pairs of a group; forests meet in a
distributed search for components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import lean, release, texts, written

RADIUS, SHINGLE = 3, 3
TILE, TILES = 1 << 20, 16  # fingerprints in a tile at most, about; tiles at least, if they hold a thousand
HOT = 4  # a node is hot if it holds more than a HOT-th of an even partition


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    line, h = b" ".join(ws), xxhash.xxh64_intdigest
    n = len(ws) - width + 1
    if n < 1:
        return h(line, 42)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = (ends - np.fromiter(map(len, ws), np.int64, len(ws)) - 1)[:n].tolist()
    hashes = np.array([h(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        counts += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(f.view(np.int64))})


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indexes reaches over the links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _signature(f: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest over the links between fingerprints of a and of b: pairs of indexes into a and b. Both ascend by signature."""
    sa, sb = _signature(a), _signature(b)
    cut_a = np.concatenate([[0], np.flatnonzero((sa[1:] != sa[:-1]).any(1)) + 1]) if len(a) else np.zeros(0, int)
    cut_b = np.concatenate([[0], np.flatnonzero((sb[1:] != sb[:-1]).any(1)) + 1]) if len(b) else np.zeros(0, int)
    stop_a, stop_b = np.append(cut_a[1:], len(a)), np.append(cut_b[1:], len(b))
    kinds_b = sb[cut_b]
    out_a, out_b, waiting = [np.zeros(0, int)], [np.zeros(0, int)], 0
    for lo, hi in zip(cut_a, stop_a, strict=True):
        near = np.flatnonzero(np.abs(kinds_b - sa[lo]).sum(1) <= radius)
        if not len(near):
            continue
        at = np.concatenate([np.arange(cut_b[k], stop_b[k]) for k in near])
        step = max(1, 4_000_000 // len(at))
        for k in range(lo, hi, step):
            i, j = np.nonzero(np.bitwise_count(a[k : min(hi, k + step), None] ^ b[None, at]) <= radius)
            out_a.append(i + k)
            out_b.append(at[j])
            waiting += len(i)
            if waiting > 2_000_000:  # a large group of near copies: only a forest of it is kept
                x, y = _forest(len(a), len(b), np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b, waiting = [x], [y], 0
    return _forest(len(a), len(b), np.concatenate(out_a), np.concatenate(out_b))


def _forest(n: int, m: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links over the same components: of each component, its smallest member of a with all of b, and its first of b with all of a."""
    if not len(x):
        return x, y
    root = _roots(n + m, x, y + n)
    b_at = np.unique(y)
    first_b = np.full(n + m, -1)
    first_b[root[b_at[::-1] + n]] = b_at[::-1]
    a_at = np.unique(x)
    return np.concatenate([root[b_at + n], a_at]), np.concatenate([b_at, first_b[root[a_at]]])


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    f = pdf["fp"].to_numpy().view(np.uint64)
    s = _signature(np.ascontiguousarray(f)).astype(np.int64)
    order = np.lexsort((f, s[:, 3], s[:, 2], s[:, 1], s[:, 0]))
    return pd.DataFrame({"p": [pdf["p"].iloc[0]], "part": [pdf["part"].iloc[0]], "fps": [f[order].tobytes()], "ids": [pdf["id"].to_numpy()[order].tobytes()]})


def _compare(radius: int) -> callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = [(np.frombuffer(f, np.uint64), np.frombuffer(i, np.int64)) for f, i in zip(pdf["fps"], pdf["ids"], strict=True)]
        (a, ia), (b, ib) = tiles[0], tiles[-1]  # one tile: it meets itself
        x, y = links(a, b, radius)
        u, v = ia[x], ib[y]
        keep = u != v
        return pd.DataFrame({"u": np.minimum(u, v)[keep], "v": np.maximum(u, v)[keep]}).drop_duplicates()

    return run


def near_links(points: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """Links (u < v) whose components are those of all pairs of points (fp, id) within radius bits. fp and id are distinct.

    Tiles are large, since each travels to all that it meets, but no tile holds more than a share of all fingerprints, so
    that a common population count doesn't fall to one task.
    """
    p = F.bit_count("fp")
    sizes = {r["p"]: r["count"] for r in points.groupBy(p.alias("p")).count().collect()}  # 65 rows at most
    if not sizes:
        return points.sparkSession.createDataFrame([], "u long, v long")
    tile = tile or max(1000, min(TILE, sum(sizes.values()) // TILES))
    groups: list[list[int]] = []  # neighbouring population counts that fill a tile together
    for k in sorted(sizes):
        if groups and sum(sizes[x] for x in groups[-1]) + sizes[k] <= tile:
            groups[-1].append(k)
        else:
            groups.append([k])
    parts = [max(1, -(-sum(sizes[x] for x in g) // tile)) for g in groups]
    first = [sum(parts[:g]) for g in range(len(groups))]
    near = [[h for h in range(len(groups)) if any(abs(x - y) <= radius for x in groups[g] for y in groups[h])] for g in range(len(groups))]
    of = lambda pairs, key: F.element_at(F.create_map(*[F.lit(int(x)) for kv in pairs for x in kv]), key)
    group = of([(k, g) for g, own in enumerate(groups) for k in own], p)
    dealt = points.select("fp", "id", group.alias("p"), F.pmod(F.xxhash64("fp"), of(enumerate(parts), group)).cast("int").alias("part"))
    tiles = written(dealt.groupBy("p", "part").applyInPandas(_pack, "p int, part int, fps binary, ids binary"), "tiles")
    # Each tile goes to the pairs it belongs to: with every tile of its own group, and of those within the radius.
    own = of(enumerate(first), F.col("p")) + F.col("part")
    low = of([(g, first[near[g][0]]) for g in range(len(groups))], F.col("p"))
    high = of([(g, first[near[g][-1]] + parts[near[g][-1]] - 1) for g in range(len(groups))], F.col("p"))
    met = tiles.withColumn("t", own).withColumn("o", F.explode(F.sequence(low, high)))
    pairs = met.select(F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "fps", "ids")
    return pairs.groupBy("i", "j").applyInPandas(_compare(radius), "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of the links u < v reaches; by large-star and small-star steps, each written, until nothing changes."""
    now, held = written(edges.distinct(), name), []
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    n_now = now.count()
    while True:
        both = now.union(now.select("v", "u"))
        around = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), name)
        down = written(_star(both, around, 2 * n_now, F.col("v") > F.col("u")).toDF("u", "v").distinct(), name)  # u > v
        low = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        new = written(_star(down, low, down.count(), F.lit(True)).union(low.select("u", "m")).select(F.least("u", "m").alias("u"), F.greatest("u", "m").alias("v")).where("u < v").distinct(), name)
        for table in held:  # what the round before read
            release(table)
        held = [around, low, down, now]
        n_new = new.count()
        if n_new == n_now and new.exceptAll(now).isEmpty():
            return new.select(F.col("v").alias("node"), F.col("u").alias("root"))
        now, n_now = new, n_new


def _star(links_: DataFrame, low: DataFrame, n_links: int, which) -> DataFrame:
    """Each neighbour v that which admits, tied to the smallest node m around u. low: u, m and n, the number of links of u.

    The centre of a large star would bring all its links to one task. Nodes that hold more links than a share of a
    partition are fewer than HOT x partitions, so those are broadcast and their links stay where they are.
    """
    share = n_links // (HOT * int(links_.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = low.where(F.col("n") > share).select("u", "m")
    known = links_.where(which).join(F.broadcast(hot), "u", "left")
    rest = known.where("m is null").select("u", "v").join(low.where(F.col("n") <= share).select("u", "m"), "u")
    return known.where("m is not null").select("u", "v", "m").unionByName(rest.select("u", "v", "m")).select(F.col("v").alias("u"), "m").where("u <> m")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and component_id, a row for each row of docs (doc_id, text).

    Null or empty texts have fingerprint zero and link like others. component_id is the smallest doc_id that the links
    reach. Rows with a null doc_id get a fingerprint, take no part in links and have a null component_id. Rows that repeat
    a doc_id with other texts join their components. An empty table gives no rows.
    """
    prints = written(texts(docs).mapInArrow(lean(_prints), "doc_id long, fp long"), "prints")
    known = prints.where("doc_id is not null")
    points = written(known.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "points")
    edges = near_links(points.select("fp", "id"), radius)
    twice = known.distinct().groupBy("doc_id").agg(F.count("fp").alias("n")).where("n > 1").select("doc_id")
    tied = known.distinct().join(twice, "doc_id").join(points, "fp").select(F.least("doc_id", "id").alias("u"), F.greatest("doc_id", "id").alias("v")).where("u < v")
    found = components(edges.union(tied))
    by_fp = points.join(found, points["id"] == found["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "id").alias("root"), "n")
    # Fingerprints of more rows than a share of a partition are few: they are broadcast, so copies don't meet in one task.
    share = prints.count() // (HOT * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(by_fp.where(F.col("n") > share).select("_fp", "root"))
    met = prints.join(hot, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "root")
    cold = met.where("root is null").select("doc_id", "fp").join(by_fp.where(F.col("n") <= share), F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "root")
    return met.where("root is not null").unionByName(cold).select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))
