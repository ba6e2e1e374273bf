"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, a scan of every document's token windows, a check of each hit, and its spans.

The set is broadcast only below max_windows windows; a larger benchmark is dealt into blocks of about that many. Each
block scans all documents in a job of its own, whose hits are written and which then gives its memory back, so no task
holds more than one block; the hits of all blocks meet the documents by their texts' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import free_prefix, written

WIDTH = 8
#: Word bytes map to themselves or lower case, all other ASCII bytes to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BASE = 0x9E3779B97F4A7C15


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split()


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window."""
    n = len(ids) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(BASE)
        out += ids[k : k + n]
    return out ^ (out >> np.uint64(29))


class Windows:
    """The windows of some benchmark items: word ids, and for each width the sorted hashes with each window's words and items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], width: int):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, ws in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]
            w = min(width, len(own))
            for k in range(len(own) - w + 1 if w else 0):
                found.setdefault(tuple(own[k : k + w]), set()).add(item)
        self.tables = {}
        for w in sorted({len(k) for k in found}):
            keys = [k for k in found if len(k) == w]
            hashes = _rolled(np.array(keys, np.uint64).ravel(), w)[::w] if keys else np.zeros(0, np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.tables[w] = (hashes[order], np.array(keys, np.uint64)[order], [sorted(found[keys[i]]) for i in order])

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items found."""
        ids = np.fromiter(map(self.ids.get, ws, [0] * len(ws)), np.uint64, len(ws))
        known = ids != 0
        hit, items = np.zeros(len(ws), bool), set()
        run = np.concatenate([[0], np.cumsum(known)])
        for w, (hashes, keys, owners) in self.tables.items():
            at = np.flatnonzero(run[w:] - run[:-w] == w)  # windows of known words only
            if not len(at):
                continue
            rolled = np.zeros(len(at), np.uint64)
            for k in range(w):
                rolled *= np.uint64(BASE)
                rolled += ids[at + k]
            rolled ^= rolled >> np.uint64(29)
            first = np.searchsorted(hashes, rolled)
            may = np.flatnonzero(first < len(hashes))
            for i in may[hashes[first[may]] == rolled[may]]:
                p, j = at[i], first[i]
                while j < len(hashes) and hashes[j] == rolled[i]:  # equal hashes stand together: each is held against the words
                    if (keys[j] == ids[p : p + w]).all():
                        hit[p : p + w] = True
                        items.update(owners[j])
                    j += 1
        return hit, items


def _edges(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def _scan(block, names: list[str], prefix: str, remove: int | None, old: tuple[str, str] | None = None) -> callable:
    """Scan texts for the items of a block, or, without one, take the hits found before from the columns old. remove: rewrite the texts and leave out those with so many items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, items = [], [], []
            all_texts = batch.column("text").to_pylist()
            before = zip(*(batch.column(c).to_pylist() for c in old), strict=True) if old else [(None, None)] * len(all_texts)
            for text, (edges, had) in zip(all_texts, before, strict=True):
                ws = words(text or "")
                hit, found = block.value.scan(ws) if block else (np.zeros(len(ws), bool), set())
                for a, b in zip((edges or ())[::2], (edges or ())[1::2], strict=True):
                    hit[a:b] = True
                n.append(len(ws))
                spans.append(_edges(hit))
                items.append(sorted(found.union(had or ())))
            columns = [batch.column(c) for c in names]
            if remove is None:
                yield pa.record_batch([*columns, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], [*names, *(prefix + c for c in RESULTS)])
                continue
            columns[names.index("text")] = pa.array([t if t is None else remove_spans(t, e) for t, e in zip(all_texts, spans, strict=True)], pa.string())
            yield pa.record_batch(columns, names).filter(pa.array([len(x) < remove for x in items], pa.bool_()))

    return run


def _hits(docs: DataFrame, blocks: Iterator[Windows]) -> DataFrame:
    """(th, chars, edges, items) of the texts that any block hits, over all blocks."""
    spark, out = docs.sparkSession, None
    rows = docs.where("text is not null").select(F.xxhash64("text").alias("th"), F.length("text").alias("chars"), "text")
    schema = "th long, chars int, text string, n_words long, edges array<long>, items array<long>"
    for windows in blocks:
        shared = spark.sparkContext.broadcast(windows)
        found = rows.mapInArrow(_scan(shared, rows.columns, "", None), schema).where("size(items) > 0")
        part = written(found.groupBy("th", "chars").agg(F.first("edges").alias("edges"), F.first("items").alias("items")), "hits")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("th", "chars").agg(F.flatten(F.collect_list("edges")).alias("edges"), F.flatten(F.collect_list("items")).alias("items"))


RESULTS = ("n_words", "edges", "items")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = 250_000, remove: int | None = None, prefix: str = "__") -> DataFrame:
    """docs with __n_words, __edges (hit spans as word positions: start, end, start, end, ...) and __items (the items found, sorted); prefix stands before these names.

    With remove, instead: docs without the rows that hold so many items or more and without the hit spans of the others;
    n_chars, if there, follows the text. Null texts have no words and stay null; a benchmark without words hits nothing;
    rows of the benchmark with a null are no items, rows that repeat an item_id are one item; repeated rows give a row
    each; an empty table gives none. Other columns pass through; they must not have the names of results. A block holds
    max_windows windows at most, or one item.
    """
    spark, names, p = docs.sparkSession, docs.columns, free_prefix(docs)
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    # A word and its separator take two characters at least, so the length bounds the number of windows.
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n_blocks = max(1, int(np.ceil(total / max_windows)))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    blocks = (Windows([(r["item_id"], words(r["text"])) for r in items.where(block == k).collect()], width) for k in range(n_blocks))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if remove is None:
        kinds += f", `{prefix}n_words` long, `{prefix}edges` array<long>, `{prefix}items` array<long>"
    if n_blocks == 1:
        out = docs.mapInArrow(_scan(spark.sparkContext.broadcast(next(blocks)), names, prefix, remove), kinds)
    else:
        hits = _hits(docs.select("text"), blocks).toDF(*[p + c for c in ("th", "chars", "edges", "items")])
        met = docs.join(hits, (F.xxhash64("text") == F.col(p + "th")) & (F.length("text") == F.col(p + "chars")), "left").select(*[F.col(f"`{c}`") for c in names], p + "edges", p + "items")
        out = met.mapInArrow(_scan(None, names, prefix, remove, (p + "edges", p + "items")), kinds)
    if remove is not None and "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def remove_spans(text: str, edges: list[int]) -> str:
    """The text without its hit words and what stands between them; other words keep their spelling and white space."""
    if not edges:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(WORDS), np.uint8) != 32
    turn = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(np.int8), [0]])))
    starts, ends = turn[::2], turn[1::2]
    out, last = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(raw[last : starts[a]])
        last = int(ends[b - 1])
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")
