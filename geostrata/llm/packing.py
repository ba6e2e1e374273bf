"""Best-fit packing into sequences of a fixed capacity.

Pieces are known by their length alone until the end, and a length is at most the capacity, so the plan works on a
histogram that the capacity bounds, not on the corpus. Large pieces (over a share of the capacity) are sorted by length,
cut into groups of equal cardinality and rounded up to their group's largest length (linear grouping); configurations of
those few sizes are chosen by column generation: the linear relaxation's duals price the sizes, and a knapsack over those
prices gives the next configuration until none is worth more than a sequence. The relaxation is rounded down and the rest
filled by the fullest configurations; real lengths take the places of rounded ones, and small pieces fill the gaps
best-fit, longest first. The plan is a list of runs; a second
distributed step gives each piece its rank among those of its length, which is its place in the runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import written
from geostrata.llm.tokens import encoder

CAPACITY, END = 2048, 0
SALTS = 64


def _pieces(capacity: int, path: str | None) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            out, at = [], 0
            flat, lens = own.batch(batch.column("text"))
            for doc, n in zip(batch.column("doc_id").to_pylist(), lens.tolist(), strict=True):
                raw = flat[at : at + n].tobytes() + end
                at += n
                first = n % capacity + 1  # n + 1 ids
                cuts = [0, *range(first, n + 2, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _groups(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Equal-cardinality groups of the pieces, longest first: runs (length, how many)."""
    total, out, own, room = int(counts.sum()), [], [], 0
    size = -(-total // k)
    room = size
    for length, n in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while n:
            take = min(n, room)
            own.append((length, take))
            n -= take
            room -= take
            if not room:
                out.append(own)
                own, room = [], size
    return out + [own] if own else out


def _worth_most(sizes: list[int], prices: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size a sequence of the highest total price holds."""
    values = [np.zeros(capacity + 1)]
    for size, price in zip(sizes, prices.tolist(), strict=True):
        v = values[-1].copy()
        if price > 0:
            for _ in range(capacity // size):
                v[size:] = np.maximum(v[size:], v[:-size] + price)
        values.append(v)
    out, room = np.zeros(len(sizes), np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        while room >= sizes[k] and values[k + 1][room] > values[k][room] + 1e-12:
            out[k] += 1
            room -= sizes[k]
    return out


def relaxed(sizes: list[int], demand: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (a column each) and how often the linear relaxation uses each, by column generation. Every basis is feasible, so the bound on the steps costs quality at most."""
    d = np.array(demand, float)
    basis = np.diag([float(capacity // x) for x in sizes])
    for _ in range(40 * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        new = _worth_most(sizes, prices, capacity)
        if prices @ new <= 1 + 1e-9:
            break
        times, turn = np.linalg.solve(basis, d), np.linalg.solve(basis, new.astype(float))
        ratio = np.where(turn > 1e-9, times / np.maximum(turn, 1e-9), np.inf)
        basis[:, int(ratio.argmin())] = new
    return basis, np.linalg.solve(basis, d)


def _configurations(sizes: list[int], demand: list[int], capacity: int, relax: bool = True) -> list[tuple[tuple[int, ...], int]]:
    """(how many of each size, times): fills the demand by the rounded relaxation, and what is left by the fullest configurations."""
    left, out = np.array(demand), []
    if relax:
        columns, times = relaxed(sizes, demand, capacity)
        for column, n in zip(columns.T.round().astype(np.int64), np.floor(np.maximum(times, 0) + 1e-6).astype(np.int64).tolist(), strict=True):
            n = min([n, *(left[column > 0] // column[column > 0]).tolist()])
            if n:
                out.append((tuple(column.tolist()), n))
                left -= n * column
    return out + _fullest(sizes, left.tolist(), capacity)


def _fullest(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(how many of each size, times): each step takes the fullest configuration that holds the largest size left (a knapsack over what is left), as often as the demand lasts."""
    left, out = list(demand), []
    while any(left):
        best: dict[int, tuple[int, ...]] = {}
        lead = next(k for k, n in enumerate(left) if n)  # sizes descend
        room = capacity - sizes[lead]
        used: dict[int, tuple[int, ...]] = {0: ()}
        for k in range(lead, len(sizes)):
            n = left[k] - (k == lead)
            if n <= 0 or sizes[k] > room:
                continue
            for f in sorted(used):
                for m in range(1, n + 1):
                    g = f + m * sizes[k]
                    if g > room:
                        break
                    if g not in used:
                        best[g] = (*used[f], *[k] * m)
            used |= best
            best = {}
            if room in used:
                break
        take = (lead, *used[max(used)])
        config = tuple(take.count(k) for k in range(len(sizes)))
        times = min(left[k] // c for k, c in enumerate(config) if c)
        for k, c in enumerate(config):
            left[k] -= c * times
        out.append((config, times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 24, large: float = 0.125, relax: bool = True) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces a sequence, offset) and the number of sequences.

    The pieces of a length take its runs in order of rank: in a run, rank r is in sequence first + (r - rank) // pieces,
    at offset + (r - rank) % pieces * length.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(histogram, 0)
    big = sorted(x for x in histogram if x > capacity * large)
    small = sorted((x for x in histogram if x <= capacity * large), reverse=True)
    bins: dict[int, list[list[int]]] = {}  # what is left in a sequence -> [first sequence, how many]
    sequences = 0
    if big:
        grouped = _groups(np.array(big), np.array([histogram[x] for x in big]), groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for g in grouped:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = sorted(merged, reverse=True)
        stock = [list(merged[s]) for s in sizes]
        for config, times in _configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity, relax):
            while times:
                slots = [k for k, c in enumerate(config) for _ in range(c)]
                # Real lengths replace the rounded ones: as many sequences alike as the shortest run of each slot's size allows.
                alike = times
                for k in set(slots):
                    alike = min(alike, max(1, stock[k][0][1] // config[k]))
                offset = 0
                for k in slots:
                    need = alike
                    length, n = stock[k][0]
                    if n < need:  # the run ends inside this slot: one sequence at a time
                        raise AssertionError("runs are cut to fit")
                    runs.append((length, rank[length], sequences, 1, offset))
                    rank[length] += need
                    stock[k][0] = (length, n - need)
                    if n == need:
                        stock[k].pop(0)
                    offset += length
                bins.setdefault(capacity - offset, []).append([sequences, alike])
                sequences += alike
                times -= alike
    for length in small:
        n = histogram[length]
        while n:
            fit = min((r for r in bins if r >= length), default=None)
            if fit is None:
                each = capacity // length
                new = -(-n // each)
                bins.setdefault(capacity, []).append([sequences, new])
                sequences += new
                fit = capacity
            first, many = bins[fit].pop()
            if not bins[fit]:
                del bins[fit]
            each = min(fit // length, n)
            full = min(many, n // each)
            runs.append((length, rank[length], first, each, capacity - fit))
            rank[length] += each * full
            n -= each * full
            if fit - each * length:
                bins.setdefault(fit - each * length, []).append([first, full])
            if many > full:
                bins.setdefault(fit, []).append([first + full, many - full])
    return runs, sequences


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan with the fewest sequences over a few numbers of groups and shares of large pieces, with the relaxation and by the fullest configurations alone."""
    tried = (plan(histogram, capacity, groups, large, relax) for relax in (True, False) for large in (0.1, 0.25, 0.5) for groups in (12, 24, 48, 96))
    return min(tried, key=lambda p: (p[1], len(p[0])))


def _place(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(runs[:, 0], length * (1 << 40) + rank, "right") - 1
            r = rank - runs[at, 1]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(runs[at, 2] + r // runs[at, 3]), pa.array(runs[at, 4] + r % runs[at, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one end id, so null and empty texts are one id. Only longer documents than the capacity are
    cut, into pieces of it; the first piece may be shorter. Sequence ids run from 0 without gaps. Rows that repeat are
    packed each; a null doc_id is kept; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = written(rows.mapInArrow(_pieces(capacity, tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").count().collect()  # bounded: capacity x salts
    histogram: dict[int, int] = {}
    before = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["salt"])):
        before[r["length"], r["salt"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = before[r["length"], r["salt"]] + r["count"]
    runs, _ = best_plan(histogram, capacity)
    table = np.array([(length * (1 << 40) + rank, rank, first, each, offset) for length, rank, first, each, offset in runs], np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table[np.argsort(table[:, 0], kind="stable")])
    starts = docs.sparkSession.createDataFrame([(a, b, c) for (a, b), c in before.items()] or [(0, 0, 0)], "length long, salt int, before long")
    # A hot length is ranked in parts: the part's start is known, so no task holds all pieces of a length.
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("in_salt", F.row_number().over(order) - 1).join(F.broadcast(starts), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("in_salt"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
