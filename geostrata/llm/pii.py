"""Personal data by bootstrapped contextual extraction.

Rules find seed entities. The words around them and their own make-up are lexical patterns; other identifier-shaped tokens
are candidates tied to the same patterns. Spark scores this pattern - instance graph in rounds: a pattern is trusted by
the number of accepted instances and their share of all it meets, a candidate joins when enough trusted patterns agree on
it, and the next round starts from the larger set, until none joins. Everything between the two ends is joins and sums of
narrow rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import release, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can start inside a run of digits unless one starts at the run, so the look-behinds change nothing but the time.
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
#: Digits in groups with one or two separators between.
GROUPS = re.compile(rb"(?<![0-9A-Za-z])[+(]?[0-9](?:[0-9]|[ .()/-]{1,2}(?=[0-9]))*+")
OPENERS, REST = b" \t\n\r\x0b\x0c\"'(<[{,;", re.compile(rb"[^\s\"')>\]},;]*")
AROUND = 256  # characters on each side that the words of a context are taken from
NO_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def flat(text: str) -> bytes:
    """One byte a code point; those outside Latin-1 become '?', which no rule admits."""
    return text.encode("latin-1", "replace")


def base_spans(b: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, last, p = [], 0, b.find(b"@")
    while p >= 0:
        s = p
        while s > last and b[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(b, p + 1) if s < p else None
        if m:
            out.append((0, s, m.end()))
            last = m.end()
        p = b.find(b"@", max(p + 1, last))
    out += [(1, *m.span()) for m in IP.finditer(b) if all(len(x.lstrip(b"0")) < 4 and int(x[-3:]) < 256 for x in m[0].split(b"."))]
    for m in CARD.finditer(b):
        digits = m[0].translate(None, NO_DIGITS)
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(b) if 9 <= len(m[0].translate(None, NO_DIGITS)) <= 15]
    return out


def _hash(*parts: bytes) -> int:
    h = xxhash.xxh64_intdigest(b"\0".join(parts))
    return h - (1 << 64) if h >= 1 << 63 else h


def patterns(kind: int, text: str, start: int, end: int) -> list[int]:
    """The lexical patterns of a span. Of its context: the word before, two before, the word after, and both sides, in lower case. Of its own make-up: runs of letters and digits and the signs between; and what follows its @, or its groups with its first signs. The make-up of a card tells nothing: the check sum does."""
    left = text[max(0, start - AROUND) : start].lower().split()[-2:]
    right = text[end : end + AROUND].lower().split(None, 1)[:1]
    own = text[start:end].lower()
    l1, l2, r1 = (left[-1] if left else "^"), (" ".join(left) if len(left) == 2 else "^"), (right[0] if right else "$")
    make = re.sub("[0-9]+", "0", re.sub("[^\\W0-9_]+", "a", own))
    tail = own.partition("@")[2] if "@" in own else re.sub("[0-9]", "0", own) + own[:3]
    found = [("L", l1), ("LL", l2), ("R", r1), ("LR", l1, r1)] + [("M", make), ("T", tail)] * (KINDS[kind] != "card")
    return [_hash(*(x.encode("utf-8", "surrogatepass") for x in p)) for p in found]


def shaped(token: bytes) -> int | None:
    """The kind whose shape an identifier has, without that kind's rules."""
    digits = len(token.translate(None, NO_DIGITS))
    if b"@" in token:
        return 0 if len(token) >= 4 else None
    if token.count(b".") == 3 and digits >= 4 and not token.translate(None, b"0123456789."):
        return 1
    return 2 if digits >= 12 else 3 if digits >= 6 else None


def candidates(b: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifier-shaped tokens outside the base spans, whole: words with @, and groups of digits that no letter follows."""
    words, last, p = [], 0, b.find(b"@")
    while p >= 0:
        s = max(last, *(b.rfind(bytes([c]), last, p) + 1 for c in OPENERS))
        last = REST.match(b, p).end()
        words.append((s, last))
        p = b.find(b"@", last)
    groups = [m.span() for m in GROUPS.finditer(b) if not b[m.end() : m.end() + 1].isalpha()]
    taken = sorted([(s, e) for _, s, e in base] + words)
    out = []
    for found, blocks in ((words, sorted((s, e) for _, s, e in base)), (groups, taken)):
        k, reach = 0, -1  # reach: the last end of the blocks that begin before the candidate's end
        for s, e in found:
            while e > s and b[e - 1] in b".!?:)":
                e -= 1
            while k < len(blocks) and blocks[k][0] < e:
                reach = max(reach, blocks[k][1])
                k += 1
            kind = shaped(b[s:e]) if reach <= s else None
            if kind is not None:
                out.append((kind, s, e))
    return out


ENTITY = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("seed", pa.bool_()), ("inst", pa.int64()), ("pats", pa.list_(pa.int64()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            b = flat(text)
            base = base_spans(b)
            both = [(True, x) for x in base] + [(False, x) for x in candidates(b, base)]
            found.append([{"k": k, "s": s, "e": e, "seed": seed, "inst": _hash(KINDS[k].encode(), b[s:e].lower()), "pats": patterns(k, text, s, e)} for seed, (k, s, e) in both])
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "th": batch.column("th"), "found": pa.array(found, pa.list_(ENTITY))})


HOT = 4  # a pattern or an instance is hot if it holds more than a HOT-th of an even partition


def _semi(links: DataFrame, keys: DataFrame, on: list[str], hot: str) -> DataFrame:
    """links whose key is in keys. Both say which keys are hot: those are fewer than HOT x partitions and broadcast, so their links stay where they are."""
    warm = links.where(hot).join(F.broadcast(keys.where(hot).select(*on)), on, "left_semi")
    return warm.unionByName(links.where(f"not {hot}").join(keys.where(f"not {hot}").select(*on), on, "left_semi"))


def weighed(graph: DataFrame) -> DataFrame:
    """graph (k, inst, pat, seed, distinct) with n, how many instances the pattern meets, and whether the pattern and the instance are hot."""
    spark = graph.sparkSession
    least = graph.count() // (HOT * int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = graph.groupBy("k", "inst", "pat").agg(F.max("seed").alias("seed"))
    # An identifier counts once for a pattern, of whatever kind.
    met = written(links.groupBy("pat").agg(F.count("*").alias("n")), "patterns")
    busy = links.groupBy("k", "inst").agg(F.count("*").alias("c"))
    often = written(met.where(F.col("n") > least), "hot-patterns")
    wide = written(busy.where(F.col("c") > least).select("k", "inst", F.lit(True).alias("hot_inst")), "hot-instances")
    out = links.join(F.broadcast(often.select("pat", F.col("n").alias("many"))), "pat", "left").join(F.broadcast(wide), ["k", "inst"], "left")
    cold = out.where("many is null").drop("many").join(met.where(F.col("n") <= least), "pat")
    both = cold.unionByName(out.where("many is not null").withColumnRenamed("many", "n"))
    return both.select("k", "inst", "pat", "seed", "n", F.coalesce("hot_inst", F.lit(False)).alias("hot_inst"), (F.col("n") > least).alias("hot_pat"))


def promoted(graph: DataFrame, precision: float, support: int, agree: int) -> DataFrame:
    """Instances (k, inst) that the seeds lead to, over graph: distinct (k, inst, pat, seed). Rounds go on until no instance joins; each only adds, so there is an end."""
    links = written(weighed(graph), "links")
    seeds = links.where("seed").select("k", "inst", "hot_inst").distinct()
    open_ = links.where("not seed")
    accepted, size, spent = seeds, -1, []
    while True:
        held = _semi(links, accepted, ["k", "inst"], "hot_inst").groupBy("k", "pat").agg(F.count("*").alias("f"), F.max("n").alias("n"), F.max("hot_pat").alias("hot_pat"))
        good = written(held.where((F.col("f") >= support) & (F.col("f") >= precision * F.col("n"))).select("k", "pat", "hot_pat"), "good")
        new = written(_semi(open_, good, ["k", "pat"], "hot_pat").groupBy("k", "inst").agg(F.count("*").alias("c"), F.max("hot_inst").alias("hot_inst")).where(F.col("c") >= agree).select("k", "inst", "hot_inst"), "promoted")
        now = new.count()
        for table in spent:  # what the round before read
            release(table)
        if now == size or not now:
            return new.select("k", "inst")
        accepted, size, spent = seeds.union(new), now, [good, new]


FOUND = "array<struct<k:int,s:int,e:int,seed:boolean,inst:bigint,pats:array<bigint>>>"


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and found: the seeds and candidates of each row, with their patterns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    return written(rows.mapInArrow(_scan, f"doc_id long, th long, found {FOUND}"), "entities")


def graph_of(scanned: DataFrame) -> DataFrame:
    """Distinct (k, inst, pat, seed) of the entities. An instance that is a seed anywhere is a seed."""
    one = scanned.where("size(found) > 0").select(F.explode("found").alias("x")).select("x.k", "x.inst", "x.seed", F.explode("x.pats").alias("pat"))
    links = written(one.groupBy("k", "inst", "pat").agg(F.max("seed").alias("seed")), "graph")
    known = links.where("seed").select("k", "inst", F.lit(True).alias("known")).distinct()
    return links.join(known, ["k", "inst"], "left").select("k", "inst", "pat", F.coalesce("known", F.lit(False)).alias("seed"))


def find(docs: DataFrame, precision: float = 0.6, support: int = 5, agree: int = 2, max_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, base and spans of each row of docs (doc_id, text): arrays of (k: kind, s: start, e: end), by kind and start.

    base are the rules' spans; spans adds the candidates that the patterns promote: at least agree patterns must point to
    it, each met by support accepted instances of its kind or more that make up the share precision of all it meets. The
    promoted instances meet the candidates by a broadcast up to max_broadcast of them and by a shuffle beyond. Null texts
    are empty and have no spans; a null doc_id is kept; repeated rows give a row each; an empty table gives none.
    """
    scanned = entities(docs)
    new = promoted(graph_of(scanned), precision, support, agree)
    new = F.broadcast(new) if new.count() <= max_broadcast else new
    one = scanned.where("size(found) > 0").select("doc_id", "th", F.explode("found").alias("x")).where("not x.seed").select("doc_id", "th", "x.*")
    more = one.join(new, ["k", "inst"], "left_semi")
    extra = more.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("k", "s", "e")).alias("_more"))
    spans = F.transform(F.filter("found", lambda x: x["seed"]), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    joined = scanned.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    both = F.when(F.col("_more").isNull(), spans).otherwise(F.array_sort(F.concat(spans, "_more")))
    return joined.select("doc_id", spans.alias("base"), both.alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
