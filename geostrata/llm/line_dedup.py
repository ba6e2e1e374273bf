"""Line dedup in DataFrame operations only: hashes of lines are range-partitioned with documents and positions in order,
first occurrences are taken from that stream, and each document gets a run-length coded keep bitmap instead of its text.

A line that a third of all documents share would fill one range. Such keys are few by count, so their first documents
are broadcast and their rows never move; all others are streamed in order of hash, document and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import SPACE, free_prefix, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT = 4  # a key is hot if it holds more than a HOT-th of an even range


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. lower() does that unless it also changes another character; only then the slower translate()."""
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(other) == other, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_runs(docs: DataFrame, min_chars: int = 10, name: str = "lines") -> DataFrame:
    """For each document and text that loses lines: _id, _hash (of the text), and its keep bitmap as runs: dropped[i] = (start, end) of line positions, end exclusive, in order."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    # No key is longer than its line, so short lines leave before the work on characters.
    key = ascii_lower(F.btrim(F.col("line"), F.lit(SPACE)))
    # Lower-casing A-Z keeps the length, so the filter needs the stripped line only.
    keyed = rows.where((F.length("line") >= min_chars) & (F.length(F.btrim(F.col("line"), F.lit(SPACE))) >= min_chars)).select("doc_id", "th", "pos", key.alias("key"))
    narrow = keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h"), F.hash("key", F.lit(7)).alias("h2"))
    # Range bounds come from a sample, which would split and hash all texts again: the narrow rows are written once.
    stored = written(narrow, name)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys that hold more rows than a share of a range are fewer than HOT x parts, whatever the data: their first
    # documents are broadcast, so a line that a third of all documents share never meets in one task.
    share = stored.count() // (HOT * parts)
    hot = written(stored.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > share).select("h", "h2", "first"), name + "-hot")
    known = stored.join(F.broadcast(hot), ["h", "h2"], "left")
    stream = known.where("first is null").drop("first").repartitionByRange(parts, "h", "h2").sortWithinPartitions("h", "h2", "doc_id", "pos")
    seen = stream.withColumn("first", F.first("doc_id").over(Window.partitionBy("h", "h2").orderBy("doc_id", "pos")))
    later = known.unionByName(seen).where("doc_id > first").select("doc_id", "th", "pos")
    by = later.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_hash")).agg(F.array_sort(F.collect_set("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get(F.col("p"), i - 1) != x - 1))
    stops = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get(F.col("p"), i + 1) != x + 1))
    return by.select("_id", "_hash", F.size("p").cast("long").alias("_n"), F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end"))).alias("_dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines between the dropped runs, joined by line ends. The text is split once: the array of one binds its lines to a name."""
    return F.get(F.transform(F.array(_lines(text)), lambda lines: _between(lines, dropped)), 0)


def _between(lines: Column, dropped: Column) -> Column:
    n = F.size(dropped)
    before = F.transform(dropped, lambda r, i: F.slice(lines, F.when(i == 0, 0).otherwise(F.get(dropped, i - 1)["end"]) + 1, r["start"] - F.when(i == 0, 0).otherwise(F.get(dropped, i - 1)["end"])))
    after = F.slice(lines, F.get(dropped, n - 1)["end"] + 1, F.size(lines))
    return F.array_join(F.concat(F.flatten(before), after), "\n")


def line_dedup(docs: DataFrame, min_chars: int = 10, prefix: str = "_") -> DataFrame:
    """docs with _n (lines dropped), _dropped (runs of dropped lines; null: none) and _kept (the text of the other lines); prefix stands before these names.

    A line's key is the line stripped of white space and lower-cased in A-Z; a key of min_chars code points found in two
    documents loses its lines everywhere but in the smallest doc_id. Null or empty texts are one empty line. Rows with a
    null doc_id keep all lines and hold no keys; rows that repeat a doc_id are one document; empty tables give no rows.
    Other columns pass through; they must not have the names of results. Lines are told apart by 96 bits of hash.
    """
    p, text = free_prefix(docs), F.coalesce(F.col("text"), F.lit(""))
    runs = drop_runs(docs.select("doc_id", "text"), min_chars).toDF(*[p + c for c in ("id", "hash", "n", "dropped")])
    joined = docs.join(runs, (F.col("doc_id") == F.col(p + "id")) & (F.xxhash64(text) == F.col(p + "hash")), "left")
    kept = F.when(F.col(p + "n").isNull(), text).otherwise(kept_text(F.col("text"), F.col(p + "dropped")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(p + "n", F.lit(0).cast("long")).alias(prefix + "n"), F.col(p + "dropped").alias(prefix + "dropped"), kept.alias(prefix + "kept"))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")
