"""Helpers shared by the training-data operators: inputs, scratch tables, text scans."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.plans.scratch import release, written

__all__ = ["SPACE", "free_prefix", "lean", "release", "table", "texts", "written"]

#: White space that separates words: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, null texts as empty ones: other columns can't clash with ours."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def free_prefix(*tables: DataFrame) -> str:
    """A prefix that no column of the tables has, in any case: names of our own that can't clash with theirs."""
    out = "__"
    while any(c.lower().startswith(out) for t in tables for c in t.columns):
        out += "_"
    return out


def lean(run: Callable, rows: int = 1000) -> Callable:
    """run, for mapInArrow, over slices of so many rows, so that few texts are Python objects at once.

    After each batch, and at the end, freed memory goes back to the system: Python workers outlive their tasks, and what
    their allocators keep counts beside the executor's heap in all stages that follow.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)
            _give_back()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(slices(batches))
        gc.collect()
        _give_back()

    return out


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
