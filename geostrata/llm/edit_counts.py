"""Edit-aware token counts: a segment tree of pre-token chunks for each document; an edit re-encodes the chunks that it
touches and the chunk before them, and the sums above those leaves follow.

A chunk starts at a space before a character that is no white space, where every encoding has a boundary. What comes
after the touched chunks starts so and stays as it is; the chunk before may grow into them, so it is encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.llm.tokens import Encoder, encoder


class Tree:
    """Sums of characters and tokens over the leaves; node k has children 2k and 2k + 1, leaf i is node size + i."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.size = 1 << max(0, int(len(chars) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(chars), 1] = tokens
        lo = self.size
        while lo > 1:
            self.sums[lo // 2 : lo] = self.sums[lo : 2 * lo : 2] + self.sums[lo + 1 : 2 * lo : 2]
            lo //= 2

    def leaf(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if position >= before + self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.size, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        delta = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += delta
            node //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])


Edit = tuple[int, int, str]


def cleaned(edits: list[dict | None] | None, size: int) -> list[Edit]:
    """Edits by start and end, within a text of size characters, apart from each other. A null, or one with a null place, is none; an end before the start is the start; what overlaps the edit before begins where that ends."""
    out: list[Edit] = []
    for start, end, new in sorted((e["start"], e["end"], e["new"] or "") for e in edits or () if e and e["start"] is not None and e["end"] is not None):
        start = min(max(start, out[-1][1] if out else 0), size)
        out.append((start, min(max(end, start), size), new))
    return out


def edited(text: str, edits: list[Edit]) -> str:
    """The text after all edits, as cleaned; their places are those of the text before."""
    for start, end, new in reversed(edits):
        text = text[:start] + new + text[end:]
    return text


def apply(tree: Tree, text: str, edits: list[Edit], own: Encoder) -> tuple[str, int]:
    """Bring tree to the text after edits, as cleaned; the text and how many characters were encoded."""
    encoded = 0
    for start, end, new in reversed(edits):
        first, at = tree.leaf(start)
        last, to = tree.leaf(max(start, end - 1))
        to += int(tree.sums[tree.size + last, 0])
        if at > 0:  # the chunk before
            first, at = tree.leaf(at - 1)
        part = text[at:start] + new + text[end:to]
        n = sum(len(own.ids(c)) for c in own.chunks(part))
        encoded += len(part)
        for k in range(first + 1, last + 1):
            if tree.sums[tree.size + k].any():
                tree.put(k, 0, 0)
        tree.put(first, len(part), n)
        text = text[:start] + new + text[end:]
    return text, encoded


def built(text: str, own: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of a text's leaves, each distinct chunk encoded once."""
    chunks = own.chunks(text)
    known = {x: len(own.ids(x)) for x in set(chunks)}
    return np.array([len(x) for x in chunks], np.int64), np.array([known[x] for x in chunks], np.int64)


COUNTS = ("n_chunks", "n_tokens", "n_tokens_after", "n_chars_after", "n_chars_encoded")


def _run(path: str | None, keep: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts, out, trees = batch.column("text").to_pylist(), [], []
            kept = [None if t is None else (np.array([x["chars"] for x in t], np.int64), np.array([x["tokens"] for x in t], np.int64)) for t in batch.column("leaves").to_pylist()]
            kept = [t if t is not None and t[0].sum() == len(text) else None for t, text in zip(kept, texts, strict=True)]
            new = [k for k, t in enumerate(kept) if t is None]
            c = own.coded(batch.column("text").take(pa.array(new, pa.int64()))) if new else {}
            for at, k in enumerate(new):
                leaves = c["index"][c["offsets"][at] : c["offsets"][at + 1]]
                kept[k] = c["chars"][leaves], c["tokens"][leaves]
                if len(leaves) == 1 and len(own.chunks(texts[k])) > 1:  # a text that the batch took whole
                    kept[k] = built(texts[k], own)
            for (chars, tokens), text, edits in zip(kept, texts, batch.column("edits").to_pylist(), strict=True):
                tree = Tree(chars, tokens)
                before = tree.tokens
                _, encoded = apply(tree, text, cleaned(edits, len(text)), own)
                out.append((len(chars), before, tree.tokens, int(tree.sums[1, 0]), encoded))
                if keep:
                    after = tree.sums[tree.size :]
                    trees.append([{"chars": x, "tokens": y} for x, y in after[after[:, 0] > 0].tolist()])
            if out:
                columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))]
                yield pa.record_batch([*columns, pa.array(trees, LEAVES)] if keep else columns, ["doc_id", *COUNTS, *["leaves"] * keep])

    return run


LEAVES = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64())]))
TREE = "array<struct<chars:bigint,tokens:bigint>>"


def recount(docs: DataFrame, edits: Column, tokenizer: str | None = None, leaves: Column | None = None, keep: bool = False) -> DataFrame:
    """Token counts of each row of docs (doc_id, text) before and after its edits: an array of (start, end, new).

    Places are code points of the text before all edits, end exclusive, cut to the text; see cleaned for nulls and
    overlaps. keep: with leaves, the tree of the text after the edits as (chars, tokens) of its leaves. Given as leaves
    with that text, it spares the encoding of all that new edits don't touch; a tree that doesn't fit its text in length
    is built anew. Null texts are empty, null edits are none; a null doc_id is kept; repeated rows give a row each; an
    empty table none.
    """
    text = F.coalesce("text", F.lit(""))
    tree = (F.lit(None) if leaves is None else leaves).cast(TREE).alias("leaves")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), edits.cast("array<struct<start:bigint,end:bigint,new:string>>").alias("edits"), tree)
    return rows.mapInArrow(_run(tokenizer, keep), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + (f", leaves {TREE}" if keep else ""))


def usual_edits(text: Column) -> Column:
    """Edits by rule, for the registered query: 24 characters after a third of the text go, a note is put in after two thirds."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    third, second = (n / 3).cast("long"), (2 * n / 3).cast("long")
    cut = F.struct(third.alias("start"), F.least(third + 24, second).alias("end"), F.lit("").alias("new"))
    note = F.struct(second.alias("start"), second.alias("end"), F.lit(" (edited: 2 words)\n").alias("new"))
    return F.array(cut, note)
