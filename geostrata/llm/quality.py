"""Quality rules: rule counts of each text, and language-specific perplexity bands of a Kneser-Ney n-gram model.

Spark counts the n-grams of every whole text; a second scan scores every whole text by the model (ngram.Model) of its
language. The band of a language lies around the median of its documents' bits a character, as wide as the spread of
those of like length and a stated share of false rejections ask for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.llm import ngram
from geostrata.llm.common import SPACE, free_prefix, lean, written

SYMBOLS = "#*$%&|<>"
HOT = 4  # a text is hot if it holds more than a HOT-th of an even partition
FLUSH = 1_500_000  # characters that wait for being counted


def rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(text.split("\n"))
    duplicates = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(SPACE))
    return len(words), chars, symbols, duplicates, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    if len(ids) < 2_000_000:  # three ids fit in 63 bits
        window = (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:]
    else:
        pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        window = pair[:-1] * len(ids) + w[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(words), bool)
    again = np.zeros(n, bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    for k in range(3):
        hit[k : k + n] |= again
    return int(hit.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[str]] = {}
    size: Counter = Counter()
    kept: dict[str, ngram.Counts] = {}

    def flush(model: str) -> None:
        kept.setdefault(model, ngram.Counts()).add(waiting.pop(model))
        size[model] = 0

    for batch in batches:
        for model, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                waiting.setdefault(model, []).append(text)
                size[model] += len(text)
                if size[model] > FLUSH:
                    flush(model)
    for model in list(waiting):
        flush(model)
    for model, counts in kept.items():
        hi, lo, n = counts.rows()
        yield pa.record_batch({"lang": pa.array([model] * len(n), pa.string()), "hi": pa.array(hi), "lo": pa.array(lo), "n": pa.array(n)})


def bits_of(texts: list[str], names: list[str], models: dict[str, ngram.Model], block: tuple[int, int] = (0, 1)) -> np.ndarray:
    """The sums of the bits of texts by the models named (0 without a model), over the code points of a block (number, of so many)."""
    out, by_model = np.zeros(len(texts)), {}
    for k, (text, name) in enumerate(zip(texts, names, strict=True)):
        if text and name in models:
            by_model.setdefault(name, []).append(k)
    for name, own in by_model.items():
        lo = 0
        while lo < len(own):
            hi, size = lo, 0
            while hi < len(own) and (hi == lo or size + len(texts[own[hi]]) <= FLUSH // 4):
                size += len(texts[own[hi]])
                hi += 1
            c, starts = ngram.code_points([texts[k] for k in own[lo:hi]])
            at = ngram.inside(starts, len(c))
            if block[1] > 1:
                at = at[(31 * c[at - 2] + c[at - 1]) % block[1] == block[0]]
            sums = np.concatenate([[0.0], np.cumsum(models[name].log2p(c, at), dtype=np.float64)])
            edges = np.searchsorted(at, np.append(starts, len(c)))
            out[own[lo:hi]] = sums[edges[:-1]] - sums[edges[1:]]
            lo = hi
    return out


def _score(models, block: tuple[int, int]) -> callable:
    """All of a row's scores in the first block, in later ones its bits alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, all_texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            bits = pa.array(bits_of(all_texts, names, models.value, block))
            base = {k: batch.column(k) for k in ("doc_id", "lang", "text_hash")} | {"chars": pa.array(map(len, all_texts), pa.int64()), "bits": bits}
            if block[0] == 0:
                found = list(zip(*map(rules, all_texts), strict=True)) or [()] * len(RULES)
                base |= {k: pa.array(v, pa.int64()) for k, v in zip(RULES, found, strict=True)}
            yield pa.record_batch(base)

    return run


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORED = "doc_id long, lang string, text_hash long, chars long, bits double"
BIN = 200  # bins of a histogram for each bit a character
PRIOR = 20  # documents that the spread over all languages counts for in each language's own


def _quartiles(bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    order = np.argsort(bins, kind="stable")
    n = np.cumsum(counts[order])
    return bins[order][np.searchsorted(n, np.array([0.25, 0.5, 0.75]) * n[-1])] / BIN


def _deviation(bins: np.ndarray, counts: np.ndarray) -> float:
    """Robust standard deviation."""
    low, _, high = _quartiles(bins, counts)
    return max(float(high - low), 1 / BIN) / 1.349


def _bands(scored: DataFrame, reject: float) -> list[tuple[str, int, float, float]]:
    """(language, length class, middle, tolerance) in bits a character, from a histogram of all documents (its size is bounded by the bins).

    A class is a power of two of characters, since the mean of a longer text is more certain. The tolerance is so many
    robust deviations that a normal tail beyond holds the share reject of what is like the language (real tails are
    heavier; README has the rates measured). Few documents say little: the spread of a class is drawn to that of the class
    over all languages, and this to the one that all documents have at that length; and it is widened by the standard
    errors of itself and of the language's median. Medians aren't drawn together: each language's model is its own, and
    bits of a model of few texts differ from those of many.
    """
    keys = ("lang", F.floor(F.log2("chars")).alias("size"), F.floor(F.col("bits") * BIN).alias("bin"))
    rows = scored.where("n_words >= 50").groupBy(*keys).count().collect()
    if not rows:
        return []
    langs, size, bins, counts = (np.array([r[c] for r in rows]) for c in ("lang", "size", "bin", "count"))
    far, width = np.zeros(len(rows)), NormalDist().inv_cdf(1 - reject / 2)
    names, at = np.unique(langs, return_inverse=True)
    mids, total = np.zeros(len(names)), np.bincount(at, counts)
    order = np.argsort(at, kind="stable")
    for k, own in enumerate(np.split(order, np.cumsum(np.bincount(at))[:-1])):
        mids[k] = _quartiles(bins[own], counts[own])[1]
        far[own] = bins[own] - round(mids[k] * BIN)
    one = _deviation(far * 2 ** ((size + 0.5) / 2), counts)  # of a character

    def drawn(own: np.ndarray | list[int], towards: float) -> float:
        n = counts[own].sum()
        return float(np.exp((n * np.log(_deviation(far[own], counts[own])) + PRIOR * np.log(towards)) / (n + PRIOR)))

    common = {int(c): drawn(size == c, one / 2 ** ((c + 0.5) / 2)) for c in np.unique(size)}
    classes: dict[tuple[int, int], list[int]] = {}
    for k, pair in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
        classes.setdefault(pair, []).append(k)
    out = []
    for (k, c), own in sorted(classes.items()):
        spread = drawn(own, common[c]) * (1 + 1.17 / (counts[own].sum() + PRIOR) ** 0.5) * (1 + np.pi / 2 / total[k]) ** 0.5
        out.append((str(names[k]), c, float(mids[k]), float(width * spread)))
    return out


def _by_model(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Code points (hi and lo hold five, other columns one each) and counts of the n-grams of each model."""
    coded = table.column("lang").combine_chunks().dictionary_encode()
    column = lambda c: table.column(c).to_numpy().astype(np.int64)
    n, of, m = column("n"), coded.indices.to_numpy(zero_copy_only=False), ngram.LOW
    if "hi" in table.column_names:
        c = np.empty((len(n), ngram.ORDER), np.int32)
        for k, (name, shift) in enumerate((("hi", 1), ("hi", 0), ("lo", 2), ("lo", 1), ("lo", 0))):
            c[:, k] = column(name) >> shift * ngram.BITS & m
    else:
        c = np.stack([column("b"), column("c")], 1).astype(np.int32)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(coded.dictionary) + 1))
    return {name: (c[order[lo:hi]], n[order[lo:hi]]) for name, lo, hi in zip(coded.dictionary.to_pylist(), cuts, cuts[1:], strict=False)}


def counted(rows: DataFrame) -> DataFrame:
    """(lang, hi, lo, n): the n-grams of all texts of rows (lang, text)."""
    return written(rows.select("lang", "text").mapInArrow(lean(_count), "lang string, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")), "n-grams")


def _discounts(grams: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The discounts of each model and order, from counts of counts over all n-grams."""
    levels, keys = grams, ["hi", "lo"]
    out = {}
    for o in range(ngram.ORDER, 0, -1):
        seen = levels.where("n <= 4").groupBy("lang", "n").count().collect()
        for name in {r["lang"] for r in seen}:
            out[name, o] = ngram.discounts(*(sum(r["count"] for r in seen if r["lang"] == name and r["n"] == k) for k in (1, 2, 3, 4)))
        if o > 1:  # without the first code point
            keep = max(0, o - 4)
            cut = {"hi": F.col("hi").bitwiseAND((1 << ngram.BITS * keep) - 1), "lo": F.col("lo").bitwiseAND((1 << ngram.BITS * min(3, o - 1)) - 1)}
            levels = levels.groupBy("lang", *[cut[k].alias(k) for k in keys]).agg(F.count("*").alias("n"))
    return out


def models_of(grams: DataFrame, block: tuple[int, int], d: dict[tuple[str, int], np.ndarray]) -> dict[str, ngram.Model]:
    """The models' part for a block of contexts: the n-grams whose two code points before the last fall in it, and all shorter ones."""
    m = ngram.LOW
    c = [F.shiftright("lo", 2 * ngram.BITS), F.shiftright("lo", ngram.BITS).bitwiseAND(m), F.col("lo").bitwiseAND(m)]
    own = _by_model((grams.where((31 * c[0] + c[1]) % block[1] == block[0]) if block[1] > 1 else grams).toArrow())
    pairs = None
    if block[1] > 1:
        pairs = _by_model(grams.select("lang", c[0].alias("a"), c[1].alias("b"), c[2].alias("c")).distinct().groupBy("lang", "b", "c").agg(F.count("*").alias("n")).toArrow())
    out, none = {}, (np.zeros((0, ngram.ORDER), np.int32), np.zeros(0, np.int64))
    for name in sorted(own.keys() | (pairs or {}).keys()):
        levels = {ngram.ORDER: own.pop(name, none)}
        for o in range(ngram.ORDER - 1, 0, -1):
            levels[o] = pairs[name] if o == 2 and pairs is not None else ngram.shorter(*levels[o + 1])
        out[name] = ngram.Model(levels, {o: d.get((name, o), ngram.discounts(0, 0, 0, 0)) for o in levels})
    return out


def scores(rows: DataFrame, max_grams: int) -> DataFrame:
    """SCORED and RULES of each row of rows (doc_id, lang, text, text_hash); bits is a mean over characters.

    The models are broadcast in blocks of about max_grams n-grams; each block scores its share of the places of every
    whole text, and the shares add up.
    """
    grams = counted(rows)
    total = grams.count()
    n_blocks = max(1, -(-total // max_grams))
    d, context = _discounts(grams), rows.sparkSession.sparkContext
    first, rest = None, None
    for k in range(n_blocks):
        shared = context.broadcast(models_of(grams, (k, n_blocks), d))
        part = rows.mapInArrow(lean(_score(shared, (k, n_blocks))), SCORED + ("".join(f", {c} long" for c in RULES) if k == 0 else ""))
        if k == 0:
            first = written(part, "scores")
        else:  # rows of one text and model have the same sum
            part = written(part.groupBy("text_hash", "lang", "chars").agg(F.max("bits").alias("bits")), "scores-block")
            rest = part if rest is None else rest.union(part)
        shared.unpersist()
    if rest is not None:
        more = rest.groupBy("text_hash", "lang", "chars").agg(F.sum("bits").alias("_more"))
        first = written(first.join(more, ["text_hash", "lang", "chars"], "left").withColumn("bits", F.col("bits") + F.coalesce("_more", F.lit(0.0))).drop("_more"), "scores-sum")
    return first.withColumn("bits", F.when(F.col("chars") > 0, F.col("bits") / F.col("chars")).otherwise(0.0))


def _met(docs: DataFrame, texts: DataFrame, text: Column, lang: Column, name: str, max_broadcast: int) -> DataFrame:
    """docs with their texts' verdicts. A verdict follows from text and language, so it meets the rows by hash, length and
    language, and only rejections travel: broadcast up to max_broadcast of them. Beyond, texts that hold more rows than a
    share of a partition, which are few, are broadcast with their verdicts, and only the rows of other texts are shuffled."""
    p = free_prefix(docs)
    same = (F.xxhash64(text) == F.col(p + "th")) & (lang == F.col(p + "lang")) & (F.length(text) == F.col(p + "chars"))
    own, keys = [F.col(f"`{c}`") for c in docs.columns], [F.col("text_hash").alias(p + "th"), F.col("lang").alias(p + "lang"), F.col("chars").alias(p + "chars")]
    gone = texts.where("not kept")
    if gone.count() <= max_broadcast:
        return docs.join(F.broadcast(gone.select(*keys)), same, "left").select(*own, F.col(p + "th").isNull().alias(name))
    share = texts.agg(F.sum("n")).first()[0] // (HOT * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(texts.where(F.col("n") > share).select(*keys, F.col("kept").alias(p + "kept")))
    warm = docs.join(hot, same).select(*own, F.col(p + "kept").alias(name))
    cold = docs.join(hot, same, "left_anti").join(gone.where(F.col("n") <= share).select(*keys), same, "left")
    return warm.unionByName(cold.select(*own, F.col(p + "th").isNull().alias(name)))


def quality(docs: DataFrame, reject: float = 1e-5, keep_columns: str | None = None, max_grams: int = 2_000_000, max_broadcast: int = 500_000) -> DataFrame:
    """Rule counts, perplexity and verdict of each row of docs (doc_id, text, lang; other columns are ignored).

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows. kept: not base_failed,
    and the bits a character within the band of the language and length, which is to reject the share reject of good
    texts. Every language with a document of 50 words has a band. Null texts are empty, a null language is one of its own (''), repeated
    rows give a row each, an empty table gives none. With keep_columns, instead: the columns of docs and the verdict
    under that name. Texts meet their verdicts by 64-bit hash, length and language.
    """
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    scored = scores(rows, max_grams)
    bands = docs.sparkSession.createDataFrame(_bands(scored, reject), "_of string, _size long, _mid double, _width double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.join(F.broadcast(bands), (F.col("lang") == F.col("_of")) & (F.floor(F.log2("chars")) == F.col("_size")), "left")
    verdict = ~failed & (F.abs(F.col("bits") - F.col("_mid")) <= F.col("_width"))
    if keep_columns:
        texts = written(scored.groupBy("text_hash", "lang", "chars").agg(F.count("*").alias("n"), F.min(verdict).alias("kept")), "verdicts")
        return _met(docs, texts, text, lang, keep_columns, max_broadcast)
    return scored.select("doc_id", *RULES, failed.alias("base_failed"), verdict.alias("kept"), "lang", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"), "text_hash")
