"""The pipeline's stages, each on what the one before kept, against plain versions of their decisions."""

import random

import corpus_pipeline
from geostrata.llm import quality
from tests.llm.test_operators import check_packing, slow_components, slow_hits, slow_lines, slow_print


def corpus(tmp_path, spark):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["the", "of", "and", "river", "stone", "walks", "under", "bright", "over"]) + rng.choice(["", "", "s", "ed"]) for _ in range(n))
    bench = [say(30), say(25)]
    texts = ["\n".join(say(40) for _ in range(3)) for _ in range(120)]
    texts += [texts[0] + "\n" + say(60), texts[1], texts[2] + "\n" + bench[0] + "\n" + bench[1], say(80) + "\n" + bench[0] + "\n" + say(30), None, "", "short", "again and " * 200, say(5000)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, list(enumerate(bench))


def test_stages(spark, tmp_path):
    texts, bench = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontaminate", "pack"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    own = {r["doc_id"]: r["text"] for r in kept.collect()}
    failed = {k for k, t in enumerate(texts) if (r := quality.rules(t or ""))[0] < 50 or 100 * r[4] > 50 * r[0]}
    assert failed >= set(range(len(texts))) - set(own) and not failed & set(own)

    one = stage["line_dedup"](spark, kept, str(tmp_path))
    ids = sorted(own)
    want = {ids[k]: t for k, n, gone, t in slow_lines([own[i] for i in ids]) if gone < n}
    assert {r["doc_id"]: r["text"] for r in one.collect()} == want and one.columns == docs.columns

    two = stage["simhash_near_dedup"](spark, one, str(tmp_path))
    ids = sorted(want)
    group = slow_components([slow_print(want[i]) for i in ids])
    left = {ids[k]: want[ids[k]] for k, g in enumerate(group) if g == k}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == left

    three = stage["decontaminate"](spark, two, str(tmp_path)).collect()
    ids = sorted(left)
    clean = {ids[k]: n for k, _, n, items, _, bad in slow_hits([left[i] for i in ids], bench) if not bad}
    assert {r["doc_id"] for r in three} == set(clean)
    assert all((r["text"] == left[r["doc_id"]]) == (clean[r["doc_id"]] == 0) and r["n_chars"] == len(r["text"]) for r in three)

    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    order = sorted(r["doc_id"] for r in three)
    place = {d: k for k, d in enumerate(order)}
    by = {r["doc_id"]: r["text"] for r in three}
    check_packing([by[d] for d in order], [r.asDict() | {"doc_id": place[r["doc_id"]]} for r in final])


def test_stages_take_empty_tables(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, str(tmp_path)).collect() == []


def test_stages_keep_odd_columns_and_rows(spark, tmp_path):
    """Columns named like helpers, null ids, null texts and repeated rows pass each stage with their values."""
    texts, _ = corpus(tmp_path, spark)
    rows = [(k, texts[k], "en", "s", len(texts[k]), f"h{k}", f"n{k}") for k in (4, 5, 5, 6)] + [(None, texts[7], None, "s", 1, "x", "y"), (9, None, "en", "s", 0, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, __kept string")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = sorted((str(r["doc_id"]), r["_id"], r["__kept"]) for r in out.collect())
        want = sorted((str(r[0]), r[5], r[6]) for r in rows if name != "quality_rules" or r[1] is not None)
        assert got == want, name
