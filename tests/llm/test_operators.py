"""Every operator against a plain version on small tables that hold nulls, empty and long texts, repeats and odd columns."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from geostrata.llm import decontaminate, edit_counts, html_text, licenses, line_dedup, ngram, packing, pii, quality, secrets, simhash
from geostrata.llm import queries as q
from geostrata.llm.common import SPACE
from geostrata.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, item_id string"


def docs_of(spark, texts, lang="en"):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(k, t, lang, None, len(t or ""), "x", "y") for k, t in enumerate(texts)], SCHEMA)


def made(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Écho", "foxtrot", "golf", "hotel", "india", "über", "kilo", "lima"]
    texts = []
    for k in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 8))]
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "  x  ", texts[0], texts[1] + "\nand one more line here", "word " * 30_000]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, made())


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# --- 1, 2: spans ------------------------------------------------------------------------------------------------------
def slow_pii(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def slow_secrets(text):
    out = [(0, *m.span()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    out += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], x[0]))


def noisy(seed):
    rng = random.Random(seed)
    parts = ["a.b@c.de", "@", "a@b", "x@y.z@w.v", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "+1 ((((", "é", "日本", " ", "\n", "12345678901234", "Token: abcdef", "pass", "PASSWORD='hunter22'", "api-key=abc", "apikey = \"ABCDEF/+==\"", "AKIA" + "A1" * 9, "deadbeef" * 4, "ſecret=abcdefg", "."]
    return "".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(40))


def test_base_spans_match_the_plain_expressions():
    for k in range(400):
        t = noisy(k)
        assert pii.base_spans(pii.flat(t)) == slow_pii(t)
        assert secrets.base_spans(t, pii.flat(t)) == slow_secrets(t)
    zeros = "0" * 5000
    assert pii.base_spans(pii.flat(f"at {zeros}1.2.3.{zeros} here")) == [(1, 3, 10009)]
    assert pii.base_spans(pii.flat(f"at {zeros}256.2.3.{zeros} here")) == []


@pytest.mark.parametrize("name, kinds, slow", [("op1_pii_bootstrap", pii.KINDS, slow_pii), ("op2_secret_crf", secrets.KINDS, slow_secrets)])
def test_queries_of_spans_match_the_plain_expressions(spark, tmp_path, monkeypatch, name, kinds, slow):
    monkeypatch.setattr(secrets, "fitted", lambda docs, field=secrets.train(secrets.made(7, 100), epochs=5): field)
    texts = [*map(noisy, range(60)), None, "", "at 10.0.0.1 and 10.0.0.2, call +1 (555) 123-4567", "deadbeef" * 4 + " AKIA" + "A1" * 9 + " then deadbeef" * 3 + " Token: abcdef"]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in getattr(q, name)(spark, str(tmp_path)).collect()}
    counted = kinds[: 4 if slow is slow_pii else 3]
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        spans = slow(t or "")
        assert [out[k][f"n_{kind}"] for kind in counted] == [sum(x[0] == n for x in spans) for n in range(len(counted))]
        assert out[k]["base_sha256"] == hashlib.sha256(",".join(f"{kinds[n]}:{s}:{e}" for n, s, e in spans).encode()).hexdigest()
        assert {f"{kinds[n]}:{s}:{e}" for n, s, e in spans} <= set(out[k]["spans"].split(","))


def test_long_digit_runs_take_linear_time():
    for t in ("1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a" * 200_000 + "@"):
        start = time.process_time()
        spans = pii.base_spans(pii.flat(t)), secrets.base_spans(t, pii.flat(t))
        assert time.process_time() - start < 5
        assert spans == ([(1, 8 * k, 8 * k + 7) for k in range(25_000)] if t[1] == "." else [], [(2, 0, 200_000)] if t[:2] in ("11", "aa") else [])


def test_pii_patterns_lead_to_unseen_identifiers(spark, docs, empty):
    seeds = [f"please write to u{k}@mail.example.com for help" for k in range(8)]
    found = docs_of(spark, [*seeds, "please write to root@localhost for help", "no such words around root2@localhost nor here", None])
    out = {r["doc_id"]: r for r in pii.find(found).collect()}
    assert len(out[0]["base"]) == 1 and len(out[8]["base"]) == 0
    s = out[8]["spans"][0]
    assert "please write to root@localhost for help"[s["s"] : s["e"]] == "root@localhost"
    assert out[9]["spans"] == [] and out[10]["spans"] == []
    assert pii.find(empty).collect() == [] and pii.find(docs).count() == docs.count()


def test_candidates_are_whole_tokens():
    text = "mail root@localhost, or <a+b@c_d> on 06-12-34-56-78 or 030.123.456 to (555) 123 456 and 10.20.30.400. x@y.com 12a34567 1 2 " + "a" * 100 + "@localhost ok"
    b = pii.flat(text)
    got = [(k, text[s:e]) for k, s, e in pii.candidates(b, pii.base_spans(b))]
    assert got == [(0, "root@localhost"), (0, "a+b@c_d"), (0, "a" * 100 + "@localhost"), (3, "06-12-34-56-78"), (3, "030.123.456"), (3, "(555) 123 456"), (1, "10.20.30.400")]
    start = time.process_time()
    for t in ("@" * 100_000, "1." * 100_000 + "x", "a" * 200_000, "a@ " * 50_000, "1 " * 100_000, "(1" * 100_000):
        pii.candidates(pii.flat(t), [])
    assert time.process_time() - start < 10
    russian = [f"пишите сюда {k}@x по делу" for k in "аб"]
    assert pii.patterns(0, russian[0], 12, 15)[0] == pii.patterns(0, russian[1], 12, 15)[0] != pii.patterns(0, "слово другое 1@x", 13, 16)[0]


def slow_promoted(links, precision, support, agree):
    """links: (k, inst, pat, seed). Rounds on sets until nothing joins."""
    met, accepted = {}, {(k, i) for k, i, _, seed in links if seed}
    for k, i, p, _ in links:
        met.setdefault(p, set()).add((k, i))
    seeds, new = set(accepted), set()
    while True:
        good = {(k, p) for p, all_of in met.items() for k in range(4) if (f := sum(x in accepted and x[0] == k for x in all_of)) >= support and f >= precision * len(all_of)}
        now = {x for x in {(k, i) for k, i, _, _ in links} - seeds if sum((x[0], p) in good for p, all_of in met.items() if x in all_of) >= agree}
        if now == new:
            return new
        new, accepted = now, seeds | now


def test_promotion_reaches_the_fixpoint(spark):
    """Chains of patterns that take many rounds, hot patterns, and random graphs, against sets."""
    chain = [(0, i, 0, True) for i in range(6)] + [(0, i, 1, True) for i in range(6)]
    for step in range(6):
        own = range(100 * (step + 1), 100 * (step + 1) + 6)
        chain += [(0, i, 2 * step + p, False) for i in own for p in (0, 1)] + [(0, i, 2 * step + 2 + p, False) for i in own for p in (0, 1)]
    chain += [(0, i, 99, False) for i in range(100, 500)]
    rng = random.Random(5)
    noisy_graph = list({(k, i, rng.randrange(12)): (i % 3 > 0) for i in range(150) for k in (i % 2,) for _ in range(4)}.items())
    noisy_graph = [(*key, seed) for key, seed in noisy_graph]
    for links in (chain, noisy_graph, []):
        want = slow_promoted(links, 0.3, 3, 2)
        got = pii.promoted(spark.createDataFrame(links, "k int, inst long, pat long, seed boolean"), 0.3, 3, 2)
        assert {(r["k"], r["inst"]) for r in got.collect()} == want
    assert len(slow_promoted(chain, 0.3, 3, 2)) == 36


def test_secret_field_learns_and_reads_whole_texts(spark, docs, empty):
    field, hit, all_of, wrong = secrets.train(secrets.made(7, 1200), epochs=80), Counter(), Counter(), 0
    for form, (t, kind, labels) in secrets.made_by_form(99, 1200):
        tagged = field.decode(t, kind)
        all_of[form] += 1
        hit[form] += tagged == labels
        wrong += not form and any(x != 2 for x in tagged)
    assert all(hit[f] / all_of[f] > (0.4 if f in secrets.TIED else 0.7) for f in secrets.FORMS) and wrong / all_of[""] < 0.05
    t = "word " * 2000 + "Bearer abc9f81c02d4a6e77bd1Q and so on"
    out = secrets.find(docs_of(spark, [t, None, "plain words only", ""]), field).orderBy("doc_id").collect()
    assert [t[s["s"] : s["e"]] for s in out[0]["spans"]] == ["abc9f81c02d4a6e77bd1Q"] and not any(r["spans"] for r in out[1:])
    assert secrets.find(empty, field).collect() == []
    odd = spark.createDataFrame([(None, t), (3, t), (3, t)], "doc_id long, text string")
    assert [len(r["spans"]) for r in secrets.find(odd, field).collect()] == [1, 1, 1]


def slow_tokens(b):
    """Tokens one by one, with the values of their shape groups and their word bucket."""
    out = []
    for m in re.finditer(rb"[0-9A-Za-z\xc0-\xff+/_.-]+|[^\sA-Za-z0-9\xc0-\xff+/_.-]+", b):
        t, n = m[0], len(m[0])
        digits, upper, lower = (sum(c in chars for c in t) for chars in (b"0123456789", bytes(range(65, 91)), bytes([*range(97, 123), *range(192, 256)])))
        share = 0 if not digits else 1 if digits * 4 < n else 2 if digits * 2 < n else 3 if digits < n else 4
        turns = sum((x < 58) != (y < 58) for x, y in zip(t, t[1:], strict=False))
        entropy = -sum(t.count(c) / n * np.log2(t.count(c) / n) for c in set(t))
        h = 0
        for k, c in enumerate(t):
            h += int(secrets.FOLDED[c]) * int(secrets.POWERS[k % 64])
        values = [digits + upper + lower == 0, t[:1] in b"=:", t[-1:] in b"\"'", min(n // 4, 10), share, (upper > 0) + 2 * (lower > 0), not t.translate(None, b"0123456789abcdef"), digits + upper + lower == n, min(turns // 2, 6), min(int(2 * entropy + 1e-9), 9), b"AKIA" in t, any(c in t.lower() for c in secrets.CUES), t.count(b".") > 1 or b"/" in t]
        out.append((*m.span(), [int(v) for v in values], (h % 2**64 >> 40) % secrets.N_WORD))
    return out


def test_tokens_and_shapes_match_a_plain_reading(monkeypatch):
    rng = random.Random(12)
    parts = ["password=", "AKIAQ1", "a1b2", "x/y.z.w", '"', ":", "=", "É", "é", "日本", " ", "\n", "0", "Token", "api_key", "--", "...", "zzzz" * 20]
    monkeypatch.setattr(secrets, "BLOCK", 50)
    for n in range(60):
        b = pii.flat("".join(rng.choice(parts) for _ in range(n)))
        t = secrets.tokens(b)
        got = list(zip(t.starts.tolist(), t.ends.tolist(), (secrets._unpacked(t.shapes) - secrets.FIRST).tolist(), t.words.tolist(), strict=True))
        assert got == slow_tokens(b)


def viterbi_slow(field, t, kind):
    import itertools

    e = [field.weights[f].sum(0) for f in secrets.features(t, kind)]
    best = None
    for y in itertools.product(range(3), repeat=len(e)):
        if y[0] == 1 or any(a == 2 and b == 1 for a, b in zip(y, y[1:], strict=False)):
            continue
        s = sum(e[k][c] for k, c in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))
        best = max(best or (s, y), (s, y))
    return list(best[1])


def test_the_field_decodes_all_tokens_of_every_text_by_the_best_path():
    rng, tagged = random.Random(8), 0
    trained = secrets.train(secrets.made(7, 200), epochs=20)
    words = ["pwd:", "CorrectHorse", "of", "Bearer", "QwErTyUiOpAsDfG", "and,", '"x"', "a7b7", "passphrase", "hunterhunter", "{", "="]
    for trial in range(40):
        own = np.random.default_rng(trial)
        weights = own.normal(size=(secrets.SIZE, 3))
        weights[:, 2] += 0.02 * (trial % 5)
        field = secrets.Field(weights, own.normal(size=(3, 3))) if trial % 3 else trained
        texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 60]))).encode() for _ in range(6)]
        want = []
        for b in texts:
            t, spans = secrets.tokens(b), []
            labels = field.decode(t, secrets._file(b))
            if len(labels) <= 7 and labels:
                assert labels == viterbi_slow(field, t, secrets._file(b))
            for s, e, label in zip(t.starts.tolist(), t.ends.tolist(), labels, strict=True):
                if label == 0:
                    spans.append((3, s, e))
                elif label == 1:
                    spans[-1] = (3, spans[-1][1], e)
            want.append(spans)
        assert secrets.found(texts, field, [[]] * len(texts)) == want
        tagged += sum(map(len, want))
    assert tagged


def test_training_climbs_the_likelihood():
    """The expected counts of the training equal those of all label sequences, one by one: at the optimum of a tiny field the gradient with its prior is near zero."""
    import itertools

    w = [secrets.labelled(b"key = a1b2c3 x", [(6, 12)]), secrets.labelled(b"no secret here", []), secrets.labelled(b'token: "Xy9" z', [(8, 11)])]
    decay = 0.05
    field = secrets.train(w, epochs=1500, rate=0.05, decay=decay, caution=0.0)
    g = np.zeros((secrets.SIZE, 3))
    for t, kind, y in w:
        f = secrets.features(t, kind)
        paths = [p for p in itertools.product(range(3), repeat=len(y)) if p[0] != 1 and not any(a == 2 and b == 1 for a, b in zip(p, p[1:], strict=False))]
        score = np.array([sum(field.weights[f[k]].sum(0)[c] for k, c in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        share = np.exp(score - score.max())
        for p, s in zip(paths, share / share.sum(), strict=True):
            for k, c in enumerate(p):
                g[f[k], c] += s
        for k, c in enumerate(y):
            g[f[k], c] -= 1
    assert np.abs(g / len(w) + decay * field.weights).max() < 0.02


def test_hidden_seeds_are_recovered(spark):
    """The field is fitted on two thirds of the documents; rule matches in the others must be tagged without the rules."""
    rng = random.Random(11)
    filler = lambda n: " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(1, 9))) for _ in range(n))
    texts = [f"{filler(40)} {rng.choice(['password', 'secret', 'api_key'])}={''.join(rng.choice('0123456789abcdef') for _ in range(20))} {filler(30)}" for _ in range(90)] + [filler(80) for _ in range(60)]
    field = secrets.fitted(docs_of(spark, texts[:60] + texts[90:]))
    held = [pii.flat(t) for t in texts[60:90]]
    bases = [secrets.base_spans(t, b) for t, b in zip(texts[60:90], held, strict=True)]
    found = secrets.found(held, field, [[]] * 30)
    hit = sum(any(end == b[0][2] for _, _, end in f) for f, b in zip(found, bases, strict=True))
    assert hit >= 27 and sum(map(len, found)) <= 33
    assert not any(secrets.found([pii.flat(t) for t in texts[90:]], field, [[]] * 60))


# --- 3: lines ---------------------------------------------------------------------------------------------------------
def slow_lines(texts):
    lines = {k: (t or "").split("\n") for k, t in enumerate(texts)}
    low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda x: x.strip(SPACE).translate(low)
    first = {}
    for k, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 10:
                first.setdefault(key(x), k)
    out = []
    for k, ls in lines.items():
        kept = [x for x in ls if len(key(x)) < 10 or first[key(x)] == k]
        out.append((k, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark, empty):
    texts = [*made(), "SHARED LINE of words\nown É line number 1\n\tshared line OF words ", "shared line of words\r\nÉCOLE des mines\nx", "École des mines\nécole des mines"]
    out = line_dedup.line_dedup(docs_of(spark, texts)).withColumn("n_lines", line_dedup.n_lines(q.F.col("text")))
    assert rows(out, "doc_id", "n_lines", "_n", "_kept") == sorted(slow_lines(texts))
    assert line_dedup.line_dedup(empty).collect() == []
    odd = spark.createDataFrame([(None, "one shared line here"), (2, "one shared line here"), (1, "one shared line here"), (1, "one shared line here")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["_n"]) for r in line_dedup.line_dedup(odd).collect()) == {(None, 0): 1, (2, 1): 1, (1, 0): 2}


def test_columns_that_clash_pass_through(spark):
    """Columns with the names of helpers and results keep their values in every operator that passes columns through."""
    base = docs_of(spark, ["shared line of words\nown", "shared line of words\nother", None])
    odd = base.select("doc_id", "text", "lang", *[q.F.concat(q.F.lit(c), q.F.col("doc_id").cast("string")).alias(c) for c in ("_th", "_id", "_hash", "_n", "_dropped", "_kept", "__kept", "__th", "_lang", "__edges", "__items", "fp", "component_id", "base", "spans", "found")])
    out = line_dedup.line_dedup(odd, prefix="mine_")
    assert sorted(map(tuple, out.select(*odd.columns).collect()), key=str) == sorted(map(tuple, odd.collect()), key=str) and {r["doc_id"]: r["mine_n"] for r in out.collect()} == {0: 0, 1: 1, 2: 0}
    out = quality.quality(odd, keep_columns="verdict")
    assert sorted(map(tuple, out.drop("verdict").collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)
    bench = spark.createDataFrame([(1, "own", "x")], "item_id long, text string, __items string")
    for most in (1000, 1):
        out = decontaminate.scan(odd, bench, prefix="mine_", max_windows=most)
        assert sorted(map(tuple, out.select(*odd.columns).collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)
        assert {r["doc_id"]: list(r["mine_items"]) for r in out.collect()} == {0: [1], 1: [], 2: []}
        assert decontaminate.scan(odd, bench, remove=1, max_windows=most).columns == odd.columns
    for f in (pii.find, simhash.near_dedup, packing.pack, lambda d: edit_counts.recount(d, edit_counts.usual_edits(q.F.col("text")))):
        assert f(odd).count() == 3


def test_nulls_and_repeats_in_every_operator(spark):
    odd = spark.createDataFrame([(None, None, None), (None, "a b c", None), (7, "a b c", "en"), (7, "a b c", "en"), (7, "other words", None), (8, None, "en")], "doc_id long, text string, lang string")
    field = secrets.train(secrets.made(7, 100), epochs=5)
    for f in (pii.find, lambda d: secrets.find(d, field), quality.quality, simhash.near_dedup, line_dedup.line_dedup, lambda d: edit_counts.recount(d, edit_counts.usual_edits(q.F.col("text")))):
        assert Counter(r["doc_id"] for r in f(odd).collect()) == {None: 2, 7: 3, 8: 1}
    assert len({(r["sequence_id"], r["offset"]) for r in packing.pack(odd).collect()}) == 6
    roots = {(r["doc_id"], r["component_id"]) for r in simhash.near_dedup(odd).collect()}
    assert roots == {(None, None), (7, 7), (8, 8)}
    assert licenses.find(odd).collect() == []


def test_line_dedup_of_hot_and_rare_lines(spark):
    """One line in every document, one in a third, pairs of documents that share one, and lines of their own, twice in a document."""
    texts = [f"the line that ALL share\n{'' if k % 3 else 'a line of a third of them'}\na line of two documents {k // 2}\nowned line number {k}\nOwned line number {k}" for k in range(200)]
    out = line_dedup.line_dedup(docs_of(spark, texts)).withColumn("n_lines", line_dedup.n_lines(q.F.col("text")))
    assert rows(out, "doc_id", "n_lines", "_n", "_kept") == sorted(slow_lines(texts))


# --- 4: quality -------------------------------------------------------------------------------------------------------
def slow_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {j for k in range(len(words) - 2) if n[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_rules():
    for t in [*(x or "" for x in made()[:-1]), "a b c a b c a b c", "# x |\n\x1c y\n# x |", "a b c"]:
        assert quality.rules(t) == slow_rules(t)


def slow_kn(text_list):
    """Modified Kneser-Ney by its recursive definition, on dictionaries of code points."""
    levels = {5: Counter()}
    for t in text_list:
        padded = "\0" * 4 + t
        levels[5].update(padded[k : k + 5] for k in range(len(t)))
    for order in (4, 3, 2, 1):
        levels[order] = Counter(g[1:] for g in levels[order + 1])
    discount = {o: ngram.discounts(*(sum(n == k for n in c.values()) for k in (1, 2, 3, 4))) for o, c in levels.items()}
    by = {o: {} for o in levels}
    for o, c in levels.items():
        for g, n in c.items():
            by[o].setdefault(g[:-1], []).append(n)

    def p(g, o):
        if o == 0:
            return 1 / (len(levels[1]) + 1)
        own = by[o].get(g[:-1])
        lower = p(g[1:], o - 1)
        if own is None:
            return lower
        n, d = levels[o].get(g, 0), discount[o]
        return (n - d[min(n, 3)]) / sum(own) + sum(d[min(x, 3)] for x in own) / sum(own) * lower

    return lambda t: -sum(np.log2(p(("\0" * 4 + t)[k : k + 5], 5)) for k in range(len(t)))


@pytest.mark.parametrize("most", [4_000_000, 700])
def test_kneser_ney(spark, most):
    """Counts in Spark and models in one block and in several, narrow and wide code points, against the definition."""
    texts = [t for t in made(20) if t][:20] + ["日本語 の 文章 日本語", "naïve 😀 text 😀", "ab"]
    rest = ["alpha beta gamma", "Quite unseen words 12", "zzz", "日本 😀x", ""]
    slow = {lang: slow_kn(own) for lang, own in (("en", texts), ("de", rest[:2]))}
    rows_ = [(k, "en", t) for k, t in enumerate(texts)] + [(100 + k, "de", t) for k, t in enumerate(rest[:2])]
    df = spark.createDataFrame(rows_, "doc_id long, lang string, text string").withColumn("text_hash", q.F.xxhash64("text"))
    out = {r["doc_id"]: r["bits"] for r in quality.scores(df, most).collect()}
    assert len(out) == len(rows_) and all(np.isclose(out[k], slow[lang](t) / len(t), atol=1e-3) for k, lang, t in rows_)
    if most > 1000:
        grams = quality.counted(df)
        models = quality.models_of(grams, (0, 1), quality._discounts(grams))
        assert np.allclose(quality.bits_of(rest, ["en"] * 5, models), [slow["en"](t) for t in rest], rtol=1e-4)
        assert quality.bits_of(["x"], ["none"], models)[0] == 0


def test_an_index_is_no_larger_than_its_hashes():
    rng = np.random.default_rng(3)
    known, other = np.split(np.unique(rng.integers(0, 1 << 64, 60_000, np.uint64, endpoint=False))[rng.permutation(50_000)], [40_000])
    table = ngram.Table(known, np.arange(len(known)))
    assert table.index.nbytes <= table.hashes.nbytes + 4
    assert (table.values[table.find(known)] == np.arange(len(known))).all() and (table.find(other) == -1).all()


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads the memory of a process from /proc")
@pytest.mark.parametrize("operator", ["quality", "simhash"])
def test_workers_give_memory_back(spark, operator):
    """What a worker could give back to the system after its task: it counts beside the heap in the stages that follow."""

    def held(batches):
        import ctypes

        import pyarrow as pa

        def mb():
            return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon")) / 1024

        for _ in batches:
            pass
        before = mb()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pa.record_batch({"mb": [before - mb()]})

    rest = lambda: max(r["mb"] for r in spark.range(0, 16, 1, 16).mapInArrow(held, "mb double").collect())
    rest()
    text = q.F.repeat(q.F.concat(q.F.sha2(q.F.col("id").cast("string"), 256), q.F.lit(" ")), 40)
    many = spark.range(0, 40_000, 1, 4).select(q.F.col("id").alias("doc_id"), q.F.lit("en").alias("lang"), text.alias("text"))
    made_ = quality.counted(many) if operator == "quality" else simhash.near_dedup(many)
    assert made_.count() > 0
    assert rest() < 32


def test_bands_against_a_plain_version(spark):
    """One language, one length class and many documents: the band is the median and the robust spread times the normal width, but for the prior and the standard errors."""
    rng = np.random.default_rng(1)
    bits = np.round(2 + 0.05 * rng.standard_normal(4000), 3)
    rows_ = [(60, "en", 1500, float(b)) for b in bits] + [(10, "en", 1500, 9.0)]
    ((lang, size, mid, width),) = quality._bands(spark.createDataFrame(rows_, "n_words long, lang string, chars long, bits double"), 1e-3)
    low, middle, high = np.quantile(bits, [0.25, 0.5, 0.75])
    assert (lang, size) == ("en", 10) and abs(mid - middle) < 0.006 and abs(width / (3.29 * (high - low) / 1.349) - 1) < 0.12


def test_perplexity_bands_reject_what_is_unlike_the_language(spark, empty):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["the", "of", "and", "river", "stone", "walks", "under", "bright", "over"]) for _ in range(80)) for _ in range(150)]
    noise = "".join(rng.choice("qxzjkvwpgy") + rng.choice(["", " "]) for _ in range(900))
    out = {r["doc_id"]: r for r in quality.quality(docs_of(spark, [*good, noise, None, "too short"])).collect()}
    assert all(out[k]["kept"] for k in range(150)) and not out[150]["base_failed"] and not out[150]["kept"]
    assert out[151]["base_failed"] and not out[151]["kept"] and out[151]["n_words"] == 0
    assert quality.quality(empty).collect() == []
    kept = quality.quality(docs_of(spark, [*good, noise, None], lang=None), keep_columns="__kept")
    assert kept.columns[:-1] == docs_of(spark, []).columns and sorted(r["doc_id"] for r in kept.where("not __kept").collect()) == [150, 151]
    copies = docs_of(spark, [*good, *[None] * 200, *[good[0]] * 100, noise])
    for most in (500_000, 0):  # by a broadcast, and with hot texts apart
        out = {r["doc_id"]: r["__kept"] for r in quality.quality(copies, keep_columns="__kept", max_broadcast=most).collect()}
        assert len(out) == 451 and {k for k, kept in out.items() if not kept} == {*range(150, 350), 450}


def test_rare_languages_have_a_band(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["the", "of", "and", "river", "stone", "walks", "under", "bright", "over"]) for _ in range(80))
    rows = [(k, text(), "en" if k < 120 else None if k < 140 else "xx" if k < 160 else "yy") for k in range(161)]
    rows += [(200 + k, " ".join("".join(rng.choice("qxzjkvwpgy") for _ in range(5)) for _ in range(80)), lang) for k, lang in enumerate(["xx", None])]
    out = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(out) == 163 and all(out[k]["kept"] or out[k]["base_failed"] for k in range(161))
    assert not any(out[k]["kept"] or out[k]["base_failed"] for k in (200, 201))


def test_bands_are_as_wide_as_their_length_asks(spark):
    rng = random.Random(7)
    words = ["the", "of", "and", "river", "stone", "walks", "under", "bright", "over", "cloud", "garden", "winter"]
    text = lambda: " ".join(rng.choice(words) for _ in range(400))
    menu = " | ".join(rng.choice(words) for _ in range(400))
    texts = [text() for _ in range(300)] + [menu]
    out = {r["doc_id"]: r for r in quality.quality(docs_of(spark, texts)).collect()}
    judged = [k for k in range(300) if not out[k]["base_failed"]]
    assert len(judged) > 100 and sum(not out[k]["kept"] for k in judged) <= 2
    mixed = [" ".join(w + "&&&" * (rng.random() < 0.08) for w in text().split()) for _ in range(3)]
    out = {r["doc_id"]: r for r in quality.quality(docs_of(spark, texts[:300] + mixed)).collect()}
    assert not any(out[300 + k]["kept"] or out[300 + k]["base_failed"] for k in range(3))


# --- 5: licenses ------------------------------------------------------------------------------------------------------
def slow_licenses(text):
    own = licenses.words(text)
    sh = [" ".join(own[k : k + 5]) for k in range(max(1, len(own) - 4))]
    out = {}
    for i, (name, t) in enumerate(licenses.TEMPLATES):
        w = licenses.words(t)
        want = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        size = licenses._class(max(1, len(w) - 4))
        step, width = max(1, size // 2), -(-size * 3 // 2)
        share = [(len(want & set(sh[k : k + width])) / len(want), k) for k in range(0, len(sh), step)]
        if max(share)[0] >= 0.8:
            out[i] = (name, max(share)[0], min(k for s, k in share if s >= 0.8))
    return out


def test_licenses(spark, empty):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["some", "free", "words", "software", "use", "copy", "license"]) for _ in range(n))
    texts = [filler(30) + "\n" + t.upper() + "\n" + filler(25) for _, t in licenses.TEMPLATES] + [None, "", "License", filler(300), licenses.TEMPLATES[5][1].replace("merge", "fuse") + filler(5)]
    got = {}
    for r in licenses.find(docs_of(spark, texts)).collect():
        got.setdefault(r["doc_id"], {})[r["template"]] = (r["license"], pytest.approx(r["containment"]), r["first_word"])
    assert got == {k: v for k, t in enumerate(texts) if (v := slow_licenses(t or ""))}
    assert licenses.find(empty).collect() == []


# --- 6, 10: tokens ----------------------------------------------------------------------------------------------------
ODD = ["", " a", "a ", "a  b   c\n d", "x <|endoftext|> y", "日本 語 test’s it's", "\n\n", "a \x1c b", "don't  \t x", "word " * 3000, "x" * 5000]


def test_batches_encode_as_the_tokenizer_does():
    import pyarrow as pa

    own = Encoder()
    texts = [t or "" for t in made(30)[:-1]] + ODD
    flat, lens = own.batch(pa.array(texts))
    at = 0
    for t, n in zip(texts, lens, strict=True):
        assert flat[at : at + n].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
        at += n


def test_edits_give_the_counts_of_the_edited_text(spark, empty):
    own, rng = Encoder(), random.Random(4)
    texts = [t or "" for t in made(25)[:-1]] + ODD
    cases = []
    for t in texts:
        places = sorted(rng.randint(0, len(t)) for _ in range(4))
        cases.append((t, [(a, b, rng.choice(["", " new", "x", " \n", "<|endoftext|>", "  two  "])) for a, b in zip(places[::2], places[1::2], strict=True)]))
    df = spark.createDataFrame([(k, t, [dict(zip(("start", "end", "new"), e, strict=True)) for e in es]) for k, (t, es) in enumerate(cases)], "doc_id long, text string, edits array<struct<start:long,end:long,new:string>>")
    out = {r["doc_id"]: r for r in edit_counts.recount(df, q.F.col("edits")).collect()}
    for k, (t, es) in enumerate(cases):
        after = edit_counts.edited(t, edit_counts.cleaned([dict(zip(("start", "end", "new"), e, strict=True)) for e in es], len(t)))
        assert (out[k]["n_tokens"], out[k]["n_tokens_after"], out[k]["n_chars_after"]) == (len(own.ids(t)), len(own.ids(after)), len(after)), (t[:60], es)
    long = edit_counts.recount(docs_of(spark, ["some words here " * 5000]), edit_counts.usual_edits(q.F.col("text"))).first()
    assert long["n_chars_encoded"] < 200
    assert edit_counts.recount(empty, edit_counts.usual_edits(q.F.col("text"))).collect() == []


def check_packing(texts, out, capacity=2048):
    own = Encoder()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for k, t in enumerate(texts):
        ids = [*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == capacity for r in pieces[1:])
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own_rows in by_seq.values():
        end = 0
        for r in sorted(own_rows, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    return len(by_seq)


def test_packing(spark, docs, empty):
    texts = made()
    n = check_packing(texts, packing.pack(docs).collect())
    assert n <= 1.05 * sum(r["length"] for r in packing.pack(docs).collect()) / 2048 + 1
    assert packing.pack(empty).collect() == []


def test_plans_hold_every_piece_and_come_near_the_bound():
    rng = random.Random(8)
    for case in range(30):
        h = Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 60), rng.randint(30, 45)]) for _ in range(rng.randint(1, 400)))
        runs, n = packing.best_plan(dict(h), 100)
        placed, fill = Counter(), Counter()
        for length, rank, first, each, offset in sorted(runs):
            assert rank == placed[length]
            end = next((r[1] for r in sorted(runs) if r[0] == length and r[1] > rank), h[length])
            for r in range(end - rank):
                fill[first + r // each] += length
                assert offset + r % each * length + length <= 100
            placed[length] = end
        assert placed == h and len(fill) == n and max(fill.values()) <= 100
        bins = []
        for x in sorted(h.elements(), reverse=True):  # best-fit decreasing
            k = min((k for k, r in enumerate(bins) if r >= x), key=lambda k: bins[k], default=None)
            if k is None:
                bins.append(100 - x)
            else:
                bins[k] -= x
        assert n <= len(bins) + 1, case


def fewest(sizes, demand, capacity):
    """The fewest sequences that hold the demand, over all configurations."""
    from functools import lru_cache
    from itertools import product

    configs = [c for c in product(*(range(capacity // s + 1) for s in sizes)) if any(c) and sum(n * s for n, s in zip(c, sizes, strict=True)) <= capacity]

    @lru_cache(None)
    def best(left):
        if not any(left):
            return 0
        lead = next(k for k, n in enumerate(left) if n)
        return 1 + min(best(tuple(max(0, n - m) for n, m in zip(left, c, strict=True))) for c in configs if c[lead])

    return best(tuple(demand))


def test_column_generation_against_all_configurations():
    rng = random.Random(21)
    for _ in range(25):
        sizes = sorted(rng.sample(range(22, 90), 4), reverse=True)
        demand = [rng.randint(1, 7) for _ in sizes]
        columns, times = packing.relaxed(sizes, demand, 100)
        want = fewest(sizes, demand, 100)
        assert np.allclose(columns @ times, demand) and times.min() > -1e-9 and (np.array(sizes) @ columns).max() <= 100
        assert times.sum() <= want + 1e-6
        _, n = packing.best_plan(dict(zip(sizes, demand, strict=True)), 100)
        assert want <= n <= want + 1


def test_edits_of_any_kind(spark):
    own, text = Encoder(), "one two  three four"
    edits = [None, [], [None], [(None, 3, "x")], [(2, None, "x")], [(-5, 3, "ab")], [(3, 1, "z")], [(4, 9, "A"), (6, 12, "B"), (5, 5, "C")], [(100, 200, "end")], [(0, 99, None)]]
    want = [text, text, text, text, text, "ab" + text[3:], text[:3] + "z" + text[3:], text[:4] + "A" + "C" + "B" + text[12:], text + "end", ""]
    kind = "doc_id long, text string, edits array<struct<start:long,end:long,new:string>>"
    df = spark.createDataFrame([(None, text, e) for e in edits] + [(3, None, [(0, 1, "x")]), (3, None, [(0, 1, "x")])], kind)
    out = edit_counts.recount(df, q.F.col("edits"), keep=True).collect()
    assert [(r["n_tokens_after"], r["n_chars_after"]) for r in out] == [(len(own.ids(t)), len(t)) for t in [*want, "x", "x"]]
    assert all(sum(x["chars"] for x in r["leaves"]) == r["n_chars_after"] and sum(x["tokens"] for x in r["leaves"]) == r["n_tokens_after"] for r in out)


def test_kept_trees_spare_the_encoding(spark, monkeypatch):
    """A second edit on the kept tree gives what a tree built anew gives, and encodes next to nothing."""
    text = "some words here, and 12 more. " * 400
    first = spark.createDataFrame([(1, text, [(500, 510, "new")])], "doc_id long, text string, edits array<struct<start:long,end:long,new:string>>")
    leaves = edit_counts.recount(first, q.F.col("edits"), keep=True).first()["leaves"]
    after = text[:500] + "new" + text[510:]
    second = spark.createDataFrame([(1, after, [(7000, 7004, " x y ")], leaves), (2, after, [(7000, 7004, " x y ")], leaves[1:]), (3, after, [(7000, 7004, " x y ")], None)], f"doc_id long, text string, edits array<struct<start:long,end:long,new:string>>, leaves {edit_counts.TREE}")
    out = edit_counts.recount(second, q.F.col("edits"), leaves=q.F.col("leaves")).orderBy("doc_id").collect()
    own, done = Encoder(), after[:7000] + " x y " + after[7004:]
    assert all(r["n_tokens_after"] == len(own.ids(done)) for r in out) and out[0]["n_chars_encoded"] < 60
    calls = []
    monkeypatch.setattr(Encoder, "coded", lambda self, texts: calls.append(len(texts)))
    kept = [{"chars": x["chars"], "tokens": x["tokens"]} for x in leaves]
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([after]), "edits": pa.array([[{"start": 1, "end": 2, "new": "z"}]]), "leaves": pa.array([kept], edit_counts.LEAVES)})
    assert next(edit_counts._run(None, False)([batch]))["n_tokens_after"][0].as_py() == len(own.ids(after[:1] + "z" + after[2:])) and not calls


# --- 7: pages ---------------------------------------------------------------------------------------------------------
PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class='cookie-banner'>We use</div><article><h1>Head &amp; tail</h1><p>One\n <b>two</b><p>Three<script>var x='</p>'</script><br>four</p><div class=\"share\">Share</div><section id='comments'><p>nice</p></section></article><aside>side</aside><form><p>f</p></form><footer>&copy;</footer>"


def test_pages(spark):
    df = spark.createDataFrame([(0, "http://A.example/x", PAGE, 1), (1, None, None, 1), (2, "bad", "", 1), (2, "bad", "just words <b>here", 1)], "page_id long, url string, html string, text int")
    out = rows(html_text.extract(df).na.fill(""), "page_id", "url", "text")
    assert out == [(0, "http://A.example/x", "Head & tail\nOne two\nThree\nfour"), (1, "", ""), (2, "bad", ""), (2, "bad", "just words here")]
    assert html_text.extract(df.limit(0)).collect() == []


def test_deep_pages_and_long_references():
    assert html_text.main_text("<div>word " * 50_000).split("\n") == ["word"] * 50_000
    zeros = "0" * 5000
    assert html_text.main_text(f"<p>a&#{zeros}65;&#{'9' * 5000};&#x42;&amp;") == "aA\ufffdB&"


def test_names_are_whole_words_and_never_cut_the_page():
    one = html_text.main_text
    assert one("<body class='has-sidebar'><p>Hello</p></body>") == one("<div class='content no-sidebar'><p>Hello</p></div>") == one("<main class='login-page-free promo'><p>Hello</p></main>") == one("<div data-id='search-12'>Hello</div>") == one("<div class='wrapper promo'><article>Hello</article></div>") == "Hello"
    assert one("<body><div class='ad'>Buy</div><article></article></body>") == one("<nav><article>x</article></nav>") == ""
    assert one("<div class='related'><article>card</article></div><article>Real<article class='comment'>first!</article></article>") == "Real"
    assert one("<ul><li><a href=x>Home</a></li></ul><p>One <a>link</a> here</p><p>&copy; 2024 Foo</p>") == "One link here"
    assert one("<div id='cookie-banner-12'>We use</div><div role='navigation'>Go</div><p>Text</p>") == "Text"


def site(k):
    """A page without names but for its title: what stands where is all there is."""
    rng = random.Random(k)
    text = "".join(f"<p>paragraph {k}.{i} of its own words {rng.random()}</p>" for i in range(rng.randint(1, 5)))
    return f"<body><div><p>Welcome to our site</p><p>Open from nine to five</p></div><div><ul><li>Best of the month</li><li>Prices</li></ul></div><div>{text}</div><div><p>All rights are ours</p></div></body>"


def slow_tree(pages):
    """(content, presentation, layouts) of each path of a host, straight from its definition."""
    parsed, out = [html_text.parsed(p) for p in pages], {}
    for path in {p for page in parsed for p in page.paths}:
        texts, layouts, m = Counter(), Counter(), 0
        for page in parsed:
            at = {k for k, p in enumerate(page.paths) if p == path}
            m += bool(at)
            texts.update({t for k, t, _ in page.blocks if k in at})
            layouts.update({page.layouts[k] for k in at if page.layouts[k]})
        if m > 1:
            drawn = lambda x, m=m: (2 + m * x) / (2 + m)
            content = drawn(1 - sum(np.log(n) / np.log(m) for n in texts.values()) / len(texts)) if texts else 1
            style = drawn(-sum(n / m * np.log(n / m) for n in layouts.values()) / np.log(m)) if layouts else 1
            out[path] = (content, style, max(1, len(layouts)))
    return out


def slow_blocks(text, tree, least=0.2):
    """Blocks kept by the composite importance, by recursion; for pages without names."""
    page = html_text.parsed(text)
    children = {k: [c for c, up in enumerate(page.parents) if up == k] for k in range(len(page.parents))}
    info = lambda k: tree.get(page.paths[k], (1, 1, 1))
    own = lambda k: [t for at, t, _ in page.blocks if at == k]

    def composite(k):
        parts = [(len(t), info(k)[0]) for t in own(k)] + [composite(c)[::-1] for c in children[k]]
        n = sum(x for x, _ in parts)
        w = 0.9 ** info(k)[2]
        return (1 - w) * info(k)[1] + w * (sum(x * y for x, y in parts) / n if n else 0), n

    floor, out = least * max(info(k)[0] for k, _, _ in page.blocks), []

    def walk(k):
        if k == 0 or page.names[k] == "body" or composite(k)[0] >= floor:
            out.extend((k, t) for t in own(k) if info(k)[0] >= floor)
            for c in children[k]:
                walk(c)

    walk(0)
    return "\n".join(t for at, t, _ in page.blocks if (at, t) in set(out))


def test_style_tree_against_its_definition(spark):
    pages = [site(k) for k in range(40)]
    df = spark.createDataFrame([(k, f"http://h/{k}", p, "x") for k, p in enumerate(pages)], "page_id long, url string, html string, host string")
    want = slow_tree(pages)
    got = {r["path"]: (r["content"], r["presentation"], r["layouts"]) for r in html_text.style_trees(df.select("host", "html")).collect()}
    assert {k: v for k, v in want.items() if v != (1, 1, 1)}.keys() == got.keys() and all(np.allclose(got[k], want[k]) for k in got)
    out = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert out == {k: slow_blocks(p, want) for k, p in enumerate(pages)}
    assert all(t.count("\n") == p.count("paragraph") - 1 and t.startswith("paragraph") and "ours" not in t for t, p in zip((out[k] for k in range(40)), pages, strict=True))
    assert {r["page_id"]: r["text"] for r in html_text.extract(df, max_paths=3).collect()} == out


def test_trees_leave_copies_and_what_an_article_repeats(spark):
    page = lambda k: f"<body><article><div class='lead'>Read our terms</div><p>text {k} of its own</p><p>The end.</p></article>"
    rows = [(k, f"http://h/{k}", page(k)) for k in range(40)] + [(100 + k, "http://copies/", "<body><p>One text</p><p>on every page</p></body>") for k in range(30)]
    rows += [(200 + k, "http://odd/", f"<body><div class='widget'><p>{'long text ' * 30} {k}</p></div><p>short</p></body>") for k in range(20)]
    out = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"text {k} of its own\nThe end." for k in range(40))
    assert all(out[100 + k] == "One text\non every page" for k in range(30))
    assert all(out[200 + k].startswith("long text") for k in range(20))


# --- 8: benchmark -----------------------------------------------------------------------------------------------------
def slow_hits(texts, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)))
    out = []
    for k, t in enumerate(texts):
        ws, hit, found = word(t), set(), set()
        for item, it in items:
            own = word(it)
            w = min(8, len(own))
            wanted = {tuple(own[i : i + w]) for i in range(len(own) - w + 1)} if w else set()
            for i in range(len(ws) - w + 1):
                if tuple(ws[i : i + w]) in wanted:
                    hit |= set(range(i, i + w))
                    found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((k, len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2))
    return out


@pytest.mark.parametrize("most", [2_000_000, 20])
def test_decontaminate(spark, tmp_path, most, monkeypatch):
    texts = [*made(30), "x y Über-kilo lima, GOLF", "alpha beta"]
    items = [(10, texts[3]), (9, texts[4][:60]), (100, "über kilo"), (3, ""), (4, None), (5, texts[3])]
    df, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    scanned = decontaminate.scan(df, bench, max_windows=most)
    assert sorted((r["doc_id"], r["__n_words"], len(r["__items"])) for r in scanned.collect()) == sorted((x[0], x[1], x[3]) for x in slow_hits(texts, items))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(q.op8_decontaminate(spark, str(tmp_path)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(slow_hits(texts, items))
    assert decontaminate.scan(df.limit(0), bench, max_windows=most).collect() == []
    kept = decontaminate.scan(df, bench, max_windows=most, remove=2)
    hits = {x[0]: x for x in slow_hits(texts, items)}
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, x in hits.items() if x[3] < 2)
    assert all(len(decontaminate.words(r["text"])) == hits[r["doc_id"]][1] - hits[r["doc_id"]][2] for r in kept.collect() if r["text"])
    if most < 100:  # a job of its own for each block: the last plan scans none
        assert scanned._jdf.queryExecution().toString().count("MapInArrow") <= 8


def test_removed_spans_leave_the_rest():
    assert decontaminate.remove_spans("One, two THREE four. Five", [1, 3]) == "One,  four. Five"
    assert decontaminate.remove_spans("a b", [0, 2]) == "" and decontaminate.remove_spans("", []) == ""


# --- 9: near duplicates -----------------------------------------------------------------------------------------------
def slow_print(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))) if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([ws[k : k + 3] for k in range(len(ws) - 2)] if len(ws) > 2 else [ws])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def test_simhash(spark, empty):
    rng = random.Random(6)
    long = " ".join(rng.choice(["red", "green", "blue", "black", "white", "grey"]) + str(rng.randint(0, 50)) for _ in range(900))
    texts = [*made(), long, long + " End", long.upper(), long.replace("red7", "red8"), "One two", "one  TWO"]
    prints = [slow_print(t) for t in texts]
    out = simhash.near_dedup(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in out} == dict(enumerate(prints))
    assert {r["doc_id"]: r["component_id"] for r in out} == dict(enumerate(slow_components(prints)))
    assert simhash.near_dedup(empty).collect() == []


@pytest.mark.parametrize("tile", [None, 16])
def test_links_lose_none(spark, tile):
    """Chains and clouds of near fingerprints, in one tile a count and in many."""
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(240):
        p = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 3)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints = sorted(prints)
    points = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)], "fp long, id long")
    edges = simhash.near_links(points, tile=tile)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert [found.get(k, k) for k in range(len(prints))] == slow_components(prints)


def test_components_of_a_star_chains_and_pairs(spark):
    """A node with most of the links, a chain whose ends are far apart, a cycle, and pairs."""
    links = [(5, 1000 + k) for k in range(600)] + [(2000 + k, 2001 + k) for k in range(40)] + [(3000, 3001), (3001, 3002), (3000, 3002)] + [(4000 + 2 * k, 4001 + 2 * k) for k in range(90)] + [(3, 1599)]
    found = simhash.components(spark.createDataFrame(links + links[:50], "u long, v long")).collect()
    want = {1000 + k: 3 for k in range(600)} | {5: 3} | {2001 + k: 2000 for k in range(40)} | {3001: 3000, 3002: 3000} | {4001 + 2 * k: 4000 + 2 * k for k in range(90)}
    assert len(found) == len(want) and {r["node"]: r["root"] for r in found} == want
