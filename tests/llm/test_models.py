"""The trained operators, token files, near duplicates, packing and the pipeline."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from quillframe.llm import html, language, near_dup, packing, tokens, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, None), (None, "text without an id here it is", "s"), (2, "", "s"), (3, long, "s"), (4, "same words in here twice", "s"), (4, "same words in here twice", "s"), (4, "other", "s"), (5, "\n\n \t", None)]
    return spark.createDataFrame(rows, SCHEMA)


# --- Operator 3.


def toxic_texts(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    texts, labels = [], []
    for k in range(n):
        w = [word() for _ in range(r.randint(20, 150))]
        if k % 2:
            for _ in range(3):
                w[r.randrange(len(w))] = "zq" + word()
        texts.append(" ".join(w))
        labels.append(k % 2)
    return texts, labels


def test_gradient():
    n = toxicity.Network.fresh(np.arange(toxicity.WORD_BUCKETS) % 40, np.arange(toxicity.CHAR_BUCKETS) % 60)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    r = np.random.default_rng(0)
    windows, real = r.integers(0, 4, (3, toxicity.WINDOW)), np.ones((3, toxicity.WINDOW), bool)
    real[2, 20:] = False
    args = (["ab", "cde", "fgh", "x"], windows, real, np.array([1, 0, 1]), np.ones(3))
    _, g = n.gradient(*args)
    for k, v in g.items():
        i, flat = int(np.abs(v).argmax()), n.p[k].reshape(-1)
        old, loss = flat[i], []
        for e in (1e-3, -1e-3):
            flat[i] = old + e
            loss.append(n.gradient(*args)[0])
        flat[i] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - v.reshape(-1)[i]) < 1e-4 * max(1, abs(v).max())


def test_toxicity(spark, odd):
    network = toxicity.fit(*toxic_texts(300, 1))
    texts, labels = toxic_texts(100, 2)
    scores = toxicity.Scorer(network).scores(texts)
    assert ((scores >= 0.5) == np.array(labels)).mean() >= 0.9
    out = toxicity.score_toxicity(odd.withColumn("score", odd.text), network).collect()
    assert len(out) == odd.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in out)
    assert all(x.score == 0 for x in toxicity.score_toxicity(odd, None).collect())
    assert toxicity.score_toxicity(odd.limit(0), network).count() == 0
    windows = toxicity.window_starts(100)
    assert windows[-1] == 68 and {i for s in windows for i in range(s, s + 32)} == set(range(100))


def test_toxicity_learns_from_whole_texts(monkeypatch):
    texts, labels = toxic_texts(20, 3)
    texts = [" ".join((t.split() * 60)[:1200]) for t in texts]
    seen, figures, gradient, calibrate = [], [], toxicity.Network.gradient, toxicity._calibrate
    monkeypatch.setattr(toxicity.Network, "gradient", lambda n, *a: seen.append(len(a[1])) or gradient(n, *a))
    monkeypatch.setattr(toxicity, "_calibrate", lambda f, y: figures.append(f) or calibrate(f, y))
    network = toxicity.fit(texts, labels)
    assert sum(seen) >= toxicity.EPOCHS[0] * 16 * len(toxicity.window_starts(1200))
    w = network.calibration
    expected = 1 / (1 + np.exp(-(figures[0] @ w[:-1] + w[-1])))
    assert np.allclose(toxicity.Scorer(network).scores(texts[::5]), expected, atol=1e-4)


def test_toxicity_hashes_a_word_once_for_all_steps(monkeypatch):
    texts, labels = toxic_texts(60, 5)
    names = {w for t in texts for w in toxicity.word_list(t)}
    done, hashed = [], toxicity.hashed
    monkeypatch.setattr(toxicity, "hashed", lambda words: done.append(len(words)) or hashed(words))
    toxicity.fit(texts, labels)
    assert sum(done) <= 2 * len(names)


def test_toxicity_network_by_hand():
    """Logits of windows in a batch against one gate of one word after another; words without a known n-gram too."""
    words = ["ab", "cde", "fgh", "x", "ab"]
    char_row = np.arange(toxicity.CHAR_BUCKETS) % 3
    word, starts, buckets, weights = toxicity.hashed(words)
    a, b = starts[3], starts[4]
    char_row[buckets[:, a:b]] = 0  # "x" has none
    n = toxicity.Network.fresh(np.arange(toxicity.WORD_BUCKETS) % 40, char_row)
    r, p = np.random.default_rng(4), n.p
    windows, real = r.integers(0, 5, (3, toxicity.WINDOW)), np.ones((3, toxicity.WINDOW), bool)
    real[1, 7:] = False
    x = []
    for k, end in enumerate([*starts[1:], buckets.shape[1]]):
        rows = [char_row[v] for v, w in zip(buckets[:, starts[k] : end].ravel(), weights[:, starts[k] : end].ravel(), strict=True) if w and char_row[v]]
        grams = sum((p["char"][v] for v in rows), np.zeros(toxicity.CHAR_DIM)) / max(1, len(rows)) ** 0.5
        x.append(np.concatenate([p["word"][word[k] % 40], grams]))
    size, sigmoid = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    for got, own, here in zip(n.forward(n.gates(n.inputs(words)[0]), windows, real), windows, real, strict=True):
        states = np.zeros((toxicity.WINDOW, 2 * size))
        for way, order, at in (("f", range(toxicity.WINDOW), 0), ("b", range(toxicity.WINDOW - 1, -1, -1), size)):
            h = np.zeros(size)
            for t in order:
                g, hu = x[own[t]] @ p[f"x{way}"] + p[f"c{way}"], h @ p[f"u{way}"]
                z, reset = sigmoid(g[:size] + hu[:size]), sigmoid(g[size : 2 * size] + hu[size : 2 * size])
                h = z * h + (1 - z) * np.tanh(g[2 * size :] + reset * hu[2 * size :])
                states[t, at : at + size] = h
        e = np.where(here, np.exp(np.tanh(states @ p["att"]) @ p["query"]), 0)
        assert abs(got - (e / e.sum() @ states @ p["out"] + p["bias"][0])) < 1e-4


def test_toxicity_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 20)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 40)
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: got.append((texts, labels)))
    for parts in (1, 7):
        spark.range(3000).selectExpr("id AS doc_id", "'text ' || id AS text").repartition(parts).write.parquet(f"{tmp_path}/{parts}/documents.parquet")
        spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 5 = 0 AS int) AS toxic").repartition(parts).write.parquet(f"{tmp_path}/{parts}/labels.parquet")
        toxicity.query(spark, f"{tmp_path}/{parts}")
    assert got[0] == got[1] and sum(got[0][1]) == 20 and len(got[0][1]) == 60


# --- Operator 9.


def test_language(spark, odd):
    r = random.Random(1)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(40))
    sets = {"aa": ["the", "ing", "er", "on"], "bb": ["ung", "sch", "ein", "ß"], "cc": ["ción", "ado", "ñ", "os"]}
    rows = [(i, make(sets[k]), k) for i, k in enumerate(list(sets) * 60)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    fresh = [(make(v), k) for k, v in sets.items() for _ in range(20)]
    best, p = model.predict([t for t, _ in fresh])
    assert np.mean([model.languages[b] == k for b, (_, k) in zip(best, fresh, strict=True)]) >= 0.95 and p.min() > 0.3
    whole, cut = "theing eron " * 200_000, "theing eron "
    assert model.languages[model.predict([whole])[0][0]] == model.languages[model.predict([cut])[0][0]]
    out = language.identify(odd.withColumn("score", odd.text), model).collect()
    assert len(out) == odd.count() and {x.lang_pred for x in out if not (x.text or "").strip()} == {"und"}
    assert all(x.lang_pred == "und" for x in language.identify(odd, None).collect())
    assert language.identify(odd.limit(0), model).count() == 0
    assert language.train(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def test_language_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_SAMPLE", 500)
    got = []
    monkeypatch.setattr(language, "fit", lambda texts, labels, languages, idf: got.append((texts, labels, languages)))
    rows = [(i, f"text {i}", f"l{i % 250:03}") for i in range(2500)]
    for parts in (1, 5):
        language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").orderBy("lang").repartition(parts))
    assert got[0] == got[1] and len(got[0][2]) == 250
    assert all(got[0][1].count(k) == 2 for k in got[0][2])


# --- Operator 10.


def test_html(spark):
    model = html.trained()
    exact = sum(html.main_text(s, model).replace("\n\n", "") != "" and set(html.main_text(s, model).split("\n\n")) == c for s, c in html.labelled_pages(60, seed=5))
    assert exact >= 48
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>'
        '<div class="cookie-notice">We use cookies here.</div><article><h1>A title &amp; more</h1><p>First para\n  graph of&nbsp;some words, long enough.'
        '<p>Second <b>bold</b> one<br>with a break in it.<div class="ad">Buy this now please.</div></article>'
        '<section id="comments"><div class="comment"><p>Nice text, thank you very much indeed.</p></div></section><footer>&copy; 2020 Site</footer>'
    )
    assert html.main_text(page, model) == "A title & more\n\nFirst para graph of some words, long enough.\n\nSecond bold one with a break in it."
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p" * 500), (4, "u", "<div>" * 3000 + "x"), (5, "u", page), (5, "u", page), (6, "u", "plain & text <"), (7, "u", "<script>never closed")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", html.F.lit("old"))
    out = html.extract(table).collect()
    assert len(out) == len(rows) and all(x.n_chars == len(x.text) for x in out)
    assert {x.text for x in out if x.page_id in (1, 2, 7)} == {""} and html.extract(table.limit(0)).count() == 0


def test_sum_product_is_exact():
    r = np.random.default_rng(1)
    parents, kinds = [-1, 0, 0, 1, 1, 2], [0, 0, 1, 2, 3, 1]
    odds, edges = r.normal(size=6).tolist(), np.exp(r.normal(size=(html.EDGE_KINDS, 2, 2)))
    weight = {}
    for s in range(64):
        y = [s >> i & 1 for i in range(6)]
        w = np.exp(sum(o * v for o, v in zip(odds, y, strict=True)))
        for i in range(1, 6):
            w *= edges[kinds[i], y[parents[i]], y[i]]
        weight[tuple(y)] = w
    total = sum(weight.values())
    got, _ = html.marginals(odds, parents, kinds, edges.tolist())
    for i in range(6):
        assert abs(got[i] - sum(w for y, w in weight.items() if y[i]) / total) < 1e-9


# --- Operator 5.


def test_code():
    r = np.random.default_rng(1)
    for counts in (np.bincount(r.zipf(1.3, 5000) % 700), np.array([0, 3]), np.array([5, 1]), 2 ** np.arange(30)):
        lengths = tokens.code_lengths(counts, 12)
        used = lengths[lengths > 0].astype(float)
        assert lengths.max() <= 12 and (len(used) == 1 or abs((2**-used).sum() - 1) < 1e-12)
        ids = r.choice(np.flatnonzero(counts), 1000)
        code = tokens.Code(lengths)
        bits, marks = code.encode(ids)
        lanes = np.append(np.full(1000 // tokens.LANE, tokens.LANE), 1000 % tokens.LANE)
        assert (code.decode(bits, np.frombuffer(marks, np.uint32), lanes) == ids).all()


def test_token_files(spark, odd, tmp_path):
    path = tokens.default_tokenizer()
    texts = ["Ünïcode İstanbul ΑΣ. don't I'LL x... a.,b \x01 y <|endoftext|> a<|endoftext|>b \x1c w é. Å. １２.", "\t a\r\nb", ".", "ab.́ cd"]
    table = odd.union(spark.createDataFrame([(10 + i, t, "s") for i, t in enumerate(texts)], SCHEMA))
    tokens.write_tokens(table.select("doc_id", "text"), str(tmp_path / "t"), path)
    got = sorted((tuple(x) for x in tokens.read_tokens(spark, str(tmp_path / "t")).collect()), key=lambda x: x[1])
    encode = Tokenizer.from_file(path)
    want = {}
    for x in table.collect():
        ids = np.array([*encode.encode(x.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.setdefault(x.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for doc, at, n, crc in got:
        assert at == start
        want[doc].remove((n, crc))
        start += n
    assert not any(want.values()) and [x[0] for x in got][1:] == sorted(x[0] for x in got if x[0] is not None)
    tokens.write_tokens(table.select("doc_id", "text").limit(0), str(tmp_path / "e"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0


# --- Operator 6.


def test_signatures_are_unbiased():
    r, gaps = np.random.default_rng(0), []
    for t in range(80):
        a, b = r.integers(1, 6, 40), r.integers(1, 6, 40)
        b = np.where(r.random(40) < 0.6, a, b)
        v = near_dup.mix(np.arange(40, dtype=np.uint64) + np.uint64(1000 * t))
        s = near_dup.signatures(np.repeat([0, 1], 40), np.append(v, v), np.append(a, b), 2)
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.015


def test_near_duplicates(spark, odd):
    r, rows = random.Random(4), []
    for base in range(12):
        words = [f"w{r.randint(0, 400)}" for _ in range(120)]
        for _ in range(r.choice([1, 2, 30])):
            w = words[:]
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 8])):
                w[r.randrange(120)] = f"n{r.random()}"
            rows.append((" ".join(w), base))
    table = spark.createDataFrame([(100 + i, t, "s") for i, (t, _) in enumerate(rows)], SCHEMA)
    sets = {100 + i: near_dup.multiset(t) for i, (t, _) in enumerate(rows)}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and rows[a - 100][1] == rows[b - 100][1] and near_dup.similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(table).collect()}
    assert got == label and len(set(label.values())) < len(rows)
    out = near_dup.near_duplicates(odd).collect()
    assert len(out) == odd.count() and all(x.class_id == x.doc_id for x in out)
    assert near_dup.keep_one(odd).count() == odd.count() - 1 and near_dup.near_duplicates(odd.limit(0)).count() == 0


# --- Operator 7.


def test_packing_by_hand():
    r = random.Random(6)
    rows = pd.DataFrame([(i, 0, 0, r.randint(1, 100), r.randint(0, 2), r.randint(0, 40), 0) for i in range(300)], columns=["id", "piece", "start", "size", "source_bit", "cluster_bit", "cluster"])
    got = packing.pack(rows, capacity=100, per_source=2)
    bins = []
    for x in got.itertuples():
        fits = [(100 - sum(y.size for y in b), k) for k, b in enumerate(bins) if sum(y.size for y in b) + x.size <= 100]
        fits = [f for f in fits if sum(y.source_bit == x.source_bit for y in bins[f[1]]) < 2 and all(y.cluster_bit != x.cluster_bit for y in bins[f[1]])]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        assert x.bin == at and x.offset == sum(y.size for y in bins[at])
        bins[at].append(x)


def test_packing(spark, odd):
    out = packing.pack_documents(odd, capacity=1000).toPandas()
    assert out.groupby(["shard", "bin"]).n_tokens.sum().max() <= 1000
    long = out[out.doc_id == 3].sort_values("piece")
    assert long.n_tokens.sum() == 60_001 and (long.start == long.n_tokens.cumsum() - long.n_tokens).all()
    assert len(out[out.doc_id == 4]) == 3 and out[out.doc_id == 1].n_tokens.tolist() == [1]
    twins = out[(out.doc_id == 4) & (out.n_tokens == 6)]
    assert twins.bin.nunique() == 2 and packing.pack_documents(odd.limit(0)).count() == 0


# --- Pipeline.


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {x.doc_id for x in packed.select("doc_id").collect()} == {x.doc_id for x in before.select("doc_id").collect()}
    marked = {x.doc_id: x.class_id for x in near_dup.near_duplicates(before).collect()}
    assert all(k == v for k, v in marked.items())
