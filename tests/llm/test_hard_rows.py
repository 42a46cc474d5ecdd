"""Every operator and pipeline stage on hard rows, every query's columns, and the ways around broadcasts."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillframe.llm import (
    common, decontaminate, html, language, line_dedup, near_dup, packing, quality, registry, secrets, tokens, toxicity,
)

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

#: Names that the operators use inside; a table may have any of them.
CLASHES = (
    "id row new gone again key node label size keys n d h spans spans_ x w hits at hash gram item text_hash hi lo drop is_hot salt rep tie"
    " held_out score predicted lang_pred class_id cluster trusted ratios llr kept n_words n_lines n_dropped n_tokens start shard bin offset"
    " piece source_bit n_assign base_sha256 ids counts n_chars html url"
).split()
LONG = " ".join(f"word{i % 977} é{i % 13}" for i in range(40_000)) + "\n" + "x" * 50_000


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and clashing names."""
    same = "the same words stand here twice or more often than that " * 12
    texts = [(1, None), (None, "a text without an id " * 30), (2, ""), (3, LONG), (4, same), (4, same), (4, "another text"), (5, "\n\n \t"), (6, same), (7, same + "end"), (None, None), (8, "½ ² ① Ⅷ 12"), (9, "token = 'Zx91kQpLm2Tr'"), (10, "\x00   \U0001f600 �")]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", *(None if k % 2 else "c" for _ in CLASHES)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the same words stand here twice or more often than that the same words"), (2, None), (3, ""), (3, "½ ² 12")], "item_id long, text string")


def operators(spark, bench):
    labels = spark.createDataFrame([(4, 1), (None, 1), (4, 1)], "doc_id long, n int").select("doc_id")
    return {
        "lines": line_dedup.dedup_lines, "quality": lambda d: quality.score_quality(d, d, labels), "secrets": secrets.find_secrets,
        "near": near_dup.near_duplicates, "keep_one": near_dup.keep_one, "packing": packing.pack_documents, "clean": lambda d: decontaminate.clean_documents(d, bench),
        "spans": lambda d: decontaminate.drop_spans(d, bench), "hits": lambda d: decontaminate.contamination(d, bench),
        "language": lambda d: language.identify(d, language.train(d)), "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.train(d.select("doc_id", "text").withColumn("toxic", (language.F.col("doc_id") > 4).cast("int")).filter("doc_id IS NOT NULL"))),
        "pages": lambda d: html.extract(d.withColumn("html", language.F.col("text"))),
    }


def test_hard_rows(spark, hard, bench):
    n = hard.count()
    for name, operator in operators(spark, bench).items():
        out = operator(hard).collect()
        if name in ("keep_one", "clean"):
            assert len(out) < n, name
        elif name != "packing":
            assert len(out) == n, name
        assert operator(hard.limit(0)).count() == 0, name


def test_hard_rows_results(spark, hard, bench, tmp_path):
    near = {(x.doc_id, x.class_id) for x in near_dup.near_duplicates(hard).collect()}
    assert near == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 4), (7, 4), (8, 8), (9, 9), (10, 10)}
    kept = near_dup.keep_one(hard)
    assert kept.columns == hard.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id) == [1, 2, 3, 4, 4, 5, 8, 9, 10]
    langs = {x.doc_id: x for x in language.identify(hard, language.train(hard)).collect()}
    assert {i for i, x in langs.items() if x.lang_pred == "und"} >= {1, 2, 5, 8} and langs[8].score == 0 and langs[3].lang_pred == "en"
    for stage in (decontaminate.clean_documents(hard, bench), decontaminate.drop_spans(hard, bench)):
        assert stage.columns == hard.columns
    tokens.write_tokens(hard, str(tmp_path / "t"), tokens.default_tokenizer())
    read = tokens.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert len(read) == hard.count() and read[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(read, read[1:], strict=False))
    packed = packing.pack_documents(hard).toPandas()
    assert packed.groupby(["shard", "bin"]).n_tokens.sum().max() <= packing.CAPACITY
    assert packed[packed.doc_id == 3].n_tokens.sum() == len(LONG.split()) + 1


def test_packing_takes_classes_and_token_counts(spark, tmp_path):
    """Near duplicates never share a bin, and sizes are the ids that operator 5 wrote."""
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"x{i % 40}"]) if i < 40 else f"unlike any other {i} " * 9, "s") for i in range(80)], "doc_id long, text string, source string")
    classes = near_dup.near_duplicates(docs).withColumnRenamed("class_id", "cluster")
    tokens.write_tokens(docs, str(tmp_path / "t"), tokens.default_tokenizer())
    sizes = tokens.read_tokens(spark, str(tmp_path / "t"))
    packed = packing.pack_documents(docs, classes, per_source=100, sizes=sizes).toPandas()
    near = packed[packed.doc_id < 40]
    assert len(packed) == 80 and near.groupby(["shard", "bin"]).size().max() == 1
    assert dict(zip(packed.doc_id, packed.n_tokens, strict=True)) == {x.doc_id: x.n_tokens for x in sizes.collect()}


def test_text_ids(spark):
    """Ids written as digits serve where ids are compared as numbers."""
    table = spark.createDataFrame([(str(i), "w " * i, "s") for i in range(9, 13)], "doc_id string, text string, source string")
    assert line_dedup.dedup_lines(table).count() == packing.pack_documents(table).select("doc_id").distinct().count() == 4
    assert sorted(x.class_id for x in near_dup.near_duplicates(table).collect())[-1] in (9, 10, 11, 12)


@needs_tables
def test_stages(spark, hard, tmp_path):
    """Each stage keeps the columns, and takes hard rows and an empty table."""
    plain = hard.select("doc_id", "text", "lang", "source", "n_chars", "gone", "d", "h", "row", "id")
    for table in (plain, plain.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.count() <= 2 * table.count() + 100, name
            assert name == "packing" or out.columns == table.columns, name


@needs_tables
def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


CONTRACT = {
    "op1_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op2_quality_rules": {"doc_id": "bigint", **dict.fromkeys("n_words word_chars n_symbols n_dup_lines n_repeat_words".split(), "bigint"), "base_failed": "boolean", "kept": "boolean"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op6_near_dup": {"doc_id": "bigint", "class_id": "bigint"},
    "op7_packing": {"doc_id": "bigint", "shard": "int", "bin": "bigint", "offset": "bigint", "n_tokens": "bigint"},
    "op8_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@needs_tables
@pytest.mark.parametrize("name", CONTRACT)
def test_query(spark, name):
    out = registry.queries()[name](spark, SF)
    types = dict(out.dtypes)
    assert CONTRACT[name].items() <= types.items()
    rows = out.collect()
    key = "page_id" if name == "op10_html_text" else "doc_id"
    table = "pages" if name == "op10_html_text" else "documents"
    ids = sorted(x[0] for x in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert (sorted(set(x[key] for x in rows)) if name == "op7_packing" else sorted(x[key] for x in rows)) == ids
    if "held_out" in types:
        modulus, rest = (3, 1) if name == "op3_toxicity" else (4, 2)
        assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % modulus == rest) and 0 <= x.score <= 1 for x in rows)


@needs_tables
def test_language_learns_from_its_fold_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, *rest: seen.extend(texts))
    language.query(spark, SF)
    held = {x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect() if zlib.crc32(str(x.doc_id).encode()) % 4 == 2}
    others = {x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect() if zlib.crc32(str(x.doc_id).encode()) % 4 != 2}
    assert seen and set(seen) <= others and not set(seen) & (held - others)


def test_language_scores_by_hand():
    """The vectorised scores against one n-gram after another."""
    r = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], r.normal(size=(language.FEATURES, 3)).astype(np.float32), r.normal(size=3))
    model.weights[0] = 0  # what has no letter weighs nothing
    texts = ["Héllo, wörld 12", "a", "xyz " * 50, "ß?! é"]
    for text, row in zip(texts, model.logits(texts), strict=True):
        points = language.Alphabet.map(np.array([ord(c) for c in text + "  "], np.uint32))
        total, n = np.zeros(3), 0
        for i in range(len(text)):
            for h in language.buckets(points[i : i + 3]):
                if h[0]:
                    total, n = total + model.weights[h[0]], n + 1
        assert np.allclose(row, total / n + model.bias, atol=1e-4)


def test_toxicity_scores_by_hand():
    """Batched windows, pieces and caches against one window at a time, over the seams of a very long text."""
    network = toxicity.Network.fresh(np.arange(toxicity.WORD_BUCKETS) % 40, np.arange(toxicity.CHAR_BUCKETS) % 60)
    network.calibration = np.array([1.0, 0.5, 0.25, -1.0])
    scorer = toxicity.Scorer(network)
    r = np.random.default_rng(2)
    step, toxicity.PIECE_WORDS = toxicity.PIECE_WORDS, 160
    try:
        for n in (1, 31, 32, 33, 175, 176, 177, 336, 337, 400, 1000):
            words = [f"w{k}" for k in r.integers(0, 50, n)]
            pieces = list(scorer._pieces(words))
            assert sum(len(toxicity.window_starts(len(p))) for p in pieces) == len(toxicity.window_starts(n))
            windows = []
            for s in toxicity.window_starts(n):
                own = words[s : s + 32]
                at = np.minimum(np.arange(32), len(own) - 1)[None]
                windows.append(network.forward(network.gates(network.inputs(own)[0]), at, np.arange(32)[None] < len(own))[0])
            figures = toxicity.worst(np.array(windows))
            want = 1 / (1 + np.exp(-(figures @ network.calibration[:3] + network.calibration[3])))
            assert abs(scorer.scores([" ".join(words)])[0] - want) < 1e-4
    finally:
        toxicity.PIECE_WORDS = step


def test_llr_by_hand(spark):
    """The log-likelihood ratio of every document against a count in Python."""
    import math
    from collections import Counter

    texts = ["alpha beta gamma", "alpha, beta!", "delta alpha alpha", "", "ümläut ab a", "alpha beta " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = spark.createDataFrame([(0,), (2,)], "doc_id long")
    grams = docs.select("doc_id", quality.buckets(quality.words(quality.F.col("text"))).alias("b")).collect()
    raw, target = Counter(), Counter()
    for x in grams:
        weight = int(1024 * min(1, 2000 / max(1, len(x.b))))
        for b in x.b:
            raw[b] += weight
            target[b] += weight * (x.doc_id in (0, 2))
    k, share = quality.SMOOTHING * 1024, sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + k) / (n * share + k)) for b, n in raw.items()}
    got = {x.doc_id: x.llr for x in quality.score_quality(docs, docs, trusted).collect()}
    for x in grams:
        assert abs(got[x.doc_id] - (sum(ratio[b] for b in x.b) / len(x.b) if x.b else 0)) < 1e-9


# --- Beyond the limits of broadcasts.


def test_shuffled_decontamination(spark, hard, bench, monkeypatch):
    want = sorted(decontaminate.contamination(hard, bench).collect(), key=repr)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_GRAMS", 0)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_HITS", 0)
    out = decontaminate.contamination(hard, bench)
    assert sorted(out.collect(), key=repr) == want and any(x.n_hit for x in want)


def test_shuffled_lines_and_hot_keys(spark, monkeypatch):
    line = "a line that very many of the documents share, long enough for a key"
    docs = spark.createDataFrame([(i, f"{line}\nown line {i} which is also long enough for a key {i % 400}") for i in range(2000)], "doc_id long, text string")
    want = sorted(line_dedup.dedup_lines(docs).collect())
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", 0)
    assert sorted(line_dedup.dedup_lines(docs).collect()) == want
    monkeypatch.setattr(common, "LEAST_HOT", 1)
    assert sorted(line_dedup.dedup_lines(docs).collect()) == want
    assert sum(x.n_dropped for x in want) == 1999 + 0


def test_shuffled_near_duplicates(spark, monkeypatch):
    base = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(base[:250] + [f"x{i // 9}"])) for i in range(90)], "doc_id long, text string")
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    monkeypatch.setattr(near_dup, "MAX_BROADCAST", 0)
    assert {x.class_id for x in near_dup.near_duplicates(docs).collect()} == {0}


def test_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 10)
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    many = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(300)] + [(None, 1)], "k long, v long")
    one = spark.createDataFrame([(i, i * i) for i in range(200)], "k long, s long")
    spread = common.Spread(many, ["k"])
    assert spread.hot.count() == 1
    for how in ("inner", "left"):
        assert sorted(spread.join(many, one, how).collect(), key=repr) == sorted(many.join(one, "k", how).collect(), key=repr)
