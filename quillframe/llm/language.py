"""Operator 9: language identification.

Method.  Sparse multinomial logistic regression on TF-IDF of hashed character n-grams (1 to 3 characters, letters only,
everything else a space), trained with follow-the-regularised-leader and elastic-net penalties, then calibrated by a
temperature.  Document frequencies come from every training document; the classifier is fitted on a bounded sample of
them (``SAMPLE_PER_LANGUAGE``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import fold, small_batches, struct, table, ticket

FEATURES = 2**16
LONGEST = 3
#: Documents of each language that the classifier is fitted on at most (they are chosen by a hash of their id).
SAMPLE_PER_LANGUAGE = 600
#: Most documents in the sample, shared out evenly among the languages; each language has one at least.
MAX_SAMPLE = 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.002, 0.0005
SCALE = 30.0
#: Characters that are looked at in one piece; longer texts are cut into pieces that overlap by an n-gram.
PIECE = 500_000
UNKNOWN = "und"

_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter; fractions, superscripts and numerals of all kinds aren't."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


class Alphabet:
    """Maps code points to lower-case letters, and all else to the space; built on first use."""

    table: np.ndarray | None = None

    @classmethod
    def map(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            codes = np.full(0x110000, 32, dtype=np.uint32)
            for i in range(0x20000):
                c = chr(i)
                if c.isalpha():
                    low = c.lower()
                    codes[i] = ord(low) if len(low) == 1 else i
            codes[0x20000:0x32000] = np.arange(0x20000, 0x32000)
            cls.table = codes
        return cls.table[points]


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document numbers, starts, code points): texts in pieces, each followed by two characters that only look ahead."""
    docs, starts, parts, size = [], [], [], 0

    def flush():
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return np.array(docs), np.array(starts), Alphabet.map(points)

    for d, text in enumerate(texts):
        for s in range(0, max(1, len(text)), PIECE):
            part = text[s : s + PIECE + LONGEST - 1]
            part += " " * (min(len(text) - s, PIECE) + LONGEST - 1 - len(part))
            docs.append(d)
            starts.append(size)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield flush()
                docs, starts, parts, size = [], [], [], 0
    if docs:
        yield flush()


def buckets(c: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of the n-gram that starts at each place but the last two, for n = 1, 2, 3; 0 where it has no letter."""
    a, b, d = c[:-2], c[1:-1], c[2:]
    shift = np.uint32(16)
    h = a * np.uint32(2654435761)
    yield np.where(a == 32, 0, (h >> shift) | np.uint32(1)).astype(np.int64)
    h = (h ^ (h >> shift)) * np.uint32(2246822519) + b * np.uint32(3266489917)
    yield np.where((a == 32) & (b == 32), 0, (h >> shift) | np.uint32(1)).astype(np.int64)
    h = (h ^ (h >> shift)) * np.uint32(668265263) + d * np.uint32(374761393)
    yield np.where((a == 32) & (b == 32) & (d == 32), 0, (h >> shift) | np.uint32(1)).astype(np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and how often each stands in it, without bucket 0."""
    total = np.zeros(FEATURES, dtype=np.int64)
    for _, _, points in pieces([text]):
        for b in buckets(points):
            total += np.bincount(b, minlength=FEATURES)
    total[0] = 0
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages, idf and scale included
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row of logits for each text, over the whole text."""
        sums = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts))
        for docs, starts, points in pieces(texts):
            if len(points) < LONGEST:
                continue
            for b in buckets(points):
                # What only looks ahead is of no text.
                b[starts[1:] - 1] = b[starts[1:] - 2] = 0
                at = np.minimum(starts, len(b) - 1)
                for k in range(len(self.languages)):
                    np.add.at(sums[:, k], docs, np.add.reduceat(self.weights[b, k], at))
                np.add.at(n, docs, np.add.reduceat((b > 0).astype(np.float64), at))
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], languages: list[str], idf: np.ndarray, seed: int = 7) -> Model:
    """FTRL-proximal, one document at a time; every fifth document is kept back to set the temperature."""
    k = len(languages)
    number = {name: i for i, name in enumerate(languages)}
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    scale = idf * SCALE

    def weights(rows):
        w = -(np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - L1, 0)) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)
        return np.where(np.abs(z[rows]) <= L1, 0.0, w)

    rows = []
    for text, label in zip(texts, labels, strict=True):
        at, count = counts(text)
        if len(at):
            rows.append((np.append(at, FEATURES), np.append(count / count.sum() * scale[at], 1.0), number[label], text))
    random = np.random.default_rng(seed)
    train, kept = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    for _ in range(EPOCHS):
        for i in random.permutation(len(train)):
            at, x, y, _ = train[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    model = Model(languages, (w[:FEATURES] * scale[:, None]).astype(np.float32), w[FEATURES])
    if kept:
        logits, y = model.logits([r[3] for r in kept]), np.array([r[2] for r in kept])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    return model


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES, dtype=bool)
    n = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for _, _, points in pieces([text]):
                for b in buckets(points):
                    seen[b] = True
            at = np.flatnonzero(seen)
            total[at] += 1
            seen[at] = False
            n += 1
    total[0] = n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "n"])


def train(docs: DataFrame) -> Model | None:
    """A model of docs (doc_id, text, lang), or None if they have no language or no text.  Null texts are left out.

    Each language's sample are the rows with the least hashes of id and text, whatever the order of the table.
    """
    docs = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = docs.groupBy("lang").count().collect()
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    rows = docs.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros(FEATURES)
    for r in rows.collect():
        df[r["feature"]] = r["n"]
    idf = np.where(df > 0, np.log((1 + df[0]) / (1 + df)) + 1, 0.0)
    idf[0] = 0
    each = max(1, min(SAMPLE_PER_LANGUAGE, MAX_SAMPLE // len(sizes)))
    counts = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["count"]) for r in sizes], "lang string, n long"))
    # Somewhat more than twice as many as wanted are expected to be ranked, however large a language is.
    few = docs.withColumn("ticket", ticket("doc_id", "text")).join(counts, "lang")
    few = few.filter(F.col("ticket") * F.col("n") < 2 * each + 40)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("ticket", "doc_id", "text"))
    sample = few.withColumn("rank", rank).filter(F.col("rank") <= each).select("doc_id", "text", "lang").collect()
    sample.sort(key=lambda r: (str(r["doc_id"]), r["text"], r["lang"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], languages, idf)


def identify(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the calibrated probability of that language), replacing such columns.

    Null texts and texts without a letter get ``und`` and 0; so do all texts if there is no model.  Texts are read
    whole, in pieces; equal texts get equal answers; where languages tie, the first by name is taken; no rows give no
    rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(struct("lang_pred string, score double"))
    def predict(text: pa.Array) -> pa.Array:
        m = shared.value
        texts = [t or "" for t in text.to_pylist()]
        known = [m is not None and has_letter(t) for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if any(known):
            at = [i for i, k in enumerate(known) if k]
            best, p = m.predict([texts[i] for i in at])
            for i, b, s in zip(at, best, p, strict=True):
                names[i], scores[i] = m.languages[b], float(s)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(F.struct(*names).alias("row"), predict(F.col(text_column)).alias("new"))
    return out.select(*(F.col(f"row.`{n}`").alias(n) for n in names), "new.lang_pred", "new.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held_out))
    out = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
