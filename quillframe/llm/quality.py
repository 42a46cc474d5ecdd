"""Operator 2: quality rules.

Method.  The words of a text and its pairs of neighbouring words (1-grams and 2-grams) are hashed to a fixed number of
buckets.  Bucket counts of a trusted target and of the whole raw corpus give two smoothed multinomials, in which no
document weighs more than ``FULL_GRAMS`` n-grams; a document's score is the sum of the log ratios of its n-grams, divided by their number.  A document is kept if it passes the base
rules and its score is at least a fixed threshold.  Everything runs as DataFrame functions: the model is one array of
``BUCKETS`` numbers, which reaches the rows as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import table

#: Buckets of the hashed n-grams, a power of two; bounds the model (128 kB of numbers).
BUCKETS = 16384
#: Occurrences added to each bucket of both multinomials, on the scale of the target (see ``log_ratios``).
SMOOTHING = 16
#: N-grams that a document counts with in full; of a longer one each n-gram weighs less, so that the document's weight is
#: the same.  Weights are whole numbers of 1 / ``UNIT``, so that sums don't depend on their order.
FULL_GRAMS, UNIT = 2000, 1024
#: Least score, in nats for each n-gram, of a document that is kept.
THRESHOLD = -0.1
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Trusted ids are broadcast up to this number (about 64 MB); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000

_BLANK_CLASS = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of characters other than blanks; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_CLASS))


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_words(tri: Column) -> Column:
    """Words inside 3-word windows that stand in the text twice or more; tri has a hash for each window."""
    ranked = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, x, j: F.get(s, j)["h"].eqNullSafe(x["h"])
    again = lambda s: F.filter(
        F.transform(s, lambda x, j: F.when(same(s, x, j - 1) | same(s, x, j + 1), x["i"])), lambda i: i.isNotNull()
    )
    starts = F.sort_array(_bound(ranked, again))
    step = lambda acc, i: F.struct(
        (acc["n"] + F.least(F.lit(3), i + 3 - acc["end"])).cast("long").alias("n"), (i + 3).alias("end")
    )
    covered = F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step)["n"]
    return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0).cast("long")).otherwise(covered)


def _hashes(w: Column) -> Column:
    """The 64-bit hash of each word; windows and n-grams are hashes of these."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _windows(h: Column) -> Column:
    """The hash of each 3-word window; in one document a false match has odds of 1 in 10^9 at 10^5 words."""
    starts = F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))


def _figures(text: Column, ratios: Column, threshold: float) -> Column:
    """A struct of the base figures and the verdict."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    dup_lines = _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    n_symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))

    def of_words(w: Column) -> Column:
        return _bound(_hashes(w), lambda h: of_hashes(w, h))

    def of_hashes(w: Column, h: Column) -> Column:
        total = F.aggregate(_grams(h), F.lit(0.0), lambda acc, b: acc + F.get(ratios, b))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            n_symbols.cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            _bound(_windows(h), _repeated_words).alias("n_repeat_words"),
            F.when(F.size(w) > 0, total / (2 * F.size(w) - 1)).otherwise(0.0).alias("llr"),
        )

    def judged(f: Column) -> Column:
        failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEATED_PERCENT * f["n_words"])
        base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return F.struct(*(f[c].alias(c) for c in base), failed.alias("base_failed"), f["llr"].alias("llr"), (~failed & (f["llr"] >= threshold)).alias("kept"))

    return _bound(_bound(words(text), of_words), judged)


def _grams(h: Column) -> Column:
    of = lambda x: x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    firsts = F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0)))
    return F.concat(F.transform(h, of), F.transform(firsts, lambda x, i: of(F.xxhash64(x, F.get(h, i + 1)))))


def buckets(w: Column) -> Column:
    """Bucket numbers of every word and of every pair of neighbours; a word is hashed once."""
    return _bound(_hashes(w), _grams)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) in units over every document; docs: text, trusted boolean."""
    w = docs.select("trusted", words(F.col("text")).alias("w"))
    grams = F.greatest(F.lit(1), 2 * F.size("w") - 1)
    weight = F.greatest(F.lit(1), F.least(F.lit(UNIT), F.floor(F.lit(UNIT * FULL_GRAMS) / grams))).cast("long")
    # The weight is settled before, so that the n-grams' rows don't carry the words.
    w = w.select("trusted", "w", weight.alias("weight"))
    # The outer form, as the filter that Spark infers for the inner one would be pushed below and redo the hashing.
    rows = w.select("trusted", "weight", F.explode_outer(buckets(F.col("w"))).alias("bucket")).filter("bucket IS NOT NULL")
    own = F.when(F.col("trusted"), F.col("weight")).otherwise(F.lit(0))
    return rows.groupBy("bucket").agg(F.sum("weight").alias("raw"), F.sum(own).alias("target"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """One row: the array of log(target share / raw share) by bucket, and 0 for all where nothing is trusted.

    Raw counts are scaled to the target's total, so that they say how often the target should have a bucket.  Both get
    ``SMOOTHING`` more: rare buckets, which are most of a small corpus, tell little and weigh little, while what is common
    in the corpus and missing in the target weighs in full.  A bucket that no document has scores 0.
    """
    listed = counts.agg(
        F.collect_list(F.struct("bucket", "raw", "target")).alias("c"), F.sum("raw").alias("r"), F.sum("target").alias("t")
    )
    expected = lambda x: x["raw"] * (F.col("t") / F.col("r").cast("double"))
    ratio = lambda x: F.log((x["target"] + SMOOTHING * UNIT) / (expected(x) + SMOOTHING * UNIT))
    ordered = F.sort_array(
        F.concat(
            F.transform("c", lambda x: F.struct(x["bucket"].alias("b"), F.when(F.col("t") > 0, ratio(x)).otherwise(0.0).alias("v"))),
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), F.transform("c", lambda x: x["bucket"])),
                lambda b: F.struct(b.alias("b"), F.lit(0.0).alias("v")),
            ),
        )
    )
    return listed.select(F.transform(ordered, lambda x: x["v"]).alias("ratios"))


def _mark_trusted(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    ids = trusted_ids.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("trusted", F.lit(True))
    if trusted_ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def score_quality(docs: DataFrame, corpus: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds the base figures, ``base_failed``, ``llr`` (double) and ``kept`` to documents (doc_id, text, …).

    ``corpus`` (doc_id, text) gives the raw counts and, by ``trusted_ids`` (doc_id), those of the target.  Columns of
    these names are replaced.

    Null and empty texts have no words: they fail the base rules and score 0.  Where no id is trusted every score is 0,
    so the base rules alone decide; a score of exactly the threshold is kept.  Very long texts are read whole, n-grams
    of all texts count.  Repeated rows and ids are scored row by row; no rows give no rows.
    """
    marked = _mark_trusted(corpus.select("doc_id", "text"), trusted_ids)
    ratios = log_ratios(bucket_counts(marked)).scalar()
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*names).alias("row"), F.col("text")).withColumn("ratios", ratios)
    out = rows.select("row", _figures(F.col("text"), F.col("ratios"), threshold).alias("new"))
    return out.select(*(F.col(f"row.`{n}`").alias(n) for n in names), *(F.col(f"new.{n}") for n in added))


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, docs, trusted_labels(spark, sf_dir))
    return out.drop("text")
