"""Operator 8: benchmark decontamination.

Method.  The windows of the benchmark items, 13 words each, make a set of hashed n-grams that is broadcast.  Every
window of every document is hashed and looked up; hits are verified on the words themselves.  A window's hash is built
from hashes of runs of 1, 2, 4 and 8 words, each of two of the run before, so that a word is hashed once, and windows
of all lengths come from one reading.  The set's size is checked first: beyond ``MAX_BROADCAST`` windows the lookup is a
shuffled join of bare hashes.  Only hits are shuffled otherwise, and the words of the documents that are hit are read
again.  DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import ascii_lower, free_name, table
from quillframe.sources.scratch import written

WINDOW = 13
#: Hashes of benchmark windows that are broadcast (about 64 bytes each).
MAX_BROADCAST = 1_000_000
#: Occurrences, or spans and items, of the documents that are hit that are broadcast (about 50 bytes each).
MAX_BROADCAST_HITS = 1_000_000
#: Rows (window, item) that are broadcast with their words (about 200 bytes each).
MAX_BROADCAST_GRAMS = 100_000
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAKS_EITHER_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """ASCII-lower-cased runs of letters, digits and everything beyond ASCII; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAKS), "")


def _n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAKS_EITHER_CASE), "")).cast("long")


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _window_hashes(w: Column, sizes: list[int]) -> Column:
    """(size, at, hash) of all windows of these sizes (1 to 15) in the words w; at counts from 0."""
    runs = [1, 2, 4, 8]

    def doubled(h: Column, step: int) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def of_size(size: int, hashes: dict[int, Column]) -> Column:
        parts, at = [], 0
        for run in reversed(runs):
            if size & run:
                parts.append((run, at))
                at += run
        (first, _), rest = parts[0], parts[1:]
        starts = F.slice(hashes[first], 1, F.greatest(F.size(hashes[1]) - (size - 1), F.lit(0)))
        whole = lambda x, i: F.xxhash64(F.lit(size), x, *(F.get(hashes[run], i + at) for run, at in rest))
        return F.transform(starts, lambda x, i: F.struct(F.lit(size).alias("size"), i.alias("at"), whole(x, i).alias("hash")))

    def build(hashes: dict[int, Column], left: list[int]) -> Column:
        if not left:
            every = [of_size(s, hashes) for s in sizes]
            return F.concat(*every) if len(every) > 1 else every[0]
        longest = max(hashes)
        return _bound(doubled(hashes[longest], longest), lambda h: build(hashes | {left[0]: h}, left[1:]))

    needed = [r for r in runs[1:] if r <= max(sizes)]
    return _bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: build({1: h}, needed))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(size, hash, gram, item): the windows of each item; one of fewer than 13 words, but not none, is one window."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    rows = w.select("item", "w", size.alias("own"), F.explode(_window_hashes(F.col("w"), list(range(1, WINDOW + 1)))).alias("x"))
    rows = rows.filter(F.col("x.size") == F.col("own"))
    gram = F.array_join(F.slice("w", F.col("x.at") + 1, F.col("x.size")), " ")
    return rows.select("x.size", "x.hash", gram.alias("gram"), "item").distinct()


def _key() -> list[Column]:
    """A row's identity: its id and its text's hash, so that rows that share an id stay apart."""
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id"), F.xxhash64(text).alias("text_hash")]


def find_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, size, item) for each occurrence of a window; start counts words from 1."""
    facts = windows.agg(F.collect_set("size").alias("sizes"), F.countDistinct("size", "hash").alias("n"), F.count("*").alias("rows")).first()
    sizes = sorted(facts["sizes"]) or [WINDOW]
    grams = windows.select("size", "hash").distinct()
    # Bare hashes only: a row that carried its document's words would cost the square of the document's length.  The
    # outer form, as the filter that Spark infers for the inner one would be pushed below and redo the hashing.
    rows = docs.select(*_key(), F.explode_outer(_window_hashes(words(F.col("text")), sizes)).alias("x"))
    rows = rows.select("doc_id", "text_hash", "x.size", "x.at", "x.hash")
    found = rows.join(F.broadcast(grams) if facts["n"] <= MAX_BROADCAST else grams, ["size", "hash"])
    hit = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("size", "at", "hash")).alias("hits"))
    # The words of the documents that are hit are read again; a document's hits are no more than its windows.
    own = _matched(docs.select(*_key(), "text"), written(hit, "hits"), F.size("hits"))
    own = own.select("doc_id", "text_hash", words(F.col("text")).alias("w"), "hits")
    own = own.select("doc_id", "text_hash", "w", F.explode("hits").alias("x"))
    gram = F.array_join(F.slice("w", F.col("x.at") + 1, F.col("x.size")), " ")
    hits = own.select("doc_id", "text_hash", "x.size", "x.hash", (F.col("x.at") + 1).alias("start"), gram.alias("gram"))
    # Verified on the words; the few hits meet the items' windows here.
    whole = F.broadcast(windows) if facts["rows"] <= MAX_BROADCAST_GRAMS else windows
    return hits.join(whole, ["size", "hash", "gram"]).select("doc_id", "text_hash", "start", "size", "item")


def _matched(rows: DataFrame, few: DataFrame, size: Column, how: str = "inner") -> DataFrame:
    """rows joined with the written table ``few`` by doc_id and text_hash; it is broadcast if its entries are few enough."""
    names = free_name(rows.columns, "d"), free_name(rows.columns, "h")
    n = few.agg(F.sum(size + 1)).first()[0] or 0
    few = few.withColumnsRenamed({"doc_id": names[0], "text_hash": names[1]})
    few = F.broadcast(few) if n <= MAX_BROADCAST_HITS else few
    return rows.join(few, F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.col("text_hash") == F.col(names[1])), how).drop(*names)


def _covered(spans: Column) -> Column:
    """Words in the union of spans, an array of (start, end) with end exclusive."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).cast("long").alias("n"),
        F.greatest(s["end"], acc["end"]).alias("end"),
    )
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step)["n"]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items, spans, contaminated): one row for each row of docs (doc_id, text).

    ``spans`` are the word ranges (from 1, end exclusive) of the windows found, ``items`` the sorted ids of the items
    that own them.  Null and empty texts have no words and no hits; very long ones are read whole.  An empty benchmark
    hits nothing.  Rows that share an id are judged apart; equal rows alike; a null id is an id like others; items that
    share an id count once.  Other columns are ignored.  No rows give no rows.
    """
    found = written(_found(docs, items), "found")
    plain = docs.select(*_key(), _n_words(F.col("text")).alias("n_words"))
    return _judged(_matched(plain, found, F.size("spans") + F.size("items"), "left"))


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, items) of the texts that are hit."""
    found = find_hits(docs, benchmark_windows(items)).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans"),
        F.collect_set("item").alias("items"),
    )
    return found.withColumn("items", F.sort_array("items"))


def _judged(out: DataFrame) -> DataFrame:
    out = out.withColumn("n_hit", F.coalesce(_covered(F.col("spans")), F.lit(0)))
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; see ``contamination`` for odd rows."""
    found = written(_found(docs.select("doc_id", "text"), items), "found")
    hit = _matched(docs.select(*_key(), "text"), found, F.size("spans") + F.size("items"))
    bad = _judged(hit.withColumn("n_words", _n_words(F.col("text"))).drop("text")).filter("contaminated")
    d, h = free_name(docs.columns, "d"), free_name(docs.columns, "h")
    bad = written(bad.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct(), "bad")
    bad = F.broadcast(bad) if bad.count() <= MAX_BROADCAST_HITS else bad
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(d)) & (text_hash == F.col(h)), "left_anti")


def drop_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents (doc_id, text, …) with the words of benchmark spans taken out of those that have any.

    Such a text is rebuilt from its lower-cased words, joined by spaces; other texts stay as they are.
    """
    found = contamination(docs.select("doc_id", "text"), items).filter("n_hit > 0")
    d, h, spans = (free_name(docs.columns, name) for name in ("d", "h", "spans"))
    found = found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("spans").alias(spans)).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    out = docs.join(found, docs["doc_id"].eqNullSafe(F.col(d)) & (text_hash == F.col(h)), "left")
    inside = lambda i: F.exists(spans, lambda s: (i + 1 >= s["start"]) & (i + 1 < s["end"]))
    kept = F.array_join(F.filter(words(F.col("text")), lambda _, i: ~inside(i)), " ")
    return out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (
    SELECT item, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), dw AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (
    SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i FROM d, (SELECT DISTINCT size FROM bw))
), hits AS (
  SELECT doc_id, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.gram = bw.gram
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(hit_items.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hit_words.n, 0) > 0 AND 20 * coalesce(hit_words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
