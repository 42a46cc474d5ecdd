"""Operator 6: near duplicates by weighted MinHash.

Method.  A document is the multiset of its 5-word shingles.  BagMinHash gives it a signature of ``COMPONENTS`` values:
every shingle has, for each dyadic interval of its weight (0-1, 1-2, 2-4, ...), a Poisson process seeded by the shingle
and the interval; points fall on random components, count only below the shingle's weight, and each component keeps the
earliest.  Two signatures agree in a component with a probability equal to the weighted Jaccard similarity.  A process
is followed only until it is later than all components of its document.

Signatures are cut into ``BANDS`` bands of ``ROWS``; at a similarity of 0.8 a pair meets in no band with odds of 3 in a
million.  In each bucket of a band the documents are compared with a pivot, on the multisets themselves; pairs that
reach ``SIMILARITY`` are links and classes are their connected components.  Buckets whose members aren't yet in one
class are open.  There each document outside the bucket's largest class is compared with members of other classes, about
4, 64, 1024, ... of them, until each bucket has one class or all its pairs between classes are settled: no bucket is
capped.  Pairs are ruled out beforehand by exact bounds: the sizes of the multisets, and parity sketches (the
bits in which two sketches differ are no more than the shingles in which the documents do).

Texts with the same words in the same order are one node from the start, whatever their ids; rows that share an id are
put in one class at the end.  Only the texts of nodes in pairs are read again.  Hot buckets, pivots, classes and groups
of copies are dealt over tasks (``Spread``, ``BLOCK``).  Tables that are known to be small are broadcast, written by few
tasks (``few``), and their components found on the driver (``MAX_LOCAL``); larger ones take the shuffled way to the same
results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import Spread, free_name, small_batches, struct, table, ticket
from quillframe.sources.scratch import discard, written

SHINGLE, SIMILARITY = 5, 0.8
COMPONENTS, BANDS, ROWS = 256, 42, 6
#: 64-bit words of a parity sketch.
SKETCH = 12
#: Members of a bucket that are compared with its pivots in one task.
BLOCK = 4096
#: Nodes whose texts are picked by a broadcast of their ids (8 bytes each); beyond it by a shuffled join.
MAX_BROADCAST = 3_000_000
#: Rows of a narrow table (pairs, labels, open buckets) that is broadcast to a join.
SMALL = 200_000
#: Links (16 bytes each) whose components are found on the driver; beyond it in rounds of joins.
MAX_LOCAL = 1_000_000
#: Rows that one task takes, once there are more than two tasks for each core.
TASK_ROWS = 20_000
#: Words whose hashes a task remembers; the memory is emptied when it is full.
CACHE_WORDS = 500_000

_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits, and of all that is beyond ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[list[bytes]], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the multisets, by document.  Fewer than five words, but not none: one shingle."""
    sizes = np.array([len(w) for w in words])
    padded = np.maximum(sizes, np.where(sizes > 0, SHINGLE, 0))
    docs = np.repeat(np.arange(len(words)), padded)
    ends = np.cumsum(padded)
    flat = np.zeros(len(docs) + SHINGLE, dtype=np.uint64)
    for w, end, size, wide in zip(words, ends, sizes, padded, strict=True):
        flat[end - wide : end - wide + size] = np.array([hashes[x] for x in w], dtype=np.uint64)
    at = np.arange(len(docs))
    inside = at <= (ends - SHINGLE)[docs] if len(docs) else at.astype(bool)
    total = np.zeros(len(docs), dtype=np.uint64)
    for k, m in enumerate(_MULTIPLIERS):
        total += (flat[k : len(docs) + k] ^ (m >> np.uint64(3))) * m
    docs, values = docs[inside], mix(total[inside])
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    first = np.flatnonzero(new)
    return docs[first], values[first], np.diff(np.append(first, len(docs)))


def signatures(docs: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n x COMPONENTS numbers; documents without shingles keep the largest number throughout."""
    doc, seed, rate, low, weight = [docs], [values], [np.ones(len(docs))], [np.zeros(len(docs))], [weights]
    level, at = 1, np.flatnonzero(weights > 1)
    while len(at):
        width = 2.0 ** (level - 1)
        doc.append(docs[at])
        seed.append(mix(values[at] + np.uint64(level)))
        rate.append(np.full(len(at), width))
        low.append(np.full(len(at), width))
        weight.append(weights[at])
        level += 1
        at = at[weights[at] > 2 ** (level - 1)]
    doc, seed, rate, low, weight = map(np.concatenate, (doc, seed, rate, low, weight))
    best = np.full(n * COMPONENTS, np.inf)
    time, golden = np.zeros(len(doc)), np.uint64(0x9E3779B97F4A7C15)
    while len(doc):
        seed = seed + golden
        x = mix(seed)
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        slot = doc * COMPONENTS + (x & np.uint64(COMPONENTS - 1)).astype(np.int64)
        counted = np.flatnonzero(rate > 1) if low.any() else np.empty(0, np.int64)
        hit = np.ones(len(doc), dtype=bool)
        if len(counted):
            place = (mix(x[counted] ^ golden) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            hit[counted] = np.floor(low[counted] + place * rate[counted]) < weight[counted]
        np.minimum.at(best, slot[hit], time[hit])
        live = time < best.reshape(n, COMPONENTS).max(axis=1)[doc]
        doc, seed, rate, low, weight, time = (a[live] for a in (doc, seed, rate, low, weight, time))
    # Half the digits, so that the last bits of a logarithm on other hardware don't matter.
    return best.astype(np.float32).view(np.uint32).reshape(n, COMPONENTS)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def multiset(text: str | None) -> Counter:
    w = word_list(text)
    return Counter(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else Counter()


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the bands."""
    s = signature[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(s), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def sketches(docs: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n x SKETCH words: the parities of the shingle counts that fall on each of 64 * SKETCH bits."""
    bits = 64 * SKETCH
    at = docs * bits + (values >> np.uint64(33)).astype(np.int64) % bits
    odd = np.bincount(at, weights % 2, n * bits).astype(np.int64) % 2
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def _lists(flat: np.ndarray, n: int) -> pa.ListArray:
    """An array of n lists of the same length."""
    each = flat.size // max(1, n)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), pa.array(flat.ravel()))


def _digests(words: list[list[bytes]]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), dtype=">i8").astype(np.int64)
    return pa.array(both[::2]), pa.array(both[1::2])


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        words = [word_list(t) for t in batch.column("text").to_pylist()]
        n, sets = len(words), shingles(words, hashes)
        sizes = np.bincount(sets[0], sets[2], n).astype(np.int64)
        columns = [batch.column("id"), *_digests(words), pa.array(sizes), _lists(band_keys(signatures(*sets, n)), n), _lists(sketches(*sets, n), n)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "hi", "lo", "size", "keys", "sketch"])


def _list_shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingles in order, with their counts, as packed numbers."""
    hashes = Hashes()
    for batch in batches:
        words = [word_list(t) for t in batch.column("text").to_pylist()]
        docs, values, weights = shingles(words, hashes)
        ends = np.searchsorted(docs, np.arange(len(words) + 1))
        parts = [pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()) for x in (values, weights.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*_digests(words), *parts], ["hi", "lo", "values", "weights"])


def packed_similarity(values_a: bytes, weights_a: bytes, values_b: bytes, weights_b: bytes) -> float:
    """Weighted Jaccard similarity of two multisets as ``_list_shingles`` packs them."""
    a, b = np.frombuffer(values_a, np.uint64), np.frombuffer(values_b, np.uint64)
    m, n = np.frombuffer(weights_a, np.int32), np.frombuffer(weights_b, np.int32)
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int(np.where(a[at] == b, np.minimum(m[at], n), 0).sum())
    return both / max(1, int(m.sum()) + int(n.sum()) - both)


@F.arrow_udf(struct("close boolean"))
def _close(values_a: pa.Array, weights_a: pa.Array, values_b: pa.Array, weights_b: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (values_a, weights_a, values_b, weights_b)), strict=True)
    return pa.StructArray.from_arrays([pa.array([packed_similarity(*r) >= SIMILARITY for r in rows], pa.bool_())], ["close"])


def _reach() -> Column:
    """Whether the exact bounds leave it open that the sketched documents a and b are similar enough."""
    low, high, total = F.least("size", "a_size"), F.greatest("size", "a_size"), F.col("size") + F.col("a_size")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"a_s{i}"))) for i in range(SKETCH)))
    return (low >= SIMILARITY * high - 1e-6) & (total - apart >= SIMILARITY * (total + apart) - 1e-6)


def few(df: DataFrame, rows: int, each: int | None = None, anew: bool = False) -> DataFrame:
    """df, that has or comes from about so many rows, in two tasks for each core or in one for ``each`` rows if these are more.

    Without it the number of shuffle partitions is also that of the tasks and files of the smallest table.  A task that
    does several partitions of a sort-merge join keeps the sorters of all; behind such a join the rows are dealt ``anew``.
    """
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // (each or TASK_ROWS) + 1)
    return df.repartition(tasks) if anew else df.coalesce(tasks)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast to the join that it is put in if it has no more than ``SMALL`` rows."""
    return F.broadcast(df) if rows <= SMALL else df


def spread_by(df: DataFrame, keys: list[str], rows: int) -> Spread:
    """``Spread`` of a written table with so many rows, its keys counted in few tasks."""
    return Spread(few(df.groupBy(*keys).agg(F.count("*").alias("n")), rows), keys, rows)


class Search:
    """The tables of one search.  nodes: (node, rep, n, hi, lo, size, keys, sketch), one row for each different text."""

    def __init__(self, nodes: DataFrame, plain: DataFrame, repeats: bool):
        self.nodes, self.plain, self.repeats = nodes, plain, repeats
        facts = nodes.select("node", "size", *(F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)))
        self.facts, self.fact_columns = facts, facts.columns[1:]
        self.links: list[DataFrame] = []
        self.tested: list[DataFrame] = []
        self.n_tested = 0

    def ruled(self, pairs: DataFrame, n: int) -> DataFrame:
        """The n written pairs (a, b) that the bounds don't rule out; a may be hot."""
        of_a = self.facts.select(*(F.col(c).alias("a" if c == "node" else f"a_{c}") for c in self.facts.columns))
        rows = small(pairs, n).join(self.facts.withColumnRenamed("node", "b"), "b")
        rows = F.broadcast(rows).join(of_a, "a") if n <= SMALL else spread_by(pairs, ["a"], n).join(rows, of_a)
        return few(rows.filter(_reach()).select("a", "b"), n, anew=n > SMALL)

    def test(self, pairs: DataFrame, n: int) -> bool:
        """Tests the n written pairs (a, b) on the texts and keeps the links; whether there are any."""
        wanted = few(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), 2 * n)
        chosen = self.nodes.select("node", "rep", "hi", "lo").join(small(wanted, 2 * n), "node", "left_semi")
        chosen = written(few(chosen, 2 * n) if 2 * n <= SMALL else chosen, "chosen")
        count = chosen.count()
        ids = chosen.select(F.col("rep").alias("id"))
        ids = F.broadcast(ids) if count <= MAX_BROADCAST else ids.distinct()
        packed = self.plain.join(ids, "id", "left_semi").select("text").mapInArrow(_list_shingles, "hi long, lo long, values binary, weights binary")
        packed = packed.join(small(chosen.select("hi", "lo", "node"), count), ["hi", "lo"]).select("node", "values", "weights")
        packed = written(packed.dropDuplicates(["node"]) if self.repeats else packed, "shingles")
        of = lambda x: packed.select(F.col("node").alias(x), F.col("values").alias(f"values_{x}"), F.col("weights").alias(f"weights_{x}"))
        rows = spread_by(pairs, ["a"], n).join(small(pairs, n).join(of("b"), "b"), of("a"), by=[F.col("b")])
        close = rows.select("a", "b", _close("values_a", "weights_a", "values_b", "weights_b")["close"].alias("close"))
        found = written(few(close.filter("close").select("a", "b"), n, anew=True), "links")
        discard(chosen, packed)
        self.tested.append(pairs)
        self.n_tested += n
        if found.isEmpty():
            discard(found)
            return False
        self.links.append(found)
        return True

    def labels(self) -> DataFrame:
        return components(reduce(DataFrame.union, self.links))


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in edges (a, b), and the least id of each one's connected component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        of_x, of_y = label[x], label[y]
        low, new = np.minimum(of_x, of_y), label.copy()
        for place in (x, y, of_x, of_y):
            np.minimum.at(new, place, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id of the connected component, for ids in edges (a, b).

    Labels spread along edges and then jump to their own label's label, so that chains shrink by halves; each round is
    a written table.  Ids with very many edges and labels of very many ids are dealt over tasks.  The same is done in
    memory on the driver for up to ``MAX_LOCAL`` edges.
    """
    if edges.count() <= MAX_LOCAL:
        rows = edges.select("a", "b").toArrow()
        ids, least = least_labels(*(rows.column(c).to_numpy() for c in ("a", "b")))
        labels = edges.sparkSession.createDataFrame(pa.table({"id": ids, "label": least}))
        return written(few(labels, len(ids)), "labels")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    along = Spread(both, ["b"])
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        seen = along.join(both, labels.withColumnRenamed("id", "b")).groupBy("a").agg(F.min("label").alias("near"))
        near = written(labels.join(seen.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("new")), "near")
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        stepped = Spread(near, ["new"]).join(near, jump).select("id", F.least("new", "far").alias("label"), (F.col("label") != F.least("new", "far")).alias("moved"))
        stepped = written(stepped, "labels")
        discard(labels, near)
        labels = stepped
        if stepped.filter("moved").isEmpty():
            discard(both)
            return labels


def _settle(search: Search, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Goes through the open buckets; members: (key, node, pivot, n).  Returns the labels at the end."""
    n_members, n_labels = members.count(), labels.count()

    def placed(rows: DataFrame) -> DataFrame:
        """A row for each node with its buckets, of which there are ``BANDS`` at most."""
        return rows.groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("buckets"))

    def spread(rows: DataFrame) -> DataFrame:
        """A row for each node in each bucket, with the node's label; members of a large bucket are dealt to parts."""
        known = small(labels.select(F.col("id").alias("node"), "label"), n_labels)
        named = rows.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        keys = F.transform("buckets", lambda b: b["key"]).alias("keys")
        named = named.select(*(c for c in named.columns if c != "buckets"), keys, F.explode("buckets").alias("b"))
        part = F.pmod(F.xxhash64("node"), F.floor((F.col("b.n") - 1) / BLOCK) + 1)
        return named.select(*(c for c in named.columns if c != "b"), "b.key", "b.n", part.alias("part"))

    def to_parts(rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))

    def open_buckets(rows: DataFrame) -> tuple[DataFrame, int, int, int]:
        """(key, n, major, c): the open buckets and their largest classes; the largest n, the number of parts, that of heads."""
        sizes = few(rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.max("n").alias("n")), n_members)
        tops = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("classes"), F.max("n").alias("n"))
        found = written(few(tops.filter("classes > 1").select("key", "n", F.col("top.label").alias("major"), "top.c"), n_members), "open")
        parts = F.floor((F.col("n") - 1) / BLOCK) + 1
        return found, *(x or 0 for x in found.agg(F.max("n"), F.sum(parts), F.sum((F.col("n") - F.col("c")) * parts)).first())

    # A bucket of two was settled by the pivot.
    everything = written(few(placed(members.filter("n > 2")), n_members), "placed")
    found, most, parts, n_heads = open_buckets(spread(everything))
    here = spread(everything).join(small(to_parts(found).select("key", "part"), parts), ["key", "part"], "left_semi")
    # What the bounds need goes with the nodes through all rounds.
    bare = written(few(placed(here), n_members), "placed")
    n_nodes = bare.count()
    facts = search.facts.join(F.broadcast(bare.select("node")), "node", "left_semi") if n_nodes <= SMALL else search.facts
    rows = written(bare.join(small(facts, n_nodes), "node"), "placed")
    discard(everything, bare)
    done, wide = 0, 4
    while most:
        now = spread(rows)
        major = small(to_parts(found).select(F.col("key").alias("k"), F.col("part").alias("p"), "major"), parts)
        heads = now.join(major, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")) & (F.col("label") != F.col("major")))
        heads = to_parts(heads.select("key", "n", *(F.col(c).alias("a" if c == "node" else f"a_{c}") for c in ["node", "label", "keys", *search.fact_columns])))
        heads = heads.withColumnRenamed("key", "k").withColumnRenamed("part", "p").withColumnRenamed("n", "a_n")
        turn = ticket(F.least("a", "node"), F.greatest("a", "node")) * F.col("a_n")
        if n_heads <= SMALL // 4:
            heads = F.broadcast(heads)
        others = now.select("key", "part", "node", "label", "keys", *search.fact_columns)
        # A pair meets in the least of its buckets only, and in one round.
        once = (turn < wide) & (turn >= done)
        least = F.array_min(F.array_intersect("keys", "a_keys")) == F.col("key")
        meet = others.join(heads, (
            (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")) & (F.col("label") != F.col("a_label")) & once & _reach() & least
        ))
        pairs = meet.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        tested = small(reduce(DataFrame.union, search.tested), search.n_tested)
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(few(pairs, n_members, anew=search.n_tested > SMALL), "pairs")
        discard(found)
        if (n := pairs.count()) and search.test(pairs, n):
            discard(labels)
            labels = search.labels()
            n_labels = labels.count()
        if wide >= most:
            break
        found, most, parts, n_heads = open_buckets(spread(rows))
        done, wide = wide, 16 * wide
    discard(rows)
    return labels


def _classes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(hi, lo, class_id) of the texts that have copies or links; the others are classes of their own."""
    n = labels.count()
    linked = nodes.select("node", "rep", "hi", "lo").join(small(labels.withColumnRenamed("id", "node"), n), "node").drop("moved")
    linked = written(few(linked, n) if n <= SMALL else linked, "linked")
    least = few(linked.groupBy("label").agg(F.min("rep").alias("class_id")), n)
    far = linked.join(F.broadcast(least), "label") if n <= SMALL else spread_by(linked, ["label"], n).join(linked, least)
    copies = nodes.filter("n > 1").join(small(linked.select("node"), n), "node", "left_anti").select("hi", "lo", F.col("rep").alias("class_id"))
    classes = written(far.select("hi", "lo", "class_id").union(copies), "classes")
    discard(linked)
    return classes


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, class_id): one row for each row of docs; class_id is the least id of the class.

    Ids are whole numbers, or strings of digits.  Null and empty texts, and texts without a word, are a class each.
    Rows without an id get a null class.  Rows that share an id share its class, and link the classes of their texts.
    Very long texts are read whole.  Ties don't arise, as classes are connected components.  Other columns are ignored.
    No rows give no rows.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = written(plain.mapInArrow(_sign, "id long, hi long, lo long, size long, keys array<long>, sketch array<long>"), "signed")
    known, total = signed.filter("id IS NOT NULL"), signed.count()
    # Ids of several rows; mostly there are none.
    repeated = known.groupBy("id").agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("hi", "lo") for k, f in (("min", F.min), ("max", F.max))))
    repeated = written(few(repeated, total).filter("n > 1").select("id", (F.col("min_hi") != F.col("max_hi")) | (F.col("min_lo") != F.col("max_lo"))).toDF("id", "differ"), "repeated")
    repeats = not repeated.isEmpty()
    copies = known.filter("size > 0").groupBy("hi", "lo").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "keys", "sketch"))
    )
    nodes = written(few(copies, total).withColumn("node", F.monotonically_increasing_id()), "nodes")
    search = Search(nodes, plain.filter("id IS NOT NULL"), repeats)

    bands, n_bands = nodes.select("node", F.explode("keys").alias("key")), nodes.count() * BANDS
    buckets = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    buckets = written(few(buckets, n_bands, 5 * TASK_ROWS), "buckets")
    n_buckets = buckets.count()
    members = bands.join(F.broadcast(buckets), "key") if n_buckets <= SMALL else Spread(buckets, ["key"], n_bands).join(bands, buckets)
    members = written(members, "members")
    pairs = few(members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), members.count())
    pairs = written(pairs, "pairs")
    near = written(search.ruled(pairs, pairs.count()), "pairs")
    discard(pairs, buckets)
    if search.test(near, near.count()):
        labels = search.labels()
    else:
        labels = written(docs.sparkSession.createDataFrame([], "id long, label long, moved boolean"), "labels")
    labels = _settle(search, members, labels)
    discard(members)
    if repeats:
        shared = written(known.filter("size > 0").select("id", "hi", "lo").join(repeated.filter("differ").select("id"), "id").distinct(), "shared")
        placed = written(Spread(shared, ["hi", "lo"]).join(shared, nodes.select("hi", "lo", "node")).select("id", "node"), "placed")
        star = Spread(placed, ["id"]).join(placed, placed.groupBy("id").agg(F.min("node").alias("a")))
        edges = written(star.filter("node <> a").select("a", F.col("node").alias("b")), "links")
        if not edges.isEmpty():
            search.links.append(edges)
            discard(labels)
            labels = search.labels()
        discard(shared, placed)
    classes = _classes(nodes, labels)
    discard(*search.tested, *search.links, labels, nodes)
    rows = signed.select("id", "hi", "lo", (F.col("size") > 0).alias("worded"))
    named = F.when(F.col("worded") & F.col("id").isNotNull(), F.coalesce("class_id", "id")).otherwise(F.col("id"))
    if classes.count() <= SMALL:
        out = rows.join(F.broadcast(classes), ["hi", "lo"], "left")
    else:
        out = spread_by(rows, ["hi", "lo"], total).join(rows, classes, "left")
    out = out.select("id", named.alias("class_id"))
    if repeats:
        # An id may have rows with and without words.
        out = written(out, "placed")
        of_id = out.join(repeated.select("id"), "id").groupBy("id").agg(F.min("class_id").alias("least"))
        out = Spread(out, ["id"]).join(out, of_id, "left").select("id", F.coalesce("least", "class_id").alias("class_id"))
    return out.toDF(id_column, "class_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each class, with all its columns: that with the least id; rows without an id stay.

    Of several rows that share the least id, one of each text stays (that with the least hash of all columns), as only
    the id ties them.  Other odd rows are as in ``near_duplicates``.
    """
    classes = written(near_duplicates(docs, id_column, text_column), "classes")
    gone, again = free_name(docs.columns, "gone"), free_name(docs.columns, "again")
    lost = classes.filter(F.col(id_column) != F.col("class_id")).select(F.col(id_column).alias(gone)).distinct()
    kept = docs.join(lost, docs[id_column].cast("long") == F.col(gone), "left_anti")
    several = classes.filter(F.col(id_column) == F.col("class_id")).groupBy(F.col(id_column).alias(again)).count().filter("count > 1").select(again)
    if several.isEmpty():
        return kept
    own = kept[id_column].cast("long")
    rest = kept.join(several, own == F.col(again), "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    few = kept.join(several, own == F.col(again), "left_semi").groupBy(own, F.coalesce(F.col(text_column), F.lit("")))
    few = few.agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return rest.union(few.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
