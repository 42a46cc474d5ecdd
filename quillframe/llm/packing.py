"""Operator 7: best-fit packing with conflicts.

Method.  Documents are cut into pieces of at most ``CAPACITY`` tokens and put in bins of that capacity, largest piece
first.  Bins are ordered by what is left in them and carry two bitmaps, of the sources and of the duplicate clusters
that they hold.  A piece goes to the tightest bin that is compatible: the search begins at the first bin with enough
room and steps to its successors until one has a free place for the piece's source and none of its cluster.

Conflicts: a bin never holds two pieces of one duplicate cluster, and never more than ``PER_SOURCE`` pieces of one
source, so that a hot source can't fill a bin alone while others remain.  Bins are
packed in independent shards, one for every ``SHARD_PIECES`` documents; a piece's shard is a hash of its document's id,
its cluster and its number, so every shard sees a like mixture, hot sources and large clusters are spread, and no task
holds more than its shard.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import small_batches, table
from quillframe.llm.quality import words

#: Tokens of a bin; a document's tokens are its words and one end mark.
CAPACITY = 2048
PER_SOURCE = 8
SHARD_PIECES = 4000
#: Bits of the bitmaps.  Sources and clusters that share a bit count as the same, which can only separate more.
SOURCE_BITS, CLUSTER_BITS = 256, 4096


class Bins:
    """Open bins by the room left, with successor search."""

    def __init__(self, capacity: int = CAPACITY, per_source: int = PER_SOURCE):
        self.capacity, self.per_source = capacity, per_source
        self.rooms: list[tuple[int, int]] = []  # (room, bin), sorted
        self.used: list[int] = []
        self.clusters: list[int] = []
        self.full: list[int] = []  # bit for each source that has no place left
        self.counts: list[dict[int, int]] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece; source and cluster are bit numbers."""
        at, bit, mark = bisect_left(self.rooms, (size, -1)), 1 << source, 1 << cluster
        while at < len(self.rooms):
            room, b = self.rooms[at]
            if not self.full[b] & bit and not self.clusters[b] & mark:
                del self.rooms[at]
                break
            at += 1
        else:
            b, room = len(self.used), self.capacity
            self.used.append(0)
            self.clusters.append(0)
            self.full.append(0)
            self.counts.append({})
        offset = self.used[b]
        self.used[b] += size
        self.clusters[b] |= mark
        n = self.counts[b][source] = self.counts[b].get(source, 0) + 1
        if n >= self.per_source:
            self.full[b] |= bit
        if room > size:
            insort(self.rooms, (room - size, b))
        return b, offset


def pack(pieces: pd.DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> pd.DataFrame:
    """Adds bin and offset to the pieces of a shard (id, piece, start, size, source_bit, cluster_bit, cluster)."""
    order = pieces.sort_values(["size", "id", "cluster", "piece"], ascending=[False, True, True, True], kind="stable", na_position="last")
    bins = Bins(capacity, per_source)
    placed = [bins.place(*row) for row in zip(order["size"], order["source_bit"], order["cluster_bit"], strict=True)]
    return order.assign(bin=[b for b, _ in placed], offset=[o for _, o in placed])


def token_counts(docs: DataFrame) -> DataFrame:
    """(id, source, cluster, tokens): the cluster is the hash of the text's words, lower-cased."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        words(F.lower("text")).alias("w"),
    )
    return rows.select("id", "source", F.xxhash64("w").alias("cluster"), (F.size("w") + 1).cast("long").alias("tokens"))


def pack_documents(
    docs: DataFrame, clusters: DataFrame | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, sizes: DataFrame | None = None
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, shard, bin, offset): a row for each piece of docs (doc_id, text, source).

    ``clusters`` (doc_id, cluster long), such as classes of near duplicates, names duplicate clusters; without it
    documents with the same words are one.  ``sizes`` (doc_id, n_tokens long), such as operator 5 reads back, gives the
    tokens of documents; without it, and for ids that it hasn't, they are the words and an end mark.
    A bin is named by shard and bin; offsets are in tokens.  A document of more than ``capacity`` tokens is cut into
    full pieces and a rest, none of which is dropped; only the rest can share a bin.

    Null and empty texts are one token, the end mark.  A null source counts as one source.  Rows that share an id are
    packed apart, as are equal rows.  No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = token_counts(docs)
    if clusters is not None:
        named = clusters.select(F.col("doc_id").cast("long").alias("id"), F.col("cluster").cast("long").alias("named"))
        named = named.groupBy("id").agg(F.min("named").alias("named"))
        rows = rows.join(named, "id", "left").withColumn("cluster", F.coalesce("named", "cluster")).drop("named")
    if sizes is not None:
        known = sizes.select(F.col("doc_id").cast("long").alias("id"), F.greatest(F.lit(1), F.col("n_tokens")).cast("long").alias("known"))
        rows = rows.join(known.groupBy("id").agg(F.max("known").alias("known")), "id", "left").withColumn("tokens", F.coalesce("known", "tokens")).drop("known")
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(capacity).cast("long"))
    pieces = rows.select("id", "source", "cluster", "tokens", F.posexplode_outer(starts).alias("piece", "start"))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("start")))
    # Each document has at most one piece that isn't full; full ones take a bin each without a search.
    shards = max(1, -(-docs.count() // SHARD_PIECES))
    pieces = pieces.select(
        F.pmod(F.xxhash64("id", "cluster", "piece"), F.lit(shards)).cast("int").alias("shard"),
        "id", "piece", "start", "size", "cluster",
        F.pmod(F.xxhash64("source"), F.lit(SOURCE_BITS)).cast("int").alias("source_bit"),
        F.pmod(F.col("cluster"), F.lit(CLUSTER_BITS)).cast("int").alias("cluster_bit"),
    )
    schema = "doc_id long, piece int, start long, n_tokens long, shard int, bin long, offset long"

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        done = pack(shard, capacity, per_source)
        return done.rename(columns={"id": "doc_id", "size": "n_tokens"})[["doc_id", "piece", "start", "n_tokens", "shard", "bin", "offset"]]

    return pieces.groupBy("shard").applyInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
