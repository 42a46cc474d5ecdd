"""Operator 5: token ids in binary files.

Method.  Global counts of the ids give a canonical Huffman code whose words have at most ``MAX_BITS`` bits.  Documents
are encoded one by one, ordered by id and gathered in independent blocks.  A block lists its documents and, for every
``LANE`` ids, the bit offset where they begin (a checkpoint), so that a block is decoded in many lanes at once by one
table lookup for each id.

Files.  A folder with two Parquet tables: ``codebook`` (one row: the code length of each id) and ``blocks`` (part,
base, docs, sizes, marks, bits): files in ascending id order, ``base`` being the ids that precede the block in its
part.  Spark's writer puts them in place, so they can be in any store and a lost executor's work is redone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import small_batches, table
from quillframe.sources.scratch import new_path

END_ID = 1
MAX_BITS, LANE = 18, 128
#: Ids in a block, about, and rows in a file of blocks, about.
BLOCK_IDS, PART_DOCS = 500_000, 8_000
#: Words that a task remembers the ids of; the memory is emptied when it is full.
CACHE_WORDS = 2_000_000
_MARKER = "\x01"
#: A Latin letter that is one letter when it is lower-cased (the capital I with a dot isn't), a mark, and a word's end.
_MARKED = "([A-Za-zÀ-ÖØ-öø-įı-ɏ])([.,])( |$)"
#: Words that are encoded in one text, and bytes of text that are cut into words at once.
GROUP_WORDS, CHUNK_BYTES = 500, 8 * 2**20
#: Files of blocks whose sizes are summed up in one task.
GROUP_PARTS = 4096


# --- Tokenizing -----------------------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, so that each word can be encoded on its own and remembered.

    Words are the runs between spaces and line feeds; a full stop or comma behind a Latin letter, with a blank or the end
    behind it, is a word of its own (``_MARKED``).  Arrow cuts a batch of texts, numbers its different words and finds the
    known ones; numpy gathers their ids from one pool.  New words, special tokens among them, go to the tokenizer as they
    are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 2**16 else np.uint32
        marker = self.tokenizer.encode(_MARKER, add_special_tokens=False).ids
        self.marker = marker[0] if len(marker) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.pool = np.array([END_ID], self.dtype)
        # Run 0 is the end of a document, run i + 1 are the ids of the i-th known word.
        self.starts, self.sizes = np.zeros(1, np.int32), np.ones(1, np.int32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, starts, sizes) of the ids of words; many are encoded at once, with a marker between them."""
        starts, sizes = (np.zeros(len(words), np.int32) for _ in "ab")
        pool, size = [], 0
        alone = [i for i, w in enumerate(words) if self.marker is None or _MARKER in w]
        plain = np.delete(np.arange(len(words)), alone)
        groups = [plain[i : i + GROUP_WORDS] for i in range(0, len(plain), GROUP_WORDS)]
        texts = [f" {_MARKER} ".join([words[i] for i in g]) for g in groups]
        groups += [np.array([i]) for i in alone]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([*texts, *(words[i] for i in alone)], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            cuts = np.flatnonzero(ids == self.marker) if len(group) > 1 else np.empty(0, np.int64)
            begin = np.append(0, cuts + 1)
            starts[group], sizes[group] = size + begin, np.append(cuts, len(ids)) - begin
            pool.append(ids)
            size += len(ids)
        return np.concatenate([np.empty(0, self.dtype), *pool]), starts, sizes

    def _learn(self, words: pa.Array) -> None:
        """Gives the words runs in the pool."""
        pool, starts, sizes = self._encode(words.to_pylist())
        self.known = pa.concat_arrays([self.known, words])
        self.starts = np.concatenate([self.starts, len(self.pool) + starts]).astype(np.int32)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, pool])

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end id included, and for each text where its ids end)."""
        marked = pc.replace_substring_regex(pc.replace_substring(pc.fill_null(text, ""), "\n", " "), _MARKED, r"\1 \2\3")
        lists = pc.split_pattern(marked, " ")
        coded = pc.dictionary_encode(lists.flatten())
        names = coded.dictionary
        found = pc.index_in(names, value_set=self.known)
        if found.null_count and len(self.known) + found.null_count > CACHE_WORDS:
            self._forget()
            found = pc.index_in(names, value_set=self.known)
        run = pc.fill_null(found, -1).to_numpy() + np.int32(1)
        if found.null_count:
            new = pc.is_null(found)
            run = run.copy()
            run[new.to_numpy(zero_copy_only=False)] = np.arange(found.null_count, dtype=np.int32) + len(self.sizes)
            self._learn(names.filter(new))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
        words = np.ones(len(coded) + len(text), dtype=bool)
        words[ends] = False
        full = np.zeros(len(words), dtype=np.int32)
        full[words] = run[coded.indices.to_numpy()] if len(names) else 0
        sizes = self.sizes[full]
        upto = np.cumsum(sizes)
        first = self.starts[full] - (upto - sizes).astype(np.int32)
        at = np.repeat(first, sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at], upto[ends]


def shared_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process.  This code is unpickled anew for each task, so the encoder is kept
    on the tokenizer library's module, which stays."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_quillframe_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of data as an array of bytes."""
    offsets = np.append(0, ends * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``CHUNK_BYTES``: the more texts are cut at once, the fewer words are looked up again."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _tokenize(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        names = ["doc_id", "ids", "counts"]
        total = np.zeros(2**16 if encoder.dtype == np.uint16 else encoder.tokenizer.get_vocab_size(), np.int64)
        for batch in _gathered(batches):
            ids, ends = encoder(batch.column("text"))
            total += np.bincount(ids, minlength=len(total))
            columns = [batch.column("doc_id"), _binaries(ids, ends), pa.nulls(len(ends), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        used = np.flatnonzero(total)
        packed = np.stack([used, total[used]]).astype(np.int64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], names)

    return run


def _sum_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            for i, n in np.frombuffer(packed, np.int64).reshape(2, -1).T.tolist():
                total[i] = total.get(i, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "n"])


# --- The code -------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    while 2**limit < len(used):
        limit += 1
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    merged, leaves = weights, []
    for level in range(limit):
        if level:
            packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([weights, packages])
            by = np.argsort(both, kind="stable")
            merged, leaf = both[by], by < len(weights)
        else:
            leaf = np.ones(len(weights), dtype=bool)
        leaves.append(leaf)
    lengths, take = np.zeros(len(order), dtype=np.int64), 2 * len(order) - 2
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: by length, then by id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code, before = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        at = np.flatnonzero(lengths == n)
        code <<= n - before
        before = n
        codes[at] = code + np.arange(len(at))
        code += len(at)
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical(lengths)
        self.width = max(1, int(lengths.max(initial=1)))
        self._table: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, marks): the code words in a row, first bit highest, and the offset of every ``LANE``-th."""
        bits, marks = self.encode_lanes(ids, np.arange(0, len(ids), LANE))
        return bits, marks.astype(np.uint32).tobytes()

    def encode_lanes(self, ids: np.ndarray, lanes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """As ``encode``, with the offsets of the code words at ``lanes``."""
        n = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        marks = starts[lanes]
        words = int(ends[-1] + 31) // 32 if len(ids) else 0
        # A word's bits are disjoint, so sums of doubles are exact.
        shifted = self.codes[ids].astype(np.uint64) << (64 - n - (starts & 31)).astype(np.uint64)
        at = starts >> 5
        high = np.bincount(at, (shifted >> np.uint64(32)).astype(np.float64), words + 1)
        low = np.bincount(at + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 2)[: words + 1]
        return (high + low)[:words].astype(">u4").tobytes(), marks

    @property
    def table(self) -> np.ndarray:
        """For each ``width`` bits, the id whose code word they begin with (upper bits) and its length (lower 6)."""
        if self._table is None:
            used = np.flatnonzero(self.lengths)
            order = used[np.lexsort((used, self.lengths[used]))]
            spans = (1 << (self.width - self.lengths[order].astype(np.int64))).astype(np.int64)
            filled = np.repeat((order.astype(np.uint64) << np.uint64(6)) | self.lengths[order].astype(np.uint64), spans)
            self._table = np.zeros(1 << self.width, dtype=np.uint64)
            self._table[: len(filled)] = filled
        return self._table

    def decode(self, bits: bytes, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All ids of a block.  marks: bit offsets of lanes; sizes: ids in each lane, ``LANE`` at most."""
        raw = np.frombuffer(bits + bytes(8 + LANE * self.width // 8), dtype=np.uint8).astype(np.uint64)
        window = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
        at, out = marks.astype(np.int64), np.zeros((len(marks), LANE), dtype=np.uint32)
        mask, top = np.uint64((1 << self.width) - 1), 40 - self.width
        last = len(window) - 1
        for step in range(LANE):
            w = window[np.minimum(at >> 3, last)]
            found = self.table[(w >> (top - (at & 7)).astype(np.uint64)) & mask]
            out[:, step] = found >> np.uint64(6)
            at += (found & np.uint64(63)).astype(np.int64)
        return out[np.arange(LANE)[None, :] < sizes[:, None]]


# --- Files ----------------------------------------------------------------------------------------------------------


def lane_sizes(sizes: np.ndarray) -> np.ndarray:
    """Ids in each lane of documents with so many ids: ``LANE``, and what is left in a document's last."""
    n = -(-sizes // LANE)
    out = np.full(int(n.sum()), LANE, dtype=np.int64)
    last = np.cumsum(n)[n > 0] - 1
    out[last] = sizes[n > 0] - (n[n > 0] - 1) * LANE
    return out


def _blocks(lengths, dtype):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of documents that come in order; memory holds one block."""
        code = Code(np.frombuffer(lengths.value, np.uint8))
        part, base, docs, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def emit() -> pa.RecordBatch:
            ids, sizes = np.frombuffer(b"".join(held), dtype), np.array([len(x) for x in held], np.int64) // np.dtype(dtype).itemsize
            lanes = lane_sizes(sizes)
            bits, marks = code.encode_lanes(ids, np.cumsum(lanes) - lanes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())), pa.array([marks.astype(np.uint64).tobytes()], pa.binary()),
                    pa.array([bits], pa.binary()),
                ],
                ["part", "base", "docs", "sizes", "marks", "bits"],
            )

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                held.append(ids)
                size += len(ids) // np.dtype(dtype).itemsize
                if size >= BLOCK_IDS:
                    yield emit()
                    base, docs, held, size = base + size, [], [], 0
        if held:
            yield emit()

    return run


def _decode(lengths):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths.value, np.uint8))
        for batch in batches:
            for part, base, docs, sizes, marks, bits in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ids = code.decode(bits, np.frombuffer(marks, np.uint64), lane_sizes(np.array(sizes, np.int64))).astype("<u4")
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes, strict=True)]
                starts = base + ends - np.array(sizes)
                columns = [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64())]
                columns += [pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> None:
    """Encodes documents (doc_id long, text) with the tokenizer file and writes the folder.

    Every text, however long, is encoded whole and ends with id 1; null and empty texts are that id alone.  Rows that
    share an id stay next to each other, ordered by a hash of their ids and then in any order; rows without one come
    first.  Other columns are ignored.  No documents give an empty blocks table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    ids_path = new_path(spark, "ids")
    schema = "doc_id long, ids binary, counts binary"
    plain.mapInArrow(_tokenize(tokenizer), schema).write.option("compression", "zstd").parquet(ids_path)
    stored = spark.read.schema(schema).parquet(ids_path)
    summed = stored.filter("counts IS NOT NULL").select("counts").mapInArrow(_sum_counts, "id long, n long")
    rows = summed.groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each id of the vocabulary at most
    counts = np.zeros(max((r["id"] for r in rows), default=END_ID) + 1, dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    packed = code_lengths(counts).tobytes()
    dtype = WordEncoder(tokenizer).dtype
    spark.createDataFrame([(bytearray(packed),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/codebook")
    lengths = spark.sparkContext.broadcast(packed)
    tokens = stored.filter("ids IS NOT NULL").select("doc_id", "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))
    parts = max(1, int(stored.count() // PART_DOCS))
    # Equal rows are apart by their place, so that a hot id or text doesn't fill one part.
    ordered = tokens.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "ids")
    blocks = ordered.mapInArrow(_blocks(lengths, dtype), "part int, base long, docs array<long>, sizes array<long>, marks binary, bits binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    _delete(spark, ids_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _before(sizes: DataFrame) -> DataFrame:
    """(part, offset): the running sum of n over the parts before; sizes: part int, n long.

    Parts are summed in groups, and groups in one task: one row for every ``GROUP_PARTS`` * ``PART_DOCS`` documents.
    """
    grouped = sizes.withColumn("group", F.floor(F.col("part") / GROUP_PARTS))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("group").agg(F.sum("n").alias("n")).select("group", earlier(Window.orderBy("group")).alias("all_before"))
    within = grouped.select("part", "group", earlier(Window.partitionBy("group").orderBy("part")).alias("own_before"))
    return within.join(groups, "group").select("part", (F.col("all_before") + F.col("own_before")).alias("offset"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts all ids before it."""
    small_batches(spark)
    packed = spark.read.parquet(f"{folder}/codebook").first()["lengths"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    lengths = spark.sparkContext.broadcast(bytes(packed))
    rows = blocks.select("part", "base", "docs", "sizes", "marks", "bits").mapInArrow(
        _decode(lengths), "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    out = rows.join(_before(sizes), "part")
    return out.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, default_tokenizer())
    return read_tokens(spark, folder)
