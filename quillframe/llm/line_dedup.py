"""Operator 1: lines that many documents share.

Method.  Two Bloom filters over line hashes, one of hashes seen once and one of hashes seen twice or more.  Each task
builds sparse parts of both for its rows; the parts meet by ranges of bits, where a bit that two parts hold moves into
the second filter.  Only the second filter is kept.  Lines that it holds are suspected repeats: just their 128-bit
digests are shuffled, counted exactly, and the document that keeps the line is chosen.  False positives cost a little
shuffle and never change a result, so a filter that is too small for its corpus makes the job slower, not wrong.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import BLANKS, Spread, small_batches, struct, table
from quillframe.sources.scratch import written

MIN_CHARS, MIN_DOCS = 40, 5
#: Bits a filter has for each line of the least length that the corpus could hold, and the most it ever has (128 MB).
BITS_PER_LINE, MAX_BITS = 8, 2**30
#: Bits of one range; parts of the filters meet by range.
RANGE_BITS = 2**22
#: Hashes that a task gathers before it sends a part on.
PART_HASHES = 1_000_000
#: Repeated keys that are broadcast (24 bytes each).
MAX_BROADCAST = 1_000_000


def line_key(line: str, min_chars: int) -> bytes | None:
    """The line without padding, A-Z lower-cased, in UTF-8; None if it has fewer code points than asked for."""
    key = line.strip(BLANKS)
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= min_chars else None


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    return {k for line in (text or "").split("\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(size - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _parts(hashes: np.ndarray, size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """The two filters of some hashes, a hash once for each document: for each range, offsets of the bits set."""
    values, counts = np.unique(hashes, return_counts=True)
    once = np.unique(np.concatenate(_bits(values, size)))
    twice = np.unique(np.concatenate(_bits(values[counts > 1], size)))
    for r in np.unique(once // np.uint64(RANGE_BITS)):
        cut = [x[slice(*np.searchsorted(x, [r * np.uint64(RANGE_BITS), (r + np.uint64(1)) * np.uint64(RANGE_BITS)]))] for x in (once, twice)]
        offsets = [(x % np.uint64(RANGE_BITS)).astype(np.uint32).tobytes() for x in cut]
        yield int(r), offsets[0], offsets[1]


def _emit(hashes: list[int], size: int) -> pa.RecordBatch:
    rows = list(_parts(np.array(hashes, dtype=np.uint64), size))
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["range", "once", "twice"])


def _sketch(size: int, min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        for batch in batches:
            for text in batch.column("text").to_pylist():
                hashes += map(xxhash.xxh3_64_intdigest, _keys(text, min_chars))
                if len(hashes) >= PART_HASHES:
                    yield _emit(hashes, size)
                    hashes = []
        if hashes:
            yield _emit(hashes, size)

    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter of each range that comes to this task; parts are read one after another."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            seen = once.setdefault(r, np.zeros(RANGE_BITS, dtype=bool))
            again = twice.setdefault(r, np.zeros(RANGE_BITS, dtype=bool))
            offsets = np.frombuffer(a, dtype=np.uint32)
            again[offsets] |= seen[offsets]
            seen[offsets] = True
            again[np.frombuffer(b, dtype=np.uint32)] = True
    for r, again in twice.items():
        packed = zstandard.compress(np.packbits(again, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed], pa.binary())], ["range", "bits"])


def _suspects(ranges: dict[int, bytes], size: int, min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(max(size, RANGE_BITS) // 8, dtype=np.uint8)
        for r, packed in ranges.value.items():
            bits[r * RANGE_BITS // 8 : (r + 1) * RANGE_BITS // 8] = np.frombuffer(zstandard.decompress(packed), np.uint8)
        has = lambda at: (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        for batch in batches:
            ids, keys, hashes = [], [], []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = list(_keys(text, min_chars))
                ids += [doc] * len(found)
                keys += found
                hashes += map(xxhash.xxh3_64_intdigest, found)
            first, second = _bits(np.array(hashes, dtype=np.uint64), size)
            at = np.flatnonzero(has(first) & has(second))
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(keys[i]) for i in at), dtype=">i8").astype(np.int64)
            arrays = [pa.array([ids[i] for i in at], pa.int64()), pa.array(digests[::2]), pa.array(digests[1::2])]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "hi", "lo"])

    return run


def twice_seen(docs: DataFrame, min_chars: int) -> tuple[dict[int, bytes], int]:
    """The second filter, as compressed ranges, and its size in bits; ``MAX_BITS`` bounds what comes to the driver."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = 2**16
    while size < min(MAX_BITS, BITS_PER_LINE * total // max(1, min_chars)):
        size *= 2
    parts = docs.select("text").mapInArrow(_sketch(size, min_chars), "range int, once binary, twice binary")
    ranges = max(1, size // RANGE_BITS)
    merged = parts.repartition(min(ranges, 200), "range").mapInArrow(_merge, "range int, bits binary")
    return {r["range"]: bytes(r["bits"]) for r in merged.collect()}, size


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, drop): for each document that loses lines, the digests of their keys.  docs: id long, text."""
    spark = docs.sparkSession
    docs = docs.filter(F.col("id").isNotNull())
    ranges, size = twice_seen(docs, min_chars)
    shared = spark.sparkContext.broadcast(ranges)
    found = written(docs.mapInArrow(_suspects(shared, size, min_chars), "id long, hi long, lo long"), "lines")
    counted = found.groupBy("hi", "lo").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper"))
    keys = written(counted.filter(F.col("n") >= min_docs).select("hi", "lo", "keeper"), "keys")
    # A line that very many documents share doesn't bring its rows to one task either way.
    both = found.join(F.broadcast(keys), ["hi", "lo"]) if keys.count() <= MAX_BROADCAST else Spread(found, ["hi", "lo"]).join(found, keys)
    shed = both.filter("id <> keeper")
    return shed.groupBy("id").agg(F.collect_set(F.struct("hi", "lo")).alias("drop"))


@F.arrow_udf(struct("text string, n_lines long, n_dropped long"))
def _strip(text: pa.Array, drop: pa.Array, min_chars: pa.Array) -> pa.Array:
    kept, lines_in, lost = [], [], []
    for t, d, least in zip(text.to_pylist(), drop.to_pylist(), min_chars.to_pylist(), strict=True):
        lines = (t or "").split("\n")
        keep = lines
        if d:
            digests = {(x["hi"], x["lo"]) for x in d}
            keep = [x for x in lines if (k := line_key(x, least)) is None or _digest(k) not in digests]
        kept.append("\n".join(keep))
        lines_in.append(len(lines))
        lost.append(len(lines) - len(keep))
    columns = [pa.array(kept, pa.string()), pa.array(lines_in, pa.int64()), pa.array(lost, pa.int64())]
    return pa.StructArray.from_arrays(columns, ["text", "n_lines", "n_dropped"])


def _digest(key: bytes) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(key)
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Drops lines whose key stands in ``min_docs`` documents or more, but in the largest id that holds it.

    A key is the line without blanks at its ends, A-Z lower-cased; keys under ``min_chars`` code points are left
    alone.  Lines are split at ``\\n`` and the rest is joined again.  Returns the documents with the text replaced, and
    ``n_lines`` (before) and ``n_dropped``, which take the place of columns of these names.

    Ids are whole numbers, or strings of digits.  Null or empty text: one empty line, nothing dropped, the text becomes empty.  Rows that share an id count as one
    document, and keep or lose a line together.  Rows without an id count for no key and stay whole.  No rows give no
    rows.  Line ends inside very long texts are all looked at.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    drops = repeated_lines(plain, min_chars, min_docs)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    packed = docs.select(F.col(id_column).cast("long").alias("id"), F.struct(*names).alias("row"))
    done = Spread(plain.select("id"), ["id"]).join(packed, drops, "left", [F.col(f"row.`{text_column}`")]).select("row", _strip(f"row.`{text_column}`", "drop", F.lit(min_chars)).alias("new"))
    columns = [F.col("new.text").alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in names]
    return done.select(*columns, "new.n_lines", "new.n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.i, u.line,
    translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d, LATERAL (
    SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
      unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS i) u
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
