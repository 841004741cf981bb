"""What the operators share: the folder for written tables, slices of batches, samples, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts that are taken from an Arrow batch at once; the batch has spark.sql.execution.arrow.maxBytesPerBatch at most.
SLICE_BYTES = 4 << 20
#: Bytes of a text that are split into words at once, so that a very long text needs no list of all its words.
SEGMENT_BYTES = 1 << 22
#: Words whose hash a worker remembers before it starts anew.
CACHE_WORDS = 1 << 17
#: Bits of the broadcast bitmap of `likely` at most (16 MB).
MAX_BITS = 1 << 27

_SPACE = b" \t\n\r\x0b\x0c"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Within it, Arrow batches have `rows` rows at most: for what is run inside and holds texts of two sides in a row."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it cuts the lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def split_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, mod parts; null without an id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, bound: int, *key: str | Column) -> DataFrame:
    """At most about `bound` rows, chosen by a hash of key; rows of one key count as one, so that no hot row floods it.

    The share that is taken follows from an estimate (of 2 %) of the number of keys, less a tenth.
    """
    hashed = df.select(F.struct(*df.columns).alias("row"), F.xxhash64(F.lit(17), *key).alias("hash"))
    n = max(1, hashed.agg(F.approx_count_distinct("hash", 0.02)).first()[0])
    share = min(1.0, 0.9 * bound / n)
    picked = hashed.where(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30)))
    return picked.groupBy("hash").agg(F.first("row").alias("row")).select("row.*")


def likely(df: DataFrame, key: str, wanted: DataFrame, most_bits: int = MAX_BITS) -> DataFrame:
    """df without most of the rows whose key is not in wanted (one column): a filter before a join that shuffles df.

    A bitmap of the keys' hashes, of 16 bits a key and most_bits at most, is broadcast. Beyond that it would let most rows
    pass, and df stays as it is. Rows with a null key go.
    """
    n = wanted.count()
    bits = 1 << 15
    while bits < 16 * n:
        bits *= 2
    if bits > 4 * most_bits:
        return df
    bits = min(bits, most_bits)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    name = wanted.columns[0]
    maps = wanted.groupBy(F.bitmap_bucket_number(place(name)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(name))).alias("_map"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("_byte >> _bit & 1") == 1
    rows = df.withColumn("_bucket", F.bitmap_bucket_number(place(key))).join(F.broadcast(maps), "_bucket")
    return rows.withColumns({"_byte": byte, "_bit": (at % 8).cast("int")}).where(is_set).select(*df.columns)


class WordHashes(dict):
    """word -> 64-bit hash; forgets when it has grown to CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def segments(data: bytes, seps: bytes = _SPACE) -> Iterator[bytes]:
    """data cut at separators into pieces of about SEGMENT_BYTES."""
    at = 0
    while len(data) - at > SEGMENT_BYTES:
        end = at + SEGMENT_BYTES
        while end < len(data) and data[end] not in seps:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def word_hashes(data: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words between ASCII white space, in order."""
    parts = [hashes.of(x.split()) for x in segments(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` neighbours; empty when there are fewer."""
    n = len(h) - width + 1
    if n < 1:
        return h[:0]
    out = h[:n].copy()
    for k in range(1, width):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += h[k : k + n]
    return out ^ (out >> np.uint64(32))


def slices(batches: Iterator, column: str | int = "text", most: int = SLICE_BYTES) -> Iterator:
    """Record batches, arrays or tuples of arrays, cut into parts of about `most` bytes of text, a row at least; nothing is copied.

    column names the texts of a record batch, or is their place in a tuple.
    """
    for b in batches:
        texts = b if isinstance(b, pa.Array) else b.column(column) if isinstance(b, pa.RecordBatch) else b[column]
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield tuple(x.slice(at, end - at) for x in b) if isinstance(b, tuple) else b.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch | pa.Array, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts of a batch; null is empty."""
    values = batch if isinstance(batch, pa.Array) else batch.column(column)
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]
