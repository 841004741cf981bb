"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes is looked at in windows of NEAR bytes to both sides: a chunk ends where the hash
is least. Equal least ones stand only in text that says the same over and over; there every chunk of NEAR bytes or more is
the same, wherever it begins. Where a chunk ends thus depends on the bytes around it alone, so that equal passages
are cut alike whatever stands before them, from GEAR + NEAR bytes after their begin to NEAR bytes before their end, and an
insertion changes only the chunks around it. Chunks are deduplicated by a digest. Runs of neighbouring chunks that other
documents hold too are the repeated passages.

Passages of over 50 words are meant. At both of its ends a passage loses what lies outside its first and last cut, 31 bytes
on average, so a run counts from MIN_WORDS words on. A digest has 64 bits: a
run has five chunks or more, and no two runs are taken for equal because of one collision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import likely, slices, texts_of, written

#: Bytes that the rolling hash sees, and bytes to both sides among which the hash is least where a chunk ends.
GEAR, NEAR = 16, 16
#: A chunk in which no hash is least in its window, as in a long descent, ends after so many bytes.
MAX_CHUNK = 80
#: Word begins in a run of repeated chunks that make a passage.
MIN_WORDS = 32
#: Bytes of a text whose hashes are held at once.
PIECE = 1 << 22

_GEAR = np.random.default_rng(8_2024).integers(0, 1 << 32, 256, dtype=np.uint32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def gear_hashes(data: bytes) -> np.ndarray:
    """The sum of gear[b] << age over the last GEAR bytes, for each byte; by doubling, without a loop over bytes."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def _least(h: np.ndarray) -> np.ndarray:
    """The least of NEAR neighbours from each place on; h is longer than NEAR."""
    step = 1
    while step < NEAR:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return h


def _cuts(data: bytes) -> np.ndarray:
    """Places after which a hash is no more than all others of NEAR bytes to both sides."""
    out = []
    for a in range(0, len(data), PIECE):
        low, high = max(0, a - GEAR - NEAR), min(len(data), a + PIECE + NEAR)
        h = gear_hashes(data[low:high]).astype(np.int64)
        edge = np.full(NEAR, 1 << 32, np.int64)
        least = _least(np.r_[edge, h, edge])
        is_cut = (h <= least[: len(h)]) & (h <= least[NEAR + 1 : NEAR + 1 + len(h)])
        at = np.flatnonzero(is_cut) + low + 1
        out.append(at[(at > a) & (at <= a + PIECE)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of data; the last is its length."""
    ends, at, n = [], 0, len(data)
    for e in [*_cuts(data).tolist(), n] if n else []:
        while e - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if e - at >= NEAR or e == n > at:
            at = e
            ends.append(at)
    return ends


def word_begins(data: bytes) -> np.ndarray:
    """For each byte, whether a word begins there."""
    is_space = _IS_SPACE[np.frombuffer(data, np.uint8)]
    return ~is_space & np.r_[True, is_space[:-1]]


CHUNKS = "doc long, text_key long, span long, words int, digest long"


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_text: bool = True) -> DataFrame:
    """(doc, text_key, span, words, digest): the chunks of every row.

    span holds start and end in UTF-8 bytes, of 32 bits each. text_key tells rows of one id apart by a hash of their text,
    and is 0 where by_text is not asked for. Null and empty texts have no chunks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            docs, keys, spans, words, digests = [], [], [], [], []
            for doc, key, data in zip(b.column("doc").to_pylist(), b.column("text_key").to_pylist(), texts_of(b), strict=True):
                ends = chunk_ends(data)
                if not ends:
                    continue
                starts = [0, *ends[:-1]]
                docs += [doc] * len(ends)
                keys += [key] * len(ends)
                spans.append(np.array(starts, np.int64) << 32 | np.array(ends, np.int64))
                words.append(np.add.reduceat(word_begins(data).astype(np.int32), starts))
                digests += [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(starts, ends, strict=True)]
            none = np.zeros(0, np.int64)
            columns = [pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.concatenate([none, *spans])), pa.array(np.concatenate([none, *words]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(digests, np.uint64).view(np.int64))], names=["doc", "text_key", "span", "words", "digest"])

    text = F.col(text_col).cast("string")
    key = F.xxhash64(text) if by_text else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc"), key.alias("text_key"), text.alias("text")).mapInArrow(cut, CHUNKS)


def _unlike(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool, bool]:
    """Ids that stand on rows of different texts; whether there are such ids or rows without an id; whether any id repeats."""
    h = F.xxhash64(F.col(text_col).cast("string"))
    ids = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.count("*").alias("n"), (F.min(h) != F.max(h)).alias("unlike"))
    ids = written(ids.where("n > 1 OR doc_id IS NULL"), "repeated")
    several = ids.where("unlike AND doc_id IS NOT NULL").select("doc_id")
    return several, not ids.where("unlike OR doc_id IS NULL").isEmpty(), not ids.isEmpty()


def _passages(docs: DataFrame, id_col: str, text_col: str, by_text: bool, repeats: bool) -> DataFrame:
    rows = chunks(docs, id_col, text_col, by_text)
    # partial sums shrink a digest that a third of all documents hold before it is shuffled
    place = F.struct("doc", "text_key", "span")
    shared = rows.groupBy("digest").agg(F.min(place).alias("first"), F.max(F.struct("doc", "text_key")).alias("last"))
    shared = written(shared.where("NOT (first.doc <=> last.doc AND first.text_key = last.text_key)").select("digest", "first"), "shared")
    # a table of its own, so that Spark may split a digest that very many chunks have
    own = likely(rows, "digest", shared.select("digest")).join(shared, "digest").select("doc", "text_key", "span", "words", "first")
    own = own.distinct() if repeats else own
    text = ["doc", "text_key"]
    start, end = F.shiftright("span", 32), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF))
    is_first = F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.text_key") == F.col("text_key")) & (F.col("first.span") == F.col("span"))
    own = own.select(*text, start.alias("start"), end.alias("end"), "words", F.col("first.doc").alias("first_doc"), is_first.alias("is_first"))
    order = Window.partitionBy(*text).orderBy("start")
    runs = own.withColumn("begins", F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True)))
    turns = F.col("begins") | (F.lag("is_first").over(order) != F.col("is_first"))
    count = lambda c: F.sum(c.cast("int")).over(order)
    runs = runs.withColumn("turns", turns).withColumn("run", count(F.col("begins"))).withColumn("part", count(F.col("turns")))
    # all of these lie by text already: no further shuffle
    parts = runs.groupBy(*text, "run", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("first_doc", "start").alias("first_doc_id"), F.min("is_first").alias("kept"), F.sum("words").alias("words")
    )
    whole = Window.partitionBy(*text, "run")
    return parts.withColumn("run_words", F.sum("words").over(whole)).where(F.col("run_words") >= MIN_WORDS)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, first_doc_id, kept): the passages of documents that stand in other documents too.

    Passages are longest runs of chunks, of MIN_WORDS words at least, that occur in more than one document; start and end
    are in UTF-8 bytes of the text. A run is parted where chunks that occur here first (by doc_id, rows without one before
    all others, then by place) meet chunks that do not, and each part has a row. kept: the part's chunks occur here first;
    otherwise the part can be cut, and first_doc_id holds its first chunk. So of every chunk one copy stays.

    Rows of one id and one text are one document; rows of one id and different texts are several, and so are rows without
    an id, whose passages have a null doc_id. Null and empty texts have no passage. Other columns are not read. An empty
    table, or one without repeats, gives an empty one.
    """
    _, by_text, repeats = _unlike(docs, id_col, text_col)
    return _passages(docs, id_col, text_col, by_text, repeats).select(F.col("doc").alias("doc_id"), "start", "end", "first_doc_id", "kept")


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose texts lack the passages that stand in an earlier document; all rows and columns stay, whatever their names.

    Null texts stay null. Texts without an id, and those of an id that stands on rows of different texts, stay whole, since
    places in them are not known by the id.
    """
    several, by_text, repeats = _unlike(docs, id_col, text_col)
    cuts = _passages(docs, id_col, text_col, by_text, repeats).where("NOT kept AND doc IS NOT NULL")
    cuts = cuts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = written(cuts.join(several.withColumnRenamed("doc_id", "doc"), "doc", "left_anti"), "cuts")

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in slices(batches, 0):
            out = []
            for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                if text and own:
                    data, at, parts = text.encode(), 0, []
                    for s in own:
                        parts.append(data[at : s["start"]])
                        at = s["end"]
                    text = b"".join([*parts, data[at:]]).decode(errors="ignore")
                out.append(text)
            yield pa.array(out, pa.string())

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(cuts, F.col(f"row.`{id_col}`").cast("long") == F.col("doc"), "left")
    text = F.arrow_udf(cut, "string")(F.col(f"row.`{text_col}`").cast("string"), F.col("cuts"))
    return joined.select("row", text.alias("text")).select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
