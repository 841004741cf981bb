"""Order MinHash: fingerprints of texts that follow the edit distance.

A text's k-mers of WIDTH code points are numbered by occurrence. Each of REPEATS random orders picks the LEAST smallest
(k-mer, number) pairs; they are put back in the order in which they stand in the text, and a hash of that tuple is one entry.
An order reads one of CIRCLES hashes of the pairs from a random value on, so that a text is sorted CIRCLES times only.
Two texts agree in an entry about as often as their least k-mers are the same and stand in the same order, so that moved
passages count, unlike in a plain MinHash. An entry has 16 bits; likeness is the share of equal entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import slices, written

WIDTH, LEAST, REPEATS = 8, 2, 64
#: Independent hashes of the k-mers; an order reads one of them as a circle and begins at a random place of it.
CIRCLES = 4
#: k-mers whose numbers are found at once.
MANY = 1 << 22

_RANDOM = np.random.default_rng(12_2026)
_BEGIN = np.sort(_RANDOM.integers(0, 1 << 32, (CIRCLES, REPEATS // CIRCLES), dtype=np.uint64)) << np.uint64(32)
_SALT = _RANDOM.integers(0, 1 << 63, CIRCLES, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HALF = np.uint64((1 << 32) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h ^= h >> np.uint64(27)
    h *= _ODD[2]
    h ^= h >> np.uint64(31)
    return h


def kmers(text: str) -> np.ndarray:
    """A hash for each run of WIDTH code points; a shorter text, but not none, is one run."""
    if len(text) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(text.encode())] if text else [], np.uint64)
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32) * _ODD[0]
    h ^= h >> np.uint64(29)
    step, times = 1, int(_ODD[1])
    while step < WIDTH:  # a polynomial of twice as many letters
        h = h[:-step] * np.uint64(times) + h[step:]
        step, times = 2 * step, times * times % (1 << 64)
    return _mixed(h)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each. Those of very long texts are looked at in parts by their hash."""
    n = np.zeros(len(h), np.uint64)
    parts = max(1, -(-len(h) // MANY))
    for part in range(parts):
        at = np.flatnonzero(h % np.uint64(parts) == part) if parts > 1 else None
        own = h if at is None else h[at]
        bits = np.uint64(len(own).bit_length())
        # hash and place in one number: equal k-mers lie side by side, in order of their place
        packed = np.sort((own >> bits) << bits | np.arange(len(own), dtype=np.uint64))
        same = packed[1:] >> bits == packed[:-1] >> bits
        if same.any():
            follows = np.flatnonzero(same) + 1
            first = np.insert(np.diff(follows) != 1, 0, True)
            nth = np.arange(len(follows)) - np.maximum.accumulate(np.where(first, np.arange(len(follows)), 0)) + 1
            places = (packed[follows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            n[places if at is None else at[places]] = nth
    return n


def _least(numbered: np.ndarray) -> np.ndarray:
    """(REPEATS, up to LEAST) places of the least values of each random order; ties go to the earlier place."""
    n = len(numbered)
    at = np.arange(min(LEAST, n))
    out = []
    for salt, begins in zip(_SALT, _BEGIN, strict=True):
        circle = np.sort(_mixed(numbered ^ salt) & ~_HALF | np.arange(n, dtype=np.uint64))
        out.append((circle[(np.searchsorted(circle, begins)[:, None] + at) % n] & _HALF).astype(np.int64))
    return np.concatenate(out)


def _entries(h: np.ndarray) -> bytes:
    """The fingerprint of a text by its k-mers."""
    if not len(h):
        return b""
    own = h[np.sort(_least(_mixed(h + occurrences(h) * _ODD[0])), axis=1)]
    entry = own[:, 0]
    for k in range(1, own.shape[1]):
        entry = _mixed(entry * _ODD[0]) + own[:, k]
    return (_mixed(entry) >> np.uint64(48)).astype("<u2").tobytes()


def fingerprint(text: str) -> bytes:
    """REPEATS entries of two bytes; no bytes for an empty text."""
    return _entries(kmers(text))


def _edited(text: str, h: np.ndarray, after: str) -> tuple[str, np.ndarray]:
    """The text whose last quarter is replaced by the begin of another, and its k-mers; h has those of the text."""
    cut = len(text) - len(text) // 4
    edited, kept = text[:cut] + after[: len(text) // 4], cut - WIDTH + 1
    if kept < 1 or len(edited) - kept < WIDTH:
        return edited, kmers(edited)
    return edited, np.concatenate([h[:kept], kmers(edited[kept:])])


def likeness_of(a: bytes, b: bytes) -> float:
    """The share of equal entries; two empty texts are alike, an empty and another one are not."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def likeness(a: str | Column, b: str | Column) -> Column:
    """`likeness_of` for columns of fingerprints in hex."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda i: F.substr(a, 4 * i + 1, F.lit(4)) == F.substr(b, 4 * i + 1, F.lit(4))))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(equal / REPEATS)


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): a row for each row of docs, the fingerprint in hex; null texts count as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = [fingerprint(t or "").hex() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(compute, "doc_id long, fingerprint string")


_REPORT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: What a task does not know: its first document is the next one of another task's last.
_EDGE = [("part", pa.int64()), ("is_first", pa.bool_()), ("text", pa.string())]
EDGE = "part long, is_first boolean, text string"


def _reported(doc_id: int | None, text: str, h: np.ndarray, own: bytes, after: str, after_print: bytes) -> tuple:
    edited, edited_kmers = _edited(text, h, after)
    changed = own if edited == text else _entries(edited_kmers)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness_of(own, changed), likeness_of(own, after_print)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.

    The edited text has its last quarter of code points (rounded down) replaced by as many from the begin of the next
    document, in ascending order of doc_id; after the last comes the first. Rows without an id come first; rows of one id
    follow a hash of their text, and equal rows each other. A null text counts as empty; an empty text has an empty
    fingerprint. Other columns are not read. An empty table gives an empty one.

    Rows are parted by ranges of (id, hash, place), so that no id is a hot key, and each task walks its rows with one text
    in hand. Only the last row of each task waits for another task's first: two rows a task are joined afterwards.
    """
    fields = [*_REPORT, *_EDGE]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = TaskContext.get().partitionId(), None, []
        for b in slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                text = text or ""
                h = held[2] if held and held[1] == text else kmers(text)
                own = held[3] if held and held[1] == text else _entries(h)
                if held is None:
                    out.append((None, None, None, own, None, None, None, part, True, text))
                else:
                    out.append((*_reported(*held, text, own), part, None, None))
                held = doc_id, text, h, own
            yield _batch(out, fields)
            out = []
        if held:
            yield _batch([(held[0], None, None, held[3], None, None, None, part, False, held[1])], fields)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield _batch([_reported(r["doc_id"], r["text"], kmers(r["text"]), r["fingerprint"], r["after"], r["after_print"]) for r in b.to_pylist()], _REPORT)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), "hash", "place"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = written(ordered.select("doc_id", "text").mapInArrow(walk, f"{REPORT}, {EDGE}"), "fingerprints")
    names = [f for f, _ in _REPORT]
    # one number for each task
    parts = sorted(r.part for r in walked.where("is_first").select("part").collect())
    following = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part long, following long")
    first = walked.where("is_first").select(F.col("part").alias("following"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    last = walked.where("NOT is_first").join(following, "part").join(first, "following")
    done = walked.where("is_first IS NULL").select(names).unionByName(last.select("doc_id", "text", "fingerprint", "after", "after_print").mapInArrow(finish, REPORT))
    prints = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return done.withColumns(prints).select(names)
