"""Counts of the runs of up to `longest` Chinese characters, as windows: every place of a text with the characters from it on.

A window of w characters holds the counts of all its beginnings. Tasks count their windows, these are dealt by their first two
characters, and sorted, so that the windows with the same beginning lie together. A character has 15 bits; a window is two
whole numbers, of its first four and of its next characters, zeros after its run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_HAN, HAN, BITS = 0x4E00, 0x9FFF - 0x4E00 + 1, 15
#: Places of texts that are looked at together, and windows that a task holds before it passes them on.
PLACES, HELD = 1 << 20, 1 << 22
WINDOWS = "pair long, hi long, lo long, n long"


def text_slices(texts: list[str | None], places: int = PLACES) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, code points of texts[begin:end], each with a line feed after it), of about `places` at most."""
    begin, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text or "") + 1
        if size >= places or end == len(texts):
            joined = "\n".join([*(t or "" for t in texts[begin:end]), ""])
            yield begin, end, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            begin, size = end, 0


def merged(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window once, sorted, with the sum of its counts."""
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])[: len(hi)])
    return hi[at], lo[at], np.add.reduceat(n, at) if len(at) else n


def _windows(points: np.ndarray, weights: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.where((points >= FIRST_HAN) & (points < FIRST_HAN + HAN), points.astype(np.int64) - (FIRST_HAN - 1), 0)
    codes = np.concatenate([codes, np.zeros(width, np.int64)])
    at = np.flatnonzero(codes)
    known = np.flatnonzero(np.bincount(codes, minlength=HAN + 1)[1:]) + 1
    bits = max(1, int(len(known)).bit_length())
    if weights is None and bits * width <= 62:
        # few different characters: a window is one number
        dense = np.zeros(HAN + 1, np.int64)
        dense[known] = np.arange(1, len(known) + 1)
        key, n = np.unique(_packed(dense[codes], at, 0, width, np.ones(len(at), bool), bits), return_counts=True)
        back = np.concatenate([[0], known])
        own = [back[(key >> (bits * (width - 1 - j))) & ((1 << bits) - 1)] if j < width else np.zeros(len(key), np.int64) for j in range(8)]
        return sum(c << (BITS * (3 - j)) for j, c in enumerate(own[:4])), sum(c << (BITS * (3 - j)) for j, c in enumerate(own[4:])), n.astype(np.int64)
    alive = np.ones(len(at), bool)
    hi, lo = _packed(codes, at, 0, min(4, width), alive, BITS), _packed(codes, at, 4, width, alive, BITS)
    hi, lo = hi << (BITS * (4 - min(4, width))), lo << (BITS * (4 - max(0, width - 4)))
    return merged(hi, lo, np.ones(len(at), np.int64) if weights is None else weights[at])


def _packed(codes: np.ndarray, at: np.ndarray, begin: int, end: int, alive: np.ndarray, bits: int) -> np.ndarray:
    """codes[at + begin] to codes[at + end - 1] as one number; alive, which is changed, tells which windows have not ended."""
    key = np.zeros(len(at), np.int64)
    for j in range(begin, end):
        own = codes[at + j]
        own *= alive
        np.greater(own, 0, out=alive)
        key <<= bits
        key |= own
    return key


def _strings(codes: list[np.ndarray]) -> pa.Array:
    """Strings of Chinese characters, of which each has three bytes in UTF-8."""
    data = np.empty((len(codes[0]), len(codes), 3), np.uint8)
    for j, c in enumerate(codes):
        p = c + (FIRST_HAN - 1)
        data[:, j, 0], data[:, j, 1], data[:, j, 2] = 0xE0 | (p >> 12), 0x80 | ((p >> 6) & 0x3F), 0x80 | (p & 0x3F)
    offsets = np.arange(len(codes[0]) + 1, dtype=np.int32) * (3 * len(codes))
    return pa.StringArray.from_buffers(len(codes[0]), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def counts(texts: DataFrame, text_col: str, width: int, n_col: str | None = None, least: int = 1) -> DataFrame:
    """(gram, n) of the grams of up to `width` (8 at most) characters; those of two or more with n below `least` are left out.

    A row of texts counts n_col times.
    """
    if width > 8:
        raise ValueError("a window has 8 characters at most")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def passed() -> pa.RecordBatch:
            hi, lo, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(hi >> (2 * BITS)), pa.array(hi), pa.array(lo), pa.array(n)], names=["pair", "hi", "lo", "n"])

        waiting = 0
        for batch in batches:
            rows = batch.column(0).to_pylist()
            times = batch.column(1).to_numpy() if n_col else None
            for begin, end, points in text_slices(rows):
                weights = None if times is None else np.repeat(times[begin:end], [len(t or "") + 1 for t in rows[begin:end]])
                held.append(_windows(points, weights, width))
                waiting += len(held[-1][0])
                if waiting >= HELD:
                    held = [merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    waiting = 0
                    if len(held[0][0]) >= HELD:
                        yield passed()
                        held = []
        if held:
            held = [merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            yield passed()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(c).to_numpy() for c in ("hi", "lo", "n")) for b in batches]
        if not parts:
            return
        hi, lo, n = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        codes = [((hi if j < 4 else lo) >> (BITS * (3 - j % 4))) & ((1 << BITS) - 1) for j in range(width)]
        new = np.zeros(len(hi), bool)
        new[:1] = True
        for k in range(1, width + 1):
            new[1:] |= codes[k - 1][1:] != codes[k - 1][:-1]
            at = np.flatnonzero(new)
            sums, whole = np.add.reduceat(n, at), codes[k - 1][at] > 0
            whole &= sums >= (1 if k == 1 else least)
            at, sums = at[whole], sums[whole]
            for b in range(0, len(at), PLACES):
                some = at[b : b + PLACES]
                yield pa.RecordBatch.from_arrays([_strings([c[some] for c in codes[:k]]), pa.array(sums[b : b + PLACES])], names=["gram", "n"])

    rows = texts.select(F.col(text_col).cast("string"), *([F.col(n_col).cast("long")] if n_col else []))
    found = rows.mapInArrow(windows, WINDOWS).repartition(F.col("pair")).mapInArrow(grams, "gram string, n long")
    # characters alone stand in the windows of several pairs
    single = found.where(F.length("gram") == 1).groupBy("gram").agg(F.sum("n").alias("n"))
    return found.where(F.length("gram") > 1).unionByName(single)
