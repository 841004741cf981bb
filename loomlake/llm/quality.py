"""Quality rules with an isolation forest on rule statistics.

Every text gives a few counts of rules; two of them reject by themselves. The shares of the counts are the features of an
isolation forest: trees of random splits, in which anomalous documents end early. The score from which a document goes is
calibrated on labelled rows, so that at most MAX_LOSS of the good ones are lost.

There is a forest for each family of features: word lengths, symbols and marks; words said again at once; repeated windows
and lines. In one forest the many anomalies of one family would hide the few of another. The threshold of each is
calibrated on the rows that those before it keep.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import WordHashes, bounded_sample, slices, small_batches, texts_of, windows, word_hashes, written

#: Small subsamples, since bad rows are not rare: in large ones they hide each other.
N_TREES, SUBSAMPLE = 128, 64
#: Rows of which the trees take their subsamples.
FOREST_ROWS = 20_000
#: Share of the labelled good rows that the threshold may lose.
MAX_LOSS = 0.001
BINS = 1000
WIDTH = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_marks", "n_twins")
#: The features of each forest.
FAMILIES = (("word_length", "symbols", "marks"), ("twins",), ("repeats", "dup_lines"))

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\r\x0b\x0c")] = True
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]


def counts_of(data: bytes, hashes: WordHashes) -> dict[str, int]:
    """The rule counts of one text; characters are code points, marks those of ASCII, twins words equal to the one before."""
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n_chars = len(data) - int(hist[0x80:0xC0].sum())
    out = {"n_chars": n_chars, "word_chars": n_chars - int(hist[_SPACES].sum()), "n_symbols": int(hist[_SYMBOLS].sum()), "n_marks": int(hist[_MARKS].sum())}
    h = word_hashes(data, hashes)
    out["n_words"] = len(h)
    out["n_twins"] = int((h[1:] == h[:-1]).sum())
    repeated = 0
    if len(h) >= WIDTH:
        w = windows(h, WIDTH)
        order = np.argsort(w)
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            ends = np.zeros(len(h) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(ends, at, 1)
            np.add.at(ends, at + WIDTH, -1)
            repeated = int((np.cumsum(ends)[:-1] > 0).sum())
    out["n_repeat_words"] = repeated
    lines = [x for x in data.split(b"\n") if x.strip()]
    out["n_dup_lines"] = len(lines) - len(set(lines))
    return out


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every row of docs; a null text counts as empty."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            rows = [counts_of(t, hashes) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in COUNTS]], names=["doc_id", *COUNTS])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(count, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _features():
    """Shares, drawn towards those of usual prose so that a short text is not odd by chance."""
    words, chars = F.col("n_words") + 30, F.col("n_chars") + 200
    shares = ((F.col("word_chars") + 150) / words, F.col("n_symbols") / words, (F.col("n_marks") + 5) / chars, F.col("n_twins") / words, F.col("n_repeat_words") / words, F.col("n_dup_lines") / (F.col("n_dup_lines") + 10))
    return [c.alias(n) for c, n in zip(shares, sum(FAMILIES, ()), strict=True)]


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random splits, each grown on a subsample; score(): 0 to 1, higher for rows that end after fewer splits."""

    def __init__(self, rows: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = []
        self.size = min(SUBSAMPLE, len(rows))
        for _ in range(N_TREES if len(rows) else 0):
            own = rows[rng.choice(len(rows), self.size, replace=False)]
            nodes: list[tuple[int, float, int, int]] = []
            self._grow(own, 0, math.ceil(math.log2(max(2, self.size))), nodes, rng)
            feature, cut, left, right = (np.array(x) for x in zip(*nodes, strict=True))
            self.trees.append((feature, cut, left, right))

    def _grow(self, x: np.ndarray, depth: int, most: int, nodes: list, rng: np.random.Generator) -> int:
        me = len(nodes)
        wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 and depth < most else []
        if not len(wide):
            nodes.append((-1, depth + _path(len(x)), 0, 0))
            return me
        f = int(rng.choice(wide))
        cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
        nodes.append((f, cut, 0, 0))
        low = x[:, f] <= cut
        left = self._grow(x[low], depth + 1, most, nodes, rng)
        right = self._grow(x[~low], depth + 1, most, nodes, rng)
        nodes[me] = (f, cut, left, right)
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, left, right in self.trees:
            at = np.zeros(len(x), np.int64)
            inner = feature[at] >= 0
            while inner.any():
                f = feature[at]
                step = np.where(x[every, np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f >= 0, step, at)
                inner = feature[at] >= 0
            total += cut[at]
        return 2.0 ** (-total / len(self.trees) / max(_path(self.size), 1e-9))


Forests = list[IsolationForest]
_ENDS = np.cumsum([len(f) for f in FAMILIES])


def _split(x: np.ndarray) -> list[np.ndarray]:
    """The columns of each family."""
    return np.split(x, _ENDS[:-1], axis=1)


def _scored(counts: DataFrame, forests: Forests) -> DataFrame:
    """counts with `scores`, one of each forest."""
    sent = counts.sparkSession.sparkContext.broadcast(forests)

    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
            scores = [f.score(own) for f, own in zip(sent.value, _split(x), strict=True)]
            yield pa.array(list(np.stack(scores, axis=1)), pa.list_(pa.float64()))

    return counts.withColumn("scores", F.arrow_udf(score, "array<double>")(*_features()))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score), a row for each row of docs.

    A null or empty text has no words and fails. The forest is grown on a sample of at most about FOREST_ROWS rows, chosen
    by a hash of their id and counts, that pass the base rules; the thresholds are taken from histograms over all labelled rows that
    pass them. score is the
    highest of all forests. Without labels of both kinds nothing but the base rules rejects. Repeated rows get the same row each; a
    doc_id with several labels counts with each. Other columns are not read. An empty table gives an empty one.
    """
    counts = written(rule_counts(docs, id_col, text_col).withColumn("base_failed", base_failed()), "counts")
    forests, thresholds = _fitted(counts, labels, id_col, label_col)
    return _judged(counts, forests, thresholds).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_max("scores").alias("score"))


def _bin(family: int) -> Column:
    return F.floor(F.col("scores")[family] * BINS).cast("int")


def _judged(counts: DataFrame, forests: Forests, thresholds: list[int]) -> DataFrame:
    kept = ~F.col("base_failed")
    for k, t in enumerate(thresholds):
        kept = kept & (_bin(k) < t)
    return _scored(counts, forests).withColumn("kept", kept)


def _fitted(counts: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[Forests, list[int]]:
    """The forests of the rows of counts that pass the base rules, and the bins of their scores from which documents go."""
    passed = counts.where("NOT base_failed")
    sample = bounded_sample(passed, FOREST_ROWS, "doc_id", *COUNTS).select(*_features()).toArrow()
    forests = [IsolationForest(own) for own in _split(np.stack([c.to_numpy() for c in sample.columns], axis=1))]
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    marked = written(_scored(passed.join(known, "doc_id"), forests).select("scores", "label"), "marked")
    good, thresholds = marked.where("label = 1").count(), []
    for k in range(len(FAMILIES)):
        # two rows for each bin at most
        hist = Counter({(r.bin, r.label): r.n for r in marked.groupBy(_bin(k).alias("bin"), "label").agg(F.count("*").alias("n")).collect()})
        thresholds.append(_threshold(hist, good - sum(n for (_, x), n in hist.items() if x == 1)))
        marked = marked.where(_bin(k) < thresholds[-1])
    return forests, thresholds


def _threshold(hist: dict[tuple[int, int], int], lost: int = 0) -> int:
    """The bin from which documents go: it catches most bad rows while at most MAX_LOSS of the good ones lie at or above it.

    lost: good rows that are not in hist since they have gone before.
    """
    good, bad = (sum(n for (_, x), n in hist.items() if x == label) for label in (1, 0))
    best, caught, good = BINS + 1, 0, good + lost
    if good and bad:
        hit = 0
        for b in range(BINS, -1, -1):
            hit, lost = hit + hist.get((b, 0), 0), lost + hist.get((b, 1), 0)
            if lost > MAX_LOSS * good:
                break
            if hit > caught:
                best, caught = b, hit
    return best


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs without the rows whose text the rules or a forest reject; no text is shuffled.

    The rows are written with their counts, so that every text is counted once; the forests read the counts only. All
    columns stay, whatever their names. A null or empty text has no words and goes. Repeated rows stay or go together.
    """

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in slices(batches):
            rows = [counts_of(t, hashes) for t in texts_of(texts)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in COUNTS], list(COUNTS))

    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    counted = F.arrow_udf(count, ", ".join(f"{k} long" for k in COUNTS))(F.col(text_col).cast("string")).alias("_counts")
    with small_batches(docs.sparkSession):
        rows = written(docs.select(own, F.col(id_col).cast("long").alias("doc_id"), counted).select("_row", "doc_id", "_counts.*"), "counted")
    rows = rows.withColumn("base_failed", base_failed())
    forests, thresholds = _fitted(rows.drop("_row"), labels, id_col, label_col)
    return _judged(rows, forests, thresholds).where("kept").select("_row.*")
