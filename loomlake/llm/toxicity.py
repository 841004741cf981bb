"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, that occur in toxic labelled texts and hardly in others. Features
are densities of lexicon words, their proximity to a second person, capitals, punctuation and obfuscated words. Labelled
rows are split by a hash of the id: on PARTS the lexicon, the trees and the calibration are fitted apart from each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import bounded_sample, slices, split_of, written
from loomlake.llm.decontaminate import words_of

#: Labelled rows that are learned from.
TRAIN_ROWS = 30_000
#: Fifths of them for the lexicon, the trees and the calibration.
PARTS = {"lexicon": (0, 1, 2), "trees": (3,), "calibration": (4,)}
LEXICON_TERMS = 4000
STEMS = (4, 5, 6)
MIN_TEXTS, MIN_SHARE = 3, 0.8
NEAR = 6
THRESHOLD = 0.3

FEATURES = ("hits", "hit_share", "near_you", "near_share", "kinds", "capitals", "punctuation", "exclaims", "obfuscated", "words")
# Forms of the second person in the languages of the corpus.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch sie tu te ti tus usted ustedes vosotros toi vous ton ta tes votre vos".split()
_YOU = {w.encode() for w in SECOND_PERSON}
_OBFUSCATED = re.compile(rb"[A-Za-z][@$!*013457]+[A-Za-z]|(?:\b[A-Za-z][.\-_ ]){3,}[A-Za-z]\b")


def terms_of(text: str) -> set[bytes]:
    """Words of a text, and their beginnings (of STEMS characters, with an asterisk)."""
    words = set(words_of(text.lower().encode()))
    stems = {w.decode()[:n].encode() + b"*" for w in words if len(w) >= min(STEMS) for n in STEMS if len(w) > n}
    return words | stems


class _Hits(dict):
    """word -> 2 if it is in the lexicon, 1 if it is of the second person, else 0."""

    def __init__(self, lexicon: frozenset[bytes]):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        hit = word in self.lexicon or len(word) >= min(STEMS) and any(word.decode()[:n].encode() + b"*" in self.lexicon for n in STEMS)
        v = self[word] = 2 if hit else 1 if word in _YOU else 0
        return v


def features_of(text: str, hits: _Hits) -> tuple[float, ...]:
    data = text.encode()
    words = words_of(text.lower().encode())
    flags = np.fromiter(map(hits.__getitem__, words), np.uint8, len(words))
    n, at = len(words), np.flatnonzero(flags == 2)
    near = 0
    you = np.flatnonzero(flags == 1)
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
        near = int((gap <= NEAR).sum())
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    upper, marks, exclaims = int(hist[65:91].sum()), int(hist[33:48].sum() + hist[58:65].sum()), int(hist[33] + hist[63])
    odd = len(_OBFUSCATED.findall(data))
    return (np.log1p(len(at)), 100 * len(at) / (n + 20), np.log1p(near), near / (len(at) + 1), len({words[i] for i in at.tolist()}), upper / size, marks / size, exclaims / size, 100 * odd / (n + 20), np.log1p(n))


def _lexicon(docs: DataFrame) -> frozenset[bytes]:
    """The terms of toxic texts. docs: (text, toxic) of a bounded number of rows."""

    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array([[t.decode() for t in terms_of(x or "")] for x in texts.to_pylist()], pa.list_(pa.string()))

    terms = docs.select("toxic", F.explode(F.arrow_udf(split, "array<string>")("text")).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where((F.col("t") >= MIN_TEXTS) & (F.col("t") >= MIN_SHARE * F.col("n")))
    rows = counts.orderBy(F.desc("t"), "term").limit(LEXICON_TERMS).collect()
    return frozenset(r.term.encode() for r in rows)


def _featured(docs: DataFrame, lexicon: frozenset[bytes]) -> DataFrame:
    """docs with the features in place of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = ", ".join(f"{f} double" for f in FEATURES)

    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hits = _Hits(sent.value)
        for texts in slices(batches):
            rows = [features_of(x or "", hits) for x in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([float(r[i]) for r in rows], pa.float64()) for i in range(len(FEATURES))], list(FEATURES))

    return docs.withColumn("f", F.arrow_udf(features, kind)("text")).drop("text").select("*", "f.*").drop("f")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs.

    Labels are learned from rows whose crc32 of the id, mod 4, is not 2, and at most about TRAIN_ROWS of them. A null or
    empty text has zero features and a score like others. Rows without an id are scored and not held out. Repeated rows
    get the same score each; equal labels of one id count once, different ones each. Without labels of both kinds among the rows of the
    trees or of the calibration, every score is the share of toxic labels. Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held_out = F.coalesce(split_of("doc_id", 4) == 2, F.lit(False))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out)
    known = written(bounded_sample(known, TRAIN_ROWS, "doc_id", "toxic").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5))), "labels")
    of = lambda df, part: df.where(F.col("part").isin(*PARTS[part]))

    # at most about TRAIN_ROWS rows are broadcast
    lexicon = _lexicon(own.join(F.broadcast(of(known, "lexicon")), "doc_id").select("text", "toxic"))
    rows = written(_featured(own.withColumn("held_out", held_out), lexicon), "features")
    marked = rows.join(F.broadcast(known.where(~F.col("part").isin(*PARTS["lexicon"]))), "doc_id").withColumn("label", F.col("toxic").cast("double"))
    marked = written(marked.coalesce(4), "marked")
    n = {(r.part, r.toxic): r.n for r in marked.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    if any((p, x) not in n for part in ("trees", "calibration") for p in PARTS[part] for x in (0, 1)):
        share = known.agg(F.avg("toxic")).first()[0] or 0.0
        scored = rows.withColumn("score", F.lit(float(share)))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
        trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, seed=11, maxBins=64).fit(vectors.transform(of(marked, "trees")))
        # the margin, and among equal margins no order
        margin = lambda df: trees.transform(vectors.transform(df)).withColumn("margin", vector_to_array("rawPrediction")[1])
        isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margin(of(marked, "calibration")).select("margin", "label"))
        scored = isotonic.transform(margin(rows).select("doc_id", "held_out", "margin"))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
