"""Exact nearest neighbours of a batch of query vectors.

Each Arrow batch of vectors meets a block of queries as one matrix product and a task keeps its own best k, so what is shuffled
is k rows for each query and task, whatever the number of vectors. Query vectors come from Spark block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.operators.best import Best
from loomlake.operators.bm25 import top_k

#: Query vectors that are held at once, and vectors that meet them at once.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 2048


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least scores; ties go to the smaller doc."""
    if len(scores) > k:
        limit = np.partition(scores, k - 1)[k - 1]
        at = np.flatnonzero(scores <= limit)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((docs[at], scores[at]))[:k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, doc, score, rank): the k nearest by squared L2 distance, or most similar by cosine; scores of 6 digits.

    queries: (query_id, embedding). Rows with a null vector are left out; vectors have one length. Queries are dealt to
    blocks of about QUERY_BLOCK by a hash of their id; each block reads the vectors once.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("doc"), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def search(block: int) -> DataFrame:
        wanted = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).toArrow().combine_chunks()
        ids = wanted.column("query_id").to_numpy()
        q = _matrix(wanted.column("embedding").combine_chunks()) if len(ids) else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast((ids, q))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = Best(len(ids), k)
            for whole in batches:
                for at in range(0, whole.num_rows if len(ids) else 0, VECTOR_BLOCK):
                    b = whole.slice(at, VECTOR_BLOCK)
                    x, docs = _matrix(b.column("v")), b.column("doc").to_numpy()
                    dots = q @ x.T
                    if metric == "l2":
                        s = np.round(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * dots, 0), 6)
                    else:
                        s = -np.round(dots / np.maximum(np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None], 1e-300), 6)
                    best.add(s, docs)
            at, scores, docs = best.entries()
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(docs), pa.array(scores * (1 if metric == "l2" else -1) + 0.0)], names=["query_id", "doc", "score"])

        return rows.mapInArrow(near, "query_id long, doc long, score double")

    return top_k(reduce(DataFrame.union, [search(i) for i in range(n_blocks)]), k, descending=metric != "l2")
