"""Nearest neighbours by an inverted file: every vector in the list of its nearest centroid, and searches of a few lists.

Centroids are fitted by k-means on a sample of SAMPLE_ROWS at most; every vector is in a list. Lists are stored in slices of
about SLICE_ROWS, and the queries that probe a list come in blocks of about QUERY_BLOCK, so neither a list with a third of
all vectors nor one that all queries probe is a single task. `probes` sets how many lists a query searches; with as many as
there are lists the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators.bm25 import top_k
from loomlake.operators.vectors import _best, _matrix

SAMPLE_ROWS, SLICE_ROWS, QUERY_BLOCK = 100_000, 20_000, 4096
#: Lists of an index and lists that a query probes, by default; an index has MOST_LISTS at most, since all workers have the centroids.
LISTS, PROBES, MOST_LISTS = 64, 32, 16_384
STORED = "list int, slice long, doc long, v array<double>"


def _rows(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(name), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL")


class InvertedFile:
    """Lists of vectors and their centroids under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, lists: int = LISTS, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Fits the centroids and writes all vectors; null ones are left out. Of few vectors there are fewer lists."""
        if lists > MOST_LISTS:
            raise ValueError(f"an index has {MOST_LISTS} lists at most")
        rows = _rows(vectors, id_col, vec_col, "doc")
        n = rows.count()
        kept = F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 30))
        sample = rows.where(kept).limit(SAMPLE_ROWS)
        lists = max(1, min(lists, sample.count() // 4))
        centers = KMeans(k=lists, seed=seed, maxIter=10).fit(sample.select(array_to_vector("v").alias("features"))).clusterCenters() if n >= 4 else []
        self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "list int, v array<double>").write.mode("overwrite").parquet(f"{self.path}/centers")
        sent = self._centers()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    nearest = _distances(_matrix(b.column("v")), sent.value).argmin(1) if len(sent.value) else np.zeros(b.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), b.column("doc"), b.column("v")], names=["list", "doc", "v"])

        listed = rows.mapInArrow(assign, "list int, doc long, v array<double>")
        # a row for each list
        slices = listed.groupBy("list").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("slices"))
        sliced = listed.join(F.broadcast(slices), "list").withColumn("slice", F.pmod(F.xxhash64("doc"), F.col("slices"))).select("list", "slice", "doc", "v")
        sliced.repartitionByRange("list", "slice", "doc").sortWithinPartitions("list", "slice").write.mode("overwrite").parquet(f"{self.path}/lists")

    def _centers(self):
        """The centroids, which are MOST_LISTS at most, sent to all workers."""
        found = self.spark.read.schema("list int, v array<double>").parquet(f"{self.path}/centers").orderBy("list").toArrow().combine_chunks()
        return self.spark.sparkContext.broadcast(_matrix(found.column("v").combine_chunks()) if found.num_rows else np.zeros((0, 1)))

    def stored(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.path}/lists")

    def nearest(self, queries: DataFrame, k: int = 10, probes: int = PROBES) -> DataFrame:
        """(query_id, doc, score, rank): the k nearest by squared L2 distance among the vectors of the `probes` nearest lists.

        queries: (query_id, embedding); those without a vector have no hits. Ties go to the smaller doc.
        """
        sent = self._centers()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                far = _distances(_matrix(b.column("v")), sent.value) if len(sent.value) else np.zeros((b.num_rows, 1))
                picked = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
                at = pa.array(np.repeat(np.arange(b.num_rows), picked.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(picked.ravel()), b.column("query_id").take(at), b.column("v").take(at)], names=["list", "query_id", "v"])

        asked = _rows(queries, "query_id", "embedding", "query_id").mapInArrow(probe, "list int, query_id long, v array<double>")
        # a row for each list
        blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
        slices = self.stored().groupBy("list").agg((F.max("slice") + 1).alias("slices"))
        sizes = F.broadcast(blocks.join(slices, "list"))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = self.stored().join(sizes, "list").select("list", "slice", upto("blocks").alias("block"), "doc", "v")
        right = asked.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).select("list", upto("slices").alias("slice"), "block", "query_id", "v")

        def search(own: pa.Table, asking: pa.Table) -> pa.Table:
            names = ["query_id", "doc", "score"]
            if not own.num_rows or not asking.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
            own, asking = own.combine_chunks(), asking.combine_chunks()
            docs, ids = own.column("doc").to_numpy(), asking.column("query_id").to_numpy()
            vectors, wanted = (_matrix(t.column("v").combine_chunks()) for t in (own, asking))
            out = []
            for a in range(0, len(ids), 256):
                scores = np.round(_distances(wanted[a : a + 256], vectors), 6)
                for i, row in zip(ids[a : a + 256].tolist(), scores, strict=True):
                    at = _best(row, docs, k)
                    out.append((np.full(len(at), i), docs[at], row[at]))
            return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

        key = ["list", "slice", "block"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, doc long, score double")
        return top_k(found, k, descending=False)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)
