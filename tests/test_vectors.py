"""The inverted file of vectors against the exact search."""

import numpy as np
import pytest

from loomlake.operators import ivf, vectors
from loomlake.operators.ivf import InvertedFile


def hits(rows):
    return sorted((r.query_id, r["rank"], r.doc, r.score) for r in rows.collect())


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_against_exact(spark, tmp_path, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    asked = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding")
    index = InvertedFile(spark, str(tmp_path / "ivf"))
    index.build(rows)
    want = hits(vectors.nearest(rows, asked, 10))
    assert index.stored().count() == rows.count()
    got = {h[:1] + h[2:3] for h in hits(index.nearest(asked, 10))}
    assert len(got & {h[:1] + h[2:3] for h in want}) / len(want) >= 0.9
    assert hits(index.nearest(asked, 10, probes=ivf.LISTS)) == want


def test_hot_lists_nulls_and_ties(spark, tmp_path):
    rng = np.random.default_rng(1)
    same = rng.normal(size=8).round(3).tolist()
    data = [(i, same) for i in range(400)] + [(1000 + i, rng.normal(size=8).round(3).tolist()) for i in range(800)] + [(5000, None)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, same) for i in range(50)] + [(100 + i, data[400 + i][1]) for i in range(30)] + [(999, None)], "query_id long, embedding array<double>")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ivf, "SLICE_ROWS", 100)
        m.setattr(ivf, "QUERY_BLOCK", 7)
        index = InvertedFile(spark, str(tmp_path / "ivf"))
        index.build(rows, lists=10)
        assert index.stored().groupBy("list", "slice").count().agg({"count": "max"}).first()[0] < 400  # the 400 equal vectors do not lie together
        got = hits(index.nearest(asked, 5, probes=10))
    assert got == hits(vectors.nearest(rows, asked, 5))
    assert [h[2] for h in got if h[0] == 3] == [0, 1, 2, 3, 4] and not [h for h in got if h[0] == 999]


def test_small_and_empty_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, embedding array<float>")
    for name, data in (("none", []), ("one", [(4, [1.0, 1.0])]), ("few", [(i, [float(i), 0.0]) for i in range(9)])):
        index = InvertedFile(spark, str(tmp_path / name))
        rows = spark.createDataFrame(data, schema)
        index.build(rows)
        assert hits(index.nearest(asked, 3)) == hits(vectors.nearest(rows, asked, 3))
    with pytest.raises(ValueError, match="at most"):
        index.build(rows, lists=ivf.MOST_LISTS + 1)
