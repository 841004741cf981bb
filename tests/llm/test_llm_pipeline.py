import re

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from loomlake.llm import sql
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    """Each stage on what its predecessor kept; near-dedup and decontamination by SQL."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        seen.append((name, docs, out))
        docs = out
    assert [n for n, *_ in seen] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]
    assert all(out.columns == columns for n, _, out in seen if n != "packing")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    def by_sql(before, text):
        con = duckdb.connect()
        con.register("documents", before.toArrow())
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
        return con.execute(text).fetchall()

    _, before, after = seen[1]
    assert ids(after) == {r[0] for r in by_sql(before, f"SELECT doc_id FROM ({sql.OP1}) WHERE kept")}
    _, before, after = seen[2]
    assert ids(after) == {r[0] for r in by_sql(before, f"SELECT doc_id FROM ({sql.OP2}) WHERE NOT contaminated")} and ids(after) < ids(before)
    _, before, after = seen[3]
    assert ids(after) == ids(before)
    assert not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text) for r in after.collect()) and all(r.n_chars == len(r.text) for r in after.collect())
    assert ids(seen[4][2]) == ids(after)


def test_stages_with_odd_rows(spark):
    """Nulls, empty and repeated rows, columns that are named like those of the operators, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [(None, None, None, None, None), (1001, "", "en", "s", 0), (1002, "pwd: kXw9vTq2Lmz and more words follow here so that ten are there", None, None, 1), (None, item + " and so on", "en", "s", 2), (7, None, "en", "s", 0)]
    odd += [(1003, " ".join(f"w{i}" for i in range(40)), "en", "s", 1)] * 2
    clash = ("n_words", "hits", "matches", "kept", "score", "component_id", "spans", "group", "row", "u", "hub")
    rows = docs.union(spark.createDataFrame(odd, docs.schema)).select("*", *[F.lit(f"my {c}").alias(c) for c in clash])
    before = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).toArrow())
        assert after.columns == rows.columns and not after.where(" OR ".join(f"`{c}` <> 'my {c}'" for c in clash)).count(), name
        empty = stage(spark, before.limit(0), SF)
        assert empty.columns == rows.columns and empty.count() == 0
        before = after
    left = before.collect()
    assert sum(r.doc_id == 1003 for r in left) == 2 and not any(item in (r.text or "") for r in left)
    assert "kXw9vTq2Lmz" not in next(r.text for r in left if r.doc_id == 1002)
    assert corpus_pipeline.packing_stage(spark, before, SF).count() >= len(left) and corpus_pipeline.packing_stage(spark, before.limit(0), SF).count() == 0


def test_entry_has_all_eleven():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
