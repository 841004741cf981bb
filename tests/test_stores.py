"""Stores that lose nothing, and caches that read few files."""

import pytest
from pyspark.sql import functions as F

from loomlake.plans import snapshots, stores
from loomlake.plans.knowledge_base import KnowledgeBase
from loomlake.plans.snapshots import Snapshots
from loomlake.plans.stores import Cache, Conversations
from loomlake.streaming import streams
from test_operators import _docx

NEW = "session_id string, timestamp string, query string, answer string, context string"
AT = "2024-01-01 00:00:00"


def test_turns_without_a_timestamp_stay(spark, tmp_path):
    store = Conversations(spark, str(tmp_path / "c"))
    store.save(spark.createDataFrame([("s", AT, "q2", "a", None), ("s", None, "q1", None, None), (None, None, None, None, None)], NEW))
    store.save(spark.createDataFrame([("s", None, "q3", "a", "")], NEW))
    assert sorted((r.turn, r.query) for r in store.load().where("session_id = 's'").collect()) == [(1, "q1"), (2, "q2"), (3, "q3")]
    assert store.count() == 4


def test_sessions_expire_in_the_store(spark, tmp_path):
    store = Conversations(spark, str(tmp_path / "c"))
    store.save(spark.createDataFrame([("old", "2023-12-01 00:00:00", "q", "a", ""), ("new", "2023-12-01 00:00:00", "q", "a", ""), ("new", AT, "q", "a", "")], NEW))
    store.expire(F.lit("2024-01-01 12:00:00").cast("timestamp"), 86400)
    assert {(r.session_id, r.turn) for r in store.load().collect()} == {("new", 1), ("new", 2)}


@pytest.mark.parametrize("broken", ["write", "commit"])
def test_a_broken_change_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch, broken):
    store = Conversations(spark, str(tmp_path / "c"))
    store.save(spark.createDataFrame([("s", AT, "q", "a", "")], NEW))
    with monkeypatch.context() as m:
        m.setattr(Snapshots, broken, lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
        for change in (store.clear, lambda: store.append(store.load()), lambda: store.clear_sessions(store.load())):
            with pytest.raises(OSError):
                change()
    assert store.count() == 1


def files_read(rows):
    spark = rows.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rows._jdf.queryExecution().executedPlan()
        rows._jdf.queryExecution().toRdd().count()
        leaves, total = plan.collectLeaves(), 0
        for i in range(leaves.size()):
            metrics = leaves.apply(i).metrics()
            total += metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0
        return total
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_cache_lookups_read_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FAN_IN", 3)
    cache = Cache(spark, str(tmp_path / "k"))
    at = F.lit(AT).cast("timestamp")
    want = {}
    for n in range(4):
        rows = [(f"{kind}:{i}", f"{n}-{i}") for kind in ("answer", "other") for i in range(n * 40, 200)]
        cache.put(spark.createDataFrame(rows, "key string, payload string").withColumn("written_at", at + F.make_interval(secs=F.lit(n))), 100)
        want |= dict(rows)
    keys = spark.createDataFrame([("answer:5",), ("other:199",), ("none",), (None,)], "key string")
    assert {(r.key, r.payload) for r in cache.get(keys, at).collect()} == {(k, want[k]) for k in ("answer:5", "other:199")}
    assert {r.key: r.payload for r in cache.load().collect()} == want
    assert 2 * files_read(cache.lookup(keys)) < files_read(cache._visible(cache.versions.parts()))
    monkeypatch.setattr(stores, "LOOKUP_KEYS", 1)  # by a join, with the same rows
    assert {(r.key, r.payload) for r in cache.get(keys, at).collect()} == {(k, want[k]) for k in ("answer:5", "other:199")}
    assert cache.get(keys, at + F.make_interval(secs=F.lit(103))).count() == 0
    cache.invalidate(("answer:",))
    cache.put(spark.createDataFrame([("answer:5", "again")], "key string, payload string").withColumn("written_at", at), 100)
    assert {(r.key, r.payload) for r in cache.get(keys, at).collect()} == {("answer:5", "again"), ("other:199", want["other:199"])}
    for _ in range(3):  # until hidden entries are merged away
        cache.put(spark.createDataFrame([("x:1", "x")], "key string, payload string").withColumn("written_at", at), 100)
    assert cache.load().where("key LIKE 'answer:%'").count() == 1 and cache.load().count() == 1 + 200 + 1


def test_one_broken_file_fails_alone(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(20):
        (src / f"f{k}.txt").write_text(f"text number {k}")
    (src / "ok.docx").write_bytes(_docx())
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.upload(str(src))
    (src / "ok.docx").write_bytes(_docx()[:200])  # cut off
    (src / "bad.xlsx").write_bytes(b"no archive")
    (src / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0 older")
    (src / "f1.txt").write_text("changed")
    stats = {r.source: r for r in kb.upload(str(src)).collect()}
    assert (stats["f1.txt"].inserted, stats["f1.txt"].deleted) == (1, 1) and stats["f0.txt"].skipped == 1
    assert "BadZipFile" in stats["bad.xlsx"].msg and "older .xls" in stats["old.xls"].msg and "BadZipFile" in stats["ok.docx"].msg
    sources = {r.source for r in kb.sources().collect()}
    assert sources == {f"f{k}.txt" for k in range(20)} | {"ok.docx"}  # what was there of it stays
    assert kb.ledger().count() == 22
    (src / "bad.xlsx").unlink()
    streams.feed(kb, str(src), str(tmp_path / "cp")).awaitTermination(120)  # a stream goes on, too
    assert kb.sources().count() == 21
