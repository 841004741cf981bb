"""A question's whole path, with history, cache and images."""

from pyspark.sql import functions as F

from loomlake.operators import ingest
from loomlake.plans.ask import Answers
from loomlake.plans.knowledge_base import KnowledgeBase
from loomlake.plans.stores import Cache, Conversations
from test_operators import _pictured

QUESTIONS = "query_id long, session_id string, query string"


def test_sessions_caches_and_images_on_the_path(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alpha is first. beta")
    (tmp_path / "in" / "w.docx").write_bytes(_pictured())
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    answers = Answers(kb, Conversations(spark, str(tmp_path / "turns")), Cache(spark, str(tmp_path / "cache")))
    answers.upload(str(tmp_path / "in"), describe=ingest.image_text)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ask = lambda rows, hours=0: {r.query_id: r for r in answers.ask(spark.createDataFrame(rows, QUESTIONS), at + F.make_interval(hours=F.lit(hours)), top_k=2).collect()}
    first = ask([(1, "s:1", "alpha"), (2, None, "one two"), (3, "s:3", None)])
    assert not any(r.cached for r in first.values()) and first[2].session_id.startswith("client:")
    assert first[1].answer == "alpha is first." and "【历史对话】" not in first[1].context
    assert "【关联图片描述】（共 2 张）\n图片 1：image.emf，3 字节\n图片 2：image1.JPG，2 字节" in first[2].context
    assert answers.turns.count() == 3
    again = ask([(1, "s:1", "alpha"), (2, "s:new", "alpha")], 1)
    assert not again[1].cached and "【历史对话】\n用户：alpha\nAI：alpha is first." in again[1].context
    assert again[2].cached and again[2].answer == "alpha is first."
    assert {(r.session_id, r.turns) for r in answers.turns.sessions("s").collect()} == {("s:1", 2), ("s:3", 1)}  # a cached answer is no turn
    assert not ask([(2, "s:later", "alpha")], 30)[2].cached  # it has expired
    (tmp_path / "in" / "a.txt").write_text("alpha has changed!")
    answers.upload(str(tmp_path / "in"))
    changed = ask([(5, "s:5", "alpha")], 30)[5]
    assert not changed.cached and changed.answer == "alpha has changed!"
