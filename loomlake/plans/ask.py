"""Questions with sessions: history, answer cache, search, context, answer and memory, for a batch at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import new_session_id
from loomlake.operators import memory, prompts
from loomlake.plans.knowledge_base import KnowledgeBase
from loomlake.plans.stores import Cache, Conversations

#: Seconds that an answer stays in the cache.
ANSWER_TTL = 86_400
ASKED = "query_id long, session_id string, query string"


class Answers:
    """Answers from a chunk store, with the turns of sessions and a cache of answers.

    generate(docs, context, query) gives the answer; docs is an array of heading, chapter and page_content in order of rank.
    """

    def __init__(self, kb: KnowledgeBase, turns: Conversations, cache: Cache, generate: Callable[[Column, Column, Column], Column] | None = None, client: str = "client"):
        self.kb, self.turns, self.cache, self.client = kb, turns, cache, client
        self.generate = generate or (lambda docs, context, query: prompts.extractive_answer(docs))

    def _staged(self, rows: DataFrame) -> DataFrame:
        path = f"{self.kb.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.kb.spark.read.schema(rows.schema).parquet(path)

    def upload(self, path: str, **options) -> DataFrame:
        """Uploads files; if anything was replaced or added, cached answers and searches no longer count."""
        stats = self.kb.upload(path, **options)
        if not stats.where("inserted > 0 OR deleted > 0").isEmpty():
            self.cache.invalidate()
        return stats

    def ask(self, questions: DataFrame, now: Column, top_k: int = 3, relevance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """(query_id, session_id, query, answer, context, cached) of questions (query_id, session_id, query).

        A question without a session begins one. Only questions whose session has no history take their answer from the cache
        or leave it there; an answer from the cache is no turn. All others see the last turns of their session, are searched
        as they stand, and are saved as turns. Questions of one batch do not see each other. A null question counts as empty.
        """
        own = F.coalesce("session_id", new_session_id(F.lit(self.client)))
        asked = self._staged(questions.select(F.col("query_id").cast("long").alias("query_id"), own.alias("session_id"), F.coalesce("query", F.lit("")).alias("query")))
        asked = self._staged(asked.join(self.turns.history(), "session_id", "left"))
        key = F.concat(F.lit("answer:"), "query").alias("key")
        fresh = memory.without_history(asked).select("query_id", key)
        known = self._staged(fresh.join(self.cache.get(fresh.select("key"), now), "key").select("query_id", F.col("payload").alias("answer")))
        left = asked.join(known, "query_id", "left_anti")
        hits = self._staged(self.kb.search(left.select("query_id", "query"), top_k=top_k, relevance=relevance))
        images = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.coalesce("image_description", F.lit("")) != "", F.struct("rank", "image_description")))).alias("x"))
        images = images.select("query_id", F.array_join(F.transform("x", lambda x: x.image_description), "\n").alias("images"))
        docs = F.coalesce("docs", F.array().cast("array<struct<heading:string,chapter:string,page_content:string>>"))
        rows = left.join(prompts.contexts(hits), "query_id", "left").join(images, "query_id", "left").withColumn("docs", docs)
        rows = rows.withColumn("context", prompts.context_text(F.col("docs"), F.col("images"), F.col("history")))
        done = self._staged(rows.withColumn("answer", self.generate(F.col("docs"), F.col("context"), F.col("query"))).select("query_id", "session_id", "query", "answer", "context", "history"))
        kept = memory.without_history(done).select(key, F.col("answer").alias("payload"), now.alias("written_at"))
        if not done.isEmpty():
            self.cache.put(kept.dropDuplicates(["key"]), ANSWER_TTL)
            self.turns.save(done.select("session_id", F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "query", "answer", "context"))
        cached = asked.join(known, "query_id").select("query_id", "session_id", "query", "answer", F.lit("").alias("context"), F.lit(True).alias("cached"))
        return done.select("query_id", "session_id", "query", "answer", "context", F.lit(False).alias("cached")).unionByName(cached)
