"""Conversation turns, sessions, and caches with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_TURNS = 5


def pair_turns(messages: DataFrame, session: str = "conv_id") -> DataFrame:
    """(session, turn, query, answer): each user message with the next message, if that is the assistant's.

    Messages of one turn stand in order of role (user, then assistant, then others) and text.
    """
    place = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    order = Window.partitionBy(session).orderBy("turn", place, "role", "text")
    rows = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    return rows.where("role = 'user' AND next_role = 'assistant'").select(session, "turn", F.col("text").alias("query"), "answer")


def last_turns(turns: DataFrame, n: int = WINDOW_TURNS, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each session; of equal turns the one of the greater query, then answer, counts as later."""
    ties = [F.desc(c) for c in ("query", "answer") if c in turns.columns]
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order), *ties))
    return turns.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def history_text(turns: DataFrame, n: int = WINDOW_TURNS, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, history): `用户：q`, `AI：a` blocks with blank lines between, oldest first."""
    block = F.concat(F.lit("用户："), "query", F.lit("\nAI："), "answer")
    rows = last_turns(turns, n, session, order).groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("s")))).alias("x"))
    return rows.select(session, F.array_join(F.transform("x", lambda x: x.s), "\n\n").alias("history"))


def without_history(queries: DataFrame) -> DataFrame:
    """Queries whose history is null or blank: only their answers may come from the cache or go into it."""
    return queries.where(F.coalesce(F.regexp_replace("history", r"(?U)\s+", ""), F.lit("")) == "")


def session_list(turns: DataFrame, client_id: str | None = None, limit: int | None = None) -> DataFrame:
    """(session_id, turns, last_active), most recent first, `limit` at most. turns: (session_id, field, timestamp); only numeric fields count."""
    rows = turns.where(F.col("field").rlike("^[0-9]+$"))
    if client_id:
        rows = rows.where(F.col("session_id").startswith(f"{client_id}:"))
    found = rows.groupBy("session_id").agg(F.count("*").alias("turns"), F.max("timestamp").alias("last_active")).orderBy(F.desc("last_active"), "session_id")
    return found if limit is None else found.limit(limit)


def merge_sessions(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Session lists of two stores: turns are added, the later last_active stays."""
    return hot.unionByName(cold).groupBy("session_id").agg(F.sum("turns").alias("turns"), F.max("last_active").alias("last_active"))


def merge_records(first: DataFrame, later: DataFrame, n: int = WINDOW_TURNS) -> DataFrame:
    """The last n records of each session of two lists (session_id, timestamp, query, answer); the later list wins a tie."""
    rows = first.withColumn("_list", F.lit(0)).unionByName(later.withColumn("_list", F.lit(1)))
    same = Window.partitionBy("session_id", "timestamp", "query").orderBy(F.desc("_list"), "answer")
    rows = rows.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth", "_list")
    return last_turns(rows, n, "session_id", "timestamp")


def append_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """turns (session_id, turn, timestamp, query, answer) and new ones, numbered on in order of time."""
    return turns.unionByName(numbered_turns(turns.groupBy("session_id").agg(F.max("turn").alias("turn")), new))


def numbered_turns(last: DataFrame, new: DataFrame) -> DataFrame:
    """New turns (session_id, timestamp, query, ...) with their turn, from the last one (session_id, turn) of their session on.

    They are numbered in order of time, those without a timestamp first.
    """
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "query"))
    rows = new.join(last.select("session_id", F.col("turn").alias("last")), "session_id", "left")
    return rows.withColumn("turn", (F.coalesce("last", F.lit(0)) + nth).cast("int")).drop("last")


def cache_lookup(writes: DataFrame, now: Column, ttl_seconds: int, key: str = "key", at: str = "written_at") -> DataFrame:
    """The latest write of each key that has not expired by now."""
    latest = writes.groupBy(key).agg(F.max(at).alias(at), F.max_by("payload", F.struct(F.col(at), F.col("payload"))).alias("payload"))
    return latest.where(F.col(at) + F.make_interval(secs=F.lit(ttl_seconds)) > now)


def cache_invalidate(cache: DataFrame, prefixes: tuple[str, ...] = ("retrieval:", "answer:"), key: str = "key") -> DataFrame:
    """The cache without the keys of some prefixes."""
    gone = F.lit(False)
    for p in prefixes:
        gone = gone | F.col(key).startswith(p)
    return cache.where(~gone)


def renewed_sessions(events: DataFrame, gap: str = "24 hours", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, session_start, n): sessions that each event renews for `gap`."""
    rows = events.groupBy(user, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(user, F.col("w.start").alias("session_start"), "n")
