"""Streams: a drop folder of files, sessions renewed by activity, and events without repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomlake.functions.text import tokens
from loomlake.plans.knowledge_base import KnowledgeBase
from loomlake.sources.files import extension, is_supported


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(source, content, md5) of the text files that arrive in a folder."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source"), F.col("value").alias("content"), F.md5("value").alias("md5"))


def ingest_stream(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch of what has arrived to on_batch, once, and ends when all of it is done."""
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def binary_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(source, content, md5, ext) of the files of all supported formats that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(path)
    rows = rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "content", F.md5("content").alias("md5"), extension("path").alias("ext"))
    return rows.where(is_supported("source"))


def feed(kb: KnowledgeBase, path: str, checkpoint: str, operator: str = "") -> StreamingQuery:
    """Ingests what has arrived in a folder into a chunk store: each micro-batch replaces the chunks, postings, vectors and terms of its sources."""
    return ingest_stream(binary_stream(kb.spark, path), lambda batch, _: kb.ingest(batch, operator), checkpoint)


def last_turns_stream(turns: DataFrame, n: int = 5) -> DataFrame:
    """(session_id, turns): the last n turns of a session, renewed whenever turns (session_id, timestamp, query, answer) arrive."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            own = sorted([*own, *zip(b.timestamp, b["query"], b.answer, strict=True)])[-n:]
        state.update(tuple(map(list, zip(*own, strict=True))))
        yield pd.DataFrame({"session_id": [key[0]], "turns": [[f"{q}\n{a}" for _, q, a in own]]})

    kept = "timestamp array<string>, query array<string>, answer array<string>"
    return turns.groupBy("session_id").applyInPandasWithState(keep, "session_id string, turns array<string>", kept, "update", GroupStateTimeout.NoTimeout)


def expiring_turns_stream(turns: DataFrame, n: int = 5, ttl_seconds: int = 86_400) -> DataFrame:
    """`last_turns_stream` that forgets a session after ttl_seconds without a turn; each turn renews it.

    A timer removes the state of idle sessions at the next batch; a turn that arrives in that very batch begins the session
    anew, too, since the state knows when it was renewed. Turns without a timestamp count as the earliest. State and times
    are kept in the checkpoint. Timers ask for one empty batch after the other: a stream that shall end when all has been
    read (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled=false.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        own = []
        if state.exists:
            *kept, renewed = state.get
            own = list(zip(*kept, strict=True)) if now - renewed < 1000 * ttl_seconds else []
        for b in batches:
            own += list(zip(*[b[c].where(b[c].notna(), None) for c in ("timestamp", "query", "answer")], strict=True))
        own = sorted(own, key=lambda t: tuple((x is not None, x or "") for x in t))[-n:]
        state.update((*map(list, zip(*own, strict=True)), now))
        state.setTimeoutDuration(1000 * ttl_seconds)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [[f"{q or ''}\n{a or ''}" for _, q, a in own]]})

    kept = "timestamp array<string>, query array<string>, answer array<string>, renewed long"
    return turns.groupBy("session_id").applyInPandasWithState(keep, "session_id string, turns array<string>", kept, "update", GroupStateTimeout.ProcessingTimeTimeout)


def term_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, tf) of a stream of documents, kept up to date."""
    return stream.select(F.explode(tokens(text_col)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


def session_stream(events: DataFrame, gap: str = "24 hours", late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, session, n): sessions that each event renews for `gap`; events later than `late` are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(user, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n"))


def without_repeats(events: DataFrame, keys: list[str], late: str = "24 hours", ts: str = "ts") -> DataFrame:
    """The first of the events with equal keys within a time to live."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
