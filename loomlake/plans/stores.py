"""Stores of conversations and of cached answers, as versions of immutable parts: readers see all of a write or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import memory
from loomlake.plans.snapshots import Part, Snapshots

TURNS = "session_id string, turn int, timestamp string, query string, answer string, context string"
CACHE = "key string, payload string, written_at timestamp, expires_at timestamp"
#: Buckets of a cache's keys; a lookup of LOOKUP_KEYS keys at most reads the buckets of its keys alone.
BUCKETS, LOOKUP_KEYS = 32, 1000


class Store:
    """Records of one schema under a path. A store that was never written is empty; any other failure is one.

    Every change is one commit, so a writer that dies leaves the store as it was. One writer at a time: of two that begin
    with the same version, the second is refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.versions = Snapshots(spark, path)

    def _columns(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[f.strip().split(" ")[0] for f in self.schema.split(", ")])

    def load(self) -> DataFrame:
        return self.versions.read("records", self.schema)

    def append(self, rows: DataFrame) -> None:
        version = self.versions.version()
        parts = [*self.versions.parts(version), self.versions.write("records", self._columns(rows))]
        self.versions.commit(self.versions.merged(parts, {"records": lambda x: x}, {"records": self.schema}), version)

    def rewrite(self, rows: DataFrame) -> None:
        """rows, which may come from the store itself, in place of all records."""
        version = self.versions.version()
        self.versions.commit([self.versions.write("records", self._columns(rows))], version)

    def count(self) -> int:
        return self.load().count()

    def clear(self) -> None:
        self.rewrite(self.spark.createDataFrame([], self.schema))


class Conversations(Store):
    """Turns of sessions (session_id, turn, timestamp, query, answer, context)."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, TURNS)

    def save(self, new: DataFrame) -> None:
        """Appends turns (session_id, timestamp, query, answer, context), numbered on within their sessions.

        New turns are numbered in order of time, those without a timestamp first.
        """
        last = self.load().groupBy("session_id").agg(F.max("turn").alias("turn"))
        self.append(memory.numbered_turns(last, new))

    def recent(self, n: int = memory.WINDOW_TURNS) -> DataFrame:
        """The last n turns of every session."""
        return memory.last_turns(self.load(), n, "session_id")

    def history(self, n: int = memory.WINDOW_TURNS) -> DataFrame:
        """(session_id, history) of the last n turns."""
        return memory.history_text(self.load(), n, "session_id")

    def sessions(self, client_id: str | None = None, limit: int | None = None) -> DataFrame:
        return memory.session_list(self.load().withColumn("field", F.col("turn").cast("string")), client_id, limit)

    def live(self, now: Column, ttl_seconds: int) -> DataFrame:
        """The turns of sessions that some turn has renewed within the time to live."""
        turns = self.load()
        last = turns.groupBy("session_id").agg(F.max("timestamp").alias("_last"))
        alive = last.where(F.col("_last").cast("timestamp") + F.make_interval(secs=F.lit(ttl_seconds)) > now)
        return turns.join(alive.select("session_id"), "session_id", "left_semi")

    def expire(self, now: Column, ttl_seconds: int) -> None:
        """Sessions that no turn has renewed within the time to live go from the store itself."""
        self.rewrite(self.live(now, ttl_seconds))

    def clear_sessions(self, ids: DataFrame) -> None:
        """All turns of the sessions in ids (session_id) go."""
        self.rewrite(self.load().join(ids.select("session_id"), "session_id", "left_anti"))


class Cache:
    """Cached payloads by key (kind:...), each with a time to live.

    Writes go to buckets by a hash of their key, sorted by key and with a bloom filter, so a lookup of few keys reads their
    buckets alone and skips what cannot hold them. Of several writes of a key the latest counts; parts that are merged keep
    no other. To make kinds of keys invalid writes a line that hides all older entries.
    """

    ENTRIES = CACHE + ", version long"
    HIDDEN = "prefix string, version long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Snapshots(spark, path)

    def _write(self, rows: DataFrame) -> Part:
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
        rows = rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "key")
        return self.versions.write("entries", rows, partition="bucket", **{"parquet.bloom.filter.enabled#key": "true"})

    def _visible(self, parts: list[Part]) -> DataFrame:
        """All entries but the hidden ones; hidden has a row for each call of `invalidate`."""
        entries = self.versions.read("entries", self.ENTRIES + ", bucket int", parts)
        hidden = self.versions.read("hidden", self.HIDDEN, parts).groupBy("prefix").agg(F.max("version").alias("at")).collect()
        for h in hidden:
            entries = entries.where(~(F.col("key").startswith(h.prefix) & (F.col("version") <= h["at"])))
        return entries

    @staticmethod
    def _latest(entries: DataFrame) -> DataFrame:
        best = F.max_by(F.struct("payload", "written_at", "expires_at", "version"), F.struct("written_at", "version", "payload"))
        return entries.groupBy("key").agg(best.alias("x")).select("key", "x.*")

    def load(self) -> DataFrame:
        """The latest write of each key that is not hidden, expired ones too."""
        return self._latest(self._visible(self.versions.parts())).drop("version")

    def put(self, rows: DataFrame, ttl_seconds: int) -> None:
        """Writes (key, payload, written_at); the latest write of a key is the one that counts."""
        version = self.versions.version()
        rows = rows.select("key", "payload", "written_at", (F.col("written_at") + F.make_interval(secs=F.lit(ttl_seconds))).alias("expires_at"), F.lit(version + 1).cast("long").alias("version"))
        self._commit([*self.versions.parts(version), self._write(rows)], version)

    def _commit(self, parts: list[Part], version: int) -> None:
        while len(own := [p for p in parts if p[0] == "entries"]) and (many := self.versions.crowded(own)):
            # hidden entries go here; a merged entry keeps the version by which it came
            kept = self._visible([*many, *[p for p in parts if p[0] == "hidden"]])
            name, _, path = self._write(self._latest(kept).select("key", "payload", "written_at", "expires_at", "version"))
            parts = [p for p in parts if p not in many] + [(name, many[0][1] + 1, path)]
        self.versions.commit(parts, version)

    def lookup(self, keys: DataFrame, parts: list[Part] | None = None) -> DataFrame:
        """The entries of keys, all writes; for LOOKUP_KEYS keys at most only their buckets are read."""
        entries = self._visible(self.versions.parts() if parts is None else parts)
        wanted = keys.select("key").where("key IS NOT NULL").distinct()
        few = wanted.select("key", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")).limit(LOOKUP_KEYS + 1).collect()
        if len(few) <= LOOKUP_KEYS:
            return entries.where(F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col("key").isin([r.key for r in few]))
        return entries.join(wanted, "key", "left_semi")

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """(key, payload) of the keys that are known and have not expired."""
        return self._latest(self.lookup(keys)).where(F.col("expires_at") > now).select("key", "payload")

    def invalidate(self, prefixes: tuple[str, ...] = ("retrieval:", "answer:")) -> None:
        """All keys of some prefixes go."""
        version = self.versions.version()
        hidden = self.versions.write("hidden", self.spark.createDataFrame([(p, version) for p in prefixes], self.HIDDEN))
        self.versions.commit([*self.versions.parts(version), hidden], version)
