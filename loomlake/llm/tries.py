"""Tries of conversations: which beginnings they share, and how many tokens sharing them saves.

Turns are numbered within their conversation, and every beginning of a conversation gets a digest, by running totals over
ranges of rows (`running`), so that no conversation is a hot key. Equal beginnings are one node; nodes are counted before
anything else, so copies cost nothing further.

Nodes with more than `limit` members are heavy. As all their ancestors are heavy too and a conversation adds to each depth
once, there are at most rows / limit of them. What hangs below a heavy node is light: whole light subtrees are dealt to
shards, and in each shard numpy puts its nodes into level order, builds the LOUDS bits and the labels, and sums up from the
last node to the first with add.at. The heavy upper levels are merged separately, with the sums of the light subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import written

#: Turns of the first conversation of a group of GROUP that are put before another one's: 0 to MOST_SHARED - 1.
GROUP, MOST_SHARED = 20, 4
#: Nodes that are heavy at most; beyond LEAST_LIMIT members the limit follows from it.
HEAVY_NODES, LEAST_LIMIT = 1 << 19, 1024
#: Nodes of a shard, without the last light subtree.
SHARD_NODES = 1 << 18
#: Bytes of the ids of a node's ends that are put into one row.
END_BYTES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, key: str, order: list[Column], mixes: tuple[str, ...] = ()) -> DataFrame:
    """df with n (the place of a row within its key, from 1), last (whether it is the key's last row), and each long column
    of `mixes` replaced by the running XOR of it within the key.

    Rows are parted by ranges of (key, *order), so a hot key lies in several tasks. Each task counts for itself; what a key
    has in the tasks before is added afterwards, from one row a task. Rows without a key must not be given.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    schema = pa.schema([("n", pa.int64()), ("part", pa.int64()), ("ends", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, at, sums = TaskContext.get().partitionId(), None, 0, [0] * len(mixes)

        def out(b: pa.RecordBatch, follows: int | None) -> pa.RecordBatch:
            nonlocal at, sums, last_key
            keys = b.column(key).to_numpy()
            begins = np.insert(keys[1:] != keys[:-1], 0, keys[0] != last_key)
            place = np.arange(len(keys))
            first = np.maximum.accumulate(np.where(begins, place, -1))
            n = np.where(first < 0, place + 1 + at, place - first + 1)
            columns = {c: b.column(c) for c in b.schema.names}
            totals = []
            for k, c in enumerate(mixes):
                acc = np.bitwise_xor.accumulate(b.column(c).to_numpy())
                before = np.where(first > 0, acc[np.maximum(first - 1, 0)], np.where(first < 0, sums[k], 0))
                columns[c] = pa.array(acc ^ before)
                totals.append(int((acc ^ before)[-1]))
            at, sums, last_key = int(n[-1]), totals, int(keys[-1])
            ends = np.append(begins[1:], follows is None or follows != keys[-1])
            extra = [pa.array(n), pa.array(np.full(len(keys), part)), pa.array(ends)]
            return pa.RecordBatch.from_arrays([*columns.values(), *extra], names=[*columns, *schema.names])

        last_key: int | None = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield out(held, b.column(key)[0].as_py())
            held = b
        if held is not None:
            yield out(held, None)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    own = written(ordered.mapInArrow(count, f"{fields}, n long, part long, ends boolean"), "running")
    tail = F.max_by(F.struct(key, "n", *mixes), F.struct(key, "n")).alias("tail")
    # one row a task
    tasks = own.groupBy("part").agg(F.min(key).alias("head"), tail).orderBy("part").collect()
    carry: dict | None = None
    offsets = []
    for at, t in enumerate(tasks):
        goes_on = carry is not None and carry[key] == t["head"]
        more = at + 1 < len(tasks) and tasks[at + 1]["head"] == t["tail"][key]
        offsets.append((t["part"], t["head"], t["tail"][key], carry["n"] if goes_on else 0, *[carry[c] if goes_on else 0 for c in mixes], more))
        tail_row = t["tail"].asDict()
        if goes_on and tail_row[key] == carry[key]:
            tail_row = {key: carry[key], "n": tail_row["n"] + carry["n"], **{c: tail_row[c] ^ carry[c] for c in mixes}}
        carry = tail_row
    added = ", ".join(f"_{c} long" for c in ("n", *mixes))
    known = spark.createDataFrame(offsets, f"part long, _head long, _tail long, {added}, _more boolean")
    is_head = F.col(key) == F.col("_head")
    plus = {c: F.when(is_head, F.col(c).bitwiseXOR(F.col(f"_{c}"))).otherwise(F.col(c)) for c in mixes}
    plus |= {"n": F.when(is_head, F.col("n") + F.col("_n")).otherwise(F.col("n")), "last": F.col("ends") & ~(F.col("_more") & (F.col(key) == F.col("_tail")))}
    return own.join(F.broadcast(known), "part").withColumns(plus).select(*df.columns, "n", "last")


def keyed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, words): turns by a 128-bit digest of role and text; rows without a conv_id are left out."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = [F.xxhash64(F.lit(seed), role, text).alias(name) for seed, name in ((13, "a"), (1013, "b"))]
    words = F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *digest, words)


def shared_turns(conv_id: str = "conv_id") -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % MOST_SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, words): each conversation with the first turns of its group's first one in place of its own."""
    numbered = written(running(keyed_turns(turns), "conv_id", [F.asc_nulls_first("turn"), F.col("a"), F.col("b")]), "turns")
    first = numbered.where((F.pmod("conv_id", F.lit(GROUP)) == 0) & (F.col("n") < MOST_SHARED)).select(F.col("conv_id").alias("base"), "n", "a", "b", "words")
    had = first.groupBy("base").agg(F.max("n").alias("had"))
    convs = numbered.where("n = 1").select("conv_id", shared_turns().alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))).alias("base"))
    convs = written(convs.join(had, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("had", F.lit(0))).alias("taken")), "shared")
    before = convs.where("taken > 0").join(first, "base").where("n <= taken").select("conv_id", F.col("n").alias("depth"), "a", "b", "words")
    # few conversations get less than they ask for: only those change the places of their own turns
    less = convs.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("less"))
    own = numbered.where(F.col("n") > shared_turns()).join(less, "conv_id", "left")
    return before.unionByName(own.select("conv_id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("depth"), "a", "b", "words"))


def paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, id_a, id_b, up_a, up_b, words, last) of each turn of the rebuilt conversations; their conv_ids.

    id is the digest of a beginning: the XOR of a digest of each of its turns with its place. up is that of its parent; the
    root has zeros.
    """
    rows = rebuilt(turns)
    step = {c: F.xxhash64(F.lit(seed), "depth", "a", "b") for seed, c in ((17, "step_a"), (1017, "step_b"))}
    rows = rows.select("conv_id", "depth", "words", *[c.alias(n) for n, c in step.items()]).withColumns({"id_a": F.col("step_a"), "id_b": F.col("step_b")})
    done = running(rows, "conv_id", [F.col("depth")], ("id_a", "id_b"))
    up = {f"up_{c}": F.col(f"id_{c}").bitwiseXOR(F.col(f"step_{c}")) for c in "ab"}
    every = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return written(done.withColumns(up).select("conv_id", "depth", "id_a", "id_b", "up_a", "up_b", "words", "last"), "paths"), every


def end_digests(ends: DataFrame) -> DataFrame:
    """(id_a, id_b, ends_sha256) of ends (id_a, id_b, conv_id): SHA-256 of the conv_ids in ascending order.

    Tasks over ranges of (node, conv_id) write the ids of each node into rows of END_BYTES; a node's rows then pass one task
    in order, as a stream, since the digest needs them one after the other.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, told, size, out = None, 0, [], 0, []
        for b in batches:
            for a, c, conv in zip(*[b.column(x).to_pylist() for x in ("id_a", "id_b", "conv_id")], strict=True):
                if told and ((a, c) != node or size > END_BYTES):
                    out.append((*node, first, ",".join(told)))
                    told, size = [], 0
                if not told:
                    node, first = (a, c), conv
                told.append(str(conv))
                size += len(told[-1]) + 1
            yield _rows(out, "id_a id_b first ids")
            out = []
        if told:
            yield _rows([(*node, first, ",".join(told))], "id_a id_b first ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for b in batches:
            for a, c, ids in zip(*[b.column(x).to_pylist() for x in ("id_a", "id_b", "ids")], strict=True):
                if (a, c) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a, c), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _rows(out, "id_a id_b ends_sha256")
            out = []
        if node:
            yield _rows([(*node, sha.hexdigest())], "id_a id_b ends_sha256")

    by = ["id_a", "id_b", "conv_id"]
    blocks = ends.select(by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(render, "id_a long, id_b long, first long, ids string")
    return blocks.repartition("id_a", "id_b").sortWithinPartitions("id_a", "id_b", "first").mapInArrow(digest, "id_a long, id_b long, ends_sha256 string")


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    fields = names.split()
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if f in ("ids", "ends_sha256") else pa.int64()) for k, f in enumerate(fields)], names=fields)


@dataclass
class Louds:
    """A forest in level order under one super-root: for each node, in that order, a one for each child and a zero.

    Node 0 is the super-root; node i > 0 is the i-th one. order[i - 1] is the row that node i came from.
    """

    bits: np.ndarray
    order: np.ndarray
    levels: list[int]

    @classmethod
    def of(cls, parent: np.ndarray) -> Louds:
        """parent: the row of each row's parent, -1 for the roots."""
        n = len(parent)
        by_parent = np.argsort(parent, kind="stable")
        degree = np.bincount(parent + 1, minlength=n + 1)  # of row -1, the super-root, first
        starts = np.cumsum(degree) - degree
        order, levels = [], [1]
        rows = by_parent[: degree[0]]
        while len(rows):
            order.append(rows)
            levels.append(levels[-1] + len(rows))
            many = degree[rows + 1]
            stop = np.cumsum(many)
            rows = by_parent[np.arange(many.sum()) - np.repeat(stop - many - starts[rows + 1], many)]
        every = np.concatenate([np.zeros(0, np.int64), *order])
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(np.append(degree[0], degree[every + 1]) + 1) - 1] = False
        return cls(bits, every, levels)

    def parents(self) -> np.ndarray:
        """The parent of each node but the super-root: as many zeros stand before its one as nodes before its parent."""
        return np.cumsum(~self.bits)[self.bits]

    def degrees(self) -> np.ndarray:
        """Children of each node, the super-root first."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(np.append(-1, zeros)) - 1

    def children(self, node: int) -> range:
        zeros = np.flatnonzero(~self.bits)
        start = (zeros[node - 1] + 1 if node else 0) - node + 1
        return range(int(start), int(start + self.degrees()[node]))

    def sum_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over the subtree of each node (the super-root first), level by level from the last."""
        total, parents = np.concatenate([np.zeros(1, values.dtype), values]), self.parents()
        bounds = self.levels
        for a, b in reversed(list(zip(bounds[:-1], bounds[1:], strict=True))):
            np.add.at(total, parents[a - 1 : b - 1], total[a:b])
        return total


def _row_parents(t: pa.Table) -> np.ndarray:
    """The row of each row's parent, by its 128-bit id; -1 where the table does not hold it."""
    ids = np.stack([t.column("id_a").to_numpy(), t.column("id_b").to_numpy()], 1).copy().view("V16").ravel()
    ups = np.stack([t.column("up_a").to_numpy(), t.column("up_b").to_numpy()], 1).copy().view("V16").ravel()
    if not len(ids):
        return np.zeros(0, np.int64)
    _, dense = np.unique(np.concatenate([ids, ups]), return_inverse=True)
    row = np.full(dense.max() + 1, -1, np.int64)
    row[dense[: len(ids)]] = np.arange(len(ids))
    return row[dense[len(ids) :]]


NODES = "id_a long, id_b long, up_a long, up_b long, depth long, conv_id long, n_convs long, words long, shard long, children_below long, leaves_below long, saved_below long"
SUMMED = "id_a long, id_b long, up_a long, up_b long, depth long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, is_root boolean"


def _summed(t: pa.Table) -> pa.Table:
    """The sums of the nodes of a shard, or of the upper levels; what hangs below in other shards is given in *_below."""
    numbers = {c: t.column(c).to_numpy() for c in ("conv_id", "n_convs", "words", "children_below", "leaves_below", "saved_below")}
    parent = _row_parents(t)
    trie = Louds.of(parent)
    order = trie.order
    children = trie.degrees()[1:] + numbers["children_below"][order]
    leaves = trie.sum_up((children == 0) + numbers["leaves_below"][order])[1:]
    saved = trie.sum_up((numbers["n_convs"][order] - 1) * numbers["words"][order] + numbers["saved_below"][order])[1:]
    ups = parent[order]
    parent_conv = pa.array(numbers["conv_id"][ups], mask=ups < 0)
    columns = [t.column(c).take(pa.array(order)) for c in ("id_a", "id_b", "up_a", "up_b", "depth", "conv_id", "n_convs")]
    names = [f.split()[0] for f in SUMMED.split(", ")]
    return pa.table([*columns, parent_conv, pa.array(children.astype(np.int64)), pa.array(leaves.astype(np.int64)), pa.array(saved.astype(np.int64)), pa.array(ups < 0)], names=names)


def _sharded(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(light nodes with their shard, heavy nodes, paths, conv_ids)."""
    walked, every = paths(turns)
    nodes = walked.groupBy("id_a", "id_b").agg(*[F.first(c).alias(c) for c in ("up_a", "up_b", "depth", "words")], F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = written(nodes, "nodes")
    n_rows, n_nodes = walked.count(), nodes.count()
    limit = max(LEAST_LIMIT, n_rows // HEAVY_NODES + 1)
    none_below = {c: F.lit(0).cast("long") for c in ("children_below", "leaves_below", "saved_below")}
    heavy = nodes.where(F.col("n_convs") > limit)
    # at most HEAVY_NODES rows of two numbers
    ids = heavy.select(F.col("id_a").alias("up_a"), F.col("id_b").alias("up_b"))
    tops = ids.unionByName(turns.sparkSession.createDataFrame([(0, 0)], "up_a long, up_b long"))
    light = nodes.where(F.col("n_convs") <= limit)
    # the light subtree of a conversation begins where its path leaves the heavy nodes
    roots = walked.join(F.broadcast(tops), ["up_a", "up_b"], "left_semi").join(F.broadcast(ids.toDF("id_a", "id_b")), ["id_a", "id_b"], "left_anti")
    shards = max(1, -(-n_nodes // SHARD_NODES))
    roots = roots.select("conv_id", F.pmod(F.xxhash64("id_a", "id_b"), F.lit(shards)).alias("shard"))
    light = light.join(roots, "conv_id").withColumns(none_below)
    return light, heavy.withColumns(none_below), walked, every


def conversation_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    turns: (conv_id, turn, role, text), any other columns are not read. Turns are ordered by turn, null first; those of one
    turn by a digest of role and text, so equal rows are turns one after the other. A null role or text counts as empty;
    rows without a conv_id belong to no conversation. The remainder of a negative conv_id is taken as positive. An empty
    table gives the root alone, with a null conv_id and no members. Beginnings are told apart by 128 bits of hash.
    """
    light, heavy, walked, every = _sharded(turns)
    columns = [f.split()[0] for f in NODES.split(", ")]
    below = written(light.select(columns).groupBy("shard").applyInArrow(_summed, SUMMED), "light")
    by_parent = below.where("is_root").groupBy("up_a", "up_b").agg(F.count("*").alias("children_below"), F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below"))
    by_parent = by_parent.select(F.col("up_a").alias("id_a"), F.col("up_b").alias("id_b"), "children_below", "leaves_below", "saved_below")
    # the root is its own parent, with an id that no beginning has
    zero = F.lit(0).cast("long")
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).select(*[zero.alias(c) for c in ("id_a", "id_b")], *[F.lit(-1).cast("long").alias(c) for c in ("up_a", "up_b")], zero.alias("depth"), F.coalesce("conv_id", F.lit(-1)).alias("conv_id"), "n_convs", zero.alias("words"))
    upper = heavy.drop("children_below", "leaves_below", "saved_below").unionByName(root).join(by_parent, ["id_a", "id_b"], "left")
    upper = upper.withColumns({c: F.coalesce(c, zero) for c in ("children_below", "leaves_below", "saved_below")}).withColumn("shard", zero)
    # at most HEAVY_NODES and the root
    upper = written(upper.select(columns).groupBy("shard").applyInArrow(_summed, SUMMED), "upper")
    parents = F.broadcast(upper.select(F.col("id_a").alias("up_a"), F.col("id_b").alias("up_b"), F.col("conv_id").alias("up_conv")))
    summed = below.join(parents, ["up_a", "up_b"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv")).drop("up_conv").unionByName(upper)
    ended = walked.where("last").select("id_a", "id_b", "conv_id")
    turnless = every.join(ended.select("conv_id"), "conv_id", "left_anti").select(zero.alias("id_a"), zero.alias("id_b"), "conv_id")
    digests = end_digests(ended.unionByName(turnless))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = summed.join(digests, ["id_a", "id_b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return out.withColumn("conv_id", F.when(F.col("n_convs") > 0, F.col("conv_id"))).select(names)


def trie_shards(turns: DataFrame) -> DataFrame:
    """(shard, n_nodes, louds, labels_a, labels_b): the light subtrees of each shard as LOUDS bits, packed, and labels.

    Labels are the digests of the nodes' beginnings in level order. `Louds` reads the bits.
    """

    def build(t: pa.Table) -> pa.Table:
        trie = Louds.of(_row_parents(t))
        labels = [t.column(c).to_numpy()[trie.order].astype("<i8").tobytes() for c in ("id_a", "id_b")]
        return pa.table({"shard": t.column("shard")[:1], "n_nodes": [t.num_rows], "louds": [np.packbits(trie.bits).tobytes()], "labels_a": [labels[0]], "labels_b": [labels[1]]})

    columns = [f.split()[0] for f in NODES.split(", ")]
    return _sharded(turns)[0].select(columns).groupBy("shard").applyInArrow(build, "shard long, n_nodes long, louds binary, labels_a binary, labels_b binary")
