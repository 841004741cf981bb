import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.llm import tries

TURNS = "conv_id long, turn long, role string, text string, n string, part string, depth string, last string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)


def plain(rows, order):
    """By sets of whole beginnings. order: what stands for a turn where turns tie."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, order(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = defaultdict(list)
    members[()] = []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        tokens = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += tokens
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.append((min(own, default=None), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def tie_order(spark):
    known = {}

    def order(role, text):
        if (role, text) not in known:
            known[role, text] = tuple(spark.range(1).select(*[F.xxhash64(F.lit(s), F.lit(role), F.lit(text)) for s in (13, 1013)]).first())
        return known[role, text]

    return order


def table(seed, n, texts):
    rng = np.random.default_rng(seed)
    return [(int(c), k, "user" if k % 2 == 0 else "assistant", str(rng.choice(texts))) for c in rng.choice(n * 3, n, replace=False) for k in range(int(rng.integers(1, 9)))]


ODD = [(1, None, None, None), (1, None, "user", "tie"), (1, 0, "user", "a b"), (None, 0, "user", "no conversation"), (40, 0, "user", "short base"), (41, 1, "user", "x"), (41, 1, "user", "x"), (42, 5, "user", "only"), (43, 0, "", ""), (61, 0, "user", "no base"), (61, 1, "user", "no base"), (62, 0, "a", "b")]


def got(spark, rows, parts=4):
    out = tries.conversation_trie(frame(spark, rows).repartition(parts))
    assert out.columns == NAMES
    return sorted(repr(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("limit, shard, heavy", [(1024, 1 << 18, 1 << 19), (3, 20, 1), (0, 5, 1 << 19)])
def test_trie_against_sets_of_beginnings(spark, monkeypatch, limit, shard, heavy):
    monkeypatch.setattr(tries, "LEAST_LIMIT", limit)
    monkeypatch.setattr(tries, "SHARD_NODES", shard)
    monkeypatch.setattr(tries, "HEAVY_NODES", heavy if limit != 3 else 1 << 19)
    rows = ODD + [(c + 100, *r) for c, *r in table(1, 60, ["a", "b b", "c\tc c", "", "long text " * 30])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows) == plain(rows, tie_order(spark))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_that_holds_a_third_of_all_rows(spark):
    rows = [(20, k, "user", f"turn {k}") for k in range(1200)] + [(c, k, "user", f"{c} {k}") for c in range(100, 500) for k in range(3)] + [(21, k, "user", f"turn {k}") for k in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {(r.conv_id, r.depth): r for r in tries.conversation_trie(frame(spark, rows).repartition(6)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out[20, 700].n_convs == 2 and out[20, 1200].n_convs == 1 and out[20, 0].n_convs == 402
    assert out[20, 700].ends_sha256 == hashlib.sha256(b"21").hexdigest() and out[20, 1].saved_tokens == 700 * 2


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(tries, "END_BYTES", 50)
    rows = [(c, k, "user", f"same {k}") for c in range(0, 4000, 2) for k in range(3)]
    out = {r.depth: r for r in tries.conversation_trie(frame(spark, rows)).collect()}
    assert len(out) == 4 and out[3].n_convs == 2000 and out[1].saved_tokens == 3 * 1999 * 2
    assert out[3].ends_sha256 == hashlib.sha256(",".join(map(str, range(0, 4000, 2))).encode()).hexdigest()


def test_empty_table_and_turnless_conversations(spark):
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in tries.conversation_trie(frame(spark, [])).collect()] == [(None, 0, None, 0, 0, 1, 0, none)]
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    only = tries.conversation_trie(frame(spark, [(c, 0, "user", "gone")])).collect()
    assert [tuple(r) for r in only] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_running_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(v), int(v)) for k, v in zip(rng.choice([1, 2, 2, 2, 2, 5, 9], 3000), rng.permutation(3000), strict=True)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = tries.running(spark.createDataFrame(rows, "k long, v long, x long"), "k", [F.col("v")], ("x",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in (1, 2, 5, 9):
        own = sorted(v for k, v, _ in rows if k == key)
        assert sorted((r.v, r.n, r.x, r.last) for r in out if r.k == key) == [(v, i + 1, int(np.bitwise_xor.reduce(own[: i + 1])), i + 1 == len(own)) for i, v in enumerate(own)]


def test_louds_walks_like_the_tree():
    rng = np.random.default_rng(4)
    parent = np.array([-1 if i < 3 else int(rng.integers(-1, i)) for i in range(200)])
    rows = rng.permutation(200)
    moved = np.full(200, -1)
    moved[rows] = np.where(parent < 0, -1, rows[parent])
    trie = tries.Louds.of(moved)
    row_of = np.concatenate([[-1], trie.order])
    assert sorted(trie.order) == list(range(200)) and (row_of[trie.parents()] == moved[trie.order]).all()
    for node in range(201):
        assert sorted(row_of[c] for c in trie.children(node)) == sorted(np.flatnonzero(moved == row_of[node]))
    size = trie.sum_up(np.ones(200, np.int64))
    assert size[0] == 200 and all(size[i] == 1 + sum(size[c] for c in trie.children(i)) for i in range(1, 201))


def test_shards_hold_readable_tries(spark):
    rows = table(3, 40, ["a", "b", "c"])
    nodes = tries.conversation_trie(frame(spark, rows)).count()
    shards = tries.trie_shards(frame(spark, rows)).collect()
    assert sum(s.n_nodes for s in shards) == nodes - 1
    for s in shards:
        bits = np.unpackbits(np.frombuffer(s.louds, np.uint8))[: 2 * s.n_nodes + 1].astype(bool)
        assert bits.sum() == s.n_nodes and len(s.labels_a) == len(s.labels_b) == 8 * s.n_nodes
