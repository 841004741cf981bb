import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.llm import fingerprints as fp

DOCS = "doc_id long, text string, hash string, place string, n_chars string, part string, fingerprint string"
WORDS = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("n", "r", "s", "", "lt")]
rng = np.random.default_rng(5)


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], DOCS)


def plain_print(text):
    """The definition, by sorting all pairs anew for each order."""
    h = fp.kmers(text).tolist()
    seen, numbered = Counter(), []
    for k in h:
        numbered.append((k + seen[k] * int(fp._ODD[0])) % (1 << 64))
        seen[k] += 1
    values = fp._mixed(np.array(numbered, np.uint64))
    out = b""
    for salt, begins in zip(fp._SALT, fp._BEGIN, strict=True):
        circle = (fp._mixed(values ^ salt) >> np.uint64(32)).tolist()
        for begin in begins.tolist():
            least = sorted(range(len(h)), key=lambda i: ((circle[i] - (begin >> 32)) % (1 << 32), i))[: fp.LEAST]
            entry = np.array([h[i] for i in sorted(least)], np.uint64)
            e = entry[:1]
            for k in range(1, len(entry)):
                e = fp._mixed(e * fp._ODD[0]) + entry[k : k + 1]
            out += (fp._mixed(e) >> np.uint64(48)).astype("<u2").tobytes()
    return out if h else b""


@pytest.mark.parametrize("text", ["", "a", "1234567", "12345678", "123456789", "ababababababababababab", "é中🙂" * 9, prose(300, 1)])
def test_fingerprint_is_the_definition(text):
    assert fp.fingerprint(text) == plain_print(text)
    assert len(fp.fingerprint(text)) == (2 * fp.REPEATS if text else 0)


def test_occurrences_also_in_parts(monkeypatch):
    h = rng.integers(0, 40, 500).astype(np.uint64) << np.uint64(40)
    seen, want = Counter(), []
    for k in h.tolist():
        want.append(seen[k])
        seen[k] += 1
    assert fp.occurrences(h).tolist() == want
    monkeypatch.setattr(fp, "MANY", 64)
    assert fp.occurrences(h).tolist() == want


def test_likeness_follows_edits_and_order():
    near, moved, far = [], [], []
    for seed in range(30):
        text = prose(200, seed)
        words = text.split()
        own = fp.fingerprint(text)
        edited = " ".join([*words[:100], "changed", *words[101:]])
        half = " ".join([*words[100:], *words[:100]])
        blocks = [words[k : k + 10] for k in range(0, 200, 10)]
        shuffled = " ".join(w for b in np.random.default_rng(seed).permutation(20) for w in blocks[b])
        near.append(fp.likeness_of(own, fp.fingerprint(edited)))
        moved.append(fp.likeness_of(own, fp.fingerprint(half)))
        far.append(fp.likeness_of(own, fp.fingerprint(shuffled)))
    assert np.mean(near) > 0.9 and 0.3 < np.mean(moved) < 0.65 and 0.2 < np.mean(far) < 0.55  # moved passages count, unlike in a plain MinHash
    assert np.mean([fp.likeness_of(fp.fingerprint(prose(200, s)), fp.fingerprint(prose(200, s + 100))) for s in range(30)]) < 0.05


ODD = [(5, None), (None, "no id, and a text of some length"), (None, ""), (1, "a"), (1, "a"), (1, "b" * 50), (2, prose(60, 1)), (3, prose(60, 2)), (3, prose(60, 2)), (9, prose(20000, 3)), (7, "é中🙂 ok"), (8, "\n")]


def plain_report(spark, rows):
    hashes = [r.h for r in spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k long, t string").select("k", F.xxhash64("t").alias("h")).orderBy("k").collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, hashes[k]))
    out = []
    for at, k in enumerate(order):
        text, after = (rows[order[i % len(order)]][1] or "" for i in (at, at + 1))
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = plain_print(text), plain_print(edited), plain_print(after)
        near = lambda x, y: float(x == y) if not x or not y else sum(x[i : i + 2] == y[i : i + 2] for i in range(0, len(x), 2)) / fp.REPEATS
        out.append((rows[k][0], len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), near(a, b), near(a, c)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 5])
def test_report_against_a_plain_walk(spark, monkeypatch, parts):
    rows = ODD[:9] + ODD[10:] + [(100 + k, prose(int(rng.integers(1, 80)), 50 + k)) for k in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fp.edit_report(frame(spark, rows).repartition(parts)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(repr(tuple(r)) for r in got) == plain_report(spark, rows)


def test_report_of_odd_tables(spark):
    assert fp.edit_report(frame(spark, [])).collect() == []
    one = fp.edit_report(frame(spark, [(4, "only one document, followed by itself")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    long = {r.doc_id: r for r in fp.edit_report(frame(spark, ODD)).collect()}[9]
    assert long.n_chars == len(ODD[9][1]) and long.fingerprint == fp.fingerprint(ODD[9][1]).hex()
    many = [(7, f"the same id with text {k}") for k in range(500)] + [(7, "equal rows")] * 500
    assert fp.edit_report(frame(spark, many)).count() == 1000


def test_column_of_likeness_and_fingerprints(spark):
    texts = ["", prose(50, 1), prose(50, 1) + " more words", prose(50, 2)]
    rows = fp.order_minhash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    pairs = rows.crossJoin(rows.toDF("other", "print")).withColumn("near", fp.likeness("fingerprint", "print"))
    for r in pairs.collect():
        assert r.near == fp.likeness_of(bytes.fromhex(r.fingerprint), bytes.fromhex(r.print))
