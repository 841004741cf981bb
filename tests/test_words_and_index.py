"""Words of Chinese texts, the stored index that is kept up to date, and what searches do without it."""

import itertools
import math
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlake.functions import text as X
from loomlake.operators import bm25, segment, terms
from loomlake.operators.pruned import BlockIndex
from loomlake.plans import snapshots
from loomlake.plans.knowledge_base import KnowledgeBase
from loomlake.plans.snapshots import Snapshots

WORDS = "学习 成绩 学习成绩 课程 老师 学生 考试 表现 优秀 图书馆 计算机 网络 安全 管理 办法 规定 申请 材料 奖学金 评定".split()
FILLER = "的 了 在 和 与 对 把 被 由 从".split()


def chinese(seed, sentences=60):
    rng = random.Random(seed)
    return "。".join("".join(rng.choice(WORDS) + (rng.choice(FILLER) if rng.random() < 0.6 else "") for _ in range(rng.randint(3, 8))) for _ in range(sentences))


def every_path(run, weights, longest, unknown):
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        words, start = [], 0
        for i, cut in enumerate([*cuts, True], 1):
            if cut:
                words.append(run[start:i])
                start = i
        known = [weights.get(w, unknown if len(w) == 1 else None) for w in words]
        if None not in known:
            yield sum(known), words


def test_best_path_against_all_paths():
    rng = random.Random(3)
    for _ in range(300):
        letters = "天地玄黄宇"
        weights = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): -rng.randint(1, 6) for _ in range(rng.randint(0, 12))}
        longest = max(map(len, weights), default=1)
        run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        found = segment.best_path(run, weights, longest, -7)
        paths = list(every_path(run, weights, longest, -7))
        # of the best ones, the longest last word, then the longest before it, and so on
        best = max(paths, key=lambda p: (p[0], [len(w) for w in reversed(p[1])]))
        assert (sum(weights.get(w, -7) for w in found), found) == best


def test_statistics_of_words_against_counting(spark):
    texts = [chinese(1, 8), "成绩，" + chinese(2, 5), "", None, "no chinese"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = segment.gram_counts(segment.run_counts(docs), 3)
    runs = [r for t in texts for r in __import__("re").findall("[一-鿿]+", t or "")]
    grams = Counter(r[i : i + k] for r in runs for k in range(1, 5) for i in range(len(r) - k + 1))
    assert {r.gram: r.n for r in counts.collect()} == grams
    total = sum(map(len, runs))
    got = {r.word: (r.n, r.cohesion, r.left_freedom, r.right_freedom) for r in segment.word_statistics(counts, total, 3, 3).collect()}
    assert set(got) == {g for g, n in grams.items() if n >= 3 and 2 <= len(g) <= 3}

    def freedom(word, side):
        at = Counter()
        for k, r in enumerate(runs):
            for i in range(len(r) - len(word) + 1):
                if r[i : i + len(word)] == word:
                    j = i - 1 if side == "left" else i + len(word)
                    at[r[j] if 0 <= j < len(r) else (k, i)] += 1
        n = sum(at.values())
        return sum(-c / n * math.log(c / n) for c in at.values())

    for word, (n, cohesion, left, right) in got.items():
        apart = max(grams[word[:k]] * grams[word[k:]] for k in range(1, len(word)))
        assert cohesion == pytest.approx(math.log(n * total / apart), abs=1e-6)
        assert left == pytest.approx(freedom(word, "left"), abs=2e-6) and right == pytest.approx(freedom(word, "right"), abs=2e-6)


def test_fitted_words_are_those_that_were_written(spark):
    docs = spark.createDataFrame([(chinese(k),) for k in range(20)], "text string")
    words = segment.fit_words(docs)
    known = {r.word for r in words.collect()}
    assert set(WORDS) <= known and len([w for w in known if len(w) > 1 and w not in WORDS]) < 40
    cut = segment.segmenter(words)
    row = spark.createDataFrame([("学生申请奖学金，GPA_3.5 x！",), (None,), ("",)], "text string").select(cut("text").alias("t")).collect()
    assert [r.t for r in row] == [["学生", "申请", "奖学金", "，", "GPA_3", ".", "5", "x", "！"], [], []]
    again = {r.word: r.n for r in segment.recount(docs, words).collect()}
    assert set(again) <= known and set(WORDS) <= set(again)


def test_no_chinese_gives_no_words(spark):
    docs = spark.createDataFrame([("plain text",), (None,)], "text string")
    words = segment.fit_words(docs)
    assert words.count() == 0
    assert docs.select(segment.segmenter(words)("text").alias("t")).first().t == ["plain", "text"]
    empty = docs.where("false")
    assert segment.fit_words(empty).count() == 0


def write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)


def agrees(kb, asked):
    """The stored index gives what one that is built anew gives."""
    fresh = bm25.build_index(kb.chunks(), "chunk", "page_content", kb.tokenize())
    key = lambda rows: sorted(map(repr, map(tuple, rows.collect())))
    stored = kb.index()
    assert key(stored.postings) == key(fresh.postings)
    assert key(stored.term_stats.select("term", "df", F.round("idf", 9))) == key(fresh.term_stats.select("term", "df", F.round("idf", 9)))
    assert key(stored.corpus_stats.select("n", F.round("avgdl", 9))) == key(fresh.corpus_stats.select("n", F.round("avgdl", 9)))
    cut = kb.tokenize()
    assert key(bm25.bm25_top(kb.index(asked), asked, 5, tokenize=cut)) == key(bm25.bm25_top(fresh, asked, 5, tokenize=cut))


@pytest.mark.parametrize("segmented", [False, True])
def test_index_after_any_series_equals_one_built_anew(spark, tmp_path, monkeypatch, segmented):
    monkeypatch.setattr(snapshots, "FAN_IN", 3)
    kb, src = KnowledgeBase(spark, str(tmp_path / "kb"), segmented=segmented), tmp_path / "in"
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "成绩管理"), (3, "")], "query_id long, text string")
    write(src, "a.txt", "alpha beta beta")
    write(src, "b.txt", "alpha gamma")
    kb.upload(str(src))
    write(src, "a.txt", "beta only")  # replaced
    write(src, "c.txt", chinese(5, 30))  # the first Chinese text
    kb.upload(str(src))
    agrees(kb, asked)
    kb.delete("b.txt")
    write(src, "c.txt", chinese(6, 30) + "\n\nalpha")
    kb.upload(str(src))
    agrees(kb, asked)
    levels = Counter((n, level) for n, level, _ in kb.store.parts())
    assert max(level for _, level in levels) >= 1 and all(k < 3 for (n, _), k in levels.items() if n != "words")
    kb.refit()
    kb.compact()
    agrees(kb, asked)
    assert len([p for p in kb.store.parts() if p[0] == "chunks"]) == 1 and kb.store.vacuum() > 0
    agrees(kb, asked)
    assert sorted(r.source for r in kb.sources().collect()) == ["a.txt", "c.txt"]


def test_chinese_upload_gives_terms_and_a_rewritten_question(spark, tmp_path):
    kb, src = KnowledgeBase(spark, str(tmp_path / "kb")), tmp_path / "in"
    for k in range(3):
        write(src, f"f{k}.txt", chinese(k, 50))
    kb.upload(str(src))
    found = {r.term for r in kb.dictionary().collect()}
    assert {"奖学金", "图书馆", "学生"} <= found and all(2 <= len(t) <= 6 for t in found)
    asked = spark.createDataFrame([(1, "图书怎么申请")], "query_id long, query string")
    words = kb._table("words")
    cut = segment.segmenter(words.unionByName(spark.createDataFrame([("图书", 1, -1)], segment.WORDS)))
    assert terms.rewrite(asked, kb.dictionary(), cut).first().rewritten == "图书怎么申请 图书馆"
    assert terms.rewrite(asked, kb.dictionary(), X.tokens).first().rewritten == "图书怎么申请"  # single characters are not expanded
    hits = kb.search(spark.createDataFrame([(1, "奖学金评定")], "query_id long, query string")).collect()
    assert 1 <= len(hits) <= 3


def test_search_without_an_index(spark, tmp_path):
    kb, src = KnowledgeBase(spark, str(tmp_path / "kb")), tmp_path / "in"
    for k, text in enumerate(["alpha beta", "beta gamma", "delta"]):
        write(src, f"f{k}.txt", text)
    kb.upload(str(src))
    asked = spark.createDataFrame([(1, "gamma")], "query_id long, query string")
    best = lambda: [(r.source, r["rank"]) for r in kb.search(asked, rewrite=False, top_k=1).collect()]
    assert best() == [("f1.txt", 1)]
    part = tmp_path / "kb" / next(p for n, _, p in kb.store.parts() if n == "postings")
    shutil.move(part, tmp_path / "postings")
    with pytest.warns(UserWarning, match="stored index fails"):  # missing files
        assert best() == [("f1.txt", 1)]
    part.mkdir()
    (part / "x.parquet").write_text("broken")
    with pytest.warns(UserWarning, match="stored index fails"):
        assert best() == [("f1.txt", 1)]
    version = kb.store.version()
    kb.store.commit([p for p in kb.store.parts() if p[0] != "term_counts"], version)
    with pytest.warns(UserWarning, match="no parts"):
        assert best() == [("f1.txt", 1)]
    with pytest.MonkeyPatch.context() as m:  # and vectors alone
        m.setattr(bm25, "index_for", lambda *_: spark.read.parquet(str(tmp_path / "nothing")))
        with pytest.warns(UserWarning, match="rebuilt index fails"):
            assert best() == [("f1.txt", 1)]
    kb.rebuild_index()
    agrees(kb, asked.withColumnRenamed("query", "text"))


def test_two_writers_after_one_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    part = store.write("t", spark.range(3))
    assert store.commit([part], 0) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit([part], 0)
    assert store.read("t", "id long").count() == 3 and store.read("other", "id long").count() == 0
    assert store.commit([], 1) == 2 and store.parts() == [] and store.parts(1) == [part]


def test_pruned_top_equals_all_and_skips_blocks(spark, tmp_path):
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(1, 60)) + rng.choices(rare, k=rng.randint(0, 3)))) for i in range(6000)] + [(7000, None), (7001, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = [(1, "c1 c2 r5 r6"), (2, "r7"), (3, "c3"), (4, "unknown"), (5, ""), (6, "c1 c2 c3 c4 c5 r1 r2 r3"), (7, "r8 r8 c1"), (8, None)]
    asked = spark.createDataFrame(asked, "query_id long, text string")
    index = BlockIndex(spark, str(tmp_path / "blocks"))
    index.build(docs)
    plain = bm25.build_index(docs)
    key = lambda rows: sorted(map(repr, map(tuple, rows.collect())))
    for k in (1, 10, 200):
        assert key(index.top(asked, k)) == key(bm25.bm25_top(plain, asked, k))
    read = {r.query_id: (r.blocks_read / r.blocks, r.postings_read / r.postings) for r in index.report(asked, 3).collect()}
    assert set(read) == {1, 2, 3, 6, 7} and read[2] == (1.0, 1.0)
    assert read[1][1] < 0.2 and read[7][1] < 0.2 and read[6][1] < 0.6
    index.build(docs.where("false"))
    assert index.top(asked).collect() == []
