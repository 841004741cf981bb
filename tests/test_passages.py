import random
import re

from pyspark.sql import functions as F

from loomlake.operators import fusion
from loomlake.plans.retrieve import retrieve


def plain(query, text):
    """All passages of the text."""
    words = lambda s: re.findall(r"[一-鿿]|[a-z0-9_]+", (s or "").lower())
    asked, found = set(words(query)), words(text)
    held = asked & set(found)
    widths = [e - s for s in range(len(found)) for e in range(s + 1, len(found) + 1) if held <= set(found[s:e])] if held else [0]
    return len(asked), len(held), min(widths)


def test_smallest_windows_against_all_passages(spark):
    rng = random.Random(3)
    vocab = ["aa", "bb", "Cc", "dd", "ee", "中", "文", "f_1"]
    make = lambda most: rng.choice([" ", "; ", "\n"]).join(rng.choice(vocab) for _ in range(rng.randint(0, most)))
    rows = [(i, make(5), make(25)) for i in range(400)] + [(400, None, "aa"), (401, "aa", None), (402, "", ""), (403, "aa aa bb", "xx yy"), (404, "bb aa", "aa bb"), (405, "!!", "??")]
    docs = spark.createDataFrame(rows, "i long, q string, t string")
    got = {r.i: (r.n_query, r.n_terms, r.width) for r in docs.select("i", fusion.smallest_window(F.col("q"), F.col("t")).alias("w")).select("i", "w.*").collect()}
    assert got == {i: plain(q, t) for i, q, t in rows}
    assert docs.limit(0).select(fusion.passage_score(F.col("q"), F.col("t"))).count() == 0


def test_a_very_long_text(spark):
    long = spark.range(1).select(F.concat(F.repeat(F.lit("aa xx xx xx bb "), 30_000), F.lit("bb aa"), F.repeat(F.lit(" yy"), 30_000)).alias("t"))
    assert long.select(fusion.smallest_window(F.lit("aa bb cc"), F.col("t")).alias("w")).select("w.*").first() == (3, 2, 2)


def test_close_terms_come_first(spark):
    far = "solar " + "filler " * 40 + "panel"
    chunks = spark.createDataFrame([(0, far, "a", "h", ""), (1, "the solar panel " + "filler " * 39, "b", "h", ""), (2, "panel of " + "filler " * 39, "c", "h", "")], "chunk long, page_content string, source string, heading string, chapter string")
    asked = spark.createDataFrame([(1, "solar panel")], "query_id long, query string")
    hits = retrieve(chunks, asked, relevance=fusion.passage_score).orderBy("rank").collect()
    assert [r.chunk for r in hits] == [1, 0, 2] and abs(hits[0].relevance - 2.0) < 1e-9
