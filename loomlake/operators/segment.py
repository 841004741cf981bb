"""Chinese words: a dictionary that is fitted on the texts themselves, and the most likely cut of a run of characters.

A candidate is a run of up to LONGEST characters. It is a word if it occurs often, if its parts keep together (its count is
high against what the counts of its two parts would give, however it is parted), and if its neighbours on both sides vary.
All of that follows from one table of counts: the neighbours of a word of n characters are the runs of n + 1 characters.

A run is a lattice of dictionary words over its places; the best path has the greatest sum of weights. Weights are whole
numbers (millionths of the logarithm of a word's share), so that sums have no rounding and the cut is the same everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import grams
from loomlake.operators.lattice import Lattice
from loomlake.plans.staging import staged

RUN = "[一-鿿]+"
#: Characters of a word at most, occurrences of one at least, and words of a dictionary at most (the most frequent ones).
LONGEST, MIN_COUNT, MAX_WORDS = 6, 5, 1 << 18
#: Least logarithm of a word's count against that of its parts, and least entropy of its neighbours on each side.
COHESION, FREEDOM = 2.5, 0.7

WORDS = "word string, n long, weight long"


def run_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(run, n): the different runs of Chinese characters, and how often each stands in docs; null texts have none."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    return runs.groupBy("run").agg(F.count("*").alias("n"))


def gram_counts(runs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(gram, n): the parts of up to longest + 1 characters of runs (run, n); one more than words have, for their neighbours."""
    return grams.counts(runs, "run", longest + 1, "n")


def text_gram_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """The same of the runs of docs, without those that decide nothing on words of min_count: of two characters or more, found
    once. Computed once and written, as word_statistics reads them again and again."""
    return staged(grams.counts(docs, text_col, longest + 1, least=min(2, min_count)))


def word_statistics(counts: DataFrame, total: int, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(word, n, cohesion, left_freedom, right_freedom) of the candidates of two characters or more, of six digits.

    counts: (gram, n); total: how many characters there are. At the end of a run every neighbour counts as a different one.
    """
    often = counts.where((F.length("gram") >= 2) & (F.length("gram") <= longest) & (F.col("n") >= min_count)).withColumnsRenamed({"gram": "word"})
    parts = often.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    parts = parts.select("word", F.substr("word", F.lit(1), F.col("k")).alias("a"), F.substr("word", F.col("k") + 1).alias("b"))
    # a part is found as often as its word at least
    known = counts.where(F.col("n") >= min_count)
    both = parts.join(known.select(F.col("gram").alias("a"), F.col("n").alias("n_a")), "a").join(known.select(F.col("gram").alias("b"), F.col("n").alias("n_b")), "b")
    apart = both.groupBy("word").agg(F.max(F.col("n_a").cast("double") * F.col("n_b")).alias("apart"))
    longer = counts.where((F.length("gram") >= 3) & (F.col("n") >= 2))  # n log n is 0 of others
    spread = F.sum(F.col("n") * F.log("n"))
    right = longer.groupBy(F.expr("left(gram, length(gram) - 1)").alias("word")).agg(spread.alias("right"))
    left = longer.groupBy(F.expr("right(gram, length(gram) - 1)").alias("word")).agg(spread.alias("left"))
    rows = often.join(apart, "word").join(right, "word", "left").join(left, "word", "left")
    freedom = lambda c: F.round(F.log("n") - F.coalesce(c, F.lit(0.0)) / F.col("n"), 6) + 0.0
    cohesion = F.round(F.log(F.col("n") * F.lit(float(total)) / F.col("apart")), 6)
    return rows.select("word", "n", cohesion.alias("cohesion"), freedom("left").alias("left_freedom"), freedom("right").alias("right_freedom"))


def weighted(words: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(word, n, weight) of words (word, n): the max_words most frequent ones, ties in order of the word."""
    kept = words.orderBy(F.desc("n"), "word").limit(max_words)
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    weight = F.round(F.log(F.col("n") / F.col("total")) * 1_000_000).cast("long")
    return kept.crossJoin(total).select("word", "n", weight.alias("weight"))  # one row


def fit_words(docs: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT, cohesion: float = COHESION, freedom: float = FREEDOM, longest: int = LONGEST, max_words: int = MAX_WORDS) -> DataFrame:
    """(word, n, weight): the dictionary of docs; all single characters are words too. Without Chinese text it is empty."""
    counts = text_gram_counts(docs, text_col, longest, min_count)
    single = counts.where(F.length("gram") == 1)
    total = single.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = word_statistics(counts, total, min_count, longest).where((F.col("cohesion") >= cohesion) & (F.least("left_freedom", "right_freedom") >= freedom))
    return weighted(found.select("word", "n").unionByName(single.select(F.col("gram").alias("word"), "n")), max_words)


def recount(docs: DataFrame, words: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """The dictionary again, with each word's count on the best paths of docs: what only stands inside other words goes.

    Single characters stay, at a count of one if no path takes them.
    """
    cut = segmenter(words)
    taken = docs.select(F.explode(cut(text_col)).alias("word")).where(F.col("word").rlike(f"^{RUN}$")).groupBy("word").agg(F.count("*").alias("n"))
    kept = words.select("word").join(taken, "word", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return weighted(kept.where((F.col("n") >= min_count) | (F.length("word") == 1)), max_words)


def best_path(run: str, weights: dict[str, int], longest: int, unknown: int) -> list[str]:
    """The words of the best path over a run. A character that is no word weighs `unknown`; of equal paths to a place, the one
    with the longer last word is taken."""
    best, step = [0], [0]
    for end in range(1, len(run) + 1):
        options = []
        for n in range(1, min(longest, end) + 1):
            w = weights.get(run[end - n : end], unknown if n == 1 else None)
            if w is not None:
                options.append((best[end - n] + w, n))
        score, n = max(options)
        best.append(score)
        step.append(n)
    words, at = [], len(run)
    while at:
        words.append(run[at - step[at] : at])
        at -= step[at]
    return words[::-1]


def segmenter(words: DataFrame) -> Callable[[str | Column], Column]:
    """A column function like `functions.text.tokens` that cuts Chinese into the words of a dictionary (word, weight).

    Other text keeps its case, and visible characters that are neither letters, digits nor Chinese are tokens of their own.
    Null texts have no tokens. The dictionary passes the driver: it has MAX_WORDS rows at most, and more are refused.
    """
    spark: SparkSession = words.sparkSession
    rows = words.select("word", "weight").limit(MAX_WORDS + 1).toArrow()
    if rows.num_rows > MAX_WORDS:
        raise ValueError(f"a dictionary may have {MAX_WORDS} words at most")
    weights = dict(zip(rows.column("word").to_pylist(), rows.column("weight").to_pylist(), strict=True))
    longest = max(map(len, weights), default=1)
    unknown = min(weights.values(), default=0) - 1_000_000
    sent = spark.sparkContext.broadcast(Lattice(weights, longest, unknown))

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield sent.value.tokens(texts.to_pylist())

    return lambda text: F.arrow_udf(cut, "array<string>")((F.col(text) if isinstance(text, str) else text).cast("string"))
