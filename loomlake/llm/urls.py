"""URL filters: rules on hosts and paths, and a character language-model ratio for what no rule decides.

Two variable-order Markov models of characters are counted from the URLs that the rules allow and block. A context of
ORDER characters is interpolated with shorter ones (Witten-Bell), down to equal chances. A URL without a rule is allowed
if the difference of its log-likelihoods, a character, reaches a threshold, which is calibrated on URLs held out from the
counts. Runs of digits count as one character, since numbers of pages say nothing.

A character and the ORDER ones before it are one number, the gram; its last bytes are the grams of the lower orders. All
counts are exact and kept in tables, which grow with the different grams of the input: each order's counts are sums of the
next one's, and joins of these tables give each gram the difference of its log-probabilities. The URLs then only look up
their grams: in sorted arrays that are sent to the workers while there are MODEL_GRAMS of them at most, and by a join
beyond that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import slices, written

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 5
#: Different grams that are sent to the workers at most, of 16 bytes each.
MODEL_GRAMS = 2_000_000
#: One URL in HELD of those with a rule calibrates the threshold and is not counted.
HELD = 5
BINS, SPAN = 4000, 20.0
#: Digits of a score; sums of the same numbers in another order do not change it.
DIGITS = 9

_DIGITS = re.compile(r"[0-9]+")


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ?, # or the end); empty without ://."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: len(r[0])):
        own, cut, rest = name.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(cut + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams_of(text: str) -> np.ndarray:
    """The grams of a text, a number for each of its UTF-8 bytes and for its end (2); before it stand ORDER starts (1)."""
    c = np.frombuffer(b"\x01" * ORDER + _DIGITS.sub("0", text).encode() + b"\x02", np.uint8).astype(np.int64)
    n = len(c) - ORDER
    out = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | c[k : k + n]
    return out


def _counted(urls: DataFrame) -> DataFrame:
    """(gram, a, b): how often each gram of urls (text, allow: null where it only is looked up) is allowed and blocked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [grams_of(t) for t in batch.column("text").to_pylist()]
            allow = np.repeat([-1 if x is None else int(x) for x in batch.column("allow").to_pylist()], [len(x) for x in found])
            grams, at = np.unique(np.concatenate(found), return_inverse=True)
            sums = [np.bincount(at[allow == x], minlength=len(grams)) for x in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(grams), *[pa.array(x.astype(np.int64)) for x in sums]], names=["gram", "a", "b"])

    return urls.mapInArrow(count, "gram long, a long, b long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def model(counts: DataFrame) -> DataFrame:
    """(gram, lp): the log-probability of each gram's last character among the allowed URLs, less that among the blocked ones.

    counts: (gram, a, b). From order 0 up, p = (n(gram) + t * p of the next lower order) / (n(context) + t), where t is the
    number of different characters after the context, and p of the lower order where the context does not occur.
    """
    # the counts of an order are sums of the next higher one's
    tables = [counts]
    for k in range(ORDER - 1, -1, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")
        tables.append(written(tables[-1].groupBy(tail).agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "grams"))
    lower = None
    for k, table in enumerate(reversed(tables)):
        rows = table.withColumn("context", F.shiftright("gram", 8))
        seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
        contexts = rows.groupBy("context").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), seen("a").alias("ta"), seen("b").alias("tb"))
        rows = rows.join(contexts, "context")
        if k:
            rows = rows.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(lower, "tail")
        else:
            rows = rows.withColumns({"pa": F.lit(1 / 256), "pb": F.lit(1 / 256)})
        p = lambda x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"p{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"p{x}"))  # noqa: B023, E731
        lower = written(rows.select(F.col("gram").alias("tail"), p("a").alias("pa"), p("b").alias("pb")), "chances")
    floor = F.lit(1e-12)
    return lower.select(F.col("tail").alias("gram"), (F.log(F.greatest("pa", floor)) - F.log(F.greatest("pb", floor))).alias("lp"))


def _scored(rows: DataFrame, lps: DataFrame, n_grams: int) -> DataFrame:
    """rows with the score of their text: the mean difference of log-probabilities of its grams."""
    if n_grams <= MODEL_GRAMS:
        table = lps.orderBy("gram").toArrow()
        sent = rows.sparkSession.sparkContext.broadcast((table.column("gram").to_numpy(), table.column("lp").to_numpy()))

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known, values = sent.value
            for texts in slices(batches):
                found = [grams_of(t) for t in texts.to_pylist()]
                sizes = np.array([len(x) for x in found])
                own = values[np.searchsorted(known, np.concatenate(found))]
                yield pa.array(np.add.reduceat(own, np.r_[0, np.cumsum(sizes)[:-1]]) / sizes)

        return rows.withColumn("score", F.round(F.arrow_udf(score, "double")("text"), DIGITS))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [grams_of(t) for t in texts]
            sizes = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(np.repeat(np.arange(len(texts)), sizes))), pa.array(np.concatenate(found))], names=["text", "gram"])

    # texts that many rows have are scored once; what repeats in a text is counted before it is shuffled
    grams = rows.select("text").distinct().mapInArrow(explode, "text string, gram long").groupBy("text", "gram").agg(F.count("*").alias("n"))
    scores = grams.join(lps, "gram").groupBy("text").agg(F.round(F.sum(F.col("n") * F.col("lp")) / F.sum("n"), DIGITS).alias("score"))
    return rows.join(scores, "text")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of pages.

    A null URL, or one without ://, has an empty host and path and is judged by the models like others. Repeated rows get
    the same row each. Where the rules allow none or block none, all that has no rule is allowed. Other columns are not
    read. An empty table gives an empty one.
    """
    host, path = host_path(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "text": F.concat("host", "path")})
    held = F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0
    counts = written(_counted(rows.select("text", F.when(~held, F.col("by_rule") == "allow").alias("allow"))), "grams")
    lps = written(model(counts), "model")
    scored = lambda df: _scored(df, lps, counts.count())
    binned = F.floor((F.col("score") + SPAN / 2) / SPAN * BINS).cast("int")
    known = rows.where(held & F.col("by_rule").isNotNull()).select("text", (F.col("by_rule") == "allow").alias("allow"))
    # at most two rows for each of BINS bins
    hist = scored(known).groupBy(binned.alias("bin"), "allow").agg(F.count("*").alias("n")).collect()
    threshold = _threshold({(r.bin, r.allow): r.n for r in hist}) * SPAN / BINS - SPAN / 2
    judged = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return scored(rows).select("page_id", "host", "path", "rule", F.coalesce("by_rule", judged).alias("verdict"), "score")


def _threshold(hist: dict[tuple[int, bool], int]) -> int:
    """The first bin to allow: the two kinds of error, as shares of their class, have the least sum there.

    Between two bins that hold URLs the errors are the same, and the middle is taken.
    """
    good, bad = (sum(n for (_, x), n in hist.items() if x is kind) for kind in (True, False))
    if not good or not bad:
        return -BINS
    bins = sorted({b for b, _ in hist})
    best, least, lost, passed = bins[0], 1.0, 0, bad
    for b, after in zip(bins, [*bins[1:], bins[-1] + 1]):
        lost, passed = lost + hist.get((b, True), 0), passed - hist.get((b, False), 0)
        if lost / good + passed / bad < least:
            best, least = (b + 1 + after) // 2, lost / good + passed / bad
    return best
