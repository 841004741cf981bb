"""Term dictionaries of sources, and queries rewritten with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.text import CHINESE, tokens
from loomlake.operators.bm25 import Tokenize

TOP_TERMS, MIN_LEN, MAX_LEN = 60, 2, 6
MAX_EXPAND = 3

# Words that are no terms, and words of a query that are not expanded.
TERM_STOPWORDS = (
    "一个 我们 你们 他们 她们 它们 这个 那个 这些 那些 什么 怎么 如何 为什么 可以 进行 相关 以及 或者 没有 不是 就是 自己 目前 需要 如果 因为 所以 "
    "通过 对于 关于 由于 其中 同时 但是 然后 之后 已经 将会 可能 应该 主要 重要 一般 非常"
).split()
QUERY_STOPWORDS = "什么 怎么 如何 为什么 可以 进行 相关 以及 没有 不是 就是 自己 目前 需要 如果 因为 所以 通过 对于 关于 其中 同时 已经 将会 可能 应该 主要 重要 一般 非常 的 了 在".split()


def is_term(term: str | Column, script: str | None = CHINESE) -> Column:
    c = F.col(term) if isinstance(term, str) else term
    fits = F.length(c).between(MIN_LEN, MAX_LEN) & ~c.isin(TERM_STOPWORDS)
    return fits & c.rlike(script) if script else fits


def source_terms(docs: DataFrame, top: int = TOP_TERMS, script: str | None = CHINESE, tokenize: Tokenize = tokens) -> DataFrame:
    """(source, term, n, term_rank): the most frequent terms of each source; ties in order of the term.

    Counts are summed up in each task before they are shuffled, so a source with a third of all documents is no burden.
    """
    words = docs.select("source", F.explode(tokenize("text")).alias("term")).where(is_term("term", script))
    counts = words.groupBy("source", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "term")
    return counts.withColumn("term_rank", F.row_number().over(order)).where(F.col("term_rank") <= top)


def all_terms(terms: DataFrame) -> DataFrame:
    """(term, dict_pos): the terms of all sources, each once, in order of source_seq and rank. terms: with source_seq."""
    first = terms.groupBy("term").agg(F.min(F.struct("source_seq", "term_rank")).alias("at"))
    # at most TOP_TERMS for each source
    return first.select("term", F.row_number().over(Window.orderBy("at", "term")).alias("dict_pos"))


def rewrite(queries: DataFrame, dictionary: DataFrame, tokenize: Tokenize = tokens) -> DataFrame:
    """(query_id, query, rewritten): terms that contain a token of the query are appended, three a token at most.

    dictionary: (term, dict_pos). A token that is a stopword, shorter than two characters or a term itself is not
    expanded, nor is a term appended that the query holds already. Terms are short, so a token inside a term is found by an
    equal join on the parts of terms, not by comparing all with all.
    """
    words = queries.select("query_id", F.col("query"), F.posexplode(tokenize("query")).alias("qpos", "token"))
    words = words.where((F.length("token") >= 2) & ~F.col("token").isin(QUERY_STOPWORDS)).join(dictionary.select(F.col("term").alias("token")), "token", "left_anti")
    n = F.length("term")
    ends = lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.col("term").substr(i, j - i + 1))
    parts = dictionary.where(n >= 2).select("term", "dict_pos", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), ends)))).alias("token"))
    hits = words.join(parts, "token").where(~F.contains("query", "term"))
    order = Window.partitionBy("query_id", "qpos").orderBy("dict_pos")
    hits = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MAX_EXPAND)
    added = hits.groupBy("query_id", "term").agg(F.min(F.struct("qpos", "nth")).alias("at"))
    texts = added.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x.term), " ").alias("more"))
    return queries.join(texts, "query_id", "left").select("query_id", "query", F.concat_ws(" ", "query", "more").alias("rewritten"))
