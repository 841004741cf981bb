"""BM25: an inverted index as tables, and ranked hits for a batch of queries.

Joins carry no hints: the side of the queries is sent to all tasks only while its measured size stays under Spark's limit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions.text import tokens

K1, B = 1.5, 0.75
#: Turns a text into its tokens: `functions.text.tokens`, or what `segment.segmenter` gives.
Tokenize = Callable[[str | Column], Column]


@dataclass
class Index:
    """postings (doc, term, tf, dl), term_stats (term, df, idf) and corpus_stats (n, avgdl)."""

    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame

    def save(self, path: str) -> None:
        """Postings lie sorted by term, so that a query reads only the row groups of its terms."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.term_stats.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
        self.corpus_stats.write.mode("overwrite").parquet(f"{path}/corpus_stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "term_stats", "corpus_stats")])


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.size(tokens(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("dl"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenize: Tokenize = tokens) -> Index:
    """The index of all rows of docs; a null text has no terms and length 0, ids are taken as unique."""
    toks = tokenize(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc"), toks.alias("toks")).withColumn("dl", F.size("toks").cast("long"))
    postings = rows.select("doc", "dl", F.explode("toks").alias("term")).groupBy("doc", "term", "dl").agg(F.count("*").alias("tf")).select("doc", "term", "tf", "dl")
    corpus = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return Index(postings, term_statistics(postings, corpus), corpus)


def terms_of(queries: DataFrame, tokenize: Tokenize = tokens) -> DataFrame:
    """(query_id, term): the different terms of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))


def index_for(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenize: Tokenize = tokens) -> Index:
    """The part of the index that a batch of queries needs: postings and statistics of their terms, lengths of all docs.

    Other terms are dropped before anything is grouped or shuffled.
    """
    toks = tokenize(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc"), toks.alias("toks")).withColumn("dl", F.size("toks").cast("long"))
    wanted = terms_of(queries, tokenize).select("term").distinct()
    found = rows.select("doc", "dl", F.explode("toks").alias("term")).join(wanted, "term", "left_semi")
    postings = found.groupBy("doc", "term", "dl").agg(F.count("*").alias("tf")).select("doc", "term", "tf", "dl")
    corpus = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return Index(postings, term_statistics(postings, corpus), corpus)


def term_statistics(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf) of postings; corpus (n, avgdl) has one row, of several the first by n counts."""
    return inverse_frequencies(postings.groupBy("term").agg(F.count("*").alias("df")), corpus)


def inverse_frequencies(df: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf) of df (term, df)."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(_one_row(corpus).select("n")).select("term", "df", idf.alias("idf"))


def _one_row(corpus: DataFrame) -> DataFrame:
    return corpus.orderBy("n").limit(1)


def bm25_scores(index: Index, queries: DataFrame, k1: float = K1, b: float = B, tokenize: Tokenize = tokens) -> DataFrame:
    """(query_id, doc, score) of all documents that share a term with a query; queries: (query_id, text)."""
    hits = index.postings.join(terms_of(queries, tokenize), "term").join(index.term_stats.select("term", "idf"), "term").crossJoin(_one_row(index.corpus_stats).select("avgdl"))
    avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return hits.groupBy("query_id", "doc").agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "query_id", item: str = "doc", descending: bool = True, score: str = "score") -> DataFrame:
    """The k best of each key with their rank from 1; ties go to the smaller item."""
    order = Window.partitionBy(key).orderBy(F.desc(score) if descending else F.asc(score), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_top(index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, tokenize: Tokenize = tokens) -> DataFrame:
    return top_k(bm25_scores(index, queries, k1, b, tokenize).where("score > 0"), k)
