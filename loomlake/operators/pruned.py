"""BM25 top k over postings in blocks, of which those are skipped that cannot change the result.

Documents are dealt to ranges of about RANGE_DOCS by their length: lengths of a geometric class lie together, and a class is
split by a hash of the document. A block holds the postings of one term in one range, with the greatest tf and the least
length among them. These bound the score of every document of the range, whatever the statistics of the corpus become:
a term's part grows with tf and falls with the length.

For each query the rarest terms, with FIRST of its postings at most, are scored; the k-th best score so far is a limit. Terms
whose bounds together stay below it are weak: a document with weak terms alone is out. So only the blocks of the other, mostly rare terms
are read, in ranges whose bound reaches the limit; and of the weak terms only blocks in ranges of documents that could still
reach the k-th best score by then. No other document can be among the best k, so the result is exact.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions.text import tokens
from loomlake.operators import bm25
from loomlake.operators.bm25 import K1, B, Tokenize, top_k

RANGE_DOCS, CLASS_STEP, FIRST = 64, 1.25, 0.2
#: Terms of a batch of queries up to which readers of the blocks are told them, so that they skip the row groups of others.
PUSHED_TERMS = 1000
#: Scores have six digits; a document within this much of the limit may still be among the best.
MARGIN = 2e-6
BLOCKS = "term string, class int, split long, docs array<long>, tfs array<long>, dls array<long>, n int, max_tf long, min_dl long"
RANGE = ["class", "split"]


class BlockIndex:
    """Blocks, document frequencies and corpus statistics under a path."""

    def __init__(self, spark: SparkSession, path: str, tokenize: Tokenize = tokens):
        self.spark, self.path, self.tokenize = spark, path.rstrip("/"), tokenize

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Writes the index of docs; null texts have no terms, ids are taken as unique."""
        toks = lambda c: self.tokenize(F.coalesce(F.col(c), F.lit("")))
        rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.size(toks(text_col)).cast("long").alias("dl"))
        rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).write.mode("overwrite").parquet(f"{self.path}/corpus")
        size_class = F.floor(F.log(F.greatest("dl", F.lit(1))) / F.log(F.lit(CLASS_STEP))).cast("int")
        rows = rows.where("dl > 0").withColumn("class", size_class)
        # a row for each class of lengths; there are about 100
        sizes = rows.groupBy("class").agg(F.count("*").alias("docs_of_class"))
        rows = rows.join(F.broadcast(sizes), "class")
        rows = rows.withColumn("split", F.pmod(F.xxhash64("doc"), F.ceil(F.col("docs_of_class") / RANGE_DOCS)))
        # the documents of a range meet, and their postings are made there: one shuffle, of the texts
        postings = rows.select("doc", "dl", *RANGE, "text").repartition(*RANGE).select("doc", "dl", *RANGE, F.explode(toks("text")).alias("term")).groupBy("term", *RANGE, "doc", "dl").agg(F.count("*").alias("tf"))
        entries = F.array_sort(F.collect_list(F.struct("doc", "tf", "dl"))).alias("e")
        blocks = postings.groupBy("term", *RANGE).agg(entries, F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
        lists = [F.col(f"e.{c}").alias(f"{c}s") for c in ("doc", "tf", "dl")]
        blocks = blocks.select("term", *RANGE, *lists, "n", "max_tf", "min_dl")
        # each file has its own order of terms, by which readers skip its row groups
        blocks.sortWithinPartitions("term", *RANGE).write.mode("overwrite").parquet(f"{self.path}/blocks")
        df = self.blocks().groupBy("term").agg(F.sum("n").alias("df"))
        df.orderBy("term").write.mode("overwrite").parquet(f"{self.path}/frequencies")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    def _staged(self, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def top(self, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, doc, score, rank): what `bm25.bm25_top` gives. queries: (query_id, text)."""
        return self._searched(queries, k, k1, b)[0]

    def report(self, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, blocks, blocks_read, postings, postings_read): how much of a query's terms `top` looks at."""
        _, metas, read = self._searched(queries, k, k1, b)
        rows = metas.join(read.withColumn("is_read", F.lit(1)), ["query_id", "term", *RANGE], "left").withColumn("is_read", F.coalesce("is_read", F.lit(0)))
        return rows.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("is_read").alias("blocks_read"), F.sum("n").alias("postings"), F.sum(F.col("n") * F.col("is_read")).alias("postings_read"))

    def _searched(self, queries: DataFrame, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Hits, what is known of all blocks of the queries' terms, and the blocks that are read."""
        corpus = self.spark.read.parquet(f"{self.path}/corpus")
        asked = bm25.terms_of(queries, self.tokenize)
        idf = bm25.inverse_frequencies(self.spark.read.parquet(f"{self.path}/frequencies").join(asked.select("term").distinct(), "term", "left_semi"), corpus)
        asked = self._staged(asked.join(idf.select("term", "idf"), "term").crossJoin(corpus.select("avgdl")))  # one row
        words = [r.term for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        blocks = self.blocks() if len(words) > PUSHED_TERMS else self.blocks().where(F.col("term").isin(words))
        avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
        part = lambda tf, dl: F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

        def parts(of: DataFrame) -> DataFrame:
            """(query_id, doc, class, split, part) of blocks (query_id, term, class, split)."""
            wanted = of.select("query_id", "term", *RANGE).join(asked, ["query_id", "term"])
            rows = blocks.join(wanted, ["term", *RANGE]).select("query_id", *RANGE, "idf", "avgdl", F.inline(F.arrays_zip("docs", "tfs", "dls")))
            return rows.select("query_id", F.col("docs").alias("doc"), *RANGE, part(F.col("tfs"), F.col("dls")).alias("part"))

        def scores(rows: DataFrame) -> DataFrame:
            return rows.groupBy("query_id", "doc").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")

        metas = self._staged(blocks.join(asked, "term").select("query_id", "term", *RANGE, "n", part(F.col("max_tf"), F.col("min_dl")).alias("most")))
        # a query has few terms
        rare = Window.partitionBy("query_id").orderBy("n", "term")
        by_term = metas.groupBy("query_id", "term").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
        by_term = self._staged(by_term.withColumns({"upto": F.sum("n").over(rare), "nth": F.row_number().over(rare), "total": F.sum("n").over(Window.partitionBy("query_id"))}))
        first_terms = by_term.where((F.col("upto") <= FIRST * F.col("total")) | (F.col("nth") == 1)).select("query_id", "term")
        first = metas.join(first_terms, ["query_id", "term"], "left_semi").select("query_id", "term", *RANGE)

        def limits(scored: DataFrame) -> DataFrame:
            """(query_id, limit): the k-th best of scores that are parts of the whole ones; 0 where there are fewer."""
            found = top_k(scored, k).where(F.col("rank") == k).select("query_id", (F.col("score") - MARGIN).alias("limit"))
            return self._staged(asked.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("limit", F.lit(0.0)).alias("limit")))

        limit = limits(scores(parts(first)))
        # those of the least bounds, as long as their sum stays below the limit, are weak
        rising = Window.partitionBy("query_id").orderBy("most", "term")
        weak = by_term.join(limit, "query_id").withColumn("weak", F.sum("most").over(rising) < F.col("limit")).select("query_id", "term", "weak")
        known = metas.join(weak, ["query_id", "term"])
        sums = known.groupBy("query_id", *RANGE).agg(F.sum("most").alias("bound"), F.sum(F.when(F.col("weak"), F.col("most")).otherwise(0.0)).alias("weak_bound"))
        reached = self._staged(sums.join(limit, "query_id").where("bound >= limit"))
        strong = known.where("NOT weak").join(reached, ["query_id", *RANGE], "left_semi").select("query_id", "term", *RANGE)
        partial = parts(strong).groupBy("query_id", "doc", *RANGE).agg(F.sum("part").alias("part")).join(reached.drop("limit"), ["query_id", *RANGE])
        partial = self._staged(partial)
        limit = limits(scores(partial))
        partial = self._staged(partial.join(limit, "query_id").where("part + weak_bound >= limit").select("query_id", "doc", *RANGE, "part"))
        looked_up = known.where("weak").join(partial.select("query_id", *RANGE).distinct(), ["query_id", *RANGE], "left_semi").select("query_id", "term", *RANGE)
        rest = parts(looked_up).join(partial.select("query_id", "doc"), ["query_id", "doc"], "left_semi")
        columns = ["query_id", "doc", "part"]
        return top_k(scores(partial.select(columns).union(rest.select(columns))), k), metas, first.union(strong).union(looked_up).distinct()
