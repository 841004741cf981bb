"""Reciprocal rank fusion, and the rerank stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(ranked: DataFrame, by: list[str], key: str = "text_key", k: int = RRF_K) -> DataFrame:
    """(*by, key, score, rank): 1 / (k + rank) summed over routes.

    ranked: (*by, key, route, rank). A key that stands twice in a route counts twice. Ties keep the order in which keys
    are first seen: by route, then by rank.
    """
    seen = F.min(F.struct("route", "rank")).alias("seen")
    fused = ranked.groupBy(*by, key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), seen)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "seen", key)
    return fused.withColumn("rank", F.row_number().over(order)).select(*by, key, "score", "rank")


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a rerank model: the share of a query's tokens that the text holds."""
    from loomlake.functions.text import tokens

    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))


def smallest_window(query: Column, text: Column) -> Column:
    """(n_query, n_terms, width): distinct terms of the query, those that the text holds, and the length in tokens of the
    shortest passage with all of these.

    One walk over the tokens keeps the last place of each term; the passage that ends here begins at the least of them.
    Without common terms, and for nulls, n_terms and width are 0. The work is within the row: nothing is shuffled.
    """
    from loomlake.functions.text import tokens

    def bound(value: Column, use) -> Column:
        """use(value), which is computed once although it stands in functions that are called for each element."""
        return F.transform(F.array(value), use)[0]

    def walk(x: Column) -> Column:
        none = F.lit(2**31 - 1)

        def step(state: Column, place: Column) -> Column:
            last = F.transform(state["last"], lambda at, k: F.when(k + 1 == place["term"], place["at"]).otherwise(at))
            return bound(last, lambda now: F.struct(now.alias("last"), F.when(F.array_min(now) >= 0, F.least(state["best"], place["at"] - F.array_min(now) + 1)).otherwise(state["best"]).alias("best")))

        places = F.filter(F.transform(x["all"], lambda t, i: F.struct(i.alias("at"), F.array_position(x["terms"], t).alias("term"))), lambda p: p["term"] > 0)
        start = F.struct(F.array_repeat(F.lit(-1), F.size(x["terms"])).alias("last"), none.alias("best"))
        width = F.aggregate(places, start, step, lambda state: state["best"])
        n = F.size(x["terms"])
        return F.struct(x["n_query"].alias("n_query"), n.alias("n_terms"), F.when(n == 0, 0).otherwise(width).alias("width"))

    sides = F.struct(F.array_distinct(tokens(F.coalesce(query, F.lit("")))).alias("asked"), tokens(F.coalesce(text, F.lit(""))).alias("all"))
    common = lambda s: F.struct(F.size(s["asked"]).alias("n_query"), F.array_intersect(s["asked"], s["all"]).alias("terms"), s["all"].alias("all"))
    return bound(bound(sides, common), walk)


def window_score(window: Column) -> Column:
    """From 0 to 2: the share of the query's terms that the text holds, times 1 + how densely they lie together."""
    share = window["n_terms"] / F.greatest(window["n_query"], F.lit(1))
    return share * (1 + window["n_terms"] / F.greatest(window["width"], F.lit(1)))


def passage_score(query: Column, text: Column) -> Column:
    """Relevance for `rerank`: of texts with the same terms of the query, the one that has them closest together is first."""
    return window_score(smallest_window(query, text))


def rerank(candidates: DataFrame, by: list[str], top_n: int = 10, top_k: int = 3, relevance: Column | None = None) -> DataFrame:
    """The first top_n by rank, ordered by relevance, cut to top_k. Without a model the order stays as it is."""
    first = candidates.where(F.col("rank") <= top_n)
    if relevance is None:
        return first.where(F.col("rank") <= top_k)
    order = Window.partitionBy(*by).orderBy(F.desc("relevance"), "rank")
    again = first.withColumn("relevance", relevance).withColumn("again", F.row_number().over(order))
    return again.where(F.col("again") <= top_k).drop("rank").withColumnRenamed("again", "rank")
