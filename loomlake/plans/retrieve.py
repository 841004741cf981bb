"""Hybrid retrieval of a batch of queries: rewriting, lexical and vector routes, two levels of fusion, rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import text_key, tokens
from loomlake.operators import bm25, fusion, scan, terms, vectors
from loomlake.plans.staging import sent, staged

DIMS = 256


def hashed_embedding(text: str | Column) -> Column:
    """A stand-in for an embedding model: token counts by the first byte of the token's md5, of length 1."""
    import hashlib
    import re

    token = re.compile(r"[一-鿿]|[a-z0-9_]+")

    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places: dict[str, int] = {}
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                words = token.findall((t or "").lower())
                if len(places) > 1 << 18:
                    places.clear()
                for w in words:
                    if w not in places:
                        places[w] = hashlib.md5(w.encode()).digest()[0]
                v = np.bincount([places[w] for w in words], minlength=DIMS).astype(np.float64)
                out.append(v / max(1.0, float(np.linalg.norm(v))))
            yield pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(embed, "array<double>")(F.col(text) if isinstance(text, str) else text)


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    dictionary: DataFrame | None = None,
    embed: Callable[[str], Column] | None = hashed_embedding,
    relevance: Callable[[Column, Column], Column] | None = None,
    top_n: int = 10,
    top_k: int = 3,
    index: bm25.Index | None = None,
    stored: DataFrame | None = None,
    tokenize: bm25.Tokenize = tokens,
    segment: bm25.Tokenize | None = None,
    lexical: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """(query_id, rank, chunk columns): the top_k chunks of each query.

    chunks: (chunk long, page_content, ...); queries: (query_id, query). With a dictionary each query is also searched in
    its rewritten form; without `embed` the lexical route alone is used. Chunks of equal text count as one, and the first
    stands for all. `relevance` scores (query, page_content) for the rerank; without it the fused order stays.

    index and stored vectors (chunk, embedding) spare building them; with both, and a column text_key in chunks, the texts
    of hits alone are read. tokenize gives the tokens of the lexical route, segment those that are rewritten (by default
    the same). lexical(asked, top_n) takes the place of the lexical route: (query_id, doc, rank) of asked (query_id, text).
    """
    variants = queries.select("query_id", F.lit(0).alias("variant"), F.col("query").alias("text"))
    if dictionary is not None:
        again = terms.rewrite(queries, dictionary, segment or tokenize).where("rewritten <> query")
        variants = variants.union(again.select("query_id", F.lit(1), "rewritten"))
    ids = F.col("query_id") * 2 + F.col("variant")
    asked = staged(variants.select(ids.alias("query_id"), "text"))
    if lexical is None:
        found = bm25.bm25_top(index, asked, top_n, tokenize=tokenize) if index else scan.bm25_top(chunks, asked, top_n, "chunk", "page_content", tokenize=tokenize)
    else:
        found = lexical(asked, top_n)
    hits = found.select("query_id", "doc", F.lit(1).alias("route"), "rank")
    if embed is not None:
        if stored is None:
            stored = chunks.select("chunk", embed("page_content").alias("embedding"))
        near = vectors.nearest(stored, asked.select("query_id", embed("text").alias("embedding")), top_n, id_col="chunk")
        hits = near.select("query_id", "doc", F.lit(0).alias("route"), "rank").union(hits)
    keyed = chunks if "text_key" in chunks.columns else chunks.withColumn("text_key", text_key("page_content"))
    hits = staged(hits)
    hits = keyed.select(F.col("chunk").alias("doc"), "text_key").join(sent(hits), "doc")
    inner = fusion.rrf(hits, ["query_id"])
    outer = inner.select(F.floor(F.col("query_id") / 2).alias("query_id"), "text_key", (F.col("query_id") % 2).cast("int").alias("route"), "rank")
    fused = staged(fusion.rrf(outer, ["query_id"]).where(F.col("rank") <= top_n))
    first = keyed.select("chunk", "text_key").join(sent(fused.select("text_key").distinct()), "text_key", "left_semi").groupBy("text_key").agg(F.min("chunk").alias("chunk"))
    found = chunks.drop("text_key").join(sent(staged(fused.join(first, "text_key"))), "chunk")
    if relevance is None:
        return fusion.rerank(found, ["query_id"], top_n, top_k).drop("text_key")
    found = found.join(queries.select("query_id", "query"), "query_id")
    return fusion.rerank(found, ["query_id"], top_n, top_k, relevance(F.col("query"), F.col("page_content"))).drop("text_key", "query")
