"""The chunk store: files in, chunks, index, vectors, terms and sources out."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.text import CHINESE, text_key, tokens
from loomlake.operators import bm25, chunking, ingest, segment, terms
from loomlake.plans.retrieve import hashed_embedding, retrieve
from loomlake.plans.snapshots import Part, Snapshots
from loomlake.sources import files as readers

#: gen is the version by which a row came; `replaced` names the generations of sources that newer ones, or nothing, replace.
TABLES = {
    "chunks": "source string, gen long, chunk_id int, chunk long, page_content string, text_key string, heading string, heading_level int, chapter string, doc_type string, "
    "images array<string>, image_count int, image_description string, operator string, create_time timestamp",
    "postings": "source string, gen long, doc long, term string, tf long, dl long",
    "vectors": "source string, gen long, chunk long, embedding array<double>",
    "terms": "source string, gen long, term string, n long, term_rank int, source_seq string",
    "replaced": "source string, gen long",
    "term_counts": "term string, df long",
    "corpus": "n long, total long",
    "words": segment.WORDS,
    "ledger": "md5 string, source string, total long, ingested_at timestamp",
}
#: Tables whose rows a newer generation of their source replaces, and the column by which their parts are sorted.
SORTED = {"chunks": "source", "postings": "term", "vectors": "chunk", "terms": "source"}
INDEX = ("postings", "term_counts", "corpus")
STATS = "source string, total long, inserted long, skipped long, deleted long, msg string"
FAILED = (PySparkException, Py4JJavaError)


def _columns(name: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in TABLES[name].split(", ")]


class KnowledgeBase:
    """Tables under one path: chunks and what is derived from them, and the ledger of known files.

    An upload writes new parts of all tables and commits them at once: searches see all of it or nothing, and after a broken
    upload the same files are new again. Nothing is rewritten for it. The rows of replaced sources stay in their parts, and
    are left out when they are read, until their part is merged. Document frequencies and lengths are kept as signed
    differences, so they equal those of an index that is built anew; a search reads those of its terms. One upload runs at
    a time.

    Terms and rewritten questions use the words of a dictionary, which the first upload with Chinese text fits on its
    chunks, and `refit` on all; with segmented the index does, too.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[str], Column] = hashed_embedding, script: str | None = terms.CHINESE, segmented: bool = False):
        self.spark, self.path, self.embed, self.script, self.segmented = spark, path.rstrip("/"), embed, script, segmented
        self.store = Snapshots(spark, self.path)

    def _table(self, name: str, parts: list[Part] | None = None) -> DataFrame:
        """The rows of a table that count; parts: of one version, for readers of several tables."""
        parts = self.store.parts() if parts is None else parts
        rows = self.store.read(name, TABLES[name], parts)
        return self._kept(rows, parts) if name in SORTED else rows

    def _kept(self, rows: DataFrame, parts: list[Part]) -> DataFrame:
        if not any(n == "replaced" for n, _, _ in parts):
            return rows
        return rows.join(self.store.read("replaced", TABLES["replaced"], parts), ["source", "gen"], "left_anti").select(*rows.columns)

    def _put(self, name: str, rows: DataFrame) -> Part:
        """A new part of a table, sorted so that readers of few keys skip most of it."""
        rows = rows.select(*[F.col(c) for c in _columns(name)])
        if name in SORTED:
            rows = rows.repartitionByRange(SORTED[name]).sortWithinPartitions(SORTED[name])
        return self.store.write(name, rows)

    def chunks(self) -> DataFrame:
        return self._table("chunks").drop("gen")

    def ledger(self) -> DataFrame:
        return self._table("ledger")

    def parse(self, files: DataFrame) -> DataFrame:
        """Chunks of files (source, content, md5, ext) of all formats, with the names of their images."""
        none = F.array().cast("array<string>")
        plain = chunking.markdown_chunks(readers.texts(files)).withColumns({"chapter": F.lit(""), "doc_type": F.lit("paragraph"), "images": none})
        blocks = readers.docx_blocks(files)
        word = chunking.block_chunks(blocks)
        images = ingest.chunk_images(chunking.block_places(blocks), ingest.image_names(readers.docx_images(files)))
        word = word.join(images, ["source", "chunk_id"], "left").withColumn("images", F.coalesce("images", none))
        sheets = chunking.sheet_chunks(readers.xlsx_rows(files)).withColumns({"chunk_id": F.col("part"), "heading_level": F.lit(0), "chapter": F.col("sheet_name"), "doc_type": F.lit("sheet"), "images": none})
        columns = ["source", "chunk_id", "page_content", "heading", "heading_level", "chapter", "doc_type", "images"]
        out = plain.select(columns).unionByName(word.select(columns)).unionByName(sheets.select(columns))
        try:
            pages = readers.pdf_pages(files)
        except ImportError:
            if files.where("ext = '.pdf'").isEmpty():
                return out
            raise
        return out.unionByName(chunking.pdf_chunks(pages).select(columns))

    def upload(self, path: str, operator: str = "", describe: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """Reads the files under a path, replaces the chunks of changed ones, and returns the counts of each source."""
        return self.ingest(readers.read_files(self.spark, path), operator, describe)

    def ingest(self, files: DataFrame, operator: str = "", describe: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """`upload` of files (source, content, md5, ext). Only files that the ledger does not hold are parsed, and once.

        describe(name, bytes) gives the text of an image; without it chunks have the names of their images alone. A file that
        can't be parsed has a row with what is wrong as its msg; what the store holds of its source stays, and the next
        upload tries it again.
        """
        version = self.store.version()
        parts = self.store.parts(version)
        ledger, existing = self._table("ledger", parts), self._table("chunks", parts)
        fresh = ingest.new_files(files, ledger)
        failed = f"{self.path}/staged/{uuid.uuid4().hex}"
        readers.broken_files(fresh).write.parquet(failed)
        broken = self.spark.read.schema("source string, md5 string, error string").parquet(failed)
        if not broken.isEmpty():
            fresh = fresh.join(broken.select("source", "md5").distinct(), ["source", "md5"], "left_anti")
        parsed, stats = (f"{self.path}/{name}/{uuid.uuid4().hex}" for name in ("staged", "stats"))
        self.parse(fresh).write.parquet(parsed)
        new = self.spark.read.parquet(parsed)
        counted = ingest.upload_stats(existing.select("source"), fresh.select("source", "md5"), new, ledger)
        # a known file has the count of chunks that the ledger keeps of it
        known = files.select("source", "md5").join(ledger.groupBy("md5").agg(F.max("total").alias("total")), "md5")
        known = known.select("source", "total", F.lit(0).cast("long").alias("inserted"), F.col("total").alias("skipped"), F.lit(0).cast("long").alias("deleted"), F.lit(ingest.KNOWN).alias("msg"))
        none = F.lit(0).cast("long")
        wrong = broken.select("source", *[none.alias(c) for c in ("total", "inserted", "skipped", "deleted")], F.col("error").alias("msg"))
        counted.unionByName(known).unionByName(wrong).write.parquet(stats)
        totals = counted.select("source", "total")
        new = ingest.not_blank(new)
        if describe is not None:
            known = readers.docx_images(fresh)
            known = ingest.image_names(known).join(known.select("source", "rid", "filename", "image"), ["source", "rid"])
            new = ingest.describe_images(new, known.select("source", F.col("path"), describe(F.col("filename"), F.col("image")).alias("text")), ["source", "chunk_id"], same=["source"])
        else:
            new = new.withColumn("image_description", F.lit(""))
        key = F.xxhash64("source", "chunk_id")
        now = {"gen": F.lit(version + 1).cast("long"), "chunk": key, "text_key": text_key("page_content"), "image_count": F.size("images"), "operator": F.lit(operator), "create_time": F.current_timestamp()}
        entered = fresh.select("md5", "source").distinct().join(totals, "source").withColumn("ingested_at", F.current_timestamp())
        more, parts = self._derived(new.withColumns(now), fresh.select("source").distinct(), parts)
        if more:
            self._commit([*more, self._put("ledger", entered)], parts, version)
        return self.spark.read.schema(STATS).parquet(stats)

    def _derived(self, new: DataFrame, gone: DataFrame, parts: list[Part]) -> tuple[list[Part], list[Part]]:
        """Parts by which the rows of the sources in gone are replaced by those of new chunks, in all tables, and the older
        parts that stay."""
        new, gone = (self.store.read("staged", TABLES[t], [self.store.write("staged", rows)]) for t, rows in (("chunks", new.select(*_columns("chunks"))), ("replaced", gone.withColumn("gen", F.lit(0).cast("long")))))
        gone = gone.select("source")
        if gone.isEmpty():
            return [], parts
        old = self._table("chunks", parts).join(gone, "source", "left_semi")
        out = [self._put("chunks", new), self._put("vectors", new.select("source", "gen", "chunk", self.embed("page_content").alias("embedding")))]
        words = self.store.read("words", TABLES["words"], parts)
        if self.script == CHINESE and not any(n == "words" for n, _, _ in parts):
            fitted = self.store.write("words", segment.fit_words(new, "page_content"))
            words = self.store.read("words", TABLES["words"], [fitted])
            if not words.isEmpty():
                out.append(fitted)
        cut = self._cut(words)
        if self.segmented and len(out) > 2 and any(n in INDEX for n, _, _ in parts):  # the first words: older chunks are cut into them, too
            every = self._table("chunks", parts).join(gone, "source", "left_anti").unionByName(new)
            parts = [p for p in parts if p[0] not in INDEX]
            out += self._indexed(every, every.where("false"), cut)
        else:
            out += self._indexed(new, old, cut if self.segmented else tokens)
        out.append(self._put("terms", self._terms(new, cut)))
        out.append(self._put("replaced", old.select("source", "gen").distinct()))
        return out, parts

    def _indexed(self, new: DataFrame, old: DataFrame, tokenize: bm25.Tokenize) -> list[Part]:
        """Postings of new chunks, and what they and the loss of old ones add to the counts."""
        rows = lambda df, *more: df.select(*more, F.col("chunk").alias("doc"), tokenize(F.coalesce("page_content", F.lit(""))).alias("t")).withColumn("dl", F.size("t").cast("long"))
        added = rows(new, "source", "gen")
        postings = added.select("source", "gen", "doc", "dl", F.explode("t").alias("term")).groupBy("source", "gen", "doc", "term", "dl").agg(F.count("*").alias("tf"))
        signed = added.select("t", "dl", F.lit(1).cast("long").alias("sign")).union(rows(old).select("t", "dl", F.lit(-1).cast("long")))
        df = signed.select("sign", F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
        corpus = signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("total"))
        return [self._put("postings", postings), self._put("term_counts", df.orderBy("term")), self._put("corpus", corpus)]

    def _terms(self, new: DataFrame, cut: bm25.Tokenize) -> DataFrame:
        found = terms.source_terms(new.select("source", F.col("page_content").alias("text")), script=self.script, tokenize=cut)
        first = new.groupBy("source").agg(F.date_format(F.min("create_time"), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), F.max("gen").alias("gen"))
        return found.join(first, "source").withColumn("source_seq", F.concat_ws(" ", "at", "source"))

    def _cut(self, words: DataFrame) -> bm25.Tokenize:
        """What cuts texts into words; without a dictionary, the plain tokens."""
        return tokens if self.script != CHINESE or words.isEmpty() else segment.segmenter(words)

    def _commit(self, more: list[Part], parts: list[Part], version: int, everything: bool = False) -> None:
        every = [*parts, *more]
        merge: dict[str, Callable[[DataFrame], DataFrame]] = {n: (lambda rows, by=by: self._kept(rows, every).repartitionByRange(by).sortWithinPartitions(by)) for n, by in SORTED.items()}
        merge["term_counts"] = lambda rows: rows.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").orderBy("term")
        merge["corpus"] = lambda rows: rows.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        merge["replaced"] = merge["ledger"] = lambda rows: rows
        every = self.store.merged(every, merge, TABLES, everything)
        # once all parts are merged, no row of a replaced generation is left
        self.store.commit([p for p in every if p[0] != "replaced"] if everything else every, version)

    def compact(self) -> None:
        """Merges all parts of each table; the rows of replaced generations go."""
        version = self.store.version()
        self._commit([], self.store.parts(version), version, everything=True)

    def delete(self, source: str) -> None:
        """All rows of a source go; the ledger still knows its files."""
        version = self.store.version()
        parts = self.store.parts(version)
        none = self._table("chunks", parts).where("false")
        self._commit(*self._derived(none, self.spark.createDataFrame([(source,)], "source string"), parts), version)

    def refit(self) -> None:
        """Fits the dictionary on all chunks, and cuts terms and, where it is segmented, the index anew."""
        version = self.store.version()
        parts = self.store.parts(version)
        every = self._table("chunks", parts)
        words = self.store.write("words", segment.fit_words(every, "page_content"))
        cut = self._cut(self.store.read("words", TABLES["words"], [words]))
        new = [words, self._put("terms", self._terms(every, cut))]
        if self.segmented:
            new += self._indexed(every, every.where("false"), cut)
        again = {n for n, _, _ in new}
        self.store.commit([*[p for p in parts if p[0] not in again], *new], version)

    def rebuild_index(self) -> None:
        """Builds postings and counts from the chunks anew, in place of what is stored of them."""
        version = self.store.version()
        parts = self.store.parts(version)
        every = self._table("chunks", parts)
        new = self._indexed(every, every.where("false"), self.tokenize(parts))
        self.store.commit([*[p for p in parts if p[0] not in INDEX], *new], version)

    def sources(self) -> DataFrame:
        return ingest.sources(self.chunks())

    def tokenize(self, parts: list[Part] | None = None) -> bm25.Tokenize:
        """The tokens of the index."""
        return self._cut(self._table("words", parts)) if self.segmented else tokens

    def index(self, queries: DataFrame | None = None, parts: list[Part] | None = None) -> bm25.Index:
        """The stored index; for queries (query_id, text) only what their terms need is read."""
        parts = self.store.parts() if parts is None else parts
        postings = self._table("postings", parts).select("doc", "term", "tf", "dl")
        counts = self._table("term_counts", parts)
        if queries is not None:
            wanted = bm25.terms_of(queries, self.tokenize(parts)).select("term").distinct()
            postings, counts = (x.join(wanted, "term", "left_semi") for x in (postings, counts))
        sums = self._table("corpus", parts).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
        corpus = sums.select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("avgdl"))
        df = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return bm25.Index(postings, bm25.inverse_frequencies(df, corpus), corpus)

    def dictionary(self, parts: list[Part] | None = None) -> DataFrame:
        """(term, dict_pos) of the stored terms of all sources, in order of their upload."""
        return terms.all_terms(self._table("terms", parts))

    def lexical_hits(self, asked: DataFrame, k: int, parts: list[Part] | None = None) -> DataFrame:
        """(query_id, doc, score, rank) of asked (query_id, text): by the stored index, by one that is built from the chunks
        where that is missing or broken, and without hits where that fails, too, so that vectors alone are left."""
        parts = self.store.parts() if parts is None else parts
        cut = self.tokenize(parts)

        def stored() -> bm25.Index:
            names = {n for n, _, _ in parts}
            if "chunks" in names and not names.issuperset(INDEX):
                raise FileNotFoundError("the index has no parts")
            return self.index(asked, parts)

        def rebuilt() -> bm25.Index:
            return bm25.index_for(self._table("chunks", parts), asked, "chunk", "page_content", cut)

        for name, make in (("stored", stored), ("rebuilt", rebuilt)):
            out = f"{self.path}/staged/{uuid.uuid4().hex}"
            try:
                hits = bm25.bm25_top(make(), asked, k, tokenize=cut)
                hits.write.parquet(out)
                return self.spark.read.schema(hits.schema).parquet(out)
            except (*FAILED, FileNotFoundError) as e:
                warnings.warn(f"the {name} index fails: {str(e)[:200]}", stacklevel=2)
        return self.spark.createDataFrame([], "query_id long, doc long, score double, rank int")

    def search(self, queries: DataFrame, rewrite: bool = True, top_k: int = 3, relevance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """The best chunks of a batch of queries (query_id, query), from the stored index, vectors and terms of one version."""
        parts = self.store.parts()
        words = self.dictionary(parts) if rewrite else None
        found = lambda asked, k: self.lexical_hits(asked, k, parts)
        cut = self._cut(self._table("words", parts))
        return retrieve(self._table("chunks", parts).drop("gen"), queries, words, self.embed, relevance, top_k=top_k, lexical=found, stored=self._table("vectors", parts).drop("gen"), segment=cut)
