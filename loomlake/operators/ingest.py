"""Incremental ingest: fingerprints, replacement by source, image texts, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.text import strip


# What an upload says of a known and of a new file.
KNOWN, DONE = "该文件内容未变化，已入库，跳过", "入库成功"


def new_files(files: DataFrame, ledger: DataFrame, by_source: bool = False) -> DataFrame:
    """Files (source, content) with their md5 that the ledger does not hold; by_source: not under this name."""
    keys = ["md5", "source"] if by_source else ["md5"]
    return files.withColumn("md5", F.md5("content")).join(ledger.select(*keys).distinct(), keys, "left_anti")


def replace_by_source(existing: DataFrame, new: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """existing without the sources of new (or of `sources`, which may have no chunks any more), and new."""
    gone = (new if sources is None else sources).select("source").distinct()
    return existing.join(gone, "source", "left_anti").unionByName(new, allowMissingColumns=True)


def not_blank(chunks: DataFrame, text_col: str = "page_content") -> DataFrame:
    return chunks.where(strip(F.coalesce(F.col(text_col), F.lit(""))) != "")


def upload_stats(existing: DataFrame, files: DataFrame, chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """(source, total, inserted, skipped, deleted, msg) of an upload.

    chunks: (source, page_content) of files (source, md5). A known file is skipped whole; else blank chunks are.
    """
    known = files.join(ledger.select("md5").distinct().withColumn("known", F.lit(True)), "md5", "left").select("source", F.coalesce("known", F.lit(False)).alias("known"))
    text = F.coalesce(F.col("page_content"), F.lit(""))
    counts = chunks.groupBy("source").agg(F.count("*").alias("total"), F.sum((strip(text) != "").cast("int")).alias("good"))
    old = existing.groupBy("source").agg(F.count("*").alias("old"))
    rows = known.join(counts, "source", "left").join(old, "source", "left").fillna(0, ["total", "good", "old"])
    inserted = F.when(F.col("known"), 0).otherwise(F.col("good")).cast("long")
    msg = F.when(F.col("known"), KNOWN).otherwise(DONE)
    return rows.select("source", "total", inserted.alias("inserted"), (F.col("total") - inserted).alias("skipped"), F.when(F.col("known"), 0).otherwise(F.col("old")).cast("long").alias("deleted"), msg.alias("msg"))


def image_names(images: DataFrame) -> DataFrame:
    """(source, rid, path): the names under which the images (source, nth, rid, filename) of a document are kept.

    They are numbered in order; an unknown extension becomes png.
    """
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(ext.isin("png", "jpg", "jpeg", "gif", "bmp", "webp"), ext).otherwise("png")
    number = F.lpad((F.row_number().over(Window.partitionBy("source").orderBy("nth"))).cast("string"), 4, "0")
    return images.select("source", "rid", F.concat(F.lit("image_"), number, F.lit("."), known).alias("path"))


def chunk_images(places: DataFrame, names: DataFrame) -> DataFrame:
    """(source, chunk_id, images): the image paths of each chunk, each once, in order of its first place.

    places: (source, chunk_id, block_no, images: relationship ids); names: (source, rid, path). Ids without an image go.
    """
    rids = places.select("source", "chunk_id", "block_no", F.posexplode("images").alias("j", "rid")).join(names, ["source", "rid"])
    first = rids.groupBy("source", "chunk_id", "path").agg(F.min(F.struct("block_no", "j")).alias("at"))
    found = first.groupBy("source", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("x"))
    return found.select("source", "chunk_id", F.transform("x", lambda x: x.path).alias("images"))


def as_list(value: str | Column) -> Column:
    """A string as an array of itself, null and the empty string as an empty one."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(c))


def describe_images(chunks: DataFrame, described: DataFrame, keys: list[str], same: list[str] = ()) -> DataFrame:
    """chunks with image_description: `图片 n：text` lines of images (array of paths) that `described` (path, text) knows.

    An image without a text keeps its number. A path that stands twice in a chunk counts once, at its first place; keys in
    `same` must agree between chunks and described.
    """
    images = chunks.select(*keys, F.posexplode(F.array_distinct("images")).alias("j", "path"))
    rows = images.join(described.dropDuplicates([*same, "path"]), [*same, "path"])
    line = F.concat(F.lit("图片 "), (F.col("j") + 1).cast("string"), F.lit("："), F.col("text"))
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", line.alias("s")))).alias("x"))
    texts = found.select(*keys, F.array_join(F.transform("x", lambda x: x.s), "\n").alias("image_description"))
    return chunks.join(texts, keys, "left").fillna("", ["image_description"])


def image_text(name: Column, image: Column) -> Column:
    """A stand-in for a vision model: the name and size of an image, 100 characters at most; a missing image is said to be."""
    size = F.octet_length(image).cast("string")
    return F.left(F.when(image.isNull(), F.concat(F.lit("图片不存在："), name)).otherwise(F.concat(name, F.lit("，"), size, F.lit(" 字节"))), F.lit(100))


def first_of_each(rows: DataFrame, key: str | Column, order: list[str]) -> DataFrame:
    """The first row of each key."""
    window = Window.partitionBy(F.col(key) if isinstance(key, str) else key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def sources(chunks: DataFrame) -> DataFrame:
    """(source, n): all sources and their chunks, in order."""
    return chunks.where(F.coalesce("source", F.lit("")) != "").groupBy("source").agg(F.count("*").alias("n")).orderBy("source")
