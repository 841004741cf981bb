"""Texts, blocks, page lines and sheet rows -> chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.text import heading_level_docx, heading_level_pdf, markdown_row, padded, strip

CHUNK_SIZE, OVERLAP = 800, 100
ROWS_PER_CHUNK = 50
# Separators to cut after, the best first.
SEPARATORS = ("\n", "。", "！", "？", "；", ".", "!", "?", ";", "，", ",", " ")


def paragraphs(docs: DataFrame, id_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, pos, paragraph): a text's parts between blank lines, stripped, without empty ones; pos from 0 before dropping."""
    unified = F.regexp_replace(F.col(text_col), "\r\n?", "\n")
    parts = docs.select(F.col(id_col), F.posexplode(F.split(unified, r"\n\s*\n")).alias("pos", "paragraph"))
    return parts.withColumn("paragraph", strip("paragraph")).where("paragraph <> ''")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): lines that are not blank, stripped; line_no from 1 over all lines."""
    rows = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return rows.select(id_col, (F.col("pos") + 1).alias("line_no"), strip("line").alias("line")).where("line <> ''")


_SEPARATOR_CODES = np.array([ord(c) for c in SEPARATORS], np.uint32)


def split_long(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most `size` characters, cut after the best separator in the last `overlap` of them.

    The places of all separators are found once; each cut is then looked up among those in reach.
    """
    n = len(text)
    if n <= size:
        return [text]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.flatnonzero(np.isin(codes, _SEPARATOR_CODES))
    ranks = (codes[places, None] == _SEPARATOR_CODES).argmax(axis=1)
    bounds = [(0, 0)]
    while bounds[-1][1] < n:
        begin, limit = max(bounds[-1][0] + 1, bounds[-1][1] - overlap) if bounds[1:] else 0, n
        if begin + size < n:
            limit = begin + size
            a, b = np.searchsorted(places, [max(begin + 1, limit - overlap), limit])
            if a < b:
                limit = int(places[a:b][ranks[a:b] == ranks[a:b].min()].max()) + 1
        bounds.append((begin, limit))
    return [piece for a, b in bounds[1:] if (piece := text[a:b].strip())]


def sliding_split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs with chunk_no from 1 and chunk, a row for each chunk; null texts have none.

    Where a chunk ends depends on where the one before it ended, which no column function expresses: an Arrow function
    cuts each text, in its own task.
    """

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else split_long(t, size, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    found = docs.select(id_col, F.arrow_udf(cut, "array<string>")(text_col).alias("chunks"))
    return found.select(id_col, F.posexplode("chunks").alias("pos", "chunk")).select(id_col, (F.col("pos") + 1).alias("chunk_no"), "chunk")


def markdown_chunks(docs: DataFrame, id_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, chunk_id, heading, heading_level, page_content) of plain and Markdown texts.

    A paragraph that begins with 1 to 6 # is a chunk of its own, whose first line is the heading of what follows; the
    first heading is the file's stem. Other paragraphs of over CHUNK_SIZE characters are split.
    """
    parts = paragraphs(docs, id_col, text_col).withColumnRenamed(id_col, "source")
    marks = F.regexp_extract("paragraph", r"^(#{1,6})\s*(.+)", 1)
    parts = parts.withColumn("marks", F.length(marks)).withColumn("own", F.when(F.col("marks") > 0, strip(F.regexp_extract("paragraph", r"^(#{1,6})\s*(.+)", 2))))
    order = Window.partitionBy("source").orderBy("pos")
    stem = F.regexp_extract("source", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    parts = parts.withColumn("heading", F.coalesce(F.last("own", ignorenulls=True).over(order), stem))
    level = F.when(F.col("marks") > 0, F.col("marks")).otherwise(2).cast("int")
    parts = parts.withColumn("heading_level", level)
    short = parts.where((F.col("marks") > 0) | (F.length("paragraph") <= CHUNK_SIZE)).select("source", "pos", F.lit(1).alias("chunk_no"), F.col("paragraph").alias("chunk"), "heading", "heading_level")
    keyed = parts.where((F.col("marks") == 0) & (F.length("paragraph") > CHUNK_SIZE)).withColumn("at", F.struct("source", "pos", "heading", "heading_level"))
    long = sliding_split(keyed, "at", "paragraph").select("at.source", "at.pos", "chunk_no", "chunk", "at.heading", "at.heading_level")
    every = short.unionByName(long)
    numbered = F.row_number().over(Window.partitionBy("source").orderBy("pos", "chunk_no"))
    return every.select("source", numbered.alias("chunk_id"), "heading", "heading_level", F.col("chunk").alias("page_content"))


def _joined(piece: Column, order: str, sep: str = "") -> Column:
    """Strings of a group in the order of a column."""
    found = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("s"))))
    return F.array_join(F.transform(found, lambda x: x.s), sep)


def _placed(blocks: DataFrame) -> DataFrame:
    """blocks with level, chapter and chunk_id; first-level headings and blank blocks without an image are left out."""
    rows = blocks.withColumn("text", F.when(F.col("kind") == "p", strip("text")).otherwise(F.col("text")))
    pictured = F.size("images") > 0 if "images" in blocks.columns else F.lit(False)
    rows = rows.where((strip("text") != "") | pictured)
    level = F.when(F.col("kind") == "p", heading_level_docx("text"))
    rows = rows.withColumn("level", F.when(F.col("kind") == "tbl", 0).otherwise(F.coalesce(level, F.lit(9))))
    order = Window.partitionBy("source").orderBy("block_no")
    rows = rows.withColumn("chapter", F.coalesce(F.last(F.when(F.col("level") == 1, F.col("text")), ignorenulls=True).over(order), F.lit("")))
    rows = rows.where("level <> 1")
    begins = (F.col("level").isin(0, 2) | (F.row_number().over(order) == 1)).cast("int")
    return rows.withColumn("begins", begins).withColumn("chunk_id", F.sum("begins").over(order).cast("int"))


def block_places(blocks: DataFrame) -> DataFrame:
    """(source, chunk_id, block_no, images): where the images of a document lie."""
    return _placed(blocks).where(F.size("images") > 0).select("source", "chunk_id", "block_no", "images")


def block_chunks(blocks: DataFrame) -> DataFrame:
    """(source, chunk_id, heading, heading_level, chapter, doc_type, page_content) of documents of paragraphs and tables.

    blocks: (source, block_no, kind `p` or `tbl`, text; a table's text is its Markdown). A first-level heading names the
    chapter and ends nothing; a second-level heading and a table open a chunk; text before any of them opens one too.
    Text after a table joins it. Blank blocks are ignored, but one with an image belongs to the chunk that it stands in.
    """
    rows = _placed(blocks)
    own = F.when(F.col("level") == 0, "text").when(F.col("level") == 2, "none").otherwise("body")
    piece = F.when(own == "text", F.col("text")).when(own == "none", F.lit("")).otherwise(F.concat("text", F.lit("\n\n")))
    table = F.when(F.col("chapter") != "", F.concat("chapter", F.lit(" - 表格"))).otherwise("表格")
    heading = F.when(F.col("level") == 0, table).when(F.col("level") == 2, F.col("text")).when(F.col("chapter") != "", F.col("chapter")).otherwise("文档开头")
    first = lambda c, name: F.min_by(c, "block_no").alias(name)
    out = rows.groupBy("source", "chunk_id").agg(
        first(heading, "heading"),
        first(F.when(F.col("level").isin(0, 2), F.col("level")).otherwise(1).cast("int"), "heading_level"),
        first(F.col("chapter"), "chapter"),
        first(F.when(F.col("level") == 0, "table").otherwise("paragraph"), "doc_type"),
        strip(_joined(piece, "block_no")).alias("page_content"),
    )
    return out


def page_line_chunks(pages: DataFrame) -> DataFrame:
    """(source, chunk_id, page_no, heading, heading_level, chapter, page_content) of pages of lines; blank chunks go.

    pages: (source, page_no, text). Both levels of headings open a chunk; the chapter is that of the page until a
    first-level heading names another. chunk_id runs over the whole file.
    """
    return line_chunks(pages.select("source", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")))


def line_chunks(lines: DataFrame) -> DataFrame:
    """`page_line_chunks` of lines (source, page_no, line_no, raw)."""
    rows = lines.withColumn("line", strip("raw"))
    rows = rows.withColumn("level", F.when(F.col("line") == "", 0).otherwise(F.coalesce(heading_level_pdf("line"), F.lit(9))))
    order = Window.partitionBy("source", "page_no").orderBy("line_no")
    named = F.last(F.when(F.col("level") == 1, F.col("line")), ignorenulls=True).over(order)
    rows = rows.withColumn("chapter", F.coalesce(named, F.concat(F.lit("第"), F.col("page_no").cast("string"), F.lit("页"))))
    opened = F.coalesce(F.sum((F.col("level") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = F.col("level").isin(1, 2) | ((F.col("level") > 0) & (opened == 0))
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(order)).where("part > 0")
    piece = F.when(F.col("level").isin(1, 2), F.lit("")).otherwise(F.concat("line", F.lit("\n")))
    heading = F.when(F.col("level").isin(1, 2), F.col("line")).otherwise(F.col("chapter"))
    first = lambda c, name: F.min_by(c, "line_no").alias(name)
    out = rows.groupBy("source", "page_no", "part").agg(
        first(heading, "heading"), first(F.when(F.col("level") == 2, 2).otherwise(1).cast("int"), "heading_level"), first(F.col("chapter"), "chapter"), strip(_joined(piece, "line_no")).alias("page_content")
    )
    out = out.where("page_content <> ''").withColumn("chunk_id", F.row_number().over(Window.partitionBy("source").orderBy("page_no", "part")))
    return out.select("source", "chunk_id", "page_no", "heading", "heading_level", "chapter", "page_content")


def page_table_chunks(tables: DataFrame) -> DataFrame:
    """(source, page_no, table_no, heading, page_content, table_rows, table_cols) of tables (source, page_no, table_no, cells).

    The first row is the header; short rows are filled; a table without a first row, or with a blank one, goes. The counts
    of rows and columns are those of the Markdown text: lines less one, and half of its bars less one.
    """
    kept = tables.where((F.size("cells") > 0) & F.exists(F.col("cells")[0], lambda c: F.coalesce(c, F.lit("")) != ""))
    clean = F.transform("cells", lambda r: F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    # the width stands in an array of one, so that it is found once and not again for each row
    table = F.struct(clean.alias("cells"), F.array_max(F.transform("cells", F.size)).alias("width"))
    lines = lambda t: F.transform(t["cells"], lambda r: markdown_row(padded(r, t["width"])))
    made = F.transform(F.array(table), lambda t: F.struct(lines(t).alias("lines"), markdown_row(F.array_repeat(F.lit("---"), t["width"])).alias("rule")))
    text = F.transform(made, lambda m: F.concat_ws("\n", m["lines"][0], m["rule"], F.array_join(F.slice(m["lines"], F.lit(2), F.size(m["lines"])), "\n")))[0]
    rows = kept.withColumn("page_content", strip(text))
    count = lambda c: F.length("page_content") - F.length(F.replace("page_content", F.lit(c), F.lit("")))
    heading = F.concat(F.lit("第"), F.col("page_no").cast("string"), F.lit("页 - 表格 "), (F.col("table_no") + 1).cast("string"))
    return rows.select("source", "page_no", "table_no", heading.alias("heading"), "page_content", (count("\n") - 1).alias("table_rows"), (F.floor(count("|") / 2) - 1).cast("int").alias("table_cols"))


def pdf_chunks(pages: DataFrame) -> DataFrame:
    """(source, chunk_id, page_content, heading, heading_level, chapter, doc_type, images) of PDF pages: text, then tables.

    pages: (source, page_no, text, images: names, tables). chunk_id runs over the whole file, all text chunks of a page
    before its tables; the images of a page belong to all of its chunks.
    """
    text = page_line_chunks(pages).select("source", "page_no", F.lit(0).alias("is_table"), F.col("chunk_id").alias("nth"), "page_content", "heading", "heading_level", "chapter", F.lit("paragraph").alias("doc_type"))
    tables = page_table_chunks(pages.select("source", "page_no", F.posexplode("tables").alias("table_no", "cells")))
    tables = tables.select("source", "page_no", F.lit(1), "table_no", "page_content", "heading", F.lit(0), F.concat(F.lit("第"), F.col("page_no").cast("string"), F.lit("页")), F.lit("table"))
    every = text.union(tables).join(pages.select("source", "page_no", "images"), ["source", "page_no"])
    order = Window.partitionBy("source").orderBy("page_no", "is_table", "nth")
    return every.withColumn("chunk_id", F.row_number().over(order)).drop("page_no", "is_table", "nth")


def numbered(rows: DataFrame, by: list[str], order: str, name: str, block: int = 10_000) -> DataFrame:
    """rows with their number within `by`, from 0, in order of a whole-number column.

    No task sorts a whole group: rows are numbered within blocks of `block` values of the column, and moved on by the rows
    of the blocks before, of which there is one row each.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    sizes = rows.groupBy(*by, "_block").agg(F.count("*").alias("_m"))
    upto = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.select(*by, "_block", (F.sum("_m").over(upto) - F.col("_m")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order)) - 1
    return rows.withColumn("_own", own).join(before, [*by, "_block"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_block")


def sheet_chunks(rows: DataFrame, per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """(source, sheet_name, part, heading, row_count, col_count, page_content) of sheets, as Markdown tables.

    rows: (source, sheet_name, row_no, cells). The first row that is not blank is the header and heads every part; blank
    rows go; rows are cut or filled to the header's width, from which trailing columns that are blank in all rows go.
    """
    kept = rows.where(F.exists("cells", lambda c: c != ""))
    used = F.aggregate(F.sequence(F.lit(1), F.size("cells")), F.lit(0), lambda acc, i: F.when(F.element_at(F.col("cells"), i) != "", i).otherwise(acc))
    sheet = ["source", "sheet_name"]
    facts = kept.groupBy(*sheet).agg(F.max(used).alias("width"), F.count("*").alias("row_count"), F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("head_no"))
    body = kept.join(facts.select(*sheet, "head_no", "width"), sheet).where("row_no > head_no")
    body = numbered(body, sheet, "row_no", "nth").withColumn("part", F.floor(F.col("nth") / per_chunk).cast("int") + 1)
    parts = body.groupBy(*sheet, "part").agg(F.min("nth").alias("a"), F.max("nth").alias("b"), _joined(markdown_row(padded(F.col("cells"), F.col("width"))), "nth", "\n").alias("lines"))
    out = facts.join(parts, sheet, "left").withColumn("n_data", F.col("row_count") - 1)
    total = F.ceil(F.col("n_data") / per_chunk).cast("string")
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    info = F.when(F.col("n_data") <= per_chunk, text("全部 ", F.col("n_data"), " 行")).otherwise(text("第 ", F.col("part"), "/", total, " 部分（行 ", F.col("a") + 1, "-", F.col("b") + 1, "）"))
    head = padded(F.col("header"), F.col("width"))
    table = F.concat_ws("\n", markdown_row(head), markdown_row(F.array_repeat(F.lit("---"), F.col("width"))), "lines")
    return out.select(*sheet, F.coalesce("part", F.lit(1)).alias("part"), text(F.col("sheet_name"), "（", info, "）").alias("heading"), "row_count", F.col("width").alias("col_count"), table.alias("page_content"))
