"""Readers of text, Markdown, Word and sheet files: one row for each file is scanned, and each file is parsed in its task.

Files are routed by extension. Word and sheet files are zip archives of XML and need no library; PDF needs one that reads
pages, which is asked for only when a PDF is read.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.text import markdown_row, padded

# Extensions of files that are read.
EXTENSIONS = (".docx", ".md", ".pdf", ".txt", ".xls", ".xlsx")
# Encodings of text files in order of trial; the last takes any bytes.
ENCODINGS = ("utf-8-sig", "gbk", "latin-1")

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\.[^./\\]+)$", 1))


def is_supported(path: str | Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, content, md5, ext) of the files under a path with a supported extension; source is the file's name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "content", F.md5("content").alias("md5"), extension("path").alias("ext"))
    return rows.where(F.col("ext").isin(*EXTENSIONS))


def decode(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def texts(files: DataFrame) -> DataFrame:
    """(source, text) of text and Markdown files."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            yield pa.array([None if c is None else decode(c) for c in contents.to_pylist()], pa.string())

    return files.where(F.col("ext").isin(".txt", ".md")).select("source", F.arrow_udf(read, "string")("content").alias("text"))


def word_blocks(content: bytes) -> Iterator[tuple[str, str, list[str], list[list[str]]]]:
    """(kind, text, image ids, cells) of the paragraphs and tables of a Word file's body, in order.

    A cell that spans columns stands once in its row; one that goes on from the row above has that row's text again.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            images = [v for x in node.iter() if x.tag.endswith("}blip") and (v := x.get(f"{_R}embed"))]
            yield "p", text(node), images, []
        elif node.tag == f"{_W}tbl":
            yield "tbl", "", [], _table_cells(node, text)


def _table_cells(table: ElementTree.Element, text) -> list[list[str]]:
    above: dict[int, str] = {}  # column of the grid -> text of the cell that may go on below
    rows = []
    for row in table.findall(f"{_W}tr"):
        cells, at = [], 0
        for c in row.findall(f"{_W}tc"):
            props = c.find(f"{_W}tcPr")
            span = props.find(f"{_W}gridSpan") if props is not None else None
            merge = props.find(f"{_W}vMerge") if props is not None else None
            own = "\n".join(text(p) for p in c.findall(f"{_W}p")).strip().replace("\n", " ").replace("\r", "")
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue":
                own = above.get(at, own)
            above[at] = own
            cells.append(own)
            at += int(span.get(f"{_W}val", 1)) if span is not None else 1
        rows.append(cells)
    return rows


def word_images(content: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(relationship id, file name, bytes) of the images of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        rels = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else ()
        for rel in rels:
            target = rel.get("Target", "")
            if "image" in target and (name := "word/" + target.lstrip("/")) in names:
                yield rel.get("Id"), target.rsplit("/", 1)[-1], z.read(name)


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a sheet file, cells as text: numbers as they print, dates as date and time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        xml = lambda name: ElementTree.fromstring(z.read(name)) if name in names else ()
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in xml("xl/sharedStrings.xml")]
        styles = xml("xl/styles.xml")
        own = {f.get("numFmtId"): f.get("formatCode", "") for f in (styles.iter(f"{_S}numFmt") if styles else ())}
        formats = [x.get("numFmtId") for x in (styles.find(f"{_S}cellXfs") or ())] if styles else []
        is_date = [f.isdigit() and 14 <= int(f) <= 22 or bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(f, "")), re.I)) for f in (x or "" for x in formats)]
        targets = {r.get("Id"): r.get("Target", "") for r in xml("xl/_rels/workbook.xml.rels")}
        for sheet in xml("xl/workbook.xml").iter(f"{_S}sheet"):
            target = targets.get(sheet.get(f"{_R}id"), "")
            for row in xml(target.lstrip("/") if target.startswith("/") else "xl/" + target).iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    letters = re.match("[A-Z]+", c.get("r", ""))
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    cells += [""] * (at - len(cells)) + [_cell(c, shared, is_date)]
                yield sheet.get("name"), int(row.get("r", 0)), cells


def new_sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """`sheet_rows`; the older .xls format is refused."""
    if content[:4] == b"\xd0\xcf\x11\xe0":
        raise ValueError("the older .xls format is not supported: save it as .xlsx")
    yield from sheet_rows(content)


def _cell(c: ElementTree.Element, shared: list[str], is_date: list[bool]) -> str:
    kind, v = c.get("t", "n"), c.findtext(f"{_S}v")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
    elif v is None:
        text = ""
    elif kind == "s":
        text = shared[int(v)]
    elif kind == "b":
        text = str(v == "1")
    elif kind in ("str", "e"):
        text = v
    else:
        number, style = float(v), int(c.get("s", 0))
        if style < len(is_date) and is_date[style]:
            text = str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(number * 86400)))
        else:
            text = str(int(number)) if re.fullmatch(r"-?\d+", v) else repr(number)
    return text.strip().replace("\n", " ")


def _exploded(files: DataFrame, exts: tuple[str, ...], rows_of, kind: str, schema: pa.Schema) -> DataFrame:
    """A row for each of rows_of(content), after source; a file that can't be parsed fails with its name."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, content in zip(b.column("source").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows = [(source, i, *r) for i, r in enumerate(rows_of(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    raise ValueError(f"{source} is not a {exts[0]} file: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.where(F.col("ext").isin(*exts)).select("source", "content").mapInArrow(parse, kind)


def broken_files(files: DataFrame) -> DataFrame:
    """(source, md5, error) of the Word and sheet files that can't be parsed; each is tried in its task, and no other fails with it."""
    parsers = {".docx": (word_blocks, word_images), ".xlsx": (new_sheet_rows,), ".xls": (new_sheet_rows,)}
    schema = pa.schema([("source", pa.string()), ("md5", pa.string()), ("error", pa.string())])

    def attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for source, md5, ext, content in zip(*[b.column(c).to_pylist() for c in ("source", "md5", "ext", "content")], strict=True):
                try:
                    for parser in parsers[ext]:
                        for _ in parser(content or b""):
                            pass
                except Exception as e:  # whatever is wrong with a file is said in its row
                    found.append((source, md5, f"{source}: {type(e).__name__}: {e}"[:500]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], schema=schema)

    return files.where(F.col("ext").isin(*parsers)).select("source", "md5", "ext", "content").mapInArrow(attempt, "source string, md5 string, error string")


def docx_blocks(files: DataFrame) -> DataFrame:
    """(source, block_no, kind, text, images, cells) of Word files; a table's text is its Markdown."""
    schema = pa.schema([("source", pa.string()), ("block_no", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("images", pa.list_(pa.string())), ("cells", pa.list_(pa.list_(pa.string())))])
    rows = _exploded(files, (".docx",), word_blocks, "source string, block_no int, kind string, text string, images array<string>, cells array<array<string>>", schema)
    width = F.array_max(F.transform("cells", F.size))
    lines = F.transform("cells", lambda r: markdown_row(padded(r, width)))
    table = F.concat_ws("\n", F.element_at(lines, 1), markdown_row(F.array_repeat(F.lit("---"), width)), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n"))
    return rows.withColumn("text", F.when((F.col("kind") == "tbl") & (F.size("cells") > 0), table).otherwise(F.col("text")))


def docx_images(files: DataFrame) -> DataFrame:
    """(source, nth, rid, filename, image) of the images of Word files."""
    schema = pa.schema([("source", pa.string()), ("nth", pa.int32()), ("rid", pa.string()), ("filename", pa.string()), ("image", pa.binary())])
    return _exploded(files, (".docx",), word_images, "source string, nth int, rid string, filename string, image binary", schema)


def xlsx_rows(files: DataFrame) -> DataFrame:
    """(source, nth, sheet_name, row_no, cells) of sheet files; the older .xls format is refused."""
    schema = pa.schema([("source", pa.string()), ("nth", pa.int32()), ("sheet_name", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])
    return _exploded(files, (".xlsx", ".xls"), new_sheet_rows, "source string, nth int, sheet_name string, row_no int, cells array<string>", schema)


def pdf_pages(files: DataFrame) -> DataFrame:
    """(source, page_no, text, images, tables) of PDF files, by PyMuPDF if it is installed.

    images are the names of the page's images, tables the cells of its tables; a page whose images or tables can't be read
    has none.
    """
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF files needs PyMuPDF") from e

    def pages(content: bytes):
        with fitz.open(stream=content, filetype="pdf") as doc:
            for nth, page in enumerate(doc, 1):
                try:
                    images = [f"pdf_p{nth:03d}_{k:02d}.{doc.extract_image(x[0])['ext']}" for k, x in enumerate(page.get_images(full=True), 1)]
                except (RuntimeError, ValueError, KeyError):
                    images = []
                try:
                    tables = [[[c or "" for c in row] for row in t.extract()] for t in page.find_tables().tables]
                except (RuntimeError, ValueError, AttributeError):
                    tables = []
                yield page.get_text(), images, tables

    cells = pa.list_(pa.list_(pa.list_(pa.string())))
    schema = pa.schema([("source", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("images", pa.list_(pa.string())), ("tables", cells)])
    kind = "source string, page_no int, text string, images array<string>, tables array<array<array<string>>>"
    return _exploded(files, (".pdf",), pages, kind, schema).withColumn("page_no", F.col("page_no") + 1)
