"""Column functions on texts: tokens, headings, Markdown tables, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[一-鿿]|[a-z0-9_]+"
CHINESE = r"^[一-鿿]+$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores, and single Chinese characters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))


def strip(text: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def text_key(text: str | Column) -> Column:
    return F.md5(_col(text))


def heading_level_docx(line: str | Column) -> Column:
    """1 to 4 for numbered headings of text documents, null for body text. Dots are counted over the whole line."""
    c = _col(line)
    parts = F.size(F.split(c, r"\."))
    return (
        F.when(c.rlike("^第[一二三四五六七八九十]+章"), 1)
        .when(c.rlike(r"^[0-9]+\.[0-9]+"), F.when(parts == 2, 2).when(parts == 3, 3))
        .when(c.rlike(r"^[0-9]+\s*[、．]"), 2)
        .when(c.rlike(r"^\([一二三四五六七八九十0-9]+\)"), 3)
        .when(c.rlike(r"^[（(][0-9]+[）)]"), 4)
        .cast("int")
    )


def heading_level_pdf(line: str | Column) -> Column:
    """1 to 3 for numbered headings of pages, null for body text and for lines of over 100 characters."""
    c = strip(line)
    parts = F.size(F.split(c, r"\."))
    return (
        F.when((F.length(c) == 0) | (F.length(c) > 100), None)
        .when(c.rlike("^第[一二三四五六七八九十]+[章节]"), 1)
        .when(c.rlike(r"^[0-9]+\.[0-9]+"), F.when(parts == 2, 2).otherwise(3))
        .when(c.rlike(r"^[0-9]+\s*[、．.]\s*\S"), 2)
        .when(c.rlike(r"^\([一二三四五六七八九十0-9]+\)"), 3)
        .cast("int")
    )


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def padded(cells: Column, width: Column) -> Column:
    """Cells cut or filled with empty ones to a width."""
    filled = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    return F.slice(filled, F.lit(1), width)


def short_id(session_id: str | Column) -> Column:
    """The first eight characters after the last colon."""
    return F.left(F.substring_index(_col(session_id), ":", -1), F.lit(8))


def html_escape(text: str | Column) -> Column:
    c = _col(text)
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def cut_text(text: str | Column, n: int) -> Column:
    """The first n characters."""
    return F.left(_col(text), F.lit(n))


def new_session_id(client_id: str | Column) -> Column:
    """The id of a new session of a client: its own id, a colon, and a random uuid."""
    return F.concat(_col(client_id), F.lit(":"), F.uuid())


def markdown_html(text: str | Column) -> Column:
    """Escaped text with bold and code spans and line breaks as HTML."""
    c = html_escape(text)
    c = F.regexp_replace(c, r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, "`([^`\n]+)`", "<code>$1</code>")
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def data_url(path: str | Column, content: str | Column) -> Column:
    """An image as a data URL; unknown extensions count as png. Spark may break long base64 into lines: a URL has none."""
    ext = F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(ext == "jpg", "jpeg").when(ext.isin("png", "jpeg", "gif", "bmp", "webp"), ext).otherwise("png")
    whole = F.replace(F.base64(_col(content)), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:image/"), mime, F.lit(";base64,"), whole)
