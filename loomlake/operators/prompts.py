"""Context and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a reader of contexts and prompts expects.
NOTHING = "无相关参考资料"
SYSTEM = (
    "你是一个专业的文档问答助手。请根据提供的参考资料，简洁准确地回答用户问题。\n规则：\n1. 以参考资料为主要依据，不要凭空编造\n"
    "2. 如果参考资料包含图片描述，请结合图片信息回答\n3. 如果参考资料不足以回答问题，请如实告知\n4. 答案要结构化、条理清晰，简洁明了，控制在200字以内"
)


def context_text(docs: Column, images: Column, history: Column) -> Column:
    """A context of docs (array of heading, chapter, page_content, in order), image texts and history; nulls are empty."""
    docs = F.coalesce(docs, F.array().cast("array<struct<heading:string,chapter:string,page_content:string>>"))
    images, history = F.coalesce(images, F.lit("")), F.coalesce(history, F.lit(""))

    def part(d: Column, i: Column) -> Column:
        chapter = F.when(F.coalesce(d.chapter, F.lit("")) != "", F.concat(F.lit("所属章节："), d.chapter, F.lit("\n"))).otherwise("")
        return F.concat(F.lit("【参考资料 "), (i + 1).cast("string"), F.lit("】\n标题："), F.coalesce(d.heading, F.lit("无标题")), F.lit("\n"), chapter, F.lit("内容："), d.page_content, F.lit("\n"))

    n_images = F.size(F.filter(F.split(images, "\n"), lambda x: F.trim(x) != ""))
    parts = F.concat(
        F.when(history != "", F.array(F.concat(F.lit("【历史对话】\n"), history, F.lit("\n")))).otherwise(F.array().cast("array<string>")),
        F.transform(docs, part),
        F.when(images != "", F.array(F.concat(F.lit("\n【关联图片描述】（共 "), n_images.cast("string"), F.lit(" 张）\n"), images, F.lit("\n")))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.size(parts) == 0, NOTHING).otherwise(F.array_join(parts, "\n"))


def prompt_text(context: Column, query: Column) -> Column:
    return F.concat(F.lit(SYSTEM + "\n\n参考资料：\n"), context, F.lit("\n\n用户问题："), query)


def extractive_answer(docs: Column) -> Column:
    """A stand-in for a language model: the first sentence of the first document."""
    first = F.element_at(docs, 1).page_content
    return F.when(F.size(docs) > 0, F.regexp_extract(first, r"(?s)^(.*?[.。!！?？\n]|.*$)", 1)).otherwise("")


def contexts(hits: DataFrame, history: DataFrame | None = None, by: str = "query_id") -> DataFrame:
    """(by, docs): the documents of each query as an array in order of rank. hits: (by, rank, heading, chapter, page_content)."""
    rows = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "heading", "chapter", "page_content"))).alias("x"))
    rows = rows.select(by, F.transform("x", lambda x: F.struct(x.heading.alias("heading"), x.chapter.alias("chapter"), x.page_content.alias("page_content"))).alias("docs"))
    return rows if history is None else rows.join(history, by, "left")
