import io
import random
import shutil
import sys
import zipfile

import pytest

from loomlake.functions import text as X
from loomlake.operators import bm25, chunking, fusion, ingest, memory, prompts, terms, vectors
from loomlake.plans.knowledge_base import KnowledgeBase
from loomlake.plans.retrieve import retrieve
from loomlake.plans.snapshots import Snapshots
from loomlake.plans.stores import Cache, Conversations
from loomlake.sources import files
from loomlake.streaming import streams
from pyspark.sql import functions as F


def test_tokens_split_chinese_and_ascii(spark):
    row = spark.createDataFrame([("学习成绩 GPA_3.5 é第一章",)], "s string").select(X.tokens("s")).first()
    assert row[0] == ["学", "习", "成", "绩", "gpa_3", "5", "第", "一", "章"]


def test_split_long_covers_the_text():
    text = " ".join(f"word{i}." for i in range(900))
    parts = chunking.split_long(text)
    assert all(0 < len(p) <= 800 for p in parts) and text.startswith(parts[0]) and text.endswith(parts[-1])
    assert chunking.split_long("x" * 801)[0] == "x" * 800 and chunking.split_long("short") == ["short"]


def test_bm25_against_the_formula(spark):
    import math

    docs = spark.createDataFrame([(1, "a b b c"), (2, "a c"), (3, ""), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "b B zz")], "query_id long, text string")
    hits = bm25.bm25_top(bm25.build_index(docs), q).collect()
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    assert [(h.doc, h.score) for h in hits] == [(1, round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 4 / 1.5)), 6))]


def test_rrf_sums_both_routes(spark):
    rows = spark.createDataFrame([(1, "k", 0, 1), (1, "k", 1, 1), (1, "m", 0, 2)], "query_id long, text_key string, route int, rank int")
    assert [(r.text_key, r.score, r.rank) for r in fusion.rrf(rows, ["query_id"]).orderBy("rank").collect()] == [("k", round(2 / 61, 9), 1), ("m", round(1 / 62, 9), 2)]


def test_rewrite_appends_terms_of_the_dictionary(spark):
    words = spark.createDataFrame([("学习成绩", 1), ("成绩单", 2), ("abcdef", 3)], "term string, dict_pos int")
    q = spark.createDataFrame([(1, "bcd x"), (2, "abcdef bcd"), (3, "")], "query_id long, query string")
    got = {r.query_id: r.rewritten for r in terms.rewrite(q, words).collect()}
    assert got == {1: "bcd x abcdef", 2: "abcdef bcd", 3: ""}


def test_history_and_context_layout(spark):
    turns = spark.createDataFrame([(1, 2, "q2", "a2"), (1, 1, "q1", "a1")], "conv_id long, turn int, query string, answer string")
    assert memory.history_text(turns).first().history == "用户：q1\nAI：a1\n\n用户：q2\nAI：a2"
    row = spark.range(1).select(
        prompts.context_text(F.array(F.struct(F.lit("h").alias("heading"), F.lit("c").alias("chapter"), F.lit("t").alias("page_content"))), F.lit(""), F.lit("")).alias("a"),
        prompts.context_text(F.lit(None), F.lit(None), F.lit(None)).alias("b"),
    ).first()
    assert row.a == "【参考资料 1】\n标题：h\n所属章节：c\n内容：t\n" and row.b == prompts.NOTHING


def test_append_turns_and_merge_records(spark):
    old = spark.createDataFrame([("s", 1, "t1", "q", "a")], "session_id string, turn int, timestamp string, query string, answer string")
    new = spark.createDataFrame([("s", "t3", "q3", "a"), ("s", "t2", "q2", "a"), ("n", "t0", "q", "a")], "session_id string, timestamp string, query string, answer string")
    assert sorted((r.session_id, r.turn, r.timestamp) for r in memory.append_turns(old, new).collect()) == [("n", 1, "t0"), ("s", 1, "t1"), ("s", 2, "t2"), ("s", 3, "t3")]
    merged = memory.merge_records(new, new.withColumn("answer", F.lit("later")), 1).collect()
    assert {(r.session_id, r.timestamp, r.answer) for r in merged} == {("s", "t3", "later"), ("n", "t0", "later")}


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda s: f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('第一章 总则')}{p('1.1 范围')}{p('body')}{table}</w:body></w:document>")
    return out.getvalue()


def _xlsx() -> bytes:
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {s}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="C1" t="inlineStr"><is><t>day</t></is></c></row>'
                   '<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>1.5</v></c><c r="C2" s="1"><v>45292</v></c></row></sheetData></worksheet>')  # fmt: skip
    return out.getvalue()


def test_knowledge_base_reads_replaces_and_searches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_bytes("# Top\n\nalpha beta\r\n\r\n".encode() + b"gamma")
    (src / "g.txt").write_bytes("中文".encode("gbk"))
    (src / "w.docx").write_bytes(_docx())
    (src / "s.xlsx").write_bytes(_xlsx())
    (src / "x.bin").write_bytes(b"no")
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    stats = {r.source: r for r in kb.upload(str(src)).collect()}
    assert stats["a.md"].inserted == 3 and stats["w.docx"].inserted == 1 + 1 and "x.bin" not in stats
    chunks = {(r.source, r.chunk_id): r for r in kb.chunks().collect()}
    assert chunks["g.txt", 1].page_content == "中文" and chunks["a.md", 2].heading == "Top"
    assert chunks["w.docx", 2].page_content == "| a | b |\n| --- | --- |\n| 1 |  |" and chunks["w.docx", 1].chapter == "第一章 总则"
    assert chunks["s.xlsx", 1].page_content == "| id |  | day |\n| --- | --- | --- |\n| 1 | 1.5 | 2024-01-01 00:00:00 |"
    (src / "a.md").write_text("only one")
    again = {r.source: (r.inserted, r.deleted) for r in kb.upload(str(src)).collect()}
    assert again["a.md"] == (1, 3) and again["w.docx"] == (0, 0)
    hits = kb.search(spark.createDataFrame([(1, "only one")], "query_id long, query string"), rewrite=False, top_k=1).collect()
    assert [h.source for h in hits] == ["a.md"]


def test_knowledge_base_chunks_pdf_files(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    src.mkdir()
    (src / "p.PDF").write_bytes(b"1.1 Scope\nbody")
    (src / "a.txt").write_bytes(b"plain")
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    with monkeypatch.context() as m:
        m.setitem(sys.modules, "fitz", None)
        with pytest.raises(ImportError, match="PyMuPDF"):
            kb.upload(str(src))
        assert kb.ledger().isEmpty() and kb.chunks().isEmpty()
        assert kb.parse(files.read_files(spark, str(src)).where("ext = '.txt'")).count() == 1
    # stands for the library, which may not be installed: two pages of the same text
    page = lambda f: f.where("ext = '.pdf'").select("source", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no"), F.col("content").cast("string").alias("text"), F.array(F.lit("i.png")).alias("images"), F.array(F.array(F.array(F.lit("h"), F.lit("k")), F.array(F.lit("1\n2")))).alias("tables"))
    monkeypatch.setattr(files, "pdf_pages", page)
    stats = {r.source: r for r in kb.upload(str(src)).collect()}
    chunks = {r.chunk_id: r for r in kb.chunks().where("source = 'p.PDF'").collect()}
    assert stats["p.PDF"].inserted == 4 == len(chunks) and stats["a.txt"].inserted == 1
    assert (chunks[1].heading, chunks[1].page_content, chunks[1].doc_type, chunks[1].images) == ("1.1 Scope", "body", "paragraph", ["i.png"])
    assert (chunks[2].page_content, chunks[2].doc_type, chunks[2].chapter) == ("| h | k |\n| --- | --- |\n| 1 2 |  |", "table", "第1页")
    assert {r.source for r in kb.ledger().collect()} == {"p.PDF", "a.txt"}


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _pictured() -> bytes:
    p = lambda s, rid=None: f"<w:p><w:r><w:t>{s}</w:t>" + (f'<a:blip r:embed="{rid}"/>' if rid else "") + "</w:r></w:p>"
    cell = lambda s, prop="": f"<w:tc><w:tcPr>{prop}</w:tcPr>{p(s)}</w:tc>"
    start, on, wide = '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:gridSpan w:val="2"/>'
    rows = [cell("h", wide) + cell("k"), cell("a") + cell("b") + cell("up", start), cell("c") + cell("d") + cell("", on), cell("e", wide) + cell("", on)]
    table = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:a="{A}" xmlns:r="{R}"><w:body>{p("1.1 x")}{p("one", "r2")}{p("", "r1")}{p("two", "r2")}{p("", "r9")}{table}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="media/image1.JPG"/><Relationship Id="r2" Target="media/image.emf"/></Relationships>')
        z.writestr("word/media/image1.JPG", b"12")
        z.writestr("word/media/image.emf", b"123")
    return out.getvalue()


def test_images_and_merged_cells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "w.docx").write_bytes(_pictured())
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.upload(str(tmp_path / "in"), describe=ingest.image_text)
    chunks = {r.chunk_id: r for r in kb.chunks().collect()}
    # r2 stands before r1 in the chunk, an unknown id goes, a repeated one counts once
    assert chunks[1].images == ["image_0002.png", "image_0001.jpg"] and chunks[1].image_count == 2
    assert chunks[1].image_description == "图片 1：image.emf，3 字节\n图片 2：image1.JPG，2 字节" and chunks[2].image_description == ""
    assert chunks[2].page_content == "| h | k |  |\n| --- | --- | --- |\n| a | b | up |\n| c | d | up |\n| e | up |  |"


def test_a_broken_upload_is_made_good_by_the_next(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"f{k}.txt").write_text(f"text number {k}")
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.upload(str(src))
    (src / "f1.txt").write_text("another text")
    write, n_writes = Snapshots.write, [0]

    def counts(self, *args):
        n_writes[0] += 1
        return write(self, *args)

    with monkeypatch.context() as m:  # the same upload into a copy tells how many parts are written
        m.setattr(Snapshots, "write", counts)
        shutil.copytree(tmp_path / "kb", tmp_path / "copy")
        KnowledgeBase(spark, str(tmp_path / "copy")).upload(str(src))
    assert n_writes[0] >= 9
    before = sorted(kb.index().postings.collect())
    for dies_at in {0, n_writes[0] // 2, n_writes[0]}:
        left = [dies_at]

        def breaks(self, *args):
            left[0] -= 1
            if left[0] < 0:
                raise OSError("lost")
            return write(self, *args)

        with monkeypatch.context() as m:
            m.setattr(Snapshots, "write", breaks)
            m.setattr(Snapshots, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                kb.upload(str(src))
        assert sorted(kb.index().postings.collect()) == before and kb.ledger().count() == 3
    assert kb.chunks().count() == 3
    stats = {r.source: r for r in kb.upload(str(src)).collect()}
    assert (stats["f1.txt"].inserted, stats["f1.txt"].deleted) == (1, 1) and (stats["f0.txt"].inserted, stats["f0.txt"].skipped) == (0, 1)
    assert sorted(r.page_content for r in kb.chunks().collect()) == ["another text", "text number 0", "text number 2"]
    # all tables agree, also with an index that is built anew
    fresh = bm25.build_index(kb.chunks(), "chunk", "page_content")
    assert sorted(kb.index().postings.collect()) == sorted(fresh.postings.collect()) and kb.index().corpus_stats.first() == fresh.corpus_stats.first()
    kb.delete("f1.txt")
    assert sorted(r.source for r in kb.sources().collect()) == ["f0.txt", "f2.txt"] and kb.index().corpus_stats.first().n == 2
    # what is not a table is no empty one
    (tmp_path / "bad" / "log").mkdir(parents=True)
    (tmp_path / "bad" / "log" / "x.parquet").write_text("no")
    with pytest.raises(Exception):
        KnowledgeBase(spark, str(tmp_path / "bad")).chunks().collect()


def test_stream_feeds_the_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one two")
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    feed = lambda: streams.feed(kb, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination(120)
    feed()
    (tmp_path / "in" / "b.md").write_text("# T\n\nthree")
    feed()
    assert {(r.source, r.page_content) for r in kb.chunks().collect()} == {("a.txt", "one two"), ("b.md", "# T"), ("b.md", "three")}
    turns = spark.createDataFrame([("s", f"t{k}", f"q{k}", "a") for k in range(8)], "session_id string, timestamp string, query string, answer string")
    turns.write.parquet(str(tmp_path / "turns"))
    live = streams.last_turns_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), 3)
    q = live.writeStream.format("memory").queryName("last_turns").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("last_turns").collect()[-1].turns == ["q5\na", "q6\na", "q7\na"]


def test_stores_of_conversations_and_caches(spark, tmp_path):
    store = Conversations(spark, str(tmp_path / "c"))
    assert store.count() == 0
    new = lambda *rows: spark.createDataFrame(rows, "session_id string, timestamp string, query string, answer string, context string")
    store.save(new(("c:1", "2024-01-01 00:00:00", "q", "a", "x"), ("c:1", "2024-01-01 01:00:00", "q2", "a", "x"), ("d:1", "2023-01-01 00:00:00", "q", "a", None)))
    store.save(new(("c:1", "2024-01-01 02:00:00", "q3", "a", "x")))
    assert sorted((r.session_id, r.turn) for r in store.load().collect()) == [("c:1", 1), ("c:1", 2), ("c:1", 3), ("d:1", 1)]
    assert [(r.session_id, r.turns) for r in store.sessions("c").collect()] == [("c:1", 3)] and store.sessions(limit=1).count() == 1
    assert {r.session_id for r in store.live(F.lit("2024-01-02 00:00:00").cast("timestamp"), 86400).collect()} == {"c:1"}
    store.clear_sessions(new(("c:1", "", "", "", "")))
    assert store.count() == 1
    store.clear()
    assert store.count() == 0 and store.history().count() == 0
    cache = Cache(spark, str(tmp_path / "k"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    cache.put(spark.createDataFrame([("answer:1", "old"), ("other:1", "x")], "key string, payload string").withColumn("written_at", at), 10)
    cache.put(spark.createDataFrame([("answer:1", "new")], "key string, payload string").withColumn("written_at", at + F.make_interval(secs=F.lit(5))), 10)
    keys = spark.createDataFrame([("answer:1",), ("other:1",), ("none",)], "key string")
    assert {(r.key, r.payload) for r in cache.get(keys, at + F.make_interval(secs=F.lit(12))).collect()} == {("answer:1", "new")}
    cache.invalidate()
    assert {r.key for r in cache.get(keys, at).collect()} == {"other:1"}


def test_scalar_forms(spark):
    row = spark.range(1).select(
        X.markdown_html(F.lit("**a<b** `c`\nd")).alias("html"), X.new_session_id(F.lit("c")).alias("sid"), X.cut_text(F.lit("abcdef"), 3).alias("cut"),
        files.is_supported(F.lit("a/b.XLSX")).alias("yes"), files.is_supported(F.lit("b.exe")).alias("no"), ingest.as_list(F.lit("x")).alias("l"),
    ).first()
    assert row.html == "<strong>a&lt;b</strong> <code>c</code><br>d" and row.sid.startswith("c:") and len(row.sid) == 38
    assert (row.cut, row.yes, row.no, row.l) == ("abc", True, False, ["x"])


def test_long_texts_are_cut_as_the_rule_says():
    def plain(text, size, overlap):
        out, start = [], 0
        while True:
            end = start + size
            if end < len(text):
                window = range(max(start + 1, end - overlap), end)
                kinds = [s for s in chunking.SEPARATORS if any(text[i] == s for i in window)]
                if kinds:
                    end = max(i for i in window if text[i] == kinds[0]) + 1
            out.append(text[start:end].strip())
            if end >= len(text):
                return [x for x in out if x]
            start = max(start + 1, end - overlap)

    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("ab .,\n。x") for _ in range(rng.randint(31, 200)))
        assert chunking.split_long(t, 30, 8) == plain(t, 30, 8)


def test_numbers_within_groups(spark):
    rows = spark.createDataFrame([("a", 3 * k) for k in range(50)] + [("b", -5), ("b", 7)], "g string, n long")
    got = chunking.numbered(rows, ["g"], "n", "nth", block=10).collect()
    assert all(r.nth == r.n // 3 for r in got if r.g == "a") and {(r.n, r.nth) for r in got if r.g == "b"} == {(-5, 0), (7, 1)}


def test_saved_index_and_ties(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x y"), (2, "y z")], "doc_id long, text string")
    index = bm25.build_index(docs)
    index.save(str(tmp_path / "i"))
    q = spark.createDataFrame([(0, "y z")], "query_id long, text string")
    want = bm25.bm25_top(index, q).collect()
    assert bm25.bm25_top(bm25.Index.load(spark, str(tmp_path / "i")), q).collect() == want == bm25.bm25_top(bm25.index_for(docs, q), q).collect()
    vecs = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    near = vectors.nearest(vecs, vecs.where("vec_id = 1").withColumnRenamed("vec_id", "query_id"), 3).collect()
    assert [r.doc for r in sorted(near, key=lambda r: r["rank"])] == [1, 3, 5]
    assert vectors.nearest(vecs, vecs.where("false").withColumnRenamed("vec_id", "query_id"), 3).count() == 0


def test_bad_word_file_is_named(spark):
    rows = spark.createDataFrame([("bad.docx", bytearray(b"zip?"), ".docx")], "source string, content binary, ext string")
    with pytest.raises(Exception, match="bad.docx"):
        files.docx_blocks(rows).collect()


def test_stream_of_files_and_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one two")
    got = []
    streams.ingest_stream(streams.file_stream(spark, str(tmp_path / "in")), lambda df, _: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.source, r.content) for r in got] == [("a.txt", "one two")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts")
    events.write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = streams.session_stream(live).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user_id, r.n) for r in spark.table("sessions").collect()) == sorted((r.user_id, r.n) for r in memory.renewed_sessions(events).collect())


def test_retrieve_without_vectors(spark):
    chunks = spark.createDataFrame([(1, "x y"), (2, "y z"), (3, "x y")], "chunk long, page_content string")
    q = spark.createDataFrame([(5, "x")], "query_id long, query string")
    assert [(r.query_id, r.chunk, r["rank"]) for r in retrieve(chunks, q, embed=None).collect()] == [(5, 1, 1)]
