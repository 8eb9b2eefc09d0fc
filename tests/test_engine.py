import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.operators import cache, compress, memory, prompts, stats
from docloom.config import Settings
from docloom.plans.engine import Engine
from docloom.providers import Providers
from docloom.sources.files import check_uploads, listing, read_documents
from docloom.streaming.ingest import ingest_stream, usage_stream

_WNS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SNS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RNS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def make_files(folder):
    (folder / "a.txt").write_text("Plain text. Étage two! The end of it.", encoding="utf-8")
    (folder / "b.md").write_text("# Head\n\nSome **bold** words.", encoding="utf-8")
    (folder / "c.csv").write_text("x,y\n1,aa\n2,b\n")
    (folder / "d.html").write_text("<html><style>p{}</style><p>Hi &amp; bye</p></html>")
    (folder / "e.json").write_text(json.dumps({"k": [1, {"z": "é"}]}))
    (folder / "f.bin").write_bytes(b"\x00\x01")
    with zipfile.ZipFile(folder / "g.docx", "w") as z:
        paragraphs = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in ["First", " ", "Third"])
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_WNS}"><w:body>{paragraphs}</w:body></w:document>')
    with zipfile.ZipFile(folder / "h.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SNS}" xmlns:r="{_RNS}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_SNS}"><si><t>name</t></si><si><t>n</t></si><si><t>ab</t></si></sst>')
        z.writestr(
            "xl/worksheets/s.xml",
            f'<worksheet xmlns="{_SNS}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
            '<row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>',
        )
    (folder / "i.pdf").write_bytes(b"page one|| |page three")
    (folder / "j.docx").write_bytes(b"broken")
    (folder / "k.json").write_text('{"k": ')
    (folder / "l.txt").write_bytes("Étage".encode("latin-1"))


def pages(content: bytes) -> list[str]:
    return content.decode().split("|")


@pytest.fixture()
def folder(tmp_path):
    path = tmp_path / "files"
    path.mkdir()
    make_files(path)
    return path


def test_readers(spark, folder):
    rows = read_documents(spark, str(folder), pdf_reader=pages).collect()
    found = {r.chunk_id: r for r in rows if r.chunk_id}
    assert found["a_full"].text == "Plain text. Étage two! The end of it."
    assert found["b_md"].text == "Head\n\nSome bold words." and found["b_md"].raw.startswith("# Head")
    frame = pd.DataFrame({"x": [1, 2], "y": ["aa", "b"]})
    assert found["c_csv"].text == "CSV Data Summary:\nColumns: x, y\nRows: 2\n\n" + frame.to_string(index=False)
    assert found["c_csv"].rows == 2 and found["c_csv"].columns == ["x", "y"]
    assert found["d_html"].text == "Hi & bye"
    assert found["e_json"].text == "JSON Data:\n" + json.dumps({"k": [1, {"z": "é"}]}, indent=2)
    assert found["g_para_1"].text == "First" and found["g_para_3"].paragraph_number == 3 and "g_para_2" not in found
    sheet = pd.DataFrame({"name": ["ab"], "n": [7]})
    assert found["h_One"].text == "Sheet: One\nColumns: name, n\nRows: 1\n\n" + sheet.to_string(index=False)
    assert found["i_page_1"].page_number == 1 and found["i_page_4"].text == "page three" and "i_page_2" not in found
    errors = {r.source.rsplit("/", 1)[1]: r.error for r in rows if r.error}
    assert errors["f.bin"] == "Unsupported format: .bin" and "BadZipFile" in errors["j.docx"] and len(errors) == 4
    assert errors["k.json"] == "Invalid JSON" and errors["l.txt"] == "Not valid UTF-8 text"


def test_limits_and_strict(spark, folder):
    with pytest.raises(ValueError, match="Unsupported format: .bin"):
        read_documents(spark, str(folder), strict=True)
    rows = read_documents(spark, str(folder / "a.txt"), max_bytes=10).collect()
    assert [(r.text, r.error) for r in rows] == [(None, "File size exceeds 0MB limit")]
    checks = {r.filename: r.error for r in check_uploads(listing(spark, str(folder)), Settings(max_upload_bytes=30)).collect()}
    assert checks["f.bin"] == "File type 'bin' not supported" and checks["a.txt"] == "File size exceeds 0MB limit"
    assert checks["c.csv"] is None


def test_pdf_needs_a_reader(spark, folder):
    row = read_documents(spark, str(folder / "i.pdf")).first()
    assert "pdf_reader" in row.error


@pytest.mark.parametrize("sharded", [False, True])
def test_engine_end_to_end(spark, folder, tmp_path, sharded):
    engine = Engine(spark, str(tmp_path / "store"), providers=Providers(pdf_reader=pages), sharded=sharded)
    report = {r.filename: r for r in engine.ingest(str(folder)).collect()}
    assert report["a.txt"].success and report["a.txt"].chunks_processed == 1
    assert not report["f.bin"].success and not report["j.docx"].success
    assert report["k.json"].error == "Invalid JSON" and not report["l.txt"].success
    before = engine.chunks.all().count()
    assert {r.filename: r.chunks_processed for r in engine.ingest(str(folder)).collect()}["a.txt"] == 1
    assert engine.chunks.all().count() == before
    source = engine.chunks.all().where(F.col("source").endswith("a.txt")).first()["source"]
    assert engine.chunks.for_source(source).count() == 1
    queries = spark.createDataFrame([(0, "plain text étage"), (1, "explain yield() bold words")], "query_id int, text string")
    for mode in ("semantic", "keyword", "hybrid", "two_way", "technical"):
        top = engine.search(queries, 3, mode).where("query_id = 0 AND rank = 1").first()
        assert top.source.endswith("a.txt"), mode
    with pytest.raises(ValueError):
        engine.search(queries, 3, "other")
    routed = engine.routed_search(queries, 3, "keyword").collect()
    direct = engine.search(queries, 3, "keyword").where("query_id = 0").collect()
    assert sorted(r.id for r in routed if r.query_id == 0) == sorted(r.id for r in direct)
    technical = [r for r in routed if r.query_id == 1]  # asked in its variants, each text once
    assert 0 < len(technical) <= 3 and len({r.text for r in technical}) == len(technical)
    asked = queries.withColumn("session_id", F.lit("s1"))
    first = {r.query_id: r for r in engine.query(asked, k=4, mode="semantic").collect()}
    assert "Plain text." in first[0].answer and not first[0].cached and first[0].search_mode == "semantic"
    assert first[0].sources[0].endswith("a.txt") and first[0].context_chunks > 0
    assert first[1].classification.type == "technical" and first[1].technical_validation is not None
    again = {r.query_id: r for r in engine.query(asked, k=4, mode="semantic").collect()}
    assert again[0].cached and again[0].answer == first[0].answer
    assert engine.stats()["active_sessions"] == 1
    engine.trim_history()
    engine.clear_session("s1")
    engine.clear_cache()
    assert engine.stats()["active_sessions"] == 0 and not engine.stats()["cache_available"]
    assert engine.analyze().where("part = 'documents'").first()["value"] == engine.stats()["documents_indexed"]


def test_engine_with_parents(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "long.txt").write_text(" ".join(f"w{i}" for i in range(600)))
    engine = Engine(spark, str(tmp_path / "store"))
    engine.ingest(str(path), hierarchy=True)
    assert engine.children.all().count() == 4
    queries = spark.createDataFrame([(0, "w200 w201 w202 w203")], "query_id int, text string")
    top = engine.search(queries, 1, "parent").first()
    words = top.parent_context.split()
    index = int(top.chunk_id.rsplit("_", 1)[1])
    assert words[0] == f"w{max(0, index * 250 - 250)}" and words[-1] == f"w{min(599, index * 250 + 499)}"
    answer = engine.query("w200 w201 w202 w203", k=2).first()
    assert answer.success and answer.context_chunks == 2


def test_cache_levels(spark):
    rows = spark.sql(
        "SELECT concat('q', id) AS query, concat('v', id) AS value, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS created_at FROM range(20)"
    )
    again = spark.sql("SELECT ' Q3 ' AS query, 'new' AS value, timestamp'2024-01-01 00:01:00' AS created_at")
    stored = cache.newest(cache.entries(rows.unionByName(again), 3600))
    assert stored.count() == 20
    recent = cache.newest(cache.entries(rows.unionByName(again).where("created_at >= timestamp'2024-01-01 00:00:15'"), 60))
    levels = [recent, stored]
    asked = spark.createDataFrame([("q3",), ("q19",), ("Q1 ",), ("none",)], "query string")
    at = lambda x: {r["query"]: (r["value"], r["level"]) for r in cache.lookup(asked, levels, F.lit(x).cast("timestamp")).collect()}
    assert at("2024-01-01 00:01:01") == {"q3": ("new", 1), "q19": ("v19", 1), "Q1 ": ("v1", 2), "none": (None, None)}
    assert at("2024-01-01 00:59:00")["q19"] == ("v19", 2)
    assert at("2024-01-01 02:00:00")["q3"] == (None, None)


def test_memory(spark):
    turns = [("s", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(30)]
    pairs = memory.question_answer_pairs(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string"))
    assert memory.last_turns(pairs).count() == 10
    text = memory.session_context(pairs).first()["context"]
    assert text == "".join(f"Previous Q: t{i}\nPrevious A: t{i + 1}\n\n" for i in (24, 26, 28))
    assert memory.without_session(pairs, "s").count() == 0


def test_compression_stops_at_first_overflow(spark):
    queries = spark.createDataFrame([(0, "alpha beta")], "query_id int, text string")
    rows = [(0, 1, 1, "alpha beta " * 20), (0, 2, 2, "alpha gamma " * 40), (0, 3, 3, "delta")]
    chunks = spark.createDataFrame(rows, "query_id int, rank int, id int, text string")
    kept = compress.compress_context(chunks, queries, 100).orderBy("position").collect()
    assert [r.id for r in kept] == ["1"]
    assert compress.compress_context(chunks, queries, 10_000).count() == 3
    model = lambda text: F.upper(F.left(text, F.lit(5)))
    wide = chunks.withColumn("text", F.repeat("text", 5))
    shrunk = compress.compress_context(wide, queries, 50, model=model).orderBy("position").collect()
    assert [r.text for r in shrunk][:2] == ["ALPHA", "ALPHA"] and shrunk[0].compression_method == "abstractive"


def test_prompts(spark):
    from docloom.functions.classify import classify_query

    df = spark.createDataFrame([("yield() vs join()", "ctx")], "q string, c string")
    q, c = F.col("q"), F.col("c")
    row = df.select(
        prompts.technical_prompt(q, c, classify_query(q), F.lit("")).alias("t"),
        prompts.enhanced_prompt(q, c, F.lit("summary"), F.lit("before")).alias("e"),
        prompts.plain_prompt(q, c).alias("p"),
        prompts.verification_prompt(q, F.lit("ans"), c).alias("v"),
    ).first()
    assert row.t.startswith("Compare join, yield") and "before" in row.e and row.e.startswith(prompts.SYSTEM["summary"])
    assert row.p.startswith(prompts.SYSTEM["question"]) and "ans" in row.v


def test_running_mean(spark):
    log = spark.sql("SELECT timestamp'2024-01-01' + make_dt_interval(0, id) AS ts, double(id) AS seconds, id = 1 AS cached FROM range(4)")
    found = [(r.total_queries, r.average_response_time) for r in stats.running_mean(log).orderBy("period").collect()]
    assert found == [(1, 0.0), (2, 1.0), (3, round(5 / 3, 4))]


def test_file_stream(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    for _ in range(2):
        run = ingest_stream(engine, str(folder), str(tmp_path / "cp"), files_per_batch=3).trigger(availableNow=True).start()
        run.awaitTermination(120)
    sources = [r.source.rsplit("/", 1)[1] for r in engine.chunks.all().select("source").collect()]
    assert sorted(set(sources)) == ["a.txt", "b.md", "c.csv", "d.html", "e.json", "g.docx", "h.xlsx"]
    assert sources.count("a.txt") == 1
    failed = {r.source.rsplit("/", 1)[1]: r.error for r in engine.errors.all().collect()}
    assert failed.keys() == {"f.bin", "i.pdf", "j.docx", "k.json", "l.txt"}


def test_rejected_uploads_are_not_stored(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "x.md").write_text("kept out")
    (path / "y.txt").write_text("kept in")
    engine = Engine(spark, str(tmp_path / "store"), Settings(upload_types=("txt",)))
    report = {r.filename: r for r in engine.ingest(str(path)).collect()}
    assert not report["x.md"].success and report["x.md"].chunks_processed == 0
    assert [r.text for r in engine.chunks.all().select("text").collect()] == ["kept in"]


def test_usage_stream(spark, tmp_path):
    log = spark.sql("SELECT timestamp'2024-01-01' + make_dt_interval(0, 0, id) AS ts, double(id) AS seconds, id % 2 = 0 AS cached FROM range(30)")
    log.write.parquet(str(tmp_path / "log"))
    stream = usage_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    run = stream.writeStream.format("memory").queryName("usage").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = {r.start.minute: (r.queries, r.cache_hits) for r in spark.table("usage").collect()}
    assert found[0] == (5, 3) and found[5] == (5, 2)
