"""Sources, sinks, text functions and streaming on small hand-made inputs."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import sync
from quarry.sources import files, sinks
from quarry.streaming import sync as stream


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_text_and_csv_units(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\ufeffone\r\n\r\n two\n".encode())
    assert [(r.locator, r.text) for r in files.text_units(spark, f"file://{tmp_path}/a.txt").orderBy("seq").collect()] == [("L1", "one"), ("L3", " two")]
    (tmp_path / "b.csv").write_text("x;y, z;1\n;;\n2;;3\n")
    assert [r.text for r in files.csv_units(spark, f"file://{tmp_path}/b.csv").orderBy("seq").collect()] == ["C1: x | C2: y, z | C3: 1", "C1: 2 | C3: 3"]


def test_office_units(spark, tmp_path):
    w = 'xmlns:w="w"'
    (tmp_path / "a.docx").write_bytes(zipped(**{
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="K"><w:basedOn w:val="H"/></w:style></w:styles>',
        "word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="K"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    }))
    (tmp_path / "b.xlsx").write_bytes(zipped(**{
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row><row r="2"><c r="A2"><f>B1*2</f></c></row><row r="3"/></sheetData></worksheet>',
    }))
    sp = '<p:sp xmlns:p="p"><p:cNvPr id="{i}"/><a:off xmlns:a="a" x="{x}" y="{y}"/><a:p xmlns:a="a"><a:t>{t}</a:t></a:p></p:sp>'
    (tmp_path / "c.pptx").write_bytes(zipped(**{"ppt/slides/slide1.xml": "<s>" + sp.format(i=2, x=5, y=9, t="low") + sp.format(i=3, x=1, y=2, t="high") + "</s>"}))
    (tmp_path / "d.docx").write_bytes(b"no zip")
    got = files.office_units(spark, f"file://{tmp_path}/").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.path, r.seq)):
        by.setdefault(r.path[-6:], []).append((r.level, r.text))
    assert by["a.docx"] == [(2, "Title"), (None, "Body"), (None, "a | b")]
    assert by["b.xlsx"] == [(None, "A1: name | B1: 7"), (None, "A2: [formula not calculated]")]
    assert by["c.pptx"] == [(None, "high"), (None, "low")]
    assert by["d.docx"][0][0] == -1
    starts = files.with_offsets(files.office_units(spark, f"file://{tmp_path}/a.docx"), 3).orderBy("start").collect()
    assert [(r.start, r.text) for r in starts] == [(0, "Tit"), (5, "le"), (9, "Bod"), (14, "y"), (17, "a |"), (22, " b")]


def test_json_keys_and_dependencies(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"id": "a", "n": 1}, {"id": "b", "n": 2}, {"id": "b", "n": 3}]')
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    rows = files.json_records(spark, f"file://{tmp_path}/r.json", schema)
    assert rows.count() == 3
    with pytest.raises(ValueError, match="repeated"):
        files.validated(rows, ["id"])
    known = spark.createDataFrame([("a", "x")], "k string, v string")
    with pytest.raises(ValueError, match="aren't there"):
        files.complete(rows, "id", known, "k")
    assert files.complete(rows.filter("id = 'a'"), "id", known, "k").first().v == "x"


def test_subtitles_round_trip(spark):
    srt = "1\n00:00:01,500 --> 00:00:02,000\nhello\nthere\n\n2\n01:02:03,004 --> 01:02:04,000\nbye\n\nnoise"
    rows = files.parse_srt(spark.createDataFrame([("d", srt), ("e", None)], "k string, t string"), "k", "t")
    assert [tuple(r) for r in rows.orderBy("cue").collect()] == [("d", 0, 1500, 2000, "hello\nthere"), ("d", 1, 3723004, 3724000, "bye")]
    made = {r.k: r.document for r in sinks.subtitles(rows, "k", "cue", "start_ms", "end_ms", "text").collect()}
    assert made["d"] == "1\n00:00:01,500 --> 00:00:02,000\nhello\nthere\n\n2\n01:02:03,004 --> 01:02:04,000\nbye"
    assert sinks.subtitles(rows, "k", "cue", "start_ms", "end_ms", "text", "vtt").first().document.startswith("WEBVTT\n\n00:00:01.500")


def test_ontologies_and_formats(spark, tmp_path):
    edges = spark.createDataFrame([("a", "en", "b", "vi", "Synonym"), ("a", "en", "c", "en", "Synonym"), ("a", "en", "d", "fr", "IsA"), ("a", "en", "e", "en", "IsA"), ("a", "en", "f", "en", "Antonym")], "start string, start_language string, end string, end_language string, rel string")
    assert {(r.dst, r.relation) for r in files.conceptnet_edges(edges).collect()} == {("b", "translation"), ("c", "equivalent"), ("e", "broader")}
    wiki = spark.createDataFrame([("Q1", {"P279": ["Q2"], "P31": ["Q3", "Q4"], "P9": ["Q5"]})], "id string, claims map<string,array<string>>")
    assert {(r.dst, r.relation) for r in files.wikidata_edges(wiki).collect()} == {("Q2", "broader"), ("Q3", "related"), ("Q4", "related")}
    for name, raw in (("a.pdf", b"%PDF-1.7"), ("b.pdf", b"PK\3\4"), ("c.txt", b"plain"), ("d.txt", b"\xff\xfe\0"), ("e.exe", b"MZ"), ("f.csv", b"\0")):
        (tmp_path / name).write_bytes(raw)
    got = {r.path[-5:]: r.verdict for r in files.format_check(spark.read.format("binaryFile").load(f"file://{tmp_path}/")).collect()}
    assert got == {"a.pdf": "OK", "b.pdf": "WRONG_SIGNATURE", "c.txt": "OK", "d.txt": "NOT_TEXT", "e.exe": "UNKNOWN_TYPE", "f.csv": "NOT_TEXT"}


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße C++ v1.2.3 .NET e\u0301",), (None,)], "t string")
    row = df.select(X.surface_tokens(F.col("t")).alias("s"), X.nfc("t").alias("n"), X.fold("t").alias("f")).collect()
    assert "c++" in row[0].s and ".net" in row[0].s and row[0].n.endswith("é") and row[0].f.startswith("strasse") and row[1].s == [] and row[1].n is None
    windows = spark.range(1).select(X.word_windows(F.lit(" ".join("abcdefghij")), 4, 1).alias("w")).first().w
    assert [(w.start, len(w.words)) for w in windows] == [(0, 4), (3, 4), (6, 4)]
    forms = spark.createDataFrame([("AB_C1",), ("c#",), ("SQL",), ("How so",), ("one two",), ("a b c d e f",)], "t string").select(X.query_form(F.col("t"))).collect()
    assert [r[0] for r in forms] == ["identifier", "technical", "acronym", "question", "short", "descriptive"]
    assert spark.range(1).select(X.contains_phrase(F.split(F.lit("a b c"), " "), F.split(F.lit("b c"), " "))).first()[0]
    assert spark.range(1).select(X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))).first()[0] == 1.0


def test_intervals_join_by_gap_and_length(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.5, 2.0), ("a", 2.9, 4.0), ("a", 9.0, 10.0), ("b", 0.0, 5.0)], "k string, s double, e double")
    got = sorted(tuple(r) for r in sync.merge_intervals(df, "k", "s", "e", 1.0, 3.0).collect())
    assert got == [("a", 0.0, 2.0), ("a", 2.9, 4.0), ("a", 9.0, 10.0), ("b", 0.0, 5.0)]


def test_streamed_sync_survives_replay(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    schema = "id long, ts timestamp, seq long, v string"
    feed = f"file://{tmp_path}/feed"
    spark.createDataFrame([(1, day, 1, "a"), (2, day, 1, "b")], schema).coalesce(1).write.mode("append").parquet(feed)
    changes = lambda: stream.read_changes(spark, feed, spark.createDataFrame([], schema).schema, "ts")
    run = lambda: sorted(tuple(r) for r in stream.sync(changes(), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "id", "ts", "seq").select("id", "v").collect())
    assert run() == [(1, "a"), (2, "b")]
    later = day + dt.timedelta(hours=1)
    spark.createDataFrame([(1, later, 2, "a2"), (2, day - dt.timedelta(hours=1), 0, "old"), (1, day, 1, "a")], schema).coalesce(1).write.mode("append").parquet(feed)
    assert run() == [(1, "a2"), (2, "b")]


def test_streamed_slots(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    feed = f"file://{tmp_path}/feed"
    rows = spark.createDataFrame([(i, day + dt.timedelta(minutes=7 * i)) for i in range(20)], "id long, ts timestamp")
    rows.coalesce(1).write.parquet(feed)
    counted = stream.slots(stream.replay_safe(stream.read_changes(spark, feed, rows.schema, "ts"), "id", "ts"), "ts", "1 hour", late=None)
    run = counted.writeStream.format("memory").queryName("slots_seen").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("slots_seen").agg(F.sum("events")).first()[0] >= 9


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files of every line end, cut into splits of a few bytes, some within a line end, some without any line."""
    texts = {"a": "\ufeffone\r\ntwo\r\n\r\nthree é\r\n", "b": "x" * 90 + "\n\n" + "y\n" * 40, "c": "\rold\rmac", "d": "", "e": "\n\n\n", "f": "last without end", "g": "\ufeff", "h": "mid \ufeff mark\n\ufeffkept"}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    want = set()
    for name, text in texts.items():
        lines = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        want |= {(f"{name}.txt", i, line) for i, line in enumerate(lines) if line.strip(" ")}
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (7, 64, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == 64 else "4")
            rows = files.text_units(spark, f"file://{tmp_path}").collect()
            assert len(rows) == len(want) and {(r.path.rsplit("/", 1)[1], r.seq, r.text) for r in rows} == want
            assert all(r.locator == f"L{r.seq + 1}" for r in rows)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
