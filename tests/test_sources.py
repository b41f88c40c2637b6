"""Parsers, file and golden-set sources, sinks."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from brightwater.sources import commits, files, golden, parsers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(parts: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return data.getvalue()


def cell(text, properties=""):
    return f"<w:tc><w:tcPr>{properties}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


DOCX = archive(
    {
        "word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:tbl><w:tr>{cell('a', '<w:gridSpan w:val=\"2\"/>')}{cell('b', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{cell('c')}{cell('d|e')}{cell('', '<w:vMerge/>')}</w:tr></w:tbl><w:p><w:r><w:t>Last</w:t></w:r></w:p></w:body></w:document>",
        "word/header1.xml": f"<w:hdr {W}><w:tbl><w:tr>{cell('h')}</w:tr></w:tbl></w:hdr>",
    }
)


def test_docx():
    assert parsers.docx_text(DOCX) == "First line\n\n### 表格 1\n| a [R1xC2] |  | b [R2xC1] |\n| --- | --- | --- |\n| c | d\\|e |  |\n\nLast\n\n### 表格 2\n| h |\n| --- |"
    assert parsers.docx_text(b"no zip") == ""


def test_other_archives():
    assert parsers.archive_xml(archive({"a.xml": "<a> x <b>y</b></a>", "b.bin": "z", "c.xml": "<bad"})) == "x\ny"
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    x = archive({"xl/workbook.xml": f'<workbook {m}><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {m}><si><t>head</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>in</t></is></c></row><row><c><v>1.5</v></c></row></sheetData></worksheet>'})
    assert parsers.xlsx_text(x) == "## S\n| head | in |\n| --- | --- |\n| 1.5 |  |"


def test_decoding():
    assert parsers.decode_text("报销".encode("gb18030")) == "报销" and parsers.decode_text(b"\xef\xbb\xbfa") == "a"
    with pytest.raises(parsers.ParseError):
        parsers.decode_text(b"\xff", "utf-8")
    assert parsers.local_text(b"a\xffb") == "ab"
    assert "printable" in parsers.binary_strings(b"\x00\x01printable\x02")


def test_html():
    assert parsers.html_text("<html><head><title>t</title></head><body><script>x</script><p>a &amp; b<p>c <b>d</b><br>e<!-- no --></body>") == "a & b\nc d\ne"


def test_cut_references():
    page = "<p>a &amp b&am<p>c &lt; &ampx; &#65; &copy 1</p>"
    assert parsers.html_text(page, cut_references=False) == "a &amp b&am\nc < &ampx; A &copy 1"
    assert parsers.html_text(page) == "a & b&am\nc < &x; A © 1"


def test_uploads():
    assert parsers.uploaded_text("a.unknown", b"plain") == "plain" and parsers.uploaded_text("a.docx", DOCX).startswith("First")
    for name, data in (("a.txt", b""), ("a.png", b"\x89PNG\r\n"), ("a.txt", b"  ")):
        with pytest.raises(parsers.ParseError):
            parsers.uploaded_text(name, data)


def test_file_ingest(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.TXT").write_text("text", encoding="utf-8")
    (tmp_path / "in" / "sub" / "b.docx").write_bytes(DOCX)
    (tmp_path / "in" / "c.exe").write_bytes(b"no")
    found = files.read_files(spark, str(tmp_path / "in"))
    out = {r.filename: r.text for r in files.parse_files(found).collect()}
    assert set(out) == {"a.TXT", "b.docx"} and out["a.TXT"] == "text"
    assert files.file_facts(spark, str(tmp_path / "in")).where("filename = 'a.TXT'").first().length == 4
    assert bytes(files.original(spark, str(tmp_path / "in"), "x/a.TXT").first().content) == b"text"
    with pytest.raises(ValueError):
        files.original(spark, str(tmp_path), "..")
    uploads = spark.createDataFrame([("e.txt", b"", None), ("g.txt", "报".encode("gb18030"), "gb18030"), ("p.png", b"x", None)], "filename string, content binary, encoding string")
    got = {r.filename: (r.text, r.error is None) for r in files.parse_files(uploads, uploads=True).collect()}
    assert got == {"e.txt": (None, False), "g.txt": ("报", True), "p.png": (None, False)}


def test_store_and_export(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a", "x"), (2, "b", 'say "hi"\n'), (3, "c", None)], "chunk_id long, filename string, text string")
    store = str(tmp_path / "store")
    assert files.write_store(chunks, store) == 1
    first = files.read_store(spark, store)
    rows = lambda f: sorted(map(tuple, f.select(*chunks.columns).collect()))
    assert rows(first) == rows(chunks)
    assert files.write_store(first.where("chunk_id > 1"), store) == 2  # made of the version that is there
    assert [r[0] for r in rows(files.read_store(spark, store))] == [2, 3] and rows(files.read_store(spark, store, 1)) == rows(chunks)
    chunks.write.parquet(f"{store}/data-of-a-writer-that-was-lost")  # never committed
    assert files.store_versions(spark, store) == [1, 2]
    with pytest.raises(commits.Conflict):  # made for a version that another writer has replaced
        files.write_store(chunks, store, expected=1)
    assert [r[0] for r in rows(files.read_store(spark, store))] == [2, 3]
    with pytest.raises(FileNotFoundError):
        files.read_store(spark, str(tmp_path / "none"))
    files.export_csv(chunks.orderBy("chunk_id").coalesce(1), str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("*.txt")).read_bytes()
    assert raw == b'\xef\xbb\xbf"chunk_id","filename","text"\r\n"1","a","x"\r\n"2","b","say ""hi""\n"\r\n"3","c",""\r\n'


def test_aliases(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"aliases": {"PMP": ["P M P", "pmp", "P M P"], "": ["x"]}}', encoding="utf-8")
    assert files.read_aliases(spark, str(path)) == {"pmp": ["p m p"]}
    path.write_text("{bad", encoding="utf-8")
    assert files.read_aliases(spark, str(path)) == {} == files.read_aliases(spark, str(tmp_path / "none.json"))


GOOD = '# comment\n\n{"query": " q ", "positives": ["a", " a ", ""], "filename": "b", "tags": ["t"]}\n{"id": "n", "query": "x", "expect_no_source": true}\n'


def test_golden_sets(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text(GOOD, encoding="utf-8")
    out = golden.load_cases(spark, str(path)).orderBy("case_id").collect()
    assert [(r.case_id, r.query, r.positives, r.expect_no_source) for r in out] == [("case-0003", "q", ["a", "b"], False), ("n", "x", [], True)]
    assert [r.tag for r in golden.tags(golden.load_cases(spark, str(path))).collect()] == ["t"]


@pytest.mark.parametrize(
    ("line", "problem"),
    [("[1]", "not a JSON object"), ("{bad", "not a JSON object"), ('{"positives": ["a"]}', "no query"), ('{"query": "q"}', "no answer"), ('{"query": "q", "filename": "a", "expect_no_source": true}', "both"), ('{"id": "n", "query": "q", "filename": "a"}', "duplicate id")],
)
def test_bad_golden_lines_raise(spark, tmp_path, line, problem):
    path = tmp_path / "g.jsonl"
    path.write_text(GOOD + line, encoding="utf-8")
    with pytest.raises(golden.DatasetError, match=problem):
        golden.load_cases(spark, str(path))


def test_empty_golden_set_raises(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text("# nothing\n", encoding="utf-8")
    with pytest.raises(golden.DatasetError, match="empty"):
        golden.load_cases(spark, str(tmp_path / "g.jsonl"))


def test_reports(spark, tmp_path):
    folder = str(tmp_path / "reports")
    for day in ("2024-01-01", "2024-01-03", "2024-01-02"):
        golden.save_report(spark.createDataFrame([(day, 0.5)], "generated_at string, recall double"), folder)
    (tmp_path / "reports" / "other.json").write_text('{"schema": "else", "generated_at": "2025"}\n')
    assert [r.generated_at[-1] for r in golden.reports(spark, folder, "generated_at string, recall double").collect()] == ["3", "2", "1"]
    assert golden.latest_report(spark, folder, "generated_at string").first().generated_at == "2024-01-03"
    assert F is not None


def test_lines_are_numbered_over_all_parts_of_a_file(spark, tmp_path):
    path = tmp_path / "l.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = golden.numbered_lines(spark, str(path))
        assert len({r.p for r in rows.select(F.spark_partition_id().alias("p")).collect()}) > 1
        assert {(r.lineno, r.value) for r in rows.collect()} == {(i, f"line {i}") for i in range(1, 400)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
