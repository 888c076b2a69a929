import os

import pytest

from paperloom.sources import files

DATA = "/root/testdata/sf0.001"


def test_csv_keeps_line_breaks_and_writes_nothing_for_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 'two\nlines, "quoted"'), ("b", None)], "k string, t string")
    assert files.write_csv(rows, path) and not files.write_csv(rows.where("false"), path)
    assert b"\r\n" in next((tmp_path / "t").glob("part-*.csv")).read_bytes() and not (tmp_path / "t.part").exists()
    assert {tuple(r) for r in files.read_csv(spark, path).collect()} == {("a", 'two\nlines, "quoted"'), ("b", None)}


def test_named_texts_and_listing(spark, tmp_path):
    (tmp_path / "herald_1971_06.txt").write_text("one\ntwo")
    assert tuple(files.read_named_texts(spark, str(tmp_path / "*.txt")).first()) == ("herald", "1971", "06", "one\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"2")
    (tmp_path / "a.pdf").write_bytes(b"1")
    assert [os.path.basename(r.path) for r in files.document_paths(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]
    assert {r.content for r in files.list_documents(spark, str(tmp_path)).collect()} == {b"1", b"2"}
    assert [r.content for r in files.list_documents(spark, str(tmp_path), limit=1).collect()] == [b"1"] and files.list_documents(spark, str(tmp_path), "*.doc", 3).count() == 0


def test_markdown(spark, tmp_path):
    files.write_markdown(spark.createDataFrame([("n", "3"), ("mean", "1.5")], "metric string, value string"), str(tmp_path / "m"))
    assert next((tmp_path / "m").glob("part-*")).read_text().splitlines() == ["| metric | value |", "|---|---|", "| n | 3 |", "| mean | 1.5 |"]


def test_programs_are_chained_without_files(spark, tmp_path):
    docs = spark.createDataFrame([("x/a.pdf", bytearray(b"june 1975")), ("x/b.pdf", None)], "path string, content binary")
    assert {r.path: r.text for r in files.piped(docs, [["tr", "a-z", "A-Z"], ["rev"]]).collect()} == {"x/a.pdf": "5791 ENUJ", "x/b.pdf": ""}
    assert [r.text for r in files.piped(docs, [["false"]]).collect()] == ["", ""]
    with pytest.raises(RuntimeError, match="no-such-program"):
        files.piped(docs, [["no-such-program"]])


def test_pages_are_read_as_images_where_their_text_lacks_a_date(spark):
    docs = spark.createDataFrame([("x/1975_06.pdf", bytearray(b"june 1975")), ("x/1976_07.pdf", bytearray(b"1976")), ("x/1977_08.pdf", bytearray(b"1977"))], "path string, content binary")
    text = lambda d: files.piped(d, [["cat"]])
    ocr = lambda d: files.piped(d, [["sed", "s/1976/july 1976/"]])
    got = {r.file_name: r for r in files.front_rows(docs, True, text, ocr).collect()}
    assert [(r.front_month, r.front_parse_method, r.date_source) for _, r in sorted(got.items())] == [(6, "pdftotext_layout", "both"), (7, "ocr_tesseract", "both"), (None, "pdftotext_layout", "filename_with_front_partial")]
    plain = files.front_rows(docs, False, text).where("file_name = '1976_07.pdf'").first()
    assert plain.front_month is None and len(plain) == 19


def test_layout_xml_to_paragraphs(spark, tmp_path):
    from paperloom.operators import layout

    line = lambda x, y, words: f'<line xMin="{x}" yMin="{y}" xMax="{x + 200}" yMax="{y + 10}">' + "".join(f'<word xMin="1">{w}</word>' for w in words.split()) + "</line>"
    left, right = "".join(line(40, 100 + 12 * i, f"left column line number {i} of it") for i in range(4)), "".join(line(340, 100 + 12 * i, f"right column line number {i} of it") for i in range(4))
    page = lambda blocks: f'<page width="600" height="800"><flow>{"".join(f"<block>{b}</block>" for b in blocks)}</flow></page>'
    text = f'<!DOCTYPE html>\n<html><body>\n<doc>{page([left, right])}{page([line(40, 100, "Old Bridge &amp; co over there")])}</doc></body></html>'
    (tmp_path / "x.xml").write_text(text)
    rows = files.read_layout(spark, str(tmp_path / "x.xml"))
    assert rows.count() == 9 and {(r.page_number, r.page_width) for r in rows.collect()} == {(1, 600.0), (2, 600.0)}
    docs = spark.createDataFrame([("y/x.pdf", bytearray(text.encode()))], "path string, content binary")
    lines = layout.with_columns(files.layout_lines(files.piped(docs, [["cat"]], strict=True)))
    got = layout.paragraphs(lines).orderBy("page_number", "paragraph_in_page").collect()
    assert [(r.paragraph_id, r.paragraph_text.split("\n")[0]) for r in got] == [("x_p1_c0_n1", "left column line number 0 of it"), ("x_p1_c1_n1", "right column line number 0 of it"), ("x_p2_c0_n1", "Old Bridge & co over there")]


def test_missing_rows_are_an_error(spark):
    with pytest.raises(ValueError, match="labels"):
        files.require(spark.createDataFrame([], "a int"), "labels")


def test_stream_counts_each_paragraph_once(spark, tmp_path):
    from paperloom.streaming import intake

    row = "select '{}' paragraph_id, '{}' paragraph_text, timestamp'2020-01-01' loaded_at"
    rows = spark.sql(" union all ".join([row.format("p1", "Latino families")] * 2 + [row.format("p2", "none")]))
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    q = intake.keep_up(intake.arriving(spark, str(tmp_path / "in"), rows).select("paragraph_id"), lambda df, i: got.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination()
    assert sum(got) == 3
    counts = intake.group_counts(intake.arriving(spark, str(tmp_path / "in"), rows))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.identity_type, r.n) for r in spark.table("counts").collect()} == {("panethnic", 1), ("none", 1)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 13
    assert set(entry.oracle_sql()) <= set(entry.queries())
