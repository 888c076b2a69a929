import pytest
from pyspark.sql import functions as F

from paperloom.operators import layout, metadata

LINE = "line_id long, file_name string, page_number int, column_index int, x0 double, y0 double, x1 double, y1 double, text string, loaded_at string"


def lines(spark, *rows):
    return spark.createDataFrame([(i, "f.pdf", 1, 0, x0, float(y0), x1, float(y1), text, None) for i, (x0, x1, y0, y1, text) in enumerate(rows)], LINE)


@pytest.mark.parametrize(("boxes", "expected"), [([(0, 10), (12, 22), (40, 50)], [1, 1, 2]), ([(0, 10), (22.5, 32.5)], [1, 1]), ([(0, 2), (10, 12), (21, 23)], [1, 1, 2])])
def test_gap_rule(spark, boxes, expected):
    rows = layout.segments(lines(spark, *((0.0, 1.0, a, b, "text") for a, b in boxes))).orderBy("line_id").collect()
    assert [r.paragraph_in_column for r in rows] == expected


def test_debris_counts_in_column_but_not_in_page(spark):
    rows = layout.paragraphs(lines(spark, (0.0, 1.0, 0, 10, "one long enough"), (0.0, 1.0, 40, 50, "ab"), (0.0, 1.0, 80, 90, "two long enough"))).orderBy("paragraph_in_page").collect()
    assert [(r.paragraph_in_column, r.paragraph_in_page) for r in rows] == [(1, 1), (3, 2)] and rows[0].paragraph_id == "f_p1_c0_n1"


def test_later_load_wins_and_blank_lines_vanish(spark):
    box = ("f", 1, 0, 0.0, 0.0, 1.0, 10.0)
    rows = spark.createDataFrame([(1, *box, "old", "2020-01-01"), (1, *box, "new", "2020-01-02"), (2, *box, None, None)], LINE)
    page = layout.page_texts(rows).first()
    assert page.page_text == "new" and page.line_count == 1


@pytest.mark.parametrize(("centres", "expected"), [([100, 110, 120, 300, 310], [110.0, 305.0]), ([100, 300, 500], [300.0]), ([0, 0, 200, 400, 600], [0.0, 200.0, 400.0])])
def test_columns(spark, centres, expected):
    rows = layout.column_centers(lines(spark, *((float(c), float(c), 0, 3, "words") for c in centres)), 600).orderBy("column_no").collect()
    assert [r.center for r in rows] == expected


def test_nearest_column_prefers_the_left_on_ties(spark):
    centers = spark.createDataFrame([("f.pdf", 1, 0, 100.0), ("f.pdf", 1, 1, 300.0)], "file_name string, page_number int, column_no int, center double")
    assert layout.nearest_column(lines(spark, (200.0, 200.0, 0, 3, "x")), centers).first().column_no == 0


def test_file_names(spark):
    rows = spark.createDataFrame([("1971_06.pdf",), ("1971_13.pdf",), ("x1971_06.pdf",), ("1971-06.pdf",), (None,)], "file_name string").withColumns(metadata.filename_date()).collect()
    assert [r.file_issue_date for r in rows] == ["1971-06-01", "1971-13-01", None, None, None]


@pytest.mark.parametrize(
    ("text", "month", "year", "confidence", "issue", "label"),
    [
        ("v0l. 3 n0. 4 may 1975", 5, 1975, "high", "4", None),
        ("SECOND QUARTER 1980", 6, 1980, "medium", None, "Second Quarter"),
        ("1970 filler filler 1975 June", 6, 1975, "high", None, None),
        ("nothing here", None, None, "low", None, None),
        (None, None, None, "low", None, None),
    ],
)
def test_front_pages(spark, text, month, year, confidence, issue, label):
    row = metadata.front_parsed(spark.createDataFrame([(text,)], "front_text string")).first()
    assert (row.front_month, row.front_year, row.front_confidence, row.front_issue_no, row.front_period_label, row.front_volume) == (month, year, confidence, issue, label, None)


@pytest.mark.parametrize(("file", "front", "source"), [((1980, 1), (1974, None), "conflict"), ((None, None), (1980, 5), "filename_with_front_partial"), ((1980, 1), (None, None), "filename"), ((1980, 1), (1980, 1), "both"), ((1980, 1), (None, 4), "filename_with_front_partial")])
def test_sources_of_dates(spark, file, front, source):
    row = spark.createDataFrame([(*file, *front)], "file_year int, file_month int, front_year int, front_month int").select(metadata.date_source().alias("s")).first()
    assert row.s == source


def test_better_parse_needs_strictly_more(spark):
    row = spark.sql("select named_struct('year', 1970, 'month', cast(null as int)) a, named_struct('year', 1980, 'month', cast(null as int)) b, named_struct('year', 1990, 'month', 2) c")
    assert row.select(metadata.better("a", "b")["year"]).first()[0] == 1970 and row.select(metadata.better("a", "c")["year"]).first()[0] == 1990


def test_last_loaded_issue(spark):
    rows = spark.createDataFrame([("f", "a", "2020-01-01"), ("f", "b", "2020-01-02"), ("g", "c", None)], "file_name string, validation_status string, loaded_at string")
    assert {r.validation_status for r in metadata.last_loaded(rows.withColumn("loaded_at", F.to_timestamp("loaded_at"))).collect()} == {"b", "c"}
