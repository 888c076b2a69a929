"""Dates of issues from file names and front pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.lexicon import MONTHS, QUARTERS

# Patterns of front pages, on text in capitals.
MONTH = r"\b(JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUN(?:E)?|JUL(?:Y)?|AUG(?:UST)?|SEP(?:T(?:EMBER)?)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)\b"
QUARTER = r"\b(FIRST|SECOND|THIRD|FOURTH)\s+QUARTER\b"
YEAR = r"\b(19\d{2}|20\d{2})\b"
VOLUME = r"\bV[O0][LLI1\.]?\s*([0-9]{1,2}|[IVX]{1,5})\b"
ISSUE = r"\b[MN]?[O0][\.]?\s*([0-9]{1,2}|[IVX]{1,5})\b"
CONFUSED = (("V0L", "VOL"), ("VOI", "VOL"), ("M0", "NO"), ("N0", "NO"), ("ISSISS", "ISSUES"))


def iso(year: Column, month: Column) -> Column:
    """YYYY-MM-01 without a calendar check; null if a part is missing."""
    return F.when(year.isNotNull() & month.isNotNull(), F.format_string("%04d-%02d-01", year, month))


def filename_date(name: str = "file_name") -> dict[str, Column]:
    """file_year, file_month and file_issue_date of names of the form YYYY_MM.pdf; nulls for others."""
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract({name}, '^(\\\\d{{4}})_(\\\\d{{2}})\\\\.pdf$', {i}), '') as int)")
    return {"file_year": part(1), "file_month": part(2), "file_issue_date": iso(part(1), part(2))}


def _first(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def _lookup(word: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word)


def _nearest_year(text: Column, anchor: Column) -> Column:
    """The year that starts nearest to the anchor (0 for none), of equally near ones the first."""
    years, between = F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), F.split(text, YEAR, -1)
    start = lambda k: 1 + 4 * (k - 1) + F.aggregate(F.slice(between, 1, k), F.lit(0), lambda total, x: total + F.length(x))
    places = F.transform(F.sequence(F.lit(1), F.size(years)), lambda k: F.struct(F.abs(start(k) - anchor).alias("d"), k.alias("k")))
    return F.when(F.size(years) > 0, F.element_at(years, F.array_min(places)["k"]).cast("int"))


def front_parsed(fronts: DataFrame, text: str = "front_text") -> DataFrame:
    """Adds front_month, front_year, front_volume, front_issue_no, front_period_label, front_confidence.

    The first month named counts, else a quarter's last month; the year is the one nearest to either.
    """
    clean = F.upper(F.coalesce(F.col(text), F.lit("")))
    for old, new in CONFUSED:
        clean = F.replace(clean, F.lit(old), F.lit(new))
    rows = fronts.withColumn("_c", clean).withColumns({"_m": _first(F.col("_c"), MONTH), "_q": _first(F.col("_c"), QUARTER)})
    c = F.col("_c")
    place = F.when(F.col("_m").isNotNull(), F.regexp_instr(c, F.lit(MONTH))).when(F.col("_q").isNotNull(), F.regexp_instr(c, F.lit(QUARTER))).otherwise(0)
    rows = rows.withColumns({"front_month": F.coalesce(_lookup(F.col("_m"), MONTHS), _lookup(F.col("_q"), QUARTERS)), "front_year": _nearest_year(c, place)})
    both = F.col("front_month").isNotNull() & F.col("front_year").isNotNull()
    confidence = F.when(F.col("_m").isNotNull(), F.when(both, "high").otherwise("medium")).when(F.col("_q").isNotNull() & both, "medium").otherwise("low")
    label = F.when(F.col("_q").isNotNull(), F.concat(F.initcap(F.lower("_q")), F.lit(" Quarter")))
    return rows.withColumns({"front_volume": _first(c, VOLUME), "front_issue_no": _first(c, ISSUE), "front_period_label": label, "front_confidence": confidence}).drop("_c", "_m", "_q")


def date_source() -> Column:
    fy, fm, y, m = (F.col(c) for c in ("file_year", "file_month", "front_year", "front_month"))
    all_known = y.isNotNull() & m.isNotNull() & fy.isNotNull() & fm.isNotNull()
    return (
        F.when(y.isNull() & m.isNull(), "filename")
        .when(all_known, F.when((y == fy) & (m == fm), "both").otherwise("conflict"))
        .when(y.isNotNull() & fy.isNotNull() & (y != fy), "conflict")
        .otherwise("filename_with_front_partial")
    )


def validation_status(source: Column) -> Column:
    return F.when(source == "both", "validated_match").when(source == "conflict", "review_needed").when(source == "filename_with_front_partial", "front_partial").otherwise("front_missing")


def resolved(fronts: DataFrame) -> DataFrame:
    """Adds canonical_*, date_source, date_conflict, validation_status and date_review_needed; the file name is canonical, the front page only confirms it."""
    rows = fronts.withColumns(filename_date()).withColumn("date_source", date_source())
    conflict = F.col("date_source") == "conflict"
    return rows.withColumns(
        {"canonical_year": F.col("file_year"), "canonical_month": F.col("file_month"), "canonical_issue_date": F.col("file_issue_date"), "front_issue_date": iso(F.col("front_year"), F.col("front_month")), "date_conflict": conflict, "validation_status": validation_status(F.col("date_source")), "date_review_needed": conflict}
    )


#: The columns of an issue's metadata, in order.
ISSUE_COLUMNS = """
    file_name file_year file_month file_issue_date canonical_year canonical_month canonical_issue_date front_year front_month front_issue_date front_volume
    front_issue_no front_period_label front_parse_method front_confidence date_source date_conflict validation_status date_review_needed
""".split()


def issue_rows(fronts: DataFrame, parse_method: str = "pdftotext_layout") -> DataFrame:
    """The whole metadata row of each document, ISSUE_COLUMNS, from front_parsed(); a column front_parse_method of `fronts` is kept, else all have `parse_method`."""
    if "front_parse_method" not in fronts.columns:
        fronts = fronts.withColumn("front_parse_method", F.lit(parse_method))
    return resolved(fronts).select(*ISSUE_COLUMNS)


def best_fronts(first: DataFrame, second: DataFrame, methods: tuple[str, str] = ("pdftotext_layout", "ocr_tesseract")) -> DataFrame:
    """Of two front_parsed() tables of the same documents, for each file_name the row of the second if that has strictly more of year and month; with front_parse_method."""
    parts = F.col("front_year").isNotNull().cast("int") + F.col("front_month").isNotNull().cast("int")
    both = first.withColumns({"_parts": parts, "_first": F.lit(1), "front_parse_method": F.lit(methods[0])}).unionByName(second.withColumns({"_parts": parts, "_first": F.lit(0), "front_parse_method": F.lit(methods[1])}))
    order = W.partitionBy("file_name").orderBy(F.desc("_parts"), F.desc("_first"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_parts", "_first")


def better(first: str, second: str) -> Column:
    """The second parse, a struct with year and month, if it has strictly more of the two than the first."""
    parts = lambda s: F.col(f"{s}.year").isNotNull().cast("int") + F.col(f"{s}.month").isNotNull().cast("int")
    return F.when(parts(second) > parts(first), F.col(second)).otherwise(F.col(first))


def last_loaded(issues: DataFrame) -> DataFrame:
    """Each file_name once, as last loaded."""
    order = W.partitionBy("file_name").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("validation_status"))
    return issues.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
