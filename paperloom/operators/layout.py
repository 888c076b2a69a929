"""Lines on pages: columns, reading order, paragraphs by gaps, text of pages and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.functions.text import normalized

PAGE, COLUMN = ["file_name", "page_number"], ["file_name", "page_number", "column_index"]
MAX_COLUMNS = 3
#: Pages of an issue that are joined into one text.
PAGES_PER_PART = 1000


def latest(lines: DataFrame) -> DataFrame:
    """Each line_id of a page once, as last loaded; a page loaded again keeps its number. Lines lie together by page afterwards, as all windows over pages and columns ask."""
    again = W.partitionBy(*PAGE, "line_id").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("text"))
    return lines.where("line_id is not null").repartition(*PAGE).withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n")


def without_debris(lines: DataFrame) -> DataFrame:
    """Lines with at least two letters or digits."""
    return lines.where(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]", "")) >= 2)


def segments(lines: DataFrame) -> DataFrame:
    """Adds paragraph_in_column: a new one where the gap above is more than max(8, 1.25 * median height); blank lines count for the median only."""
    rows = lines.withColumn("_h", F.median(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))).over(W.partitionBy(*COLUMN))).where(F.trim("text") != "")
    down = W.partitionBy(*COLUMN).orderBy("y0", "x0", "line_id")
    wide = F.col("y0") - F.lag("y1").over(down) > F.greatest(F.lit(8.0), 1.25 * F.col("_h"))
    rows = rows.withColumn("_new", F.coalesce(wide, F.lit(False)).cast("int"))
    return rows.withColumn("paragraph_in_column", (1 + F.sum("_new").over(down)).cast("int")).drop("_h", "_new")


def joined(text: str, separator: str) -> Column:
    """The lines of a group in reading order as one text; a group is a paragraph, page or issue."""
    ordered = F.array_sort(F.collect_list(F.struct("column_index", "y0", "x0", "line_id", text)))
    return F.array_join(F.transform(ordered, lambda x: x[text]), separator)


def paragraphs(lines: DataFrame) -> DataFrame:
    """(paragraph_id, file_name, page_number, column_index, paragraph_in_column, paragraph_in_page, paragraph_text).

    Paragraphs of fewer than eight letters or digits are left out; they count in paragraph_in_column, not in paragraph_in_page.
    """
    whole = segments(latest(lines)).groupBy(*COLUMN, "paragraph_in_column").agg(joined("text", "\n").alias("paragraph_text"))
    kept = whole.where(F.length(F.regexp_replace(normalized(F.col("paragraph_text")), "[^a-z0-9]", "")) >= 8)
    kept = kept.withColumn("paragraph_in_page", F.row_number().over(W.partitionBy(*PAGE).orderBy("column_index", "paragraph_in_column")))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return kept.withColumn("paragraph_id", F.format_string("%s_p%d_c%d_n%d", stem, "page_number", "column_index", "paragraph_in_column"))


def with_columns(lines: DataFrame) -> DataFrame:
    """The line table, (line_id, file_name, page_number, column_index, x0, y0, x1, y1, text, loaded_at), of lines with page_width; columns are found by column_centers()."""
    rows = lines.select("line_id", *PAGE, "page_width", "x0", "y0", "x1", "y1", "text")
    found = nearest_column(rows, column_centers(rows, F.col("page_width")))
    return rows.join(found.withColumnRenamed("column_no", "column_index"), "line_id").select("line_id", *COLUMN, "x0", "y0", "x1", "y1", "text", F.lit(None).cast("timestamp").alias("loaded_at"))


def column_centers(lines: DataFrame, page_width: float | Column) -> DataFrame:
    """(file_name, page_number, column_no, center): groups of line centres with steps of more than 18 % of the page width between them, the first three.

    Centres come from lines of 20 letters and height 6 if a page has eight of them, else from lines of five characters, else from all.
    Fewer than four centres make one column.
    """
    width = page_width if isinstance(page_width, Column) else F.lit(page_width)
    rows = lines.select(*PAGE, width.alias("width"), ((F.col("x0") + F.col("x1")) / 2).alias("c"), (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")) >= 20).alias("long"), (F.col("y1") - F.col("y0") >= 6).alias("high"), (F.length(F.coalesce("text", F.lit(""))) >= 5).alias("some"))
    page = W.partitionBy(*PAGE)
    rows = rows.withColumns({"n1": F.count_if(F.col("long") & F.col("high")).over(page), "n2": F.count_if(F.col("some")).over(page)})
    rows = rows.where(F.when(F.col("n1") >= 8, F.col("long") & F.col("high")).when(F.col("n2") > 0, F.col("some")).otherwise(F.lit(True)))
    across = page.orderBy("c")
    step = F.coalesce(F.col("c") - F.lag("c").over(across) > 0.18 * F.col("width"), F.lit(False))
    rows = rows.withColumns({"n": F.count("*").over(page), "step": step.cast("int")})
    rows = rows.withColumn("column_no", F.when(F.col("n") < 4, 0).otherwise(F.sum("step").over(across)).cast("int"))
    return rows.groupBy(*PAGE, "column_no").agg(F.avg("c").alias("center")).where(F.col("column_no") < MAX_COLUMNS)


def nearest_column(lines: DataFrame, centers: DataFrame) -> DataFrame:
    """(line_id, column_no): the column of the nearest centre, ties to the left; a page has at most three centres."""
    each = centers.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("column_no", "center"))).alias("centers"))
    c = (F.col("x0") + F.col("x1")) / 2
    best = F.array_min(F.transform("centers", lambda x: F.struct(F.abs(c - x["center"]).alias("d"), x["column_no"].alias("column_no"))))
    return lines.join(each, PAGE).select("line_id", best["column_no"].alias("column_no"))


def page_texts(lines: DataFrame) -> DataFrame:
    """(file_name, page_number, column_count, line_count, page_text): paragraphs of a page joined by blank lines."""
    rows = segments(latest(lines)).groupBy(*COLUMN, "paragraph_in_column").agg(joined("text", "\n").alias("t"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("column_index", "paragraph_in_column", "t")))
    return rows.groupBy(*PAGE).agg(F.count_distinct("column_index").alias("column_count"), F.sum("n").alias("line_count"), F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("page_text"))


def issue_texts(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """(file_name, part, page_count, issue_text): pages in order. An issue of more than `pages_per_part` pages comes in several parts, so that no row grows without bound."""
    part = F.floor((F.col("page_number") - 1) / pages_per_part).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "page_text")))
    return pages.groupBy("file_name", part.alias("part")).agg(F.count("*").alias("page_count"), F.array_join(F.transform(ordered, lambda x: x["page_text"]), "\n\n").alias("issue_text"))
