"""Files in and out: tables as CSV, texts that carry their metadata in their name, page layouts as XML, documents as bytes."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from paperloom.operators import layout, metadata
from paperloom.session import cut_lineage


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, infer: bool = False, multi_line: bool = True) -> DataFrame:
    """CSV with a header; cells may hold line breaks and doubled quotes. Without a schema all columns are strings, or inferred if asked for.

    Files whose cells hold no line breaks can be read with `multi_line` off, so that large ones are split over tasks.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", infer)).csv(path)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_csv(df: DataFrame, path: str, line_end: str = "\r\n") -> bool:
    """CSV with a header; nothing is written, and False returned, where there are no rows, so an older file stays.

    Rows are counted as they are written beside `path`, so they are computed once; then the folder takes its place.
    """
    seen = Observation()
    part = f"{path.rstrip('/')}.part"
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", line_end).csv(part)
    new, fs = _fs(df.sparkSession, part)
    if seen.get["n"]:
        old, _ = _fs(df.sparkSession, path)
        fs.delete(old, True)
        fs.rename(new, old)
        return True
    fs.delete(new, True)
    return False


def write_markdown(pairs: DataFrame, path: str, head: tuple[str, str] = ("metric", "value")) -> None:
    """A table of two columns with a few rows as Markdown lines, in one file."""
    a, b = pairs.columns
    rows = pairs.select(F.format_string("| %s | %s |", a, b).alias("value"))
    top = pairs.sparkSession.createDataFrame([(f"| {head[0]} | {head[1]} |",), ("|---|---|",)], "value string").coalesce(1)
    top.unionByName(rows.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def read_named_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, year, month, value): whole text files named source_year_month.txt."""
    rows = spark.read.text(path, wholetext=True).withColumn("_stem", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))
    part = F.split("_stem", "_")
    return rows.select(part[0].alias("source"), F.try_element_at(part, F.lit(2)).alias("year"), F.try_element_at(part, F.lit(3)).alias("month"), "value")


def document_paths(spark: SparkSession, folder: str, pattern: str = "*.pdf", limit: int = 0) -> DataFrame:
    """(path, length) of matching files in the order of their paths; the first `limit` where that is above 0. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path")
    return rows.limit(limit) if limit > 0 else rows


def list_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf", limit: int = 0) -> DataFrame:
    """(path, length, content) of matching files, or of the first `limit` by path. Contents are read where they are needed and never sorted; document_paths() has the order."""
    own = [r["path"] for r in document_paths(spark, folder, pattern, limit).collect()] if limit > 0 else None  # at most `limit` paths
    if own is not None and not own:
        return spark.createDataFrame([], "path string, length long, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(own or folder).select("path", "length", "content")


def piped(documents: DataFrame, commands: list[list[str]], strict: bool = False) -> DataFrame:
    """(path, text): what a chain of installed programs makes of each document, the first fed with the content, each next with the output before it.

    Empty where one of them fails, or an error if `strict`. Nothing is written to disk. Raises if a program is missing.
    """
    for command in commands:
        if shutil.which(command[0]) is None:
            raise RuntimeError(f"{command[0]} isn't installed")

    def one(content: bytes | None) -> str:
        for command in commands:
            done = subprocess.run(command, input=content or b"", capture_output=True, check=strict)
            if done.returncode:
                return ""
            content = done.stdout
        return content.decode("utf-8", "replace")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [one(c) for c in batch["content"]]})

    return documents.select("path", "content").mapInPandas(run, "path string, text string")


def first_page_text(documents: DataFrame, command: str = "pdftotext") -> DataFrame:
    """(path, text): the first page as it is laid out; empty where it can't be read."""
    return piped(documents, [[command, "-f", "1", "-l", "1", "-layout", "-", "-"]])


def first_page_ocr(documents: DataFrame, dpi: int = 250, raster: str = "pdftoppm", reader: str = "tesseract") -> DataFrame:
    """(path, text): the first page as an image in grey, read as one block of text; empty where that fails."""
    return piped(documents, [[raster, "-f", "1", "-singlefile", "-r", str(dpi), "-gray", "-png", "-"], [reader, "stdin", "stdout", "--psm", "6"]])


def front_rows(documents: DataFrame, use_ocr: bool = False, text: Callable[[DataFrame], DataFrame] = first_page_text, ocr: Callable[[DataFrame], DataFrame] = first_page_ocr) -> DataFrame:
    """The metadata row of each document, metadata.ISSUE_COLUMNS, from its name and first page. With `use_ocr`, pages whose text lacks a year or month are read as images, which counts where it has more of the two."""
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")
    first = cut_lineage(metadata.front_parsed(text(documents).select("path", name, F.col("text").alias("front_text"))))
    if not use_ocr:
        return metadata.issue_rows(first.drop("front_text"))
    lacking = first.where("front_year is null or front_month is null").select("path")
    second = metadata.front_parsed(ocr(documents.join(lacking, "path", "left_semi")).select("path", name, F.col("text").alias("front_text")))
    return metadata.issue_rows(metadata.best_fronts(first, second).drop("front_text", "path"))


#: The pages of a layout: blocks of lines of words with their boxes.
LAYOUT = "struct<page: array<struct<_width: double, _height: double, flow: array<struct<block: array<struct<line: array<struct<_xMin: double, _yMin: double, _xMax: double, _yMax: double, word: array<string>>>>>>>>>>"


def layout_lines(layouts: DataFrame) -> DataFrame:
    """(line_id, file_name, page_number, page_width, x0, y0, x1, y1, text) from (path, text) of page layouts in XML: each line of each page, words joined by blanks.

    Pages are numbered from 1 as they stand in the document; line_id is a hash of the file, page and place. A page without lines gives none.
    """
    doc = F.regexp_extract("text", r"(?s)<doc\b.*</doc>", 0)
    pages = layouts.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.posexplode(F.from_xml(doc, LAYOUT, {"valueTag": "word"})["page"]).alias("p", "page"))
    inner = F.flatten(F.flatten(F.transform("page.flow", lambda f: F.transform(f["block"], lambda b: b["line"]))))
    lines = pages.select("file_name", (F.col("p") + 1).alias("page_number"), F.col("page._width").alias("page_width"), F.posexplode(inner).alias("i", "l"))
    return lines.select(
        F.xxhash64("file_name", "page_number", "i").alias("line_id"), "file_name", "page_number", "page_width", F.col("l._xMin").alias("x0"), F.col("l._yMin").alias("y0"), F.col("l._xMax").alias("x1"), F.col("l._yMax").alias("y1"), F.array_join("l.word", " ").alias("text")
    )


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """layout_lines() of files of page layouts in XML."""
    return layout_lines(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def document_lines(documents: DataFrame, command: str = "pdftotext") -> DataFrame:
    """The line table of documents, (line_id, file_name, page_number, column_index, x0, y0, x1, y1, text, loaded_at), as layout.paragraphs() takes it. A document that can't be read is an error."""
    return layout.with_columns(layout_lines(piped(documents, [[command, "-bbox-layout", "-", "-"]], strict=True)))


def require(df: DataFrame, what: str) -> DataFrame:
    """The same rows; ValueError where there are none."""
    if df.isEmpty():
        raise ValueError(f"no rows of {what}")
    return df
