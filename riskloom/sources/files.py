"""File sources: folder scan, whole-text files, workbook text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import let

SUPPORTED_EXTENSIONS = (".pdf", ".xlsx", ".xls", ".txt", ".csv")
SHEET_MARKER = r"--- Sheet: (.*?) ---"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files directly in ``folder`` as (path, name, size, extension), by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = file_name(F.col("path"))
    return (files.select("path", name.alias("name"), F.col("length").alias("size"), extension(name).alias("extension"))
            .filter(F.col("extension").isin(*SUPPORTED_EXTENSIONS)).orderBy("name"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 text files, one whole document per row: (path, name, text)."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", file_name(F.col("path")).alias("name"), F.col("value").alias("text"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def storage_name(name: Column, content: Column, stored_at: Column) -> Column:
    """``<epoch ms>_<first 8 of the hash>_<name with unsafe characters replaced>``."""
    return F.concat_ws("_", stored_at.cast("string"), F.substring(content_hash(content), 1, 8),
                       F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"))


# --- workbook text ---------------------------------------------------------------

_INSIDE = "\uffff"  # stands for a comma inside quotes; not a character of any text


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; a comma splits if an even number of double quotes follows it, quotes are dropped.

    One pass: what stands between quotes keeps its commas under another character until the split is done.
    """
    def protected(parts: Column) -> Column:
        outside = lambda p, i: F.when(F.pmod(F.size(parts) - 1 - i, F.lit(2)) == 0, p).otherwise(F.replace(p, F.lit(","), F.lit(_INSIDE)))
        return F.array_join(F.transform(parts, outside), "")

    cells = F.split(let(F.split(line, '"'), protected), ",")
    return F.transform(cells, lambda c: F.trim(F.replace(c, F.lit(_INSIDE), F.lit(","))))


def workbook_rows(documents: DataFrame, text: str = "text") -> DataFrame:
    """Rows of all sheets of workbook texts: document columns + (sheet, sheet_no, row, cells).

    A text without sheet markers is one sheet named 'FMEA'. Row 0 is the header.
    """
    keep = [c for c in documents.columns if c != text]
    body = F.col(text)
    names = F.regexp_extract_all(body, F.lit(SHEET_MARKER), F.lit(1))
    parts = F.split(body, SHEET_MARKER)
    sheets = F.when(F.size(names) == 0, F.array(F.struct(F.lit("FMEA").alias("sheet"), body.alias("csv")))).otherwise(
        F.zip_with(names, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                   lambda n, c: F.struct(F.trim(n).alias("sheet"), c.alias("csv"))))
    sheet_rows = documents.select(*keep, F.posexplode(sheets).alias("sheet_no", "s"))
    trimmed = F.regexp_replace("s.csv", r"^\s+|\s+$", "")
    return (sheet_rows.filter(trimmed != "")
            .select(*keep, "sheet_no", F.col("s.sheet").alias("sheet"),
                    F.posexplode(F.split(trimmed, "\n")).alias("row", "line"))
            .select(*keep, "sheet_no", "sheet", "row", csv_cells(F.col("line")).alias("cells")))
