"""Files as inputs and outputs: uploads, statement texts, expected rows, results.

The name of a file without folders tells rows of different files apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPECTED = "file string, date string, description string, amount decimal(18,2), type string"


def _name(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


def read_uploads(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """``(filename, content_type, content)`` of the files below a folder.

    Spark reads no files without bytes, and files tell no media type: both come from ``manifest`` (filename,
    content_type), which names what was uploaded. A named file that is empty or missing has null content; files that
    the manifest does not name are read as well.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.select(_name().alias("filename"), "content")
    if manifest is None:
        return found.select("filename", F.lit(None).cast("string").alias("content_type"), "content")
    return manifest.select("filename", "content_type").join(found, "filename", "full_outer").select("filename", "content_type", "content")


def read_statement_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(statement_id, text)``: each text file of a folder whole, its name without ending the id."""
    files = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return files.select(stem.alias("statement_id"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(statement_id, text)`` from a table of ``(statement_id, page, text)``: the pages in order, a line end between; a page
    without text is empty. A statement's pages are one group: a printed statement has at most some hundred."""
    pages = spark.read.parquet(path).groupBy("statement_id")
    told = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.agg(told.alias("p")).select("statement_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """Expected rows from CSV with a header: ``file, date, description, amount, type``, in any order of columns."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    fields = [f.split(" ", 1) for f in EXPECTED.split(", ")]
    return raw.select(*[F.col(name) if kind == "string" else F.col(name).try_cast(kind).alias(name) for name, kind in fields])


def write_results(summary: DataFrame, rows: DataFrame, folder: str) -> None:
    """The summary as CSV with a header in ``summary``, the rows as JSON lines in ``rows``, a folder for each ``tool``."""
    summary.write.mode("overwrite").csv(f"{folder}/summary", header=True, escape='"')
    rows.write.mode("overwrite").partitionBy("tool").json(f"{folder}/rows")
