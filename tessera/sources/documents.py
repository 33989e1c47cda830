"""Document files as a source, and extracted text as a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

MAX_BYTES = 50 << 20
SUFFIXES = ("txt", "md")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, text, error of each file below a folder. Other suffixes (pdf has no parser here) and files over 50 MB have an
    error instead of a text. The content of files with an error is not decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    error = F.when(~suffix.isin(*SUFFIXES), "unsupported type").when(F.col("length") > MAX_BYTES, "too large")
    return files.select("path", F.when(error.isNull(), F.decode("content", "UTF-8")).alias("text"), error.alias("error"))


def write_extracted(docs: DataFrame, path: str) -> DataFrame:
    """(account_id, uri, text) written below path, partitioned by account; the rows with their folder key."""
    out = docs.select("account_id", text.directory_key(F.col("account_id"), F.col("uri")).alias("folder"), "uri", "text")
    out.write.mode("append").partitionBy("account_id").parquet(path)
    return out


def section_text(body: Column, start: Column, end: Column) -> Column:
    """Characters from start up to end; null where the text is shorter than end."""
    return F.when(F.length(body) >= end, F.substring(body, start + 1, end - start))
