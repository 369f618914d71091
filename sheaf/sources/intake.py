"""Files of a folder as rows, by Spark's binary reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name (without its suffix), modificationTime, length, content of the PDF files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.lower("path").endswith(".pdf")).select(
        "path", F.regexp_replace(name, r"(?i)\.pdf\z", "").alias("name"), "modificationTime", "length", "content"
    )
