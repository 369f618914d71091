"""The engine's tables, derived from Parquet tables: pages of lines, and their identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as T

LINE_STEP, LINE_HEIGHT, CHAR_WIDTH = 20, 16, 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key to several tasks for each core: a file may be of one row group, which one task reads however large it is."""
    session = rows.sparkSession
    n = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, key)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, doc_id, line_no, line: each line of each document."""
    docs = spread(read(spark, sf_dir, "documents").select("source", "doc_id", "text"), "doc_id").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, page_height: each document as a page whose lines are one under the other."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.split("text", "\n").alias("parts"))

    def line(t, i):
        box = F.struct(
            F.lit(0.0).alias("x0"), (i * LINE_STEP).cast("double").alias("y0"),
            (F.length(t) * CHAR_WIDTH).cast("double").alias("x1"), (i * LINE_STEP + LINE_HEIGHT).cast("double").alias("y1"),
        )
        return F.struct(i.alias("line_no"), t.alias("text"), box.alias("bbox"))

    return docs.select("doc_id", F.transform("parts", line).alias("lines"), (F.size("parts") * LINE_STEP).cast("double").alias("page_height"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, doc_id, line_no, id: the first identifier of each line that has one."""
    found = lines(spark, sf_dir).filter(F.col("line").rlike("[0-9]"))  # an identifier has a digit
    return found.withColumn("id", T.first_token(F.col("line"), True)).filter("id is not null").drop("line")
