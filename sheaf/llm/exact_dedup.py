"""Exact deduplication by a distributed content sort, in DataFrame operations only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: One white-space run, as the normal form has it.
RUN = r"[\x20\x09-\x0D]+"


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_groups: int = 4096, least_hot: int = 1000
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are dealt by sampled range splitters over (leading characters, digest, slice) of the normalised text, sorted
    externally, and neighbours are compared over the whole normalised text. The splitters hold at most 48 characters
    and a digest, so that the sample stays small however long the texts are.

    A group of more than max(least_hot, rows / hot_groups) equal texts is cut into slices by a hash of the identifier,
    each no larger than that. At most hot_groups groups can be that large, so the table of their sizes and smallest
    identifiers can be broadcast. Across the slices of such a group the SHA-256 digest decides.

    Null text counts as empty; a null identifier never stays where another row of its group has one. Of rows that
    repeat the smallest identifier, one stays. An empty table gives an empty result. Other columns are ignored.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), RUN, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("sha", F.sha2("norm", 256))
    most = max(least_hot, ceil(docs.count() / hot_groups))
    hot = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("hot_size"), F.min("doc_id").alias("hot_keep"))
    found = hot.filter(F.col("hot_size") > most).collect()  # at most hot_groups rows
    hot = docs.sparkSession.createDataFrame(found, hot.schema).withColumn("hot", F.lit(True))
    slices = F.ceil(F.col("hot_size") / most)
    rows = rows.join(F.broadcast(hot), "sha", "left").withColumn(
        "slice", F.coalesce(F.pmod(F.xxhash64("doc_id"), slices), F.lit(0)).cast("int")
    )
    dealt = ["head", "sha", "slice"]
    rows = rows.withColumn("head", F.substring("norm", 1, 48)).repartitionByRange(*dealt)
    rows = rows.sortWithinPartitions(*dealt, "norm", F.col("doc_id").asc_nulls_last())
    same = Window.partitionBy(*dealt, "norm")
    first = F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last())) == 1
    keep = F.when(F.col("hot"), F.col("hot_keep")).otherwise(F.min("doc_id").over(same))
    size = F.when(F.col("hot"), F.col("hot_size")).otherwise(F.count(F.lit(1)).over(same))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        size.alias("group_size"),
        (first & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
