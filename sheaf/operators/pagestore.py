"""The store of recognised pages and the history: what is left to do, what stays, what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES_KEPT, HISTORY_KEPT = 6, 200


def left_to_do(pages: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that aren't in the store."""
    return pages.join(stored.select(*keys).distinct(), keys, "left_anti")


def recent_files(touched: DataFrame, kept: int = FILES_KEPT) -> DataFrame:
    """The files touched last, from (file, updated_at); of equal times the smaller name stays."""
    last = touched.groupBy("file").agg(F.max("updated_at").alias("updated_at"))
    return last.orderBy(F.col("updated_at").desc(), "file").limit(kept)


def history(entries: DataFrame, time: str, tie: str, kept: int = HISTORY_KEPT) -> DataFrame:
    """The newest entries, newest first."""
    return entries.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(kept)


def to_retry(title: Column, identifier: Column, source: Column) -> Column:
    """Whether a page is worth another look: an archive or record without an identifier from a sound source."""
    return title.rlike("档案|记录") & (identifier.isNull() | source.isin("pool", "fallback"))


def merge_retry(pages: DataFrame, again: DataFrame) -> DataFrame:
    """pages (file, page, id, source, evidence, alts, candidates) after a second look, again (the same columns).

    Its identifier counts if a label names it, or if there was none. Its candidates follow the old ones, its alternates join them.
    """
    new = again.select(F.col("file").alias("_f"), F.col("page").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("id", "source", "evidence", "alts", "candidates")])
    rows = pages.join(new, F.col("file").eqNullSafe(F.col("_f")) & F.col("page").eqNullSafe(F.col("_p")), "left")
    taken = F.col("_id").isNotNull() & (F.col("_source").eqNullSafe("label") | F.col("id").isNull())
    none = F.array().cast("array<string>")
    old_alts = F.when(taken, F.col("_alts")).otherwise(F.col("alts"))
    changed = {k: F.when(taken, F.col(f"_{k}")).otherwise(F.col(k)) for k in ("id", "source", "evidence")}
    changed["alts"] = F.array_union(F.coalesce(old_alts, none), F.coalesce("_alts", none))
    changed["candidates"] = F.concat(F.coalesce("candidates", none), F.coalesce("_candidates", none))
    return rows.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in pages.columns])


def merge_cell(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """pages after the third look at the identifier's cell alone, which counts only where there is still none."""
    new = cells.select(F.col("file").alias("_f"), F.col("page").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("id", "source", "evidence", "alts")])
    rows = pages.join(new, F.col("file").eqNullSafe(F.col("_f")) & F.col("page").eqNullSafe(F.col("_p")), "left")
    taken = F.col("id").isNull() & F.col("_id").isNotNull()
    return rows.select(*[(F.when(taken, F.col(f"_{c}")).otherwise(F.col(c)) if c in ("id", "source", "evidence", "alts") else F.col(f"`{c}`")).alias(c) for c in pages.columns])


def stored(pages: DataFrame, store: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """pages with the facts of the newest entry of the store, NULL for a miss. store: keys, facts, updated_at."""
    newest = store.groupBy(*keys).agg(F.max_by(F.struct(*facts), "updated_at").alias("_facts"))
    newest = newest.select(*[F.col(k).alias(f"_{k}") for k in keys], "_facts")
    met = F.lit(True)
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    return pages.join(newest, met, "left").select(*pages.columns, *[F.col(f"_facts.{c}").alias(c) for c in facts])


def put(store: str, pages: DataFrame, keys: list[str] = ["file", "page"]) -> None:  # noqa: B006
    """Adds pages to the store, a folder of Parquet files by file; `stored` takes the newest entry of each page."""
    pages.withColumn("updated_at", F.current_timestamp()).write.mode("append").partitionBy(keys[0]).parquet(store)


def trimmed(store: DataFrame, kept: int = FILES_KEPT) -> DataFrame:
    """The entries of the files touched last."""
    keep = recent_files(store.select("file", "updated_at"), kept).select(F.col("file").alias("_f"))
    return store.join(F.broadcast(keep), F.col("file") == F.col("_f"), "left_semi")  # `kept` rows
