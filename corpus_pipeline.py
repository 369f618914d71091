"""From documents to token ids: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, line_dedup, minhash, mixing, registry, scratch, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _restored(rows: DataFrame, docs: DataFrame, new: dict[str, F.Column] | None = None) -> DataFrame:
    """The columns of docs out of `row`, some of them replaced. Names may be any."""
    return rows.select(*[(new or {}).get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose likeliest window scores one half or more.

    The network learns from the rows of labels whose documents are among docs. Null and empty texts are kept, as are
    rows without an identifier; repeated rows share their fate. Other columns may have any name. An empty table gives an
    empty result.
    """
    scratch.bound_batches(spark)
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one occurrence of each group of like lines; n_chars follows the text.

    A document of which no line is left goes. One that had no text stays as it was; so does n_chars where nothing was
    removed. Rows that repeat identifier and text lose the same lines. Other columns may have any name. An empty table
    gives an empty result.
    """
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    found = line_dedup.dedup_lines(rows).filter("_removed < _lines")
    size = F.when(F.col("_removed") > 0, F.length("_text").cast("long")).otherwise(F.col("row.n_chars"))
    return _restored(found, docs, {"text": F.col("_text"), "n_chars": size})


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the smallest identifier of each group of near-duplicates, by shingles of five words and a similarity of 0.8.

    Texts without words are linked with nothing and stay. Rows without an identifier stay. Rows that repeat the kept
    identifier stay. Other columns may have any name. An empty table gives an empty result.
    """
    scratch.bound_batches(spark)
    dropped = minhash.near_dedup(docs).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select("doc_id", F.struct("*").alias("row"))
    return _restored(rows.join(dropped, F.col("doc_id") == F.col("gone"), "left_anti"), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix, mix_slot and mix_place, and sorted by it.

    The order of files doesn't outlast a reread, as larger ones are read first; the two columns do, and replace columns
    of their names. Null sources are a source of their own; rows without an identifier come last in theirs. Other columns
    may have any name. An empty table gives an empty result.
    """
    mixed = mixing.mix(docs).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    passed = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("mix_slot", "mix_place")]
    return mixed.select(*passed, F.col("slot").alias("mix_slot"), F.col("place").alias("mix_place"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and decoded text of each document, and mix_slot and mix_place if docs has them.

    No other columns are returned, whatever their names. Null and empty texts have no ids. Sorted by mix_slot, then by
    mix_place, the rows are in the order of the mix. An empty table gives an empty result.
    """
    scratch.bound_batches(spark)
    mix = [c for c in ("mix_slot", "mix_place") if c in docs.columns]
    rows = docs.select(F.struct("doc_id", "lang", "source", *mix).alias("row"), "text")
    found = bpe.encode(rows, registry.VOCABULARY)
    passed = [F.col("row").getField(c).alias(c) for c in ("doc_id", "lang", "source")]
    return found.select(*passed, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded", *[F.col("row").getField(c).alias(c) for c in mix])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Neither the network nor connected groups or backtracking can be put in SQL; the tests hold each stage against others' work.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; each result but the last is written in spark.checkpoint.dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
