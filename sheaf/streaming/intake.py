"""Pages that arrive as files go to the page store as a stream. An addition of this engine: nothing else here is a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sheaf.operators import pagestore


def arriving(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    """The pages of JSON lines in a folder, as its files come in. Lines that can't be read have nulls."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def keep(pages: DataFrame, store: str, checkpoint: str, keys: tuple[str, ...] = ("file", "page")) -> StreamingQuery:
    """Puts pages in the store that it doesn't hold yet, and ends when all that has arrived is done.

    A batch that is repeated after a failure adds nothing twice, as what it has put is held already. Pages without a file
    or number are left out.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        named = batch.dropna(subset=list(keys)).dropDuplicates(list(keys))
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            held = spark.read.parquet(store)
            named = pagestore.left_to_do(named, held.select(*[held[k].cast(named.schema[k].dataType).alias(k) for k in keys]), list(keys))
        pagestore.put(store, named, list(keys))

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
