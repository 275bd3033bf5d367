"""Ingest of files as they arrive, into a store's text collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.engine import Engine
from siltstone.functions.formatting import file_kind
from siltstone.sources.files import texts
from siltstone.sources.store import ARRIVALS, Store


def stream_texts(engine: Engine, folder: str, store: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Store the pieces of new text files under ``store``/arrivals, one folder for each micro-batch.

    A batch that is run again after a failure overwrites its own folder, so
    every file is stored once.  :meth:`Store.collection` reads them with the rest.
    """
    spark: SparkSession = engine.spark
    target = Store(spark, store)
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        files = batch.withColumn("kind", file_kind(F.col("path"))).where("kind is not null")
        # numbers of a range of its own, above those of the store and of the batches before
        rows = engine.text_rows(texts(files), start=(number + 1) << 32)
        rows.write.mode("overwrite").parquet(f"{target.root}/{ARRIVALS}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
