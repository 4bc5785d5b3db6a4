"""Documents ingested as they arrive, and windows over the stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheaf.operators.inventory import merged
from sheaf.sources.documents import Decoder, ingest
from sheaf.sources.sinks import read_table, write_table


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_batch: int = 1000) -> DataFrame:
    """The files of a folder as a stream."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def start(files: DataFrame, decoders: list[tuple[str, Decoder]], corpus: str, inventory: str, checkpoint: str) -> StreamingQuery:
    """Ingests each batch: texts go to a partition of the corpus named by the batch, so a batch that is run
    again replaces itself; the inventory takes the batch's rows in place of older ones."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ingest(batch, decoders).write.mode("overwrite").parquet(f"{corpus}/batch={number}")
        # Read back what was written, so files aren't decoded a second time.
        rows = spark.read.parquet(f"{corpus}/batch={number}").select("id", "filename", "status")
        # An inventory that can't be read raises: taken for none it would be replaced by this batch.
        old = read_table(spark, inventory, "id string, filename string, status string")
        write_table(merged(old, rows, "id"), inventory)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, total): events in windows of time; later ones than the watermark are dropped
    by the stream, none by a batch."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")
    )
