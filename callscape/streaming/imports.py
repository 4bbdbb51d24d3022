"""Code graphs that arrive as files: a stream that keeps a store up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscape.functions.names import plain_function, plain_module
from callscape.sources import ingest
from callscape.sources.store import Store


def import_stream(spark: SparkSession, folder: str, store: Store, project: str, checkpoint: str) -> StreamingQuery:
    """Import every new JSON file of a folder; each file once, as the stream's checkpoint tells which are done.

    Upserts are idempotent, so a batch that is repeated after a failure leaves the same rows.
    """
    store.setup()

    def take(batch: DataFrame, _: int) -> None:
        store.import_graph(batch, project)

    docs = spark.readStream.schema(ingest.SCHEMA).option("multiLine", True).json(folder).withColumn("_file", F.col("_metadata.file_path"))
    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_windows(calls: DataFrame, late: str = "30 days", width: str = "7 days") -> DataFrame:
    """(project, callee_module, callee_function, week, n_calls) of a stream of calls rows, by the time of the call.

    Deliveries of a call count once while they come within the watermark, rows later than that are dropped.
    """
    c = calls.where("callee_module is not null and callee_function is not null").withColumn("extracted_at", F.col("extracted_at").cast("timestamp")).withWatermark("extracted_at", late)
    c = c.dropDuplicatesWithinWatermark(["call_id"])
    keys = ["project", plain_module("callee_module").alias("callee_module"), plain_function("callee_function").alias("callee_function")]
    w = c.groupBy(F.window("extracted_at", width), *keys).agg(F.count(F.lit(1)).alias("n_calls"))
    return w.select("project", "callee_module", "callee_function", F.col("window.start").alias("week"), "n_calls")
