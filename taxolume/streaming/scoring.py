"""An extension: the same scores over a stream of query vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taxolume.operators.retrieve import retrieve


def retrieve_stream(queries: DataFrame, table: DataFrame, folder: str, checkpoint: str, **how) -> StreamingQuery:
    """Appends the top-k of each micro-batch of queries (query_id, q) to Parquet, once for each batch id."""

    def step(batch: DataFrame, number: int) -> None:
        retrieve(batch, table, **how).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, kind, n, total) in tumbling windows; rows later than the watermark are left out by the stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", kind, "n", "total")
