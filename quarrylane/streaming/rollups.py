"""The event log as a stream: deduplication, rollups, and job states kept over micro-batches."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quarrylane.scratch import shared_dir


def events_stream(spark: SparkSession, sf_dir: str, twice: bool = False) -> DataFrame:
    """events as a stream with a TIMESTAMP column ts; `twice` gives every event twice."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a table is a file or a folder; a stream reads folders, and the glob leaves the other tables out
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = source.parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withColumn("__copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("__copy") if twice else stream


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows of an hour. In mode append a window comes out, and its state goes, once the watermark has passed its end."""
    rolled = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rolled.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, start, n): runs of a user's events no further apart than the gap; in mode append they come out as hourly's windows do."""
    rolled = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rolled.select("user_id", F.col("session_window.start").alias("start"), "n")


def job_states(events: DataFrame) -> DataFrame:
    """(user_id, status, events): a purchase ends a user's job, a signup starts it; what comes later changes nothing but the count."""

    def update(key, batches, state):
        # which states were reached doesn't depend on the order, so batches are read one by one
        ended, started, n = state.get if state.exists else (False, False, 0)
        for rows in batches:
            kinds = rows["event_type"]
            ended, started, n = ended or bool((kinds == "purchase").any()), started or bool((kinds == "signup").any()), n + len(rows)
        state.update((ended, started, n))
        yield pd.DataFrame({"user_id": [key[0]], "status": ["completed" if ended else "running" if started else "queued"], "events": [n]})

    out, kept = "user_id long, status string, events long", "ended boolean, started boolean, events long"
    return events.select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns its result, by way of a table in the shared folder.

    Each micro-batch overwrites the last for mode complete and is appended for the others.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{folder}/out"

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
