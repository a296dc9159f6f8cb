"""Work queue, event log and liveness, as views over logs; `now` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "filtered", "failed", "aborted")


def acquire(queue: DataFrame, now: Column, n: int, lease: str = "3 hours", most: int = 200) -> DataFrame:
    """queue (id, state, locked_at) after one worker took up to n pending rows, oldest ids first.

    Rows whose lease has run out are pending again and may be taken at once.
    """
    stale = (F.col("state") == "processing") & (F.col("locked_at") < now - F.expr(f"INTERVAL {lease}"))
    freed = queue.withColumns({"state": F.when(stale, "pending").otherwise(F.col("state")), "locked_at": F.when(~stale, F.col("locked_at"))})
    taken = freed.filter("state = 'pending'").orderBy("id").limit(min(n, most)).select("id", F.lit(True).alias("__taken"))
    joined = freed.join(F.broadcast(taken), "id", "left")  # `most` rows
    return joined.select("id", F.when(F.col("__taken"), "processing").otherwise(F.col("state")).alias("state"), F.when(F.col("__taken"), now).otherwise(F.col("locked_at")).alias("locked_at"))


def commit(queue: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue with new states, results to insert): the first result of each id that is being processed; only completed and failed ones are inserted."""
    first = results.groupBy("id").agg(F.min(F.struct("seq", "outcome")).alias("r")).select("id", F.col("r.outcome").alias("outcome"))
    open_ = queue.filter("state = 'processing'").select("id")
    valid = first.join(open_, "id", "left_semi")
    updated = queue.join(valid, "id", "left").select("id", F.coalesce("outcome", "state").alias("state"), F.when(F.col("outcome").isNull(), F.col("locked_at")).alias("locked_at"))
    return updated, valid.filter(F.col("outcome").isin("completed", "failed"))


def job_status(events: DataFrame, job: str = "job_id", order: str = "event_id", kind: str = "event_type", payload: str = "state") -> DataFrame:
    """(job, status, events, late): the first end event decides; a state that is none counts as completed; later events are late."""
    ended = F.min(F.when(F.col("kind") == "end", F.struct("order", "payload")))
    log = events.select(F.col(job).alias("job"), F.col(order).alias("order"), F.col(kind).alias("kind"), F.col(payload).alias("payload"))
    marked = log.withColumn("first_end", ended.over(Window.partitionBy("job")))  # the sums below share its shuffle
    per = marked.groupBy("job").agg(F.min("first_end").alias("e"), F.count("*").alias("events"), F.count_if(F.col("kind") == "start").alias("starts"), F.count_if(F.col("order") > F.col("first_end.order")).alias("late"))
    status = F.when(F.col("e").isNotNull(), F.when(F.col("e.payload").isin(*TERMINAL), F.col("e.payload")).otherwise("completed")).when(F.col("starts") > 0, "running").otherwise("queued")
    return per.select("job", status.alias("status"), "events", "late")


def liveness(beats: DataFrame, host: str, ts: str, now: Column, window: str = "15 seconds") -> DataFrame:
    """(host, last_seen, online)."""
    last = beats.groupBy(F.col(host).alias("host")).agg(F.max(ts).alias("last_seen"))
    return last.withColumn("online", F.col("last_seen") >= now - F.expr(f"INTERVAL {window}"))


def first_labels(labels: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Write-once labels: the first that is given counts; of several at once the smallest."""
    return labels.filter(F.col(label).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(label).alias("l"))).alias("first")).select(key, F.col("first.l").alias(label))
