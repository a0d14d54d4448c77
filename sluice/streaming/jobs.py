"""Streaming jobs: incremental refinement, daily token totals, task progress and login lock-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluice.functions.sensitive import flag
from sluice.operators.segment import split_segments
from sluice.streaming.state import fold_lockouts

# How far each step of a stage counts.
STEPS = {"started": 0.0, "retry": 0.1, "calling": 0.2, "validating": 0.6, "success": 1.0}


def start_refine(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Segments and flags newly dropped text files, each file once: a batch that is run again replaces its own folder
    batch_id=N under out, so read out as one table partitioned by batch_id."""
    files = spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))

    def refine(batch: DataFrame, batch_id: int) -> None:
        flag(split_segments(batch), "segment").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return files.writeStream.foreachBatch(refine).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_daily_tokens(ledger: DataFrame, limit: int, delay: str = "1 hour") -> DataFrame:
    """(day, user_id, tokens, over): totals per user and day of ledger (consumed_at timestamp, user_id, tokens), batch or stream.
    In a stream (append mode) a day's row comes once the watermark has passed its end; records later than the watermark are dropped."""
    totals = ledger.withWatermark("consumed_at", delay).groupBy(F.window("consumed_at", "1 day").alias("w"), "user_id").agg(F.sum("tokens").alias("tokens"))
    return totals.select(F.to_date("w.start").alias("day"), "user_id", "tokens", (F.col("tokens") >= limit).alias("over"))


def fraction(stage: Column, step: Column, stages: int = 5) -> Column:
    """(stage index + how far its step is) / stages; a failed step counts the stages before it."""
    done = F.when(step == "failed", 0.0)
    for name, share in STEPS.items():
        done = done.when(step == name, share)
    return (stage + F.coalesce(done, F.lit(0.0))) / stages


def stream_progress(events: DataFrame) -> DataFrame:
    """(task_id, progress, at) of the latest event (task_id, at, stage, step) of each task of a table; state.stream_latest() is the
    same for a stream, with state that ends."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("stage", "step"), "at").alias("e"), F.max("at").alias("at"))
    return last.select("task_id", fraction(F.col("e.stage"), F.col("e.step")).alias("progress"), "at")


def lockouts(logins: DataFrame, limit: int = 5, minutes: int = 30) -> DataFrame:
    """(email, at, locked_until) of the failures that lock, from logins (email, at seconds, seq, ok) in order of (at, seq), each pair
    once: the limit-th failure locks; attempts during a lock are refused and not counted; success clears the count; it is not
    cleared when a lock runs out, so that the next failure locks again. Names that are text are trimmed and lower-cased; rows
    without name or time do not count, one whose outcome is null has failed. state.stream_lockouts() is the same for a stream."""
    if isinstance(logins.schema["email"].dataType, T.StringType):
        logins = logins.withColumn("email", F.lower(F.trim("email")))
    return fold_lockouts(logins, limit, minutes)
