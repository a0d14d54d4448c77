"""Keyed state with event-time timers: login lock-outs and the latest progress of tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SECOND = 1_000_000  # times are microseconds in state


class Lock:
    """An account's failures and the end of its lock: all that its past attempts are worth. The limit-th failure locks; attempts
    during a lock are refused and not counted; success clears the count, the end of a lock does not."""

    def __init__(self, limit: int, minutes: int, n: int = 0, until: int = 0):
        self.limit, self.length, self.n, self.until = max(1, limit), max(1, minutes) * 60 * SECOND, n, until

    def attempt(self, at: int, ok: bool | None) -> bool:
        """Whether the attempt locks the account."""
        if at < self.until:
            return False
        self.n = 0 if ok else self.n + 1
        if self.n < self.limit:
            return False
        self.until = at + self.length
        return True


def _micros(at: pd.Series) -> list[int]:
    return at.astype("datetime64[us]").astype("int64").tolist()


def _stamps(values: list[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(pd.Series(values, dtype="int64"), unit="us"))


class Lockouts(StatefulProcessor):
    """Attempts wait until the watermark has passed them and are then taken in order of (at, seq), each pair once. So an account
    keeps its Lock and the attempts of the watermark's delay, however many it has made; one without failures keeps nothing."""

    def __init__(self, limit: int, minutes: int):
        self.limit, self.minutes = limit, minutes

    def init(self, handle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", "n int, until long")
        self.waiting = handle.getListState("waiting", "at long, seq long, ok boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for frame in rows for r in zip(_micros(frame["at"]), frame["seq"].tolist(), frame["ok"].tolist(), strict=True)]
        return self._settle(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._settle(key, [], timerValues)

    def _settle(self, key, new: list[tuple], timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        waiting = {(at, seq): ok for at, seq, ok in [*(self.waiting.get() if self.waiting.exists() else ()), *new]}
        lock = Lock(self.limit, self.minutes, *(self.lock.get() if self.lock.exists() else ()))
        locked = [at for (at, _), ok in sorted(waiting.items()) if at <= passed and lock.attempt(at, ok)]
        rest = [(at, seq, ok) for (at, seq), ok in sorted(waiting.items()) if at > passed]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
        if lock.n:
            self.lock.update((lock.n, lock.until))
        else:
            self.lock.clear()
        if locked:
            yield pd.DataFrame({"email": key[0], "at": _stamps(locked), "locked_until": _stamps([at + lock.length for at in locked])})

    def close(self) -> None:
        pass


class LatestProgress(StatefulProcessor):
    """The latest event of a task; one that is not newer than it changes nothing. A task without events for the idle time loses
    its state: by then the watermark refuses whatever is older."""

    def __init__(self, idle_seconds: int, stages: int, steps: dict[str, float]):
        self.idle, self.stages, self.steps = idle_seconds * SECOND, stages, steps

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.latest.get()) if self.latest.exists() else None
        best = None
        for frame in rows:
            for r in zip(_micros(frame["at"]), frame["seq"].tolist(), frame["stage"].tolist(), frame["step"].tolist(), strict=True):
                if (known is None or r[:2] > known) and (best is None or r[:2] > best[:2]):
                    best = r
        if best is not None:
            at, seq, stage, step = best
            self.latest.update((at, seq))
            self.handle.registerTimer(-(-(at + self.idle) // 1000))
            yield pd.DataFrame({"task_id": [key[0]], "progress": [(stage + self.steps.get(step, 0.0)) / self.stages], "at": _stamps([at])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self.latest.get()[0] + self.idle <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_lockouts(logins: DataFrame, limit: int = 5, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """(email, at, locked_until) of the attempts that lock, from a stream of logins (email, at timestamp, seq, ok): the rows of
    lockouts(), in append mode, as the watermark passes them. Attempts may come in any order and more than once within the
    delay; later ones are dropped."""
    logins.sparkSession.conf.set(*PROVIDER)
    rows = logins.select("email", "at", F.col("seq").cast("long"), "ok").filter("email IS NOT NULL").withWatermark("at", delay)
    kind = logins.schema["email"].dataType.simpleString()
    return rows.groupBy("email").transformWithStateInPandas(
        Lockouts(limit, minutes), outputStructType=f"email {kind}, at timestamp, locked_until timestamp", outputMode="Append", timeMode="EventTime"
    )


def stream_latest(events: DataFrame, steps: dict[str, float], idle_seconds: int = 86400, stages: int = 5, delay: str = "10 minutes") -> DataFrame:
    """(task_id, progress, at) in update mode, from a stream of events (task_id, at timestamp, seq, stage, step): a row whenever a
    task's latest event changes. idle_seconds should be no shorter than the delay."""
    events.sparkSession.conf.set(*PROVIDER)
    rows = events.select("task_id", "at", F.col("seq").cast("long"), F.col("stage").cast("int"), "step").filter("task_id IS NOT NULL").withWatermark("at", delay)
    kind = events.schema["task_id"].dataType.simpleString()
    return rows.groupBy("task_id").transformWithStateInPandas(
        LatestProgress(idle_seconds, stages, steps), outputStructType=f"task_id {kind}, progress double, at timestamp", outputMode="Update", timeMode="EventTime"
    )


def fold_lockouts(logins: DataFrame, limit: int, minutes: int) -> DataFrame:
    """The same over a table of logins (email, at double of seconds, seq, ok): accounts are dealt over tasks, sorted there (on disk
    where need be), and each is folded over batches of its attempts with one Lock in memory, whatever its number of attempts."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        email, lock, last = None, Lock(limit, minutes), None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for who, at, seq, ok in zip(*(batch.column(c).to_pylist() for c in ("email", "us", "seq", "ok")), strict=True):
                if who != email:
                    email, lock, last = who, Lock(limit, minutes), None
                if (at, seq) != last and lock.attempt(at, ok):
                    for column, value in zip(out, (who, at / SECOND, lock.until / SECOND), strict=True):
                        column.append(value)
                last = at, seq
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("email").type), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())], ["email", "at", "locked_until"])

    rows = logins.filter("email IS NOT NULL AND at IS NOT NULL").select("email", F.round(F.col("at") * SECOND).cast("long").alias("us"), F.col("seq").cast("long"), "ok")
    kind = logins.schema["email"].dataType.simpleString()
    return rows.repartition("email").sortWithinPartitions("email", "us", "seq").mapInArrow(fold, f"email {kind}, at double, locked_until double")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its source is exhausted, as a table; run again on the same folder, it goes on where it stopped.
    In update mode every batch has its own folder, which a repeated batch replaces, and the table has the column batch_id."""
    write = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = write.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = write.foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows") if mode == "append" else stream.sparkSession.read.parquet(f"{folder}/rows")
