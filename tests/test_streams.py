"""Streams with late, repeated and disordered records and with restarts, against the batch rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluice.streaming import jobs, state

START = dt.datetime(2024, 1, 1)
LOGIN = "email string, at timestamp, seq long, ok boolean"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes one more file of a stream's source."""
    (tmp_path / "in").mkdir()

    def add(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    return add


def batch_locks(spark, rows, limit, minutes):
    logins = spark.createDataFrame(rows, LOGIN).withColumn("at", F.unix_micros("at") / 1e6)
    return sorted((r.email, dt.datetime.fromtimestamp(r["at"], dt.UTC).replace(tzinfo=None), dt.datetime.fromtimestamp(r.locked_until, dt.UTC).replace(tzinfo=None)) for r in jobs.lockouts(logins, limit, minutes).collect())


def test_lockouts_as_a_stream_equal_the_batch_rows(spark, feed, tmp_path):
    rng = random.Random(4)
    rows = [(f"u{rng.choice([0, 0, 0, 1, 2, 3])}", at(60 * k + rng.randrange(50)), k, rng.random() < 0.3) for k in range(300)]
    early, late = rows[:150], rows[150:]
    rng.shuffle(early)  # in any order within the delay
    folder = str(tmp_path / "out")
    run = lambda stream: state.drain(state.stream_lockouts(stream, 3, 20, "4 hours"), folder)
    run(feed(early + early[:40], LOGIN))  # and some of them twice
    first = run(feed(late + late[:20], LOGIN)).count()  # a restart from the checkpoint
    assert run(feed([("u9", at(86400 * 3), 10_000, True)], LOGIN)).count() > first  # the watermark passes all of them
    got = sorted(map(tuple, run(feed([("u0", at(5), 20_000, False)] * 4, LOGIN)).collect()))  # far too late: dropped
    assert got == batch_locks(spark, rows, 3, 20) and len(got) > 10


def test_an_account_of_very_many_attempts_keeps_three_numbers(spark):
    n = 200_000
    many = spark.range(n).select(F.lit(" Hot@X.example").alias("email"), (F.col("id") * 60.0).alias("at"), F.col("id").alias("seq"), F.lit(False).alias("ok"))
    few = spark.createDataFrame([(None, 1.0, 1, False), ("a", None, 1, False), ("a", 1.0, 1, None), ("a", 1.0, 1, None), ("a", 2.0, 2, False)], "email string, at double, seq long, ok boolean")
    out = {r.email: r.n for r in jobs.lockouts(many.unionByName(few), 2, 30).groupBy("email").agg(F.count("*").alias("n")).collect()}
    assert out == {"hot@x.example": (n - 1 + 29) // 30, "a": 1}


def test_progress_as_a_stream(spark, feed, tmp_path):
    schema = "task_id string, at timestamp, seq long, stage int, step string"
    rows = [("a", at(10), 1, 0, "success"), ("a", at(20), 2, 1, "calling"), ("b", at(30), 3, 4, "success")]
    folder = str(tmp_path / "out")

    def run(stream):
        out = state.drain(state.stream_latest(stream, jobs.STEPS, 3600, 5, "10 minutes"), folder, "update")
        return sorted((r.batch_id, r.task_id, round(r.progress, 3)) for r in out.collect())

    first = run(feed(rows, schema))
    assert [r[1:] for r in first] == [("a", 0.24), ("b", 1.0)]
    assert run(feed(rows + [("a", at(15), 9, 0, "failed")], schema)) == first  # repeated and older events change nothing
    assert [r[1:] for r in run(feed([("a", at(40), 4, 2, "validating"), ("c", at(10_000), 5, 0, "started")], schema))[2:]] == [("a", 0.52), ("c", 0.0)]
    again = run(feed([("a", at(41), 6, 2, "success"), ("d", at(20_000), 7, 1, "started")], schema))[4:]
    assert [r[1:] for r in again] == [("d", 0.2)]  # an event later than the watermark is dropped, and the state has ended
    store = spark.read.format("statestore").option("stateVarName", "latest").load(f"{folder}/state")
    assert {r.key.task_id for r in store.select("key").collect()} <= {"c", "d"}


def test_daily_tokens_as_a_stream(spark, feed, tmp_path):
    schema, folder = "consumed_at timestamp, user_id string, tokens long", str(tmp_path / "out")
    run = lambda stream: sorted(map(tuple, state.drain(jobs.stream_daily_tokens(stream, 50), folder).collect()))
    day = dt.date(2024, 1, 1)
    assert run(feed([(at(100), "u", 30), (at(86_000), "u", 25)], schema)) == []  # the day is open
    closed = [(day, "u", 55, True)]
    assert run(feed([(at(86_400 + 7200), "v", 1)], schema)) == closed
    assert run(feed([(at(50), "u", 900), (at(86_400 + 60), "v", 4)], schema)) == closed  # the first record is late, the second is not
    assert run(feed([(at(3 * 86_400), "w", 1)], schema)) == [*closed, (day + dt.timedelta(days=1), "v", 5, False)]
    assert run(feed([], schema)) == [*closed, (day + dt.timedelta(days=1), "v", 5, False)]  # a restart doubles nothing
