"""Usage, quotas, task upkeep and dashboards over task, ledger and user tables; now and tz are always parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_day(epoch: str, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(epoch), tz))


def _day(now: float, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(F.lit(now)), tz))


def stats_by_user(tasks: DataFrame) -> DataFrame:
    return tasks.filter("user_id IS NOT NULL").groupBy("user_id").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("file_size") > 0).alias("uploads"), F.coalesce(F.sum("token_consumed"), F.lit(0)).cast("long").alias("tokens")
    )


def daily_stats(tasks: DataFrame, days: int, now: float, tz: str = "UTC") -> DataFrame:
    return tasks.filter(F.col("created_at") >= now - days * 86400).groupBy(local_day("created_at", tz).alias("day")).agg(
        F.count("*").alias("tasks"), F.coalesce(F.sum("token_consumed"), F.lit(0)).cast("long").alias("tokens")
    )


def user_daily_trend(tasks: DataFrame, days: int, now: float, tz: str = "UTC") -> DataFrame:
    """A row for each user and each of the last days, zeros where nothing was done."""
    day = _day(now, tz)
    calendar = F.explode(F.sequence(F.date_sub(day, days - 1), day)).alias("day")
    users = tasks.filter("user_id IS NOT NULL").select("user_id").distinct().select("user_id", calendar)
    per_day = tasks.filter(F.col("created_at") >= now - days * 86400).groupBy("user_id", local_day("created_at", tz).alias("day")).agg(
        F.count("*").alias("tasks"), F.sum("token_consumed").cast("long").alias("tokens")
    )
    return users.join(per_day, ["user_id", "day"], "left").fillna(0, ["tasks", "tokens"])


def today_by_user(tasks: DataFrame, ledger: DataFrame, now: float, tz: str = "UTC") -> DataFrame:
    """Tasks and uploads created today; tokens consumed today by the ledger, and what tasks of today hold beyond it."""
    booked = ledger.groupBy("task_id").agg(F.sum("tokens").alias("_b"))
    day = _day(now, tz)
    own = tasks.filter((local_day("created_at", tz) == day) & F.col("user_id").isNotNull()).join(booked, "task_id", "left").groupBy("user_id").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("file_size") > 0).alias("uploads"),
        F.sum(F.greatest(F.coalesce("token_consumed", F.lit(0)) - F.coalesce("_b", F.lit(0)), F.lit(0))).cast("long").alias("_more"),
    )
    today = ledger.filter((local_day("consumed_at", tz) == day) & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.sum("tokens").cast("long").alias("_today"))
    return own.join(today, "user_id", "full").fillna(0).select("user_id", "tasks", "uploads", (F.col("_today") + F.col("_more")).alias("tokens"))


#: Seconds of a piece of a user's day: what a window sorts is one piece, and a day has 1440 of them.
PIECE = 60


def _pieces(at: str) -> Column:
    return F.floor(F.col(at) / PIECE).alias("_piece")


def _before(pieces: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Running sums over the pieces of each user's day, without the piece itself: pieces has a row for each."""
    order = Window.partitionBy("user_id", "day").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("user_id", "day", "_piece", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(n) for n, c in sums.items()])


def admit(arrivals: DataFrame, task_limit: int, upload_limit: int, tz: str = "UTC") -> DataFrame:
    """Adds verdict: 'admitted', or the limit that refused it ('task' or 'upload'), in order of arrival per user and day;
    refused rows do not count, anonymous ones are always admitted. The first refusal closes the day for the same reason,
    since nothing is counted after it; so places and running sums tell every verdict. They are summed in two levels, within
    pieces of a day and over the pieces, so that a day with a third of all rows is spread over tasks."""
    key = ["user_id", "day", "_piece"]
    upload = (F.coalesce("file_size", F.lit(0)) > 0).cast("long")
    known = arrivals.filter("user_id IS NOT NULL").select("user_id", local_day("created_at", tz).alias("day"), _pieces("created_at"), "created_at", "task_id", "file_size", upload.alias("_upload"))
    totals = _before(known.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("_upload").alias("_u")), {"_rows_before": "_n", "_uploads_before": "_u"})
    order = Window.partitionBy(*key).orderBy("created_at", "task_id", "file_size")
    inside = known.withColumns({"_place": F.row_number().over(order) - 1, "_ups": F.coalesce(F.sum("_upload").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    placed = inside.join(totals, key).select("user_id", "day", "task_id", "_upload", (F.col("_place") + F.col("_rows_before")).alias("_place"), (F.col("_ups") + F.col("_uploads_before")).alias("_ups"))
    if upload_limit > 0:  # the place after the upload that reaches the limit
        full = placed.filter((F.col("_upload") == 1) & (F.col("_ups") == upload_limit - 1)).select("user_id", "day", (F.col("_place") + 1).alias("_full"))
        placed = placed.join(full, ["user_id", "day"], "left")
    else:
        placed = placed.withColumn("_full", F.lit(0))
    closed = (F.col("_place") >= F.col("_full")) & (F.col("_full") < task_limit)
    verdict = F.when(F.coalesce(closed, F.lit(False)), "upload").when(F.col("_place") >= task_limit, "task").otherwise("admitted")
    nobody = arrivals.filter("user_id IS NULL").select("user_id", local_day("created_at", tz).alias("day"), F.col("task_id").cast("string"), F.lit("admitted").alias("verdict"))
    return placed.select("user_id", "day", F.col("task_id").cast("string"), verdict.alias("verdict")).unionByName(nobody)


def quota_breaches(ledger: DataFrame, limit: int, tz: str = "UTC") -> DataFrame:
    """(user_id, day, task_id, consumed_at, total): the record with which a user's day first reaches the limit. Token counts are
    not negative, so the piece of the day that reaches it is told by the pieces' sums, and only its records are put in order."""
    key = ["user_id", "day", "_piece"]
    known = ledger.filter("user_id IS NOT NULL").select("user_id", local_day("consumed_at", tz).alias("day"), _pieces("consumed_at"), "task_id", "consumed_at", "tokens")
    sums = known.groupBy(*key).agg(F.sum("tokens").alias("_t"))
    reached = _before(sums, {"_start": "_t"}).join(sums, key).filter((F.col("_start") < limit) & (F.col("_start") + F.col("_t") >= limit) | (F.lit(limit <= 0) & (F.col("_start") <= 0)))
    first = reached.groupBy("user_id", "day").agg(F.min_by(F.struct("_piece", "_start"), "_piece").alias("p")).select("user_id", "day", "p.*")
    order = Window.partitionBy(*key).orderBy("consumed_at", "task_id")
    running = known.join(first, key).withColumn("total", F.col("_start") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = running.filter(F.col("total") >= limit).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    return at.select("user_id", "day", "task_id", "consumed_at", "total")


def dashboard(users: DataFrame, tasks: DataFrame, now: float, tz: str = "UTC") -> DataFrame:
    """One row of counts."""
    state = F.col("status")
    t = tasks.agg(
        F.count("*").alias("tasks"), F.count_if(local_day("created_at", tz) == _day(now, tz)).alias("today"), F.count_if(state.isin("processing", "pending")).alias("open"),
        F.count_if(state == "completed").alias("completed"), F.count_if(state.isin("failed", "cancelled")).alias("failed"), F.coalesce(F.sum("token_consumed"), F.lit(0)).cast("long").alias("tokens"),
        F.count_if(F.col("file_size") > 0).alias("uploads"), F.count_distinct("user_id").alias("active_owners"), F.count_if(state.isin("failed", "cancelled", "warning")).alias("abnormal"),
    )
    u = users.agg(F.count("*").alias("users"), F.count_if(F.col("status") == "active").alias("active_users"))
    one = F.lit(1).alias("_k")
    return u.select("*", one).join(t.select("*", one), "_k").drop("_k")


def top_users(tasks: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    return stats_by_user(tasks).join(users.select(F.col("id").alias("user_id"), "username"), "user_id").orderBy(F.desc("tokens"), "user_id").limit(n)


def user_list(users: DataFrame, tasks: DataFrame, search: str = "", role: str | None = None, status: str | None = None, viewer_role: str = "admin") -> DataFrame:
    out = users
    if search:
        out = out.filter(F.contains(F.lower("username"), F.lit(search.lower())) | F.contains(F.lower("email"), F.lit(search.lower())))
    if role:
        out = out.filter(F.col("role") == role)
    if status:
        out = out.filter(F.col("status") == status)
    if viewer_role != "super_admin":
        out = out.filter("role <> 'super_admin'")
    return out.withColumnRenamed("id", "user_id").join(stats_by_user(tasks), "user_id", "left").fillna(0, ["tasks", "uploads", "tokens"])


def recent_tasks(tasks: DataFrame, n: int = 6) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "task_id")
    return tasks.filter("user_id IS NOT NULL").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def task_list(tasks: DataFrame, outputs: DataFrame, owner: str | None = None) -> DataFrame:
    """Tasks, of one owner where given, and output folders that are no task's."""
    own = tasks if owner is None else tasks.filter(F.col("user_id") == owner)
    return own.unionByName(outputs.join(tasks.select("task_id"), "task_id", "left_anti"), allowMissingColumns=True)


def progress(stage_files: DataFrame, stages: int = 5) -> DataFrame:
    """(task_id, progress, status) from finished stages (task_id, stage; the final record is stage 'final')."""
    done = stage_files.groupBy("task_id").agg(F.count_distinct("stage").alias("n"), F.max(F.col("stage") == "final").alias("final"))
    return done.select("task_id", F.when(F.col("final"), 1.0).otherwise(F.col("n") / stages).alias("progress"), F.when(F.col("final"), "completed").otherwise("processing").alias("status"))


def apply_batch(tasks: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """(task_id, outcome): cancel takes open tasks, retry failed or cancelled ones, delete those that are not processing."""
    state = F.col("status")
    fits = {"cancel": state.isin("pending", "processing", "pausing", "paused"), "retry": state.isin("failed", "cancelled"), "delete": ~state.isin("processing", "pausing")}[action]
    found = ids.select("task_id").distinct().join(tasks.select("task_id", "status"), "task_id", "left")
    return found.select("task_id", F.when(state.isNull(), "not_found").when(fits, "success").otherwise("skipped").alias("outcome"))


def recover(tasks: DataFrame, message: str = "interrupted") -> DataFrame:
    state = F.col("status")
    return tasks.withColumns({"error": F.when(state == "processing", message).otherwise(F.col("error")), "status": F.when(state == "pausing", "paused").when(state == "processing", "failed").otherwise(state)})


def retention(files: DataFrame, tasks: DataFrame, file_days: int, result_days: int, now: float) -> tuple[DataFrame, DataFrame]:
    """(files kept, tasks kept): 0 days keep for ever; tasks of dropped results go with them. files: path, task_id, kind, modified_at."""
    days = F.when(F.col("kind") == "upload", file_days).otherwise(result_days)
    old = (days > 0) & (F.col("modified_at") < F.lit(now) - days * 86400)
    gone = files.filter(old & (F.col("kind") == "result")).select("task_id").distinct()
    return files.filter(~old), tasks.join(gone, "task_id", "left_anti")
