"""Queries over usage, quotas, audit, access, messages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import access, usage
from sluice.plans import base
from sluice.plans.base import LEDGER, NOW, TASKS, USERS, table
from sluice.streaming import jobs, state

QUERIES, ORACLES = {}, {}
BASE = f"WITH {TASKS}, {LEDGER}, {USERS}"
DAY = "CAST(CAST(to_timestamp({0}) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR)"
SINCE = 1705276800.0  # 2024-01-15T00:00:00Z


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(BASE + " SELECT user_id, count(*) AS tasks, count(*) FILTER (file_size > 0) AS uploads, CAST(sum(token_consumed) AS BIGINT) AS tokens FROM tasks WHERE user_id IS NOT NULL GROUP BY user_id")
def stats_by_user(spark, sf_dir):
    return usage.stats_by_user(base.tasks(spark, sf_dir))


@query(BASE + f" SELECT {DAY.format('created_at')} AS day, count(*) AS tasks, CAST(sum(token_consumed) AS BIGINT) AS tokens FROM tasks WHERE created_at >= {SINCE} - 7 * 86400 GROUP BY 1")
def daily_stats(spark, sf_dir):
    return usage.daily_stats(base.tasks(spark, sf_dir), 7, SINCE).withColumn("day", F.col("day").cast("string"))


@query(BASE + f""", u AS (SELECT DISTINCT user_id FROM tasks WHERE user_id IS NOT NULL), d AS (SELECT CAST(CAST(unnest(range(DATE '2024-01-09', DATE '2024-01-16', INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day),
p AS (SELECT user_id, {DAY.format('created_at')} AS day, count(*) AS n, sum(token_consumed) AS t FROM tasks WHERE created_at >= {SINCE} - 7 * 86400 GROUP BY 1, 2)
SELECT u.user_id, d.day, coalesce(n, 0) AS tasks, CAST(coalesce(t, 0) AS BIGINT) AS tokens FROM u, d LEFT JOIN p ON p.user_id = u.user_id AND p.day = d.day""")
def user_daily_trend(spark, sf_dir):
    return usage.user_daily_trend(base.tasks(spark, sf_dir), 7, SINCE).withColumn("day", F.col("day").cast("string"))


@query(BASE + f""", b AS (SELECT task_id, sum(tokens) AS b FROM ledger GROUP BY task_id), o AS (
SELECT user_id, count(*) AS tasks, count(*) FILTER (file_size > 0) AS uploads, sum(greatest(token_consumed - coalesce(b, 0), 0)) AS more FROM tasks LEFT JOIN b USING (task_id) WHERE {DAY.format('created_at')} = '2024-01-15' AND user_id IS NOT NULL GROUP BY user_id),
l AS (SELECT user_id, sum(tokens) AS t FROM ledger WHERE {DAY.format('consumed_at')} = '2024-01-15' AND user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, coalesce(tasks, 0) AS tasks, coalesce(uploads, 0) AS uploads, CAST(coalesce(more, 0) + coalesce(t, 0) AS BIGINT) AS tokens FROM o FULL JOIN l USING (user_id)""")
def today_by_user(spark, sf_dir):
    return usage.today_by_user(base.tasks(spark, sf_dir), base.ledger(spark, sf_dir), SINCE)


@query(BASE + f""", n AS (SELECT task_id, user_id, {DAY.format('created_at')} AS day, row_number() OVER (PARTITION BY user_id, {DAY.format('created_at')} ORDER BY created_at, task_id) AS r FROM tasks)
SELECT user_id, day, task_id, CASE WHEN user_id IS NULL OR r <= 2 THEN 'admitted' ELSE 'task' END AS verdict FROM n""")
def admissions(spark, sf_dir):
    return usage.admit(base.tasks(spark, sf_dir), 2, 1_000_000).withColumn("day", F.col("day").cast("string"))


@query(BASE + f""", c AS (SELECT user_id, {DAY.format('consumed_at')} AS day, task_id, consumed_at, sum(tokens) OVER (PARTITION BY user_id, {DAY.format('consumed_at')} ORDER BY consumed_at, task_id ROWS UNBOUNDED PRECEDING) AS total FROM ledger WHERE user_id IS NOT NULL)
SELECT user_id, day, task_id, consumed_at, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY consumed_at, task_id) AS r FROM c WHERE total >= 50) WHERE r = 1""")
def quota_breaches(spark, sf_dir):
    return usage.quota_breaches(base.ledger(spark, sf_dir), 50).withColumn("day", F.col("day").cast("string"))


@query(BASE + f""" SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM users WHERE status = 'active') AS active_users, count(*) AS tasks, count(*) FILTER ({DAY.format('created_at')} = '2024-01-15') AS today,
count(*) FILTER (status IN ('processing', 'pending')) AS open, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('failed', 'cancelled')) AS failed, CAST(sum(token_consumed) AS BIGINT) AS tokens,
count(*) FILTER (file_size > 0) AS uploads, count(DISTINCT user_id) AS active_owners, count(*) FILTER (status IN ('failed', 'cancelled', 'warning')) AS abnormal FROM tasks""")
def dashboard(spark, sf_dir):
    return usage.dashboard(base.users(spark, sf_dir), base.tasks(spark, sf_dir), SINCE)


@query(BASE + " SELECT user_id, count(*) AS tasks, count(*) FILTER (file_size > 0) AS uploads, CAST(sum(token_consumed) AS BIGINT) AS tokens, any_value(username) AS username FROM tasks JOIN users ON users.id = user_id GROUP BY user_id ORDER BY tokens DESC, user_id LIMIT 10")
def top_users(spark, sf_dir):
    return usage.top_users(base.tasks(spark, sf_dir), base.users(spark, sf_dir))


@query(BASE + """, s AS (SELECT user_id, count(*) AS tasks, count(*) FILTER (file_size > 0) AS uploads, sum(token_consumed) AS tokens FROM tasks WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT id AS user_id, username, email, role, status, coalesce(tasks, 0) AS tasks, coalesce(uploads, 0) AS uploads, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens FROM users LEFT JOIN s ON s.user_id = id WHERE email LIKE '%machinery%' AND status = 'active' AND role <> 'super_admin'""")
def user_list(spark, sf_dir):
    return usage.user_list(base.users(spark, sf_dir), base.tasks(spark, sf_dir), "Machinery", status="active")


@query(BASE + " SELECT user_id, task_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, task_id) AS INT) AS rank FROM tasks WHERE user_id IS NOT NULL) WHERE rank <= 6")
def recent_tasks(spark, sf_dir):
    return usage.recent_tasks(base.tasks(spark, sf_dir)).select("user_id", "task_id", "rank")


@query(BASE + " SELECT task_id, user_id, status FROM tasks UNION ALL SELECT 'order-' || o_orderkey, NULL, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'processing' END FROM orders")
def task_list(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing")
    outputs = table(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("task_id"), status.alias("status"))
    return usage.task_list(base.tasks(spark, sf_dir), outputs).select("task_id", "user_id", "status")


@query("SELECT user_id AS task_id, CASE WHEN bool_or(event_type = 'purchase') THEN 1.0 ELSE count(DISTINCT event_type) / 5 END AS progress, CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' ELSE 'processing' END AS status FROM events GROUP BY user_id")
def task_progress(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "purchase", "final").otherwise(F.col("event_type")).alias("stage"))
    return usage.progress(files)


@query(BASE + " SELECT k AS task_id, CASE WHEN t.task_id IS NULL THEN 'not_found' WHEN status IN ('failed', 'cancelled') THEN 'success' ELSE 'skipped' END AS outcome FROM (SELECT CAST(c_custkey * 13 AS VARCHAR) AS k FROM customer) LEFT JOIN tasks AS t ON t.task_id = k")
def batch_retry(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 13).cast("string").alias("task_id"))
    return usage.apply_batch(base.tasks(spark, sf_dir), ids, "retry")


@query(BASE + " SELECT task_id, CASE status WHEN 'pausing' THEN 'paused' WHEN 'processing' THEN 'failed' ELSE status END AS status, CASE status WHEN 'processing' THEN 'interrupted' END AS error FROM tasks")
def recovered_tasks(spark, sf_dir):
    return usage.recover(base.tasks(spark, sf_dir)).select("task_id", "status", "error")


@query(BASE + f" SELECT task_id FROM tasks WHERE NOT (CAST(task_id AS BIGINT) % 2 = 1 AND created_at < {NOW} - 20 * 86400)")
def retained_tasks(spark, sf_dir):
    t = base.tasks(spark, sf_dir)
    files = t.select("task_id", F.when(F.col("task_id") % 2 == 1, "result").otherwise("upload").alias("kind"), F.col("created_at").alias("modified_at"))
    return usage.retention(files, t, 10, 20, NOW)[1].select("task_id")


def _logs(spark, sf_dir):
    return base.tasks(spark, sf_dir).select(F.col("task_id").cast("long").alias("id"), "user_id", F.col("status").alias("action"), "created_at")


@query(BASE + f" SELECT CAST(task_id AS BIGINT) AS id, user_id, status AS action, created_at FROM tasks WHERE status = 'failed' AND created_at >= {SINCE} ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20")
def audit_search(spark, sf_dir):
    return access.audit_search(_logs(spark, sf_dir), action="failed", since=SINCE, limit=50, offset=20)


@query(BASE + " SELECT CAST(task_id AS BIGINT) AS id, user_id, t.status AS action, created_at FROM tasks AS t WHERE user_id IN (SELECT id FROM users WHERE email LIKE '%household%')")
def audit_by_keyword(spark, sf_dir):
    return access.audit_by_keyword(_logs(spark, sf_dir), base.users(spark, sf_dir), "household").select("id", "user_id", "action", "created_at")


def _rules(spark, sf_dir):
    """Networks of nations, domains of regions and a blacklist of the users who are disabled."""
    n = table(spark, sf_dir, "nation").select(F.lit("ip_whitelist").alias("type"), F.concat(F.lit("10."), F.col("n_nationkey").cast("string"), F.lit(".0.0/17")).alias("value"))
    v6 = table(spark, sf_dir, "region").select(F.lit("ip_whitelist").alias("type"), F.concat(F.lit("fd00:"), F.col("r_regionkey").cast("string"), F.lit("::/32")).alias("value"))
    d = table(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.lit("domain_whitelist").alias("type"), F.when(F.col("r_regionkey") == 0, "@HOUSEHOLD.example").otherwise("machinery.example").alias("value"))
    b = base.users(spark, sf_dir).filter("status = 'disabled'").select(F.lit("user_blacklist").alias("type"), F.upper("email").alias("value"))
    return n.unionByName(v6).unionByName(d).unionByName(b).withColumn("note", F.lit(None).cast("string"))


@query(BASE + """, c AS (SELECT CAST(id AS BIGINT) AS k, id, email, status FROM users) SELECT id, CASE WHEN status = 'disabled' THEN 'blacklisted'
WHEN NOT CASE k % 5 WHEN 0 THEN k % 40 < 25 AND k % 250 < 128 WHEN 1 THEN true WHEN 2 THEN k % 7 < 5 WHEN 3 THEN false ELSE false END THEN 'ip'
WHEN NOT (email LIKE '%@household.example' OR email LIKE '%@machinery.example') THEN 'domain' ELSE 'allowed' END AS decision FROM c""")
def screened_logins(spark, sf_dir):
    k = F.col("id").cast("long")
    text = lambda c: c.cast("string")
    ip = F.when(k % 5 == 0, F.concat(F.lit("10."), text(k % 40), F.lit("."), text(k % 250), F.lit(".7"))).when(k % 5 == 1, "127.0.0.1").when(k % 5 == 2, F.concat(F.lit("fd00:"), text(k % 7), F.lit("::1"))).when(k % 5 == 3, "not an address").otherwise("8.8.8.8")
    return access.screen(base.users(spark, sf_dir).select("id", "email", ip.alias("ip")), _rules(spark, sf_dir)).select("id", "decision")


@query(BASE + " SELECT type, value, valid, name FROM (SELECT 'user_blacklist' AS type, upper(email) AS value, true AS valid, username AS name FROM users WHERE status = 'disabled' UNION ALL SELECT 'ip_whitelist', '10.' || n_nationkey || '.0.0/17', true, NULL FROM nation UNION ALL SELECT 'ip_whitelist', 'fd00:' || r_regionkey || '::/32', true, NULL FROM region UNION ALL SELECT 'domain_whitelist', CASE r_regionkey WHEN 0 THEN '@HOUSEHOLD.example' ELSE 'machinery.example' END, true, NULL FROM region WHERE r_regionkey < 2)")
def access_rules(spark, sf_dir):
    return access.check_rules(access.rule_list(_rules(spark, sf_dir), base.users(spark, sf_dir))).select("type", "value", "valid", "name")


def _messages(spark, sf_dir):
    """A message for each order: to all, to two users, scheduled or revoked."""
    k = F.col("o_orderkey")
    both = F.concat(F.lit('["'), (k % 100).cast("string"), F.lit('","'), F.col("o_custkey").cast("string"), F.lit('"]'))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 1000 == 0, "all").otherwise(both).alias("target_users"), F.when(k % 4 == 0, "scheduled").when(k % 4 == 1, "revoked").otherwise("sent").alias("status"),
        (F.lit(NOW) + (k % 50 - 25) * 100).alias("scheduled_at"), F.when(k % 4 > 1, F.lit(NOW) - k).alias("sent_at"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").cast("date").cast("string").alias("title"),
    )


MESSAGES = f"""
raw AS (
  SELECT o_orderkey AS id, CAST(o_orderkey % 100 AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b, o_orderkey % 1000 = 0 AS everyone,
         CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 50 <= 25 THEN 'sent' ELSE 'scheduled' END WHEN o_orderkey % 4 = 1 THEN 'revoked' ELSE 'sent' END AS status,
         CASE WHEN o_orderkey % 4 = 0 THEN {NOW} + (o_orderkey % 50 - 25) * 100 ELSE {NOW} - o_orderkey END AS sent FROM orders
)"""


@query(BASE + "," + MESSAGES + """, t AS (SELECT id, sent, a AS user_id FROM raw WHERE NOT everyone AND status = 'sent' UNION ALL SELECT id, sent, b FROM raw WHERE NOT everyone AND status = 'sent'),
v AS (SELECT t.id, sent, user_id FROM t JOIN users ON users.id = user_id UNION ALL SELECT raw.id, sent, users.id FROM raw, users WHERE everyone AND raw.status = 'sent')
SELECT user_id, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY sent DESC, id) AS INT) AS rank FROM v) WHERE rank <= 5""")
def inboxes(spark, sf_dir):
    return access.inbox(_messages(spark, sf_dir), base.users(spark, sf_dir), NOW, 5).select("user_id", "id", "rank")


@query(BASE + "," + MESSAGES + " SELECT raw.id, raw.status, CASE WHEN everyone THEN 'all' ELSE coalesce(x.username, a) || '、' || coalesce(y.username, b) END AS targets FROM raw LEFT JOIN users AS x ON x.id = a LEFT JOIN users AS y ON y.id = b")
def message_list(spark, sf_dir):
    return access.message_list(_messages(spark, sf_dir), base.users(spark, sf_dir), NOW)


@query(BASE + f" SELECT {DAY.format('consumed_at')} AS day, user_id, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) >= 50 AS over FROM ledger GROUP BY 1, 2")
def daily_tokens(spark, sf_dir):
    led = base.ledger(spark, sf_dir).withColumn("consumed_at", F.timestamp_seconds("consumed_at"))
    return jobs.stream_daily_tokens(led, 50).withColumn("day", F.col("day").cast("string"))


@query("SELECT user_id AS task_id, (arg_max(event_id % 5, event_id) + arg_max(CASE event_type WHEN 'view' THEN 0.0 WHEN 'click' THEN 0.2 WHEN 'signup' THEN 0.6 WHEN 'purchase' THEN 1.0 ELSE 0.0 END, event_id)) / 5 AS progress, max(event_id) AS last_event FROM events GROUP BY user_id")
def latest_progress(spark, sf_dir):
    kind = F.col("event_type")
    step = F.when(kind == "view", "started").when(kind == "click", "calling").when(kind == "signup", "validating").when(kind == "purchase", "success").otherwise("failed")
    return jobs.stream_progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("at"), (F.col("event_id") % 5).alias("stage"), step.alias("step"))).withColumnRenamed("at", "last_event")


@query(BASE + "," + MESSAGES + """ SELECT raw.id, raw.status, CASE WHEN everyone THEN 'all' ELSE coalesce(x.username, a) || '、' || coalesce(y.username, b) END AS targets
FROM raw JOIN orders ON o_orderkey = id LEFT JOIN users AS x ON x.id = a LEFT JOIN users AS y ON y.id = b WHERE o_orderpriority LIKE '1%' AND raw.status = 'sent' AND CAST(CAST(o_orderdate AS DATE) AS VARCHAR) LIKE '%-03-%'""")
def found_messages(spark, sf_dir):
    return access.message_list(_messages(spark, sf_dir), base.users(spark, sf_dir), NOW, "1-URGENT", "sent", "-03-")


@query("""WITH RECURSIVE l AS (SELECT user_id, event_id, floor(epoch(ts)) AS t, event_type NOT IN ('error', 'view') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS r FROM events),
w AS (SELECT user_id, r, CASE WHEN ok THEN 0 ELSE 1 END AS n, CAST(0 AS DOUBLE) AS until, false AS locks, CAST(t AS DOUBLE) AS t FROM l WHERE r = 1
UNION ALL SELECT l.user_id, l.r, CASE WHEN l.t < until THEN n WHEN ok THEN 0 ELSE n + 1 END, CASE WHEN l.t >= until AND NOT ok AND n + 1 >= 3 THEN l.t + 7200.0 ELSE until END, l.t >= until AND NOT ok AND n + 1 >= 3, CAST(l.t AS DOUBLE)
FROM w JOIN l ON l.user_id = w.user_id AND l.r = w.r + 1)
SELECT user_id AS email, t AS locked_at, until AS locked_until FROM w WHERE locks""")
def lockouts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    logins = e.select(F.col("user_id").alias("email"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "view")).alias("ok"))
    return jobs.lockouts(logins, 3, 120).withColumnRenamed("at", "locked_at")


def _event_stream(spark, sf_dir):
    """The table as a stream, times cut to seconds as in the batch queries."""
    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's path is a folder or one
    return stream.withColumn("at", F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp"))))


@query(ORACLES["lockouts"])
def lockouts_streamed(spark, sf_dir):
    """The lock-outs of the event-time stream: the same rows as the batch fold gives."""
    logins = _event_stream(spark, sf_dir).select(F.col("user_id").alias("email"), "at", F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "view")).alias("ok"))
    out = state.drain(state.stream_lockouts(logins, 3, 120, "0 seconds"), base.folder(spark))
    return out.select("email", F.unix_timestamp("at").cast("double").alias("locked_at"), F.unix_timestamp("locked_until").cast("double").alias("locked_until"))


@query("""WITH e AS (SELECT user_id, event_id % 5 AS stage, CASE event_type WHEN 'view' THEN 0.0 WHEN 'click' THEN 0.2 WHEN 'signup' THEN 0.6 WHEN 'purchase' THEN 1.0 ELSE 0.0 END AS step, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id FROM events)
SELECT user_id AS task_id, (stage + step) / 5 AS progress, t AS last_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r FROM e) WHERE r = 1""")
def progress_streamed(spark, sf_dir):
    kind = F.col("event_type")
    step = F.when(kind == "view", "started").when(kind == "click", "calling").when(kind == "signup", "validating").when(kind == "purchase", "success").otherwise("failed")
    events = _event_stream(spark, sf_dir).select(F.col("user_id").alias("task_id"), "at", F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("stage"), step.alias("step"))
    out = state.drain(state.stream_latest(events, jobs.STEPS), base.folder(spark), "update")
    return out.select("task_id", "progress", F.unix_timestamp("at").alias("last_at"))


@query(f"""WITH e AS (SELECT user_id, to_timestamp(floor(epoch(ts))) AS t, event_id % 97 AS tokens FROM events), d AS (SELECT {DAY.format('epoch(t)')} AS day, user_id, tokens, t FROM e)
SELECT day, user_id, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) >= 50 AS over FROM d WHERE CAST(day AS DATE) + 1 <= (SELECT (max(t) - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' FROM e) GROUP BY 1, 2""")
def closed_days(spark, sf_dir):
    """The daily totals of the event-time stream in append mode: those of days that its watermark has passed."""
    ledger = _event_stream(spark, sf_dir).select(F.col("at").alias("consumed_at"), "user_id", (F.col("event_id") % 97).alias("tokens"))
    return state.drain(jobs.stream_daily_tokens(ledger, 50), base.folder(spark)).withColumn("day", F.col("day").cast("string"))
