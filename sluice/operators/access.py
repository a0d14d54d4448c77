"""Audit search, access rules and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.addresses import address, network


def audit_search(logs: DataFrame, user_id: str | None = None, action: str | None = None, since: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of matching log rows, newest first; the page size stays within 1..500."""
    return audit_matches(logs, user_id, action, since).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(min(max(limit, 1), 500))


def audit_matches(logs: DataFrame, user_id: str | None = None, action: str | None = None, since: float | None = None) -> DataFrame:
    for name, value in (("user_id", user_id), ("action", action)):
        logs = logs if value is None else logs.filter(F.col(name) == value)
    return logs if since is None else logs.filter(F.col("created_at") >= since)


def audit_by_keyword(logs: DataFrame, users: DataFrame, keyword: str) -> DataFrame:
    """Log rows of users whose name or e-mail holds the keyword; filtered before any paging."""
    hit = users.filter(F.contains(F.lower("username"), F.lit(keyword.lower())) | F.contains(F.lower("email"), F.lit(keyword.lower())))
    return logs.join(hit.select(F.col("id").alias("user_id")), "user_id", "left_semi")


#: Always let in, so that nobody locks themselves out of their own machine.
LOOPBACK = ("127.0.0.1", "::1", "localhost")


def screen_ip(df: DataFrame, rules: DataFrame, ip: str = "ip") -> DataFrame:
    """Adds ip_ok: loopback, or within a rule of type ip_whitelist (an address or a network, v4 or v6), and ip_rule, the longest
    such network; a bad address is refused, a bad rule is no rule. Each distinct address is cut to every length that networks
    have (162 at most) and joined with them by equality, so neither table's size matters and Spark chooses the join."""
    nets = rules.filter("type = 'ip_whitelist'").select(network(F.col("value")).alias("_net"), F.trim("value").alias("ip_rule")).filter("_net IS NOT NULL").groupBy("_net").agg(F.min("ip_rule").alias("ip_rule"))
    lengths = sorted(r[0] for r in nets.select(F.length("_net")).distinct().collect())
    seen = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_bits", address(F.col("_ip"))).filter("_bits IS NOT NULL")
    cut = seen.select("_ip", F.explode(F.array_distinct(F.array(*[F.substring("_bits", 1, n) for n in lengths]).cast("array<string>"))).alias("_net"))
    known = cut.join(nets, "_net").groupBy("_ip").agg(F.max_by("ip_rule", F.length("_net")).alias("ip_rule"))
    out = df.drop("ip_rule").join(known, F.col(ip) == F.col("_ip"), "left").drop("_ip")
    return out.withColumn("ip_ok", F.coalesce(F.col(ip).isin(*LOOPBACK) | F.col("ip_rule").isNotNull(), F.lit(False)))


def screen_email(df: DataFrame, rules: DataFrame, email: str = "email") -> DataFrame:
    """Adds domain_ok and blacklisted; neither case nor outer blanks matter, a leading @ of a rule is dropped, and an address
    without @ has no domain."""
    plain = lambda c: F.lower(F.trim(c))
    domains = rules.filter("type = 'domain_whitelist'").select(plain(F.regexp_replace("value", "^@+", "")).alias("_dom"), F.lit(True).alias("domain_ok")).distinct()
    black = rules.filter("type = 'user_blacklist'").select(plain(F.col("value")).alias("_mail"), F.lit(True).alias("blacklisted")).distinct()
    out = df.withColumns({"_dom": F.when(F.contains(email, F.lit("@")), plain(F.substring_index(email, "@", -1))), "_mail": plain(F.col(email))})
    return out.join(domains, "_dom", "left").join(black, "_mail", "left").drop("_dom", "_mail").fillna(False, ["domain_ok", "blacklisted"])


def screen(df: DataFrame, rules: DataFrame, ip_on: bool = True, domain_on: bool = True) -> DataFrame:
    """Adds decision: blacklist before IP before domain."""
    out = screen_email(screen_ip(df, rules), rules)
    decision = F.when(F.col("blacklisted"), "blacklisted")
    if ip_on:
        decision = decision.when(~F.col("ip_ok"), "ip")
    if domain_on:
        decision = decision.when(~F.col("domain_ok"), "domain")
    return out.withColumn("decision", decision.otherwise("allowed"))


def rule_list(rules: DataFrame, users: DataFrame, rule_type: str | None = None, search: str = "") -> DataFrame:
    """Rules, blacklist ones with the user's name, or the local part of the address where there is no such user."""
    out = rules if rule_type is None else rules.filter(F.col("type") == rule_type)
    if search:
        out = out.filter(F.contains(F.lower("value"), F.lit(search.lower())) | F.contains(F.lower(F.coalesce("note", F.lit(""))), F.lit(search.lower())))
    names = users.select(F.lower("email").alias("_m"), "username")
    out = out.withColumn("_m", F.lower("value")).join(names, "_m", "left").drop("_m")
    return out.withColumn("name", F.when(F.col("type") == "user_blacklist", F.coalesce("username", F.split("value", "@")[0]))).drop("username")


def check_rules(rules: DataFrame) -> DataFrame:
    """Adds valid, by type."""
    domain = F.regexp_replace("value", "^@", "").rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")
    valid = F.when(F.col("type") == "ip_whitelist", network(F.col("value")).isNotNull()).when(F.col("type") == "domain_whitelist", domain).otherwise(F.col("value").rlike(r"^[^@\s]+@[^@\s]+$"))
    return rules.withColumn("valid", F.coalesce(valid, F.lit(False)))


def visible(messages: DataFrame, now: float) -> DataFrame:
    """Sent messages, and scheduled ones that are due, which count as sent at their time."""
    due = (F.col("status") == "scheduled") & (F.col("scheduled_at") <= now)
    return messages.withColumns({"sent_at": F.when(due, F.col("scheduled_at")).otherwise(F.col("sent_at")), "status": F.when(due, "sent").otherwise(F.col("status"))})


def inbox(messages: DataFrame, users: DataFrame, now: float, n: int = 20) -> DataFrame:
    """(user_id, id, rank): the newest n messages of each user, to all or naming the user; revoked ones are hidden."""
    sent = visible(messages, now).filter("status = 'sent'")
    named = sent.filter("target_users <> 'all'").select("id", "sent_at", F.explode(F.from_json("target_users", "array<string>")).alias("user_id"))
    named = named.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi").select("user_id", "id", "sent_at")
    newest = sent.filter("target_users = 'all'").orderBy(F.desc("sent_at"), "id").limit(n)  # no user sees more of them
    everyone = users.select(F.col("id").alias("user_id")).join(F.broadcast(newest.select("id", "sent_at")), F.lit(True))
    w = Window.partitionBy("user_id").orderBy(F.desc("sent_at"), "id")
    return named.unionByName(everyone).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def message_list(messages: DataFrame, users: DataFrame, now: float, msg_type: str = "", status: str = "", title: str = "") -> DataFrame:
    """(id, status, targets), of one type, one status (as it is now) and titles that hold the given text where these are given:
    names of the targets joined by 、, unknown ids as they are, all as it is."""
    out = visible(messages, now)
    for name, value in (("type", msg_type), ("status", status)):
        out = out.filter(F.col(name) == value) if value else out
    if title:
        out = out.filter(F.contains(F.lower("title"), F.lit(title.lower())))
    each = out.filter("target_users <> 'all'").select("id", F.posexplode(F.from_json("target_users", "array<string>")).alias("pos", "user_id"))
    names = users.select(F.col("id").alias("user_id"), "username")
    joined = each.join(names, "user_id", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("username", "user_id").alias("t")))).alias("p"))
    return out.join(joined, "id", "left").select("id", "status", F.coalesce(F.array_join("p.t", "、"), "target_users").alias("targets"))
