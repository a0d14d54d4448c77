"""Sensitive values: detection with exact spans, masking, flagging and reports, all in built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.columns import let

# Placeholders and default rules.
MASKED = "【敏感数据】"
FLAGGED = "【敏感数据-禁止向量化入库】"
MARKERS = f"{FLAGGED}|{MASKED}"


@dataclass(frozen=True)
class Rule:
    """action is 'mask', 'detect' or 'flag'; rules of a lower priority number match first. Patterns must not match nothing. Texts
    without any of the lower-case fragments that needs lists (where it lists any), or without as many digits in a row as digits
    says, are not scanned for the pattern, so a match must always hold them."""

    name: str
    pattern: str
    action: str = "mask"
    priority: int = 100
    case_sensitive: bool = False
    description: str = ""
    needs: tuple[str, ...] = ()
    digits: int = 0


# Names, patterns, actions and priorities.
RULES = (
    Rule("password", r"(?:密码|password|passwd|pwd)[：:=\s]+\s*[^\s，。；,;]{4,}", "mask", 10, needs=("密码", "passw", "pwd")),
    Rule("api_key", r"(?:api[_\-\s]?key|API\s*Key)[：:=\s]+\s*[A-Za-z0-9_\-]{8,}", "mask", 10, needs=("key",)),
    Rule("secret_key", r"(?:secret[_\-\s]?key|密钥)[：:=\s]+\s*[A-Za-z0-9_\-]{8,}", "mask", 10, needs=("key", "密钥")),
    Rule("token", r"(?:token|令牌)[：:=\s]+\s*[A-Za-z0-9_\-\.]{8,}", "mask", 10, needs=("token", "令牌")),
    Rule("salt", r"salt[：:=\s]+\s*[A-Za-z0-9_\-]{4,}", "mask", 10, needs=("salt",)),
    Rule("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)", "mask", 20, digits=11),
    Rule("id_card", r"(?<!\d)\d{17}[\dXx](?!\d)", "mask", 20, digits=17),
    Rule("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "detect", 30, needs=("@",)),
    Rule("bank_card", r"(?<!\d)\d{16,19}(?!\d)", "mask", 30, digits=16),
    Rule("internal_ip", r"(?<!\d)(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})(?!\d)", "detect", 40, needs=("10.", "192.168.", "172.")),
)

_HIT = "array<struct<start:int,end:int,rule:string,action:string,text:string>>"
_ORDERED = "array<struct<start:int,end:int,order:int,rule:string,action:string,text:string>>"
OPEN, CLOSE = "\ufdd0", "\ufdd1"
BLOCK = 128
#: Letters that match others where case does not count, though lower() leaves them as they are.
ALIKE = ("\u017f\u0131\u0307", "si")


def _java(rule: Rule) -> str:
    return ("(?uU)" if rule.case_sensitive else "(?iuU)") + rule.pattern


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running results of step over an array, folded in blocks and then over the blocks, so that no long array grows one by one."""
    fold = lambda own: F.slice(F.aggregate(own, F.array(F.lit(None).cast("int")), lambda s, x: F.concat(s, F.array(F.coalesce(step(F.element_at(s, -1), x), x)))), 2, F.size(own))

    def join(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("int")), fold(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return let(before, lambda own: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: F.coalesce(step(F.get(own, k), x), x)))))

    blocks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK)), lambda at: fold(F.slice(values, at + 1, BLOCK)))
    return F.when(F.size(values) > 0, let(blocks, join)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, rule: str, action: str, order: int) -> Column:
    """All hits of one pattern by one scan, which sets signs around them; the lengths between the signs are their places."""
    marked = F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}")

    def places(parts: Column) -> Column:
        def found(ends: Column) -> Column:
            hit = lambda k: F.struct(F.get(ends, 2 * k).alias("start"), F.get(ends, 2 * k + 1).alias("end"), F.lit(order).alias("order"), F.lit(rule).alias("rule"), F.lit(action).alias("action"), F.get(parts, 2 * k + 1).alias("text"))
            return F.transform(F.sequence(F.lit(0), (F.size(parts) / 2).cast("int") - 1), hit)

        ends = _running(F.transform(parts, lambda p: F.length(p)), lambda s, x: s + x)
        return F.when(F.size(parts) > 1, let(ends, found)).otherwise(F.array()).cast(_ORDERED)

    return let(F.split(marked, f"[{OPEN}{CLOSE}]"), places)


def _accepted(together: Column) -> Column:
    """Of hits that overlap one another, those that no earlier one in order of rules overlaps."""

    def accept(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(x)))

    by_rule = F.array_sort(together, lambda x, y: F.when((x["order"] < y["order"]) | ((x["order"] == y["order"]) & (x["start"] < y["start"])), -1).otherwise(1))
    return F.when(F.size(together) == 1, together).otherwise(F.aggregate(by_rule, F.array().cast(_ORDERED), accept))


def hits(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Accepted hits by place. Existing markers are accepted first and so never matched into; then rules by priority, a hit
    that overlaps an accepted one being skipped. Texts are scanned for the rules whose fragments they hold; the hits of all
    rules are swept in order of place, and only runs of hits that overlap are decided by rule. Two characters that no text
    should have (U+FDD0, U+FDD1) count as unknown ones."""
    ordered = sorted(rules, key=lambda r: r.priority)
    holds = lambda c, signs: reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in signs])
    clean = F.when(holds(text, OPEN + CLOSE), F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")).otherwise(text)
    none = F.array().cast(_ORDERED)
    least = min((r.digits for r in ordered if r.digits), default=0)
    low = let(F.lower(clean), lambda own: F.when(holds(own, ALIKE[0]), F.translate(own, *ALIKE)).otherwise(own))
    about = F.struct(low.alias("low"), (clean.rlike(rf"(?U)\d{{{least}}}") if least else F.lit(False)).alias("digits"))

    def every(known: Column) -> Column:
        def of(rule: Rule, order: int) -> Column:
            maybe = holds(known["low"], rule.needs) if rule.needs else F.lit(True)
            return F.when(maybe & known["digits"] if rule.digits else maybe, _spans(clean, _java(rule), rule.name, rule.action, order)).otherwise(none)

        markers = F.when(F.contains(clean, F.lit(MASKED[:-1])), _spans(clean, MARKERS, "", "marker", -1)).otherwise(none)
        return F.array_sort(F.concat(markers, *[of(r, k) for k, r in enumerate(ordered)]))

    def sweep(found: Column) -> Column:
        reach = _running(F.transform(found, lambda x: x["end"]), lambda s, x: F.greatest(s, x))
        begins = let(reach, lambda own: F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda k: (k == 0) | (F.get(found, k)["start"] >= F.get(own, k - 1))))
        runs = let(begins, lambda own: F.transform(own, lambda at, k: F.slice(found, at + 1, F.coalesce(F.get(own, k + 1), F.size(found)) - at)))
        return F.when(F.size(found) > 1, F.flatten(F.transform(runs, _accepted))).otherwise(found)

    kept = F.filter(let(let(about, every), sweep), lambda x: x["action"] != "marker")
    return F.array_sort(F.transform(kept, lambda x: x.dropFields("order"))).cast(_HIT)


def detect(df: DataFrame, col: str, rules: Sequence[Rule] = RULES, action: str | None = None) -> DataFrame:
    """Adds hits, an array of (start, end, rule, action, text); null and empty texts have none."""
    df = df.withColumn("hits", F.when(F.col(col) != "", hits(F.col(col), rules)).otherwise(F.array().cast(_HIT)))
    return df if action is None else df.withColumn("hits", F.filter("hits", lambda h: h["action"] == action))


def exploded(detected: DataFrame, *keys: str) -> DataFrame:
    """(keys, h): a row for each hit. The outer form, since for the inner one Spark would add a filter that detects once more."""
    return detected.select(*keys, F.explode_outer("hits").alias("h")).filter("h IS NOT NULL")


def replace(text: Column, found: Column, placeholder: str) -> Column:
    """The text with the given spans replaced."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, h: Column) -> Column:
        return F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, h["start"] - s["at"]), F.lit(placeholder)).alias("out"), h["end"].alias("at"))

    return F.aggregate(found, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def mask(df: DataFrame, col: str, placeholder: str = MASKED, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds hits and masked: values of rules whose action is mask are replaced, others stay."""
    df = detect(df, col, rules)
    only = F.filter("hits", lambda h: h["action"] == "mask")
    return df.withColumn("masked", F.when(F.size(only) > 0, replace(F.col(col), only, placeholder)).otherwise(F.col(col)))


def flag(df: DataFrame, col: str, placeholder: str = FLAGGED, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds hits and flagged: every hit is replaced, whatever its action."""
    df = detect(df, col, rules)
    return df.withColumn("flagged", F.when(F.size("hits") > 0, replace(F.col(col), F.col("hits"), placeholder)).otherwise(F.col(col)))


def mask_answers(qa: DataFrame, placeholder: str = MASKED, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Questions and answers with the answer masked, and its hits for registration."""
    return mask(qa, "answer", placeholder, rules).withColumn("answer", F.col("masked")).drop("masked")


def report_entry(hit: Column) -> Column:
    """'rule: match → masked'; nothing after the arrow for rules that only detect."""
    return F.concat(hit["rule"], F.lit(": "), hit["text"], F.lit(" → "), F.when(hit["action"] == "detect", F.lit("")).otherwise(F.lit(MASKED)))


def scan_report(df: DataFrame, key: str, col: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per key and rule: number of hits and their texts; keys without hits have no row."""
    found = exploded(detect(df.select(key, col), col, rules), key)
    return found.groupBy(key, F.col("h.rule").alias("rule")).agg(
        F.count("*").alias("n_hits"), F.array_join(F.array_sort(F.collect_list("h.text")), "|").alias("texts")
    )


def mask_key(key: Column) -> Column:
    """For display: empty stays, up to eight characters become ****, longer ones keep three and four."""
    return F.when(key == "", "").when(F.length(key) <= 8, "****").otherwise(F.concat(F.substring(key, 1, 3), F.lit("****"), F.right(key, F.lit(4))))
