"""Requests to and answers of an external model as tables, and the deterministic rules of the stages."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.columns import let
from sluice.operators import typed
from sluice.operators.merge import FIELDS, MISSING, TAGS

# Classes in tie order with their keywords, and spellings of an unknown tag.
FAMILIES = {
    "制度合规": ("policy", "rule", "licens", "rights", "制度", "合规"),
    "FAQ": ("faq", r"\?", "question", "问"),
    "产品活动": ("product", "price", "活动", "产品"),
    "技术运维": ("server", "token", "password", "运维", "部署"),
    "教学知识": ("lesson", "course", "教学", "课程"),
}
STAGE_TEXTS = {
    "empty_text": "Value error, cleaned_text 不能为空", "empty_chunks": "Value error, chunks 不能为空", "empty_content": "Value error, chunk content 不能为空",
    "empty_pairs": "Value error, qa_pairs 不能为空（每个 chunk 至少 3 条 QA）",
}
UNKNOWN_TAGS = ("", "未知", "待定", "未注明")
EXPIRED = "-已过期"
DATE = r"(\d{4}-\d{2}-\d{2})"


def requests(units: DataFrame, stage: int, failures: DataFrame | None = None, system: str = "Refine the given text.") -> DataFrame:
    """(doc_id, unit, stage, system, user): one request per unit (doc_id, unit, title, source, text); a unit that failed gets
    its errors and previous answer (doc_id, unit, errors, previous) at the end. Without a title the source stands for it."""
    user = F.concat(F.lit("# "), F.coalesce("title", "source", F.lit("")), F.lit("\n"), F.col("text"))
    if failures is not None:
        units = units.join(failures, ["doc_id", "unit"], "left")
        again = F.concat(F.lit("\nErrors: "), F.array_join("errors", "; "), F.lit("\nPrevious: "), F.coalesce("previous", F.lit("")))
        user = F.concat(user, F.when(F.col("errors").isNotNull(), again).otherwise(""))
    return units.select("doc_id", "unit", F.lit(stage).alias("stage"), F.lit(system).alias("system"), user.alias("user"))


def parse_responses(responses: DataFrame, schema: T.StructType | str, col: str = "content") -> DataFrame:
    """Adds body (the unfenced text), parsed (null unless a JSON object of the schema) and ok."""
    body = F.regexp_replace(F.trim(F.col(col)), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    parsed = F.from_json(body, schema, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})
    valid = body.rlike(r"(?s)^\s*\{.*\}\s*$") & F.schema_of_variant(F.try_parse_json(F.regexp_replace(body, r"[\x00-\x1f]", " "))).isNotNull()
    ok = F.coalesce(valid, F.lit(False))
    return responses.withColumns({"body": body, "ok": ok}).withColumn("parsed", F.when(F.col("ok"), parsed))


def gate(parsed: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with errors): rules maps 'path: message' to what must hold; null counts as broken."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(text)) for text, holds in rules.items()]))
    checked = parsed.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


_LISTS = "exception_list struct<" + ",".join(f"{f}:array<string>" for f in FIELDS) + ">"
_PAIRS = "array<struct<question:string,answer:string,keywords:array<string>,confidence_score:int,remark:string>>"
_TAGS = "struct<" + ",".join(f"{t}:string" for t in TAGS) + ">"

#: What the answers of each stage are read as (parse_responses).
STAGE_SCHEMAS = {
    1: "cleaned_text string, doc_type string, sensitive_items array<string>, terminology_pending array<string>",
    2: f"chunks array<struct<chunk_id:string,title:string,content:string,remark:string>>, {_LISTS}",
    3: f"chunks array<struct<chunk_id:string,qa_pairs:{_PAIRS}>>, {_LISTS}",
    4: f"chunks array<struct<chunk_id:string,doc_type:string,metadata:{_TAGS},remark:string>>, {_LISTS}",
}


def _filled(message: str) -> typed.Kind:
    return typed.text(lambda t: F.when(t.rlike(r"(?U)^\s*$"), message))


def _numbered(example: str) -> typed.Kind:
    form = lambda t: F.concat(F.lit("Value error, chunk_id 格式错误: '"), t, F.lit("'，应为 P{N}-C{NNN}" + example))
    return typed.text(lambda t: F.when(~t.rlike(r"^P\d+-C\d+$"), form(t)))


_TEXT, _TEXTS, _TYPE = typed.text(), typed.list_of(typed.text()), typed.one_of(tuple(FAMILIES))
_EXCEPTIONS = typed.record("ExceptionList", {}, {f: _TEXTS for f in FIELDS})
_PAIR = typed.record("QaPair", {"question": _TEXT, "answer": _TEXT, "keywords": _TEXTS, "confidence_score": typed.whole(0, 100)}, {"remark": _TEXT})
_PARTS = {
    2: ("Stage2Chunk", {"chunk_id": _numbered("（如 P1-C001）"), "title": _TEXT, "content": _filled(STAGE_TEXTS["empty_content"])}, {"remark": _TEXT}),
    3: ("Stage3Chunk", {"chunk_id": _numbered(""), "qa_pairs": typed.list_of(_PAIR, STAGE_TEXTS["empty_pairs"])}, {}),
    4: ("Stage4Chunk", {"chunk_id": _numbered(""), "doc_type": _TYPE, "metadata": typed.record("Metadata", {t: _TEXT for t in TAGS})}, {"remark": _TEXT}),
}
#: What the answers of each stage are checked by.
STAGE_KINDS = {1: typed.record("Stage1Output", {"cleaned_text": _filled(STAGE_TEXTS["empty_text"]), "doc_type": _TYPE}, {"sensitive_items": _TEXTS, "terminology_pending": _TEXTS})} | {
    n: typed.record(f"Stage{n}Output", {"chunks": typed.list_of(typed.record(*part), STAGE_TEXTS["empty_chunks"])}, {"exception_list": _EXCEPTIONS}) for n, part in _PARTS.items()
}


def stage_errors(stage: int, answer: Column) -> Column:
    """The array of 'path: message' of a stage's answer, a VARIANT; empty where it may pass: required fields, types, known
    document types, ids of the form P1-C001, texts and lists that must not be empty, scores from 0 to 100. remark and the
    exception lists may be absent but not null; unknown fields are ignored."""
    return STAGE_KINDS[stage](answer, F.lit(""))


def stage_gate(responses: DataFrame, stage: int, col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with errors) answers of a stage; one that is no JSON object is rejected as such."""
    parsed = parse_responses(responses, STAGE_SCHEMAS[stage], col)
    answer = F.try_parse_json(F.regexp_replace("body", r"[\x00-\x1f]", " "))
    errors = F.when(F.col("ok"), let(answer, lambda v: stage_errors(stage, v))).otherwise(F.array(F.lit("no JSON object")))
    checked = parsed.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def next_attempts(attempts: DataFrame, retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(to try again, given up) of attempts (doc_id, unit, attempt, ok, ...): by each unit's latest attempt, where none was ok."""
    w = Window.partitionBy("doc_id", "unit")
    latest = attempts.withColumns({"_any": F.max("ok").over(w), "_last": F.max("attempt").over(w)}).filter("NOT _any AND attempt = _last").drop("_any", "_last")
    return latest.filter(F.col("attempt") < 1 + retries), latest.filter(F.col("attempt") >= 1 + retries)


def usage_by_task(responses: DataFrame) -> DataFrame:
    return responses.groupBy("task_id").agg(*[F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


def classify(df: DataFrame, col: str = "text", families: dict[str, tuple[str, ...]] = FAMILIES) -> DataFrame:
    """Adds doc_type: the family with the most keyword hits; ties and no hits go to the earlier family."""
    counts = [F.regexp_count(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit("|".join(words))) for words in families.values()]
    df = df.withColumn("_c", F.array(*counts))
    place = F.array_position("_c", F.array_max("_c")).cast("int")
    return df.withColumn("doc_type", F.element_at(F.array(*[F.lit(f) for f in families]), place)).drop("_c")


LEAST_LETTERS = 8


@F.pandas_udf(T.ArrayType(T.StringType()))
def _one_edit_apart(texts: pd.Series) -> pd.Series:
    """'A / B' of the words of each list that differ by one letter put in, left out or changed, by what is left of them without
    one letter. Words of one length are indexed at a time, one place of the letter at a time."""

    def near(words: Iterable[str]) -> list[str]:
        lengths: dict[int, list[str]] = {}
        for w in words:
            lengths.setdefault(len(w), []).append(w)
        pairs = set()
        for n, own in lengths.items():
            shorter = set(lengths.get(n - 1, ()))
            for place in range(n):
                index: dict[str, list[str]] = {}
                for w in own:
                    rest = w[:place] + w[place + 1 :]
                    others = index.setdefault(rest, [])
                    pairs.update((min(w, o), max(w, o)) for o in others)
                    others.append(w)
                    if rest in shorter:
                        pairs.add((min(w, rest), max(w, rest)))
        return [f"{a} / {b}" for a, b in sorted(pairs)]

    return pd.Series([near(words) if words is not None else [] for words in texts])


def term_pairs(df: DataFrame, key: str, col: str, least: int = LEAST_LETTERS) -> DataFrame:
    """(key, item 'A / B'): the distinct words of a document, of least letters of any script or more, that differ by one edit, each
    pair once in order of code points. A word is compared by its deletions and not with other words, within its own row, so
    nothing is shuffled."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(r"\p{L}{%d,}" % least), F.lit(0)))
    return df.select(key, F.explode(_one_edit_apart(words)).alias("item"))


def normalise_tags(tags: DataFrame) -> DataFrame:
    """Unknown tags become the placeholder; FAQ documents are of knowledge type FAQ; summaries are cut to 20 characters."""
    clean = {t: F.when(F.coalesce(F.trim(t), F.lit("")).isin(*UNKNOWN_TAGS), MISSING).otherwise(F.col(t)) for t in TAGS}
    clean["knowledge_type"] = F.when(F.col("doc_type") == "FAQ", "FAQ").otherwise(clean["knowledge_type"])
    clean["summary"] = F.substring(clean["summary"], 1, 20)
    return tags.withColumns(clean)


def expire(tags: DataFrame, as_of: str) -> DataFrame:
    """Adds expired: whether the last date of version_timeliness is before as_of."""
    dates = F.regexp_extract_all("version_timeliness", F.lit(DATE), F.lit(1))
    last = F.try_to_timestamp(F.get(dates, F.size(dates) - 1), F.lit("yyyy-MM-dd")).cast("date")
    return tags.withColumn("expired", F.coalesce(last < F.lit(as_of).cast("date"), F.lit(False)))


def expired_items(tags: DataFrame, as_of: str) -> DataFrame:
    """(doc_id, chunk_id, item): the expired_items entry of each chunk whose time is over."""
    entry = F.concat("chunk_id", F.lit(": "), F.coalesce("version_timeliness", F.lit("")), F.lit(EXPIRED))
    return expire(tags, as_of).filter("expired").select("doc_id", "chunk_id", entry.alias("item"))


def missing_tags(tags: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, item): an entry for each placeholder tag."""
    entries = F.array_compact(F.array(*[F.when(F.col(t) == MISSING, F.concat("chunk_id", F.lit(f": 缺少{t}"))) for t in TAGS]))
    return tags.select("doc_id", "chunk_id", F.explode(entries).alias("item"))
