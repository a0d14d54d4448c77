"""One pass over whole records: format, numbers, consistency with repairs, and the review list, in this order.

A record is a JSON text. It is parsed once, to a VARIANT, which tells an absent key from a null, and brought into one struct that
all findings are taken from; no table is joined or shuffled. A record with errors is still counted, repaired and reviewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.columns import let, strings
from sluice.operators import review
from sluice.operators.merge import FIELDS
from sluice.operators.typed import field, items, kind_of
from sluice.operators.validate import ADVICE, ATOM_KEYS, CHUNK_ID, INFO_KEYS, LEAST, LOW, LOW_MARK, LOW_REMARK, META_KEYS, MOST, NOT_STATED, QA_KEYS, SECRETS, SHORT, SIZE_MARK, SUMMARY_KEYS, TOP_KEYS

# What findings say.
NO_TOP, NO_INFO, NO_ATOMS = "缺少顶层字段: ", "document_info缺少字段: ", "knowledge_atoms为空"
CHUNKS_DIFFER, PAIRS_DIFFER = "total_chunks(%s)与实际知识原子数(%d)不一致", "total_qa_pairs(%s)与实际QA数(%d)不一致"
ATOM, BAD_ID, NO_FIELD, NO_META = "知识原子[%d]", "%s chunk_id格式错误: '%s'，应为P{N}-C{NNN}", " 缺少字段: ", ".metadata 缺少字段: "
NO_LIST_FIELD, NO_ARRAY, NO_SUMMARY, NO_BOOLEAN = "exception_list缺少字段: ", "exception_list.%s 不是数组", "quality_summary缺少字段: ", "quality_summary.needs_review 不是布尔值: "
BARE_TITLE, LONG_SUMMARY, NO_KEYWORDS, ADVISES = "%s title缺少【上下文归属】: '%s'", "%s summary超过20字(%d字): '%s'", "%s keywords为空", "%s Answer可能含有原文外的建议: 包含'"
OUT_OF_RANGE, CURLY = "%s confidence_score超出范围: %s", "JSON中包含中文引号（\"\"''），应使用ASCII引号"
SCORE_TYPE, SIZE_TYPE, SIZE_UNLISTED, SECRET_UNLISTED, SECRET_OPEN, TOO_SHORT = "置信分与标记矛盾", "字符数与标注矛盾", "颗粒度异常未登记", "敏感数据未登记", "QA答案敏感数据未脱敏", "答案过短"
FIXED = "已修复: %s - 添加低置信标记"
NO_JSON = "no JSON object"

_STRINGS = "array<string>"
_ISSUES = "array<struct<type:string,location:string,detail:string>>"


def _text(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def _lacks(value: Column, keys: tuple[str, ...]) -> Column:
    return strings(*[F.when(field(value, k).isNull(), F.lit(k)) for k in keys])


def _prefixed(prefix: Column | str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, n))


def _pair(x: Column) -> Column:
    return F.struct(
        _lacks(x, QA_KEYS).alias("lacks"), F.coalesce(_text(x, "question"), F.lit("")).alias("question"), F.coalesce(_text(x, "answer"), F.lit("")).alias("answer"),
        F.coalesce(F.size(items(field(x, "keywords"))), F.lit(0)).alias("n_keywords"), F.try_variant_get(x, "$.confidence_score", "double").alias("score"),
        _text(x, "confidence_score").alias("score_text"), F.coalesce(_text(x, "remark"), F.lit("")).alias("remark"),
    )


def _atom(x: Column) -> Column:
    text = lambda n: F.coalesce(_text(x, n), F.lit("")).alias(n)
    pairs = F.coalesce(items(field(x, "qa_pairs")), F.array().cast("array<variant>"))
    return F.struct(
        _lacks(x, ATOM_KEYS).alias("lacks"), _lacks(field(x, "metadata"), META_KEYS).alias("meta_lacks"), text("chunk_id"), text("title"), text("content"), text("remark"),
        F.coalesce(F.try_variant_get(x, "$.metadata.summary", "string"), F.lit("")).alias("summary"), F.transform(pairs, _pair).alias("pairs"),
    )


def _record(v: Column) -> Column:
    info, lists, summary = field(v, "document_info"), field(v, "exception_list"), field(v, "quality_summary")
    list_state = lambda f: F.when(field(lists, f).isNull(), F.concat(F.lit(NO_LIST_FIELD), F.lit(f))).when(items(field(lists, f)).isNull(), F.lit(NO_ARRAY % f))
    entries = lambda f: F.coalesce(F.transform(items(field(lists, f)), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast(_STRINGS)).alias(f)
    every = F.map_values(F.try_variant_get(lists, "$", "map<string,variant>"))
    review_kind = kind_of(field(summary, "needs_review"))
    return F.struct(
        _lacks(v, TOP_KEYS).alias("lacks"), info.isNotNull().alias("has_info"), _lacks(info, INFO_KEYS).alias("info_lacks"), _lacks(summary, SUMMARY_KEYS).alias("summary_lacks"),
        strings(*[list_state(f) for f in FIELDS]).alias("list_errors"), F.struct(*[entries(f) for f in FIELDS]).alias("lists"),
        F.coalesce(F.aggregate(F.transform(every, lambda x: F.coalesce(F.size(items(x)), F.lit(0))), F.lit(0), lambda s, n: s + n), F.lit(0)).alias("exception_count"),
        F.transform(F.coalesce(items(field(v, "knowledge_atoms")), F.array().cast("array<variant>")), _atom).alias("atoms"),
        F.struct(*[_text(info, k).alias(k) for k in ("total_chunks", "total_qa_pairs")], *[_text(summary, k).alias(k) for k in ("avg_confidence", "low_confidence_count", "exception_count", "coverage_rate", "needs_review")]).alias("declared"),
        (review_kind.isNotNull() & (review_kind != "BOOLEAN")).alias("review_no_boolean"),
    )


def _numbers(r: Column) -> Column:
    """What the record's numbers should be."""
    pairs = F.flatten(F.transform(r["atoms"], lambda a: a["pairs"]))
    scores = F.filter(F.transform(pairs, lambda q: q["score"]), lambda s: s.isNotNull())
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x).cast("decimal(20,4)")
    says = lambda q: (F.trim(q["answer"]) != "") & (F.trim(q["answer"]) != NOT_STATED)
    covered = F.size(F.filter(r["atoms"], lambda a: F.exists(a["pairs"], says)))
    ratio = lambda a, b, digits: F.coalesce(F.bround(a / F.when(b > 0, b).cast("decimal(18,0)"), digits).cast("double"), F.lit(0.0))
    return F.struct(
        ratio(total, F.size(scores), 1).alias("avg_confidence"), F.size(F.filter(scores, lambda s: s < LOW)).alias("low_confidence_count"), r["exception_count"].alias("exception_count"),
        ratio(covered.cast("decimal(18,0)"), F.size(r["atoms"]), 2).alias("coverage_rate"), (r["exception_count"] > 0).alias("needs_review"),
        F.size(pairs).alias("total_qa_pairs"), F.size(r["atoms"]).alias("total_chunks"),
    )


def _errors(r: Column, n: Column) -> Column:
    def pair(q: Column, at: Column) -> Column:
        wrong = F.when((q["score"] < 0) | (q["score"] > 100), F.format_string(OUT_OF_RANGE, at, q["score_text"]))
        return F.concat(_prefixed(F.concat(at, F.lit(NO_FIELD)), q["lacks"]), strings(wrong))

    def atom(a: Column, at: Column) -> Column:
        pairs = F.flatten(F.transform(a["pairs"], lambda q, j: pair(q, F.format_string("%s QA[%d]", at, j))))
        bad = F.when(~a["chunk_id"].rlike(CHUNK_ID), F.format_string(BAD_ID, at, a["chunk_id"]))
        return F.concat(strings(bad), _prefixed(F.concat(at, F.lit(NO_FIELD)), a["lacks"]), _prefixed(F.concat(at, F.lit(NO_META)), a["meta_lacks"]), pairs)

    declared, shown = r["declared"], lambda c: F.coalesce(c, F.lit("None"))
    differs = lambda name, text: F.when(~declared[name].try_cast("double").eqNullSafe(n[name].cast("double")), F.format_string(text, shown(declared[name]), n[name]))
    deeper = F.concat(
        _prefixed(NO_INFO, r["info_lacks"]), strings(F.when(F.size(r["atoms"]) == 0, F.lit(NO_ATOMS)), differs("total_chunks", CHUNKS_DIFFER)),
        F.flatten(F.transform(r["atoms"], lambda a, i: atom(a, F.format_string(ATOM, i)))), strings(differs("total_qa_pairs", PAIRS_DIFFER)), r["list_errors"],
        _prefixed(NO_SUMMARY, r["summary_lacks"]), strings(F.when(r["review_no_boolean"], F.concat(F.lit(NO_BOOLEAN), shown(declared["needs_review"])))),
    )
    return F.concat(_prefixed(NO_TOP, r["lacks"]), F.when(r["has_info"], deeper).otherwise(F.array().cast(_STRINGS)))


def _warnings(r: Column, raw: Column) -> Column:
    def pair(q: Column, at: Column) -> Column:
        advice = [F.when(F.contains(q["answer"], F.lit(p)) & ~F.contains(q["answer"], F.lit(NOT_STATED)), F.concat(F.format_string(ADVISES, at), F.lit(f"{p}'"))) for p in ADVICE]
        return strings(F.when(q["n_keywords"] == 0, F.format_string(NO_KEYWORDS, at)), *advice)

    def atom(a: Column, at: Column) -> Column:
        title = F.when((a["title"] != "") & ~a["title"].rlike("^【.+】"), F.format_string(BARE_TITLE, at, a["title"]))
        summary = F.when(F.length(a["summary"]) > 20, F.format_string(LONG_SUMMARY, at, F.length(a["summary"]), a["summary"]))
        return F.concat(strings(title, summary), F.flatten(F.transform(a["pairs"], lambda q, j: pair(q, F.format_string("%s QA[%d]", at, j)))))

    found = F.concat(F.flatten(F.transform(r["atoms"], lambda a, i: atom(a, F.format_string(ATOM, i)))), strings(F.when(raw.rlike("[“”‘’]"), F.lit(CURLY))))
    return F.when(r["has_info"], found).otherwise(F.array().cast(_STRINGS))


def _fixes(r: Column, n: Column) -> Column:
    """The numbers that are absent or differ, with what they become."""

    def one(name: str, logical: bool = False) -> Column:
        old, new = r["declared"][name], n[name]
        same = old.eqNullSafe(new.cast("string")) if logical else old.try_cast("double").eqNullSafe(new.cast("double"))
        return F.when(~same, F.struct(F.lit(name).alias("field"), old.alias("old"), new.cast("string").alias("new")))

    names = ("avg_confidence", "low_confidence_count", "exception_count", "coverage_rate", "needs_review", "total_qa_pairs", "total_chunks")
    return F.array_compact(F.array(*[one(x, x == "needs_review") for x in names]))


def _named(r: Column, name: str) -> Column:
    """The distinct chunk ids that the entries of a field name."""
    return F.array_distinct(F.flatten(F.transform(r["lists"][name], lambda x: F.regexp_extract_all(x, F.lit(r"P\d+-C\d+"), F.lit(0)))))


def _issues(r: Column, ids: Column) -> Column:
    def issue(when: Column, kind: str, at: Column, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), at.alias("location"), detail.alias("detail")))

    def found(*own: Column) -> Column:
        return F.array_compact(F.array(*own)).cast(_ISSUES)

    shown = lambda a: F.when(a["chunk_id"] == "", "?").otherwise(a["chunk_id"])
    each = lambda of: F.flatten(F.transform(r["atoms"], of))
    by_pair = lambda a, of: F.flatten(F.transform(a["pairs"], lambda q, j: of(q, F.format_string("%s 第%d条QA", shown(a), j + 1))))
    listed = lambda a, f: F.array_contains(ids[f], a["chunk_id"])

    def score(q: Column, at: Column) -> Column:
        marked, low = F.contains(q["remark"], F.lit(LOW_MARK)), q["score"] < LOW
        return found(
            issue(low & ~marked, SCORE_TYPE, at, F.format_string("confidence_score=%s<80，但remark未标记【低置信-人工复核】", q["score_text"])),
            issue(~low & marked, SCORE_TYPE, at, F.format_string("confidence_score=%s≥80，但remark标记了【低置信-人工复核】", q["score_text"])),
        )

    def size(a: Column) -> Column:
        n, marked = F.length(a["content"]), F.contains(a["remark"], F.lit(SIZE_MARK))
        odd = (n < LEAST) | (n > MOST)
        return found(
            issue(odd & ~marked, SIZE_TYPE, shown(a), F.format_string("内容%d字，偏离300-800区间，但未标注【拆分颗粒度异常】", n)),
            issue(~odd & marked, SIZE_TYPE, shown(a), F.format_string("内容%d字，在300-800区间内，但标注了【拆分颗粒度异常】", n)),
            issue(odd & ~listed(a, "chunk_anomalies"), SIZE_UNLISTED, shown(a), F.format_string("内容%d字偏离区间，但exception_list.chunk_anomalies中无对应记录", n)),
        )

    def secrets(a: Column) -> Column:
        unlisted = issue(F.contains(a["content"], F.lit("敏感数据")) & ~listed(a, "sensitive_items"), SECRET_UNLISTED, shown(a), F.lit("content中标记了敏感数据，但exception_list.sensitive_items中无对应记录"))
        is_open = lambda q, at: found(*[issue(q["answer"].rlike("(?U)" + p) & ~F.contains(q["answer"], F.lit("【敏感数据】")), SECRET_OPEN, at, F.lit(text)) for p, text in SECRETS])
        return F.concat(found(unlisted), by_pair(a, is_open))

    def short(q: Column, at: Column) -> Column:
        n = F.length(F.trim(q["answer"]))
        return found(issue((n > 0) & (n < SHORT) & (F.trim(q["answer"]) != NOT_STATED), TOO_SHORT, at, F.format_string("答案仅%d字（低于20字），可能信息不完整", n)))

    return F.concat(each(lambda a: by_pair(a, score)), each(size), each(secrets), each(lambda a: by_pair(a, short)))


def _repairs(r: Column) -> Column:
    """The pairs that get the mark of a low score, with their remark as it becomes."""

    def of(a: Column, i: Column) -> Column:
        new = lambda q, j: F.struct(i.alias("atom"), j.alias("pair"), F.format_string("%s 第%d条QA", a["chunk_id"], j + 1).alias("location"), F.trim(F.concat(q["remark"], F.lit(" " + LOW_REMARK))).alias("remark"))
        return F.array_compact(F.transform(a["pairs"], lambda q, j: F.when((q["score"] < LOW) & ~F.contains(q["remark"], F.lit(LOW_MARK)), new(q, j))))

    return F.flatten(F.transform(r["atoms"], of))


def _review(r: Column, n: Column, ids: Column) -> Column:
    """The review list of the record with its numbers put right (review.review_list() is the same over tables)."""

    def text(name: str, item: Column) -> Column:
        plain = review.clean_item(item)

        def of(own: Column) -> Column:
            title = F.coalesce(F.regexp_replace(own["title"], review.TITLE_PREFIX, ""), F.lit(""))
            if name == "low_confidence_qa":
                pairs = own["pairs"]
                number = F.regexp_extract(item, review.QUESTION_NO, 1).try_cast("int")
                question = F.coalesce(F.when(number > 0, F.get(pairs, number - 1)["question"]), F.get(F.filter(pairs, lambda q: q["score"] < LOW), 0)["question"], F.lit(""))
                return F.when(question != "", F.format_string(review.UNSURE, question)).otherwise(plain)
            if name == "chunk_anomalies":
                sized = F.format_string(review.SIZED, title, F.replace(plain, F.lit(review.GRANULARITY + "-"), F.lit("")))
                return F.when((title != "") & F.contains(plain, F.lit(review.GRANULARITY)), sized).otherwise(plain)
            return F.when(title != "", F.format_string(review.CUT, title)).otherwise(plain)

        if name not in ("low_confidence_qa", "chunk_anomalies", "truncated_items"):
            return plain
        place = F.array_position(ids["atoms"], F.regexp_extract(item, review.CHUNK_ID, 1)).cast("int")
        return let(F.get(r["atoms"], place - 1), of)

    def section(no: int) -> Column:
        own = [(f, head) for f, k, head in review.SECTIONS if k == no]
        line_of = lambda f: F.transform(r["lists"][f], lambda x: F.concat(F.lit("- "), text(f, x)))
        lines = F.concat(*[line_of(f) for f, _ in own])
        return F.when(F.size(lines) > 0, F.concat(F.lit(own[0][1] + "\n"), F.array_join(lines, "\n")))

    body = F.array_join(strings(*[section(no) for no in sorted({k for _, k, _ in review.SECTIONS})]), "\n\n")
    header = F.format_string(review.HEADER, n["total_chunks"], n["total_qa_pairs"], n["exception_count"])
    return let(body, lambda b: F.when((n["exception_count"] > 0) & (b != ""), F.concat(header, b, F.lit(review.CLOSING))).otherwise(review.ALL_PASSED))


def validate_all(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """(doc_id, errors, warnings, numbers, fixes, issues, repairs, fixed, summary, needs_review, valid, unfixable, passed) of every
    record (doc_id, raw): numbers are the right ones, fixes those that were put right, repairs the remarks as they become. A text
    that is no JSON object has that one error. A record passes when it has no errors and no issue but those repaired."""
    parsed = docs.select("doc_id", F.col(raw).alias("_raw"), F.try_parse_json(raw).alias("_v"))
    is_object = F.startswith(kind_of(F.col("_v")), F.lit("OBJECT"))
    parsed = parsed.select("doc_id", "_raw", F.coalesce(is_object, F.lit(False)).alias("_ok"), _record(F.col("_v")).alias("_r"))
    r, n, ids, ok = F.col("_r"), F.col("_n"), F.col("_ids"), F.col("_ok")
    known = F.struct(F.transform(r["atoms"], lambda a: a["chunk_id"]).alias("atoms"), *[_named(r, f).alias(f) for f in ("chunk_anomalies", "sensitive_items")])
    counted = parsed.withColumns({"_n": _numbers(r), "_ids": known})
    none = F.array().cast(_STRINGS)
    found = counted.select(
        "doc_id", F.when(ok, _errors(r, n)).otherwise(F.array(F.lit(NO_JSON))).alias("errors"), F.when(ok, _warnings(r, F.col("_raw"))).otherwise(none).alias("warnings"),
        n.alias("numbers"), _fixes(r, n).alias("fixes"), _issues(r, ids).alias("issues"), _repairs(r).alias("repairs"), _review(r, n, ids).alias("summary"),
    )
    left = F.size("issues") - F.size("repairs")
    return found.select(
        "*", F.transform("repairs", lambda x: F.format_string(FIXED, x["location"])).alias("fixed"), (F.col("summary") != review.ALL_PASSED).alias("needs_review"),
        (F.size("errors") == 0).alias("valid"), left.alias("unfixable"), ((F.size("errors") == 0) & (left == 0)).alias("passed"),
    )
