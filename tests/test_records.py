"""Whole records in one pass: findings in order, numbers, repairs and the review list."""

import copy
import json

import pytest

from sluice.operators import merge, records, review, validate

PAIR = {"question": "怎么登录？", "answer": "打开首页，输入账号和口令，再按下登录按钮即可进入系统。", "keywords": ["登录"], "confidence_score": 95, "remark": ""}
ATOM = {"chunk_id": "P1-C001", "title": "【账号】- 登录", "content": "字" * 400, "doc_type": "FAQ", "metadata": dict.fromkeys(merge.TAGS, "x"), "qa_pairs": [PAIR], "remark": ""}
GOOD = {
    "document_info": {"source": "a.md", "doc_type": "FAQ", "total_chunks": 1, "total_qa_pairs": 1, "processing_date": "2024-01-01"}, "knowledge_atoms": [ATOM],
    "exception_list": {f: [] for f in merge.FIELDS}, "quality_summary": {"avg_confidence": 95.0, "low_confidence_count": 0, "exception_count": 0, "coverage_rate": 1.0, "needs_review": False},
}


def changed(*changes):
    """GOOD with values put at paths; ... takes a key away."""
    record = copy.deepcopy(GOOD)
    for path, value in changes:
        at = record
        for step in path[:-1]:
            at = at[step]
        if value is ...:
            del at[path[-1]]
        else:
            at[path[-1]] = value
    return record


A, Q = ("knowledge_atoms", 0), ("knowledge_atoms", 0, "qa_pairs", 0)


@pytest.fixture(scope="module")
def check(spark):
    def run(*cases):
        raw = [json.dumps(c, ensure_ascii=False) if not isinstance(c, str) else c for c in cases]
        rows = records.validate_all(spark.createDataFrame(list(enumerate(raw)), "doc_id int, raw string")).orderBy("doc_id").collect()
        return rows

    return run


def test_a_right_record_passes(check):
    (r,) = check(GOOD)
    assert (r.errors, r.warnings, r.fixes, r.issues, r.fixed) == ([], [], [], [], []) and r.passed and r.valid and r.unfixable == 0
    assert r.summary == review.ALL_PASSED and not r.needs_review and tuple(r.numbers) == (95.0, 0, 0, 1.0, False, 1, 1)


def test_errors_in_their_order(check):
    cases = [
        (changed((("document_info",), ...), (("exception_list",), ...)), ["缺少顶层字段: document_info", "缺少顶层字段: exception_list"]),
        (changed((("document_info", "source"), ...), (("document_info", "total_chunks"), ...), ((*A, "remark"), ...), ((*A, "metadata", "summary"), ...)),
         ["document_info缺少字段: source", "document_info缺少字段: total_chunks", "total_chunks(None)与实际知识原子数(1)不一致", "知识原子[0] 缺少字段: remark", "知识原子[0].metadata 缺少字段: summary"]),
        (changed((("knowledge_atoms",), []), (("document_info", "total_chunks"), 0)), ["knowledge_atoms为空", "total_qa_pairs(1)与实际QA数(0)不一致"]),
        (changed(((*A, "chunk_id"), "C1"), ((*Q, "remark"), ...), ((*Q, "confidence_score"), 101)), ["知识原子[0] chunk_id格式错误: 'C1'，应为P{N}-C{NNN}", "知识原子[0] QA[0] 缺少字段: remark", "知识原子[0] QA[0] confidence_score超出范围: 101"]),
        (changed(((*Q, "confidence_score"), None)), []),  # a null is no error
        (changed(((*Q, "confidence_score"), ...)), ["知识原子[0] QA[0] 缺少字段: confidence_score"]),
        (changed((("exception_list", "vague_items"), ...), (("exception_list", "missing_info"), None), (("quality_summary", "avg_confidence"), ...), (("quality_summary", "needs_review"), "yes")),
         ["exception_list.missing_info 不是数组", "exception_list缺少字段: vague_items", "quality_summary缺少字段: avg_confidence", "quality_summary.needs_review 不是布尔值: yes"]),
        (changed((("quality_summary", "needs_review"), ...)), ["quality_summary缺少字段: needs_review"]),  # once
        ("[1]", [records.NO_JSON]), ("{", [records.NO_JSON]), ("", [records.NO_JSON]),
    ]
    for r, (_, want) in zip(check(*[c for c, _ in cases]), cases, strict=True):
        assert (r.errors, r.valid) == (want, not want)


def test_warnings(check):
    (r, none) = check(
        changed(((*A, "title"), "登录"), ((*A, "metadata", "summary"), "长" * 21), ((*Q, "keywords"), []), ((*Q, "answer"), "建议您联系，也可以尝试“重启”。这样就能够恢复正常的状态了。")),
        changed(((*A, "title"), ""), ((*Q, "answer"), "文档未说明，可以尝试再次阅读全文以寻找相关的内容。")),
    )
    assert r.warnings == [
        "知识原子[0] title缺少【上下文归属】: '登录'", f"知识原子[0] summary超过20字(21字): '{'长' * 21}'", "知识原子[0] QA[0] keywords为空",
        "知识原子[0] QA[0] Answer可能含有原文外的建议: 包含'建议您'", "知识原子[0] QA[0] Answer可能含有原文外的建议: 包含'可以尝试'", records.CURLY,
    ]
    assert r.passed and none.warnings == []


def test_numbers_are_put_right(check):
    (r,) = check(changed((("quality_summary", "avg_confidence"), 85.2), (("quality_summary", "needs_review"), True), (("exception_list", "vague_items"), ["一", "二"]), (("document_info", "total_qa_pairs"), "1"), (("quality_summary", "coverage_rate"), ...)))
    assert [tuple(f) for f in r.fixes] == [("avg_confidence", "85.2", "95.0"), ("exception_count", "0", "2"), ("coverage_rate", None, "1.0")]
    assert r.needs_review and "- 一\n- 二" in r.summary and "其中 2 项需要你关注" in r.summary


def test_issues_and_repairs(check):
    low = {**PAIR, "confidence_score": 60, "remark": "旧"}
    marked = {**PAIR, "remark": "【低置信-人工复核】"}
    short = {**PAIR, "answer": "密码：abc123"}
    record = changed(((*A, "qa_pairs"), [low, marked, short]), ((*A, "content"), "敏感数据"), (("document_info", "total_qa_pairs"), 3), (("exception_list", "chunk_anomalies"), ["见 P1-C002 和 P1-C001: 拆分颗粒度异常-内容4字"]))
    (r,) = check(record)
    assert [(i.type, i.location) for i in r.issues] == [
        (records.SCORE_TYPE, "P1-C001 第1条QA"), (records.SCORE_TYPE, "P1-C001 第2条QA"), (records.SIZE_TYPE, "P1-C001"), (records.SECRET_UNLISTED, "P1-C001"), (records.SECRET_OPEN, "P1-C001 第3条QA"), (records.TOO_SHORT, "P1-C001 第3条QA"),
    ]
    assert r.issues[0].detail == "confidence_score=60<80，但remark未标记【低置信-人工复核】" and r.issues[4].detail == "密码值未脱敏"
    assert [(x.atom, x.pair, x.remark) for x in r.repairs] == [(0, 0, "旧 【低置信-人工复核】")] and r.fixed == ["已修复: P1-C001 第1条QA - 添加低置信标记"]
    assert (r.valid, r.unfixable, r.passed) == (True, 5, False)
    ok = changed(((*A, "qa_pairs"), [{**PAIR, "confidence_score": 60}]))
    assert [(r.unfixable, r.passed, len(r.fixed)) for r in check(ok)] == [(0, True, 1)]


def test_the_review_list_is_that_of_the_tables(spark, check):
    lists = {"low_confidence_qa": ["P1-C001-Q2: 置信分60-【低置信】", "P1-C009: 说不清"], "chunk_anomalies": ["P1-C001: 拆分颗粒度异常-内容4字"], "truncated_items": ["P1-C001: 截断"], "vague_items": ["P1-C001: 大约"]}
    pairs = [PAIR, {**PAIR, "question": "第二问", "confidence_score": 60}]
    (r,) = check(changed(((*A, "qa_pairs"), pairs), *[(("exception_list", f), x) for f, x in lists.items()]))
    exceptions = spark.createDataFrame([(0, f, k, x) for f, own in lists.items() for k, x in enumerate(own)], "doc_id int, field string, pos int, item string")
    atoms = spark.createDataFrame([(0, "P1-C001", 1, ATOM["title"])], "doc_id int, chunk_id string, chunk_no int, title string")
    qa = spark.createDataFrame([(0, "P1-C001", k + 1, q["question"], q["confidence_score"]) for k, q in enumerate(pairs)], "doc_id int, chunk_id string, qa_no int, question string, confidence_score int")
    assert r.summary == review.review_list(spark.createDataFrame([(0,)], "doc_id int"), exceptions, atoms, qa).first().summary and "第二问" in r.summary


def test_table_checks_agree_with_the_pass_over_records(spark):
    docs = spark.createDataFrame([(0, json.dumps(changed((("quality_summary", "needs_review"), ...))))], "doc_id int, raw string")
    assert [r.error for r in validate.check_document(docs).collect()] == ["quality_summary missing: needs_review"] and validate.check_lists(docs, merge.FIELDS).count() == 0
    qa = spark.createDataFrame([(0, "c", 1, None), (0, "c", 2, 101), (0, "c", 3, -1), (0, "c", 4, 100)], "doc_id int, chunk_id string, qa_no int, confidence_score int")
    assert [r.qa_no for r in validate.check_qa(qa).collect()] == [2, 3]
    atoms = spark.createDataFrame([(0, "P1-C001", "x"), (0, "P1-C003", "x")], "doc_id int, chunk_id string, content string")
    entries = spark.createDataFrame([(0, "chunk_anomalies", "P1-C002, P1-C001: 两处")], "doc_id int, field string, item string")
    assert [r.chunk_id for r in validate.unregistered_lengths(atoms, entries).collect()] == ["P1-C003"]
