"""Merging, validation, sources and exports in the cases that single tables of the queries do not show."""

import json
import random

from sluice.operators import export, merge, review, segment, stages, usage, validate
from sluice.sources import documents as sources

UNKNOWN_TYPE = "doc_type: Input should be '制度合规', 'FAQ', '产品活动', '技术运维' or '教学知识'"
Q = "chunks.0.qa_pairs.0"
TAGS = "struct<" + ",".join(f"{t}:string" for t in merge.TAGS) + ">"


def test_finished_records_and_rejects(spark, tmp_path):
    good = {"document_info": {"source": "a.md", "total_chunks": 1}, "knowledge_atoms": [], "exception_list": {"vague_items": ["x"]}, "quality_summary": {"avg_confidence": 83.5}}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text('{"document_info": ')
    records, rejects = sources.read_kb_json(spark, str(tmp_path))
    assert [(r.document_info.source, r.exception_list, r.quality_summary.coverage_rate) for r in records.collect()] == [("a.md", {"vague_items": ["x"]}, 0.0)]
    assert records.count() == 1 and rejects.count() == 1
    assert [(r.path.rpartition("/")[2], r._corrupt_record) for r in rejects.collect()] == [("bad.json", '{"document_info": ')]


def test_unreadable_checkpoint_is_built_anew(spark, tmp_path):
    units, path = spark.range(4).withColumnRenamed("id", "doc_id"), tmp_path / "stage"
    path.mkdir()
    (path / "part-0.parquet").write_text("no parquet")
    assert sources.with_checkpoint(units, str(path), "doc_id", lambda df: df).count() == 4
    assert sources.with_checkpoint(units.union(units.limit(1)), str(path), "doc_id", lambda df: df).count() == 4
    assert sources.clear_checkpoint(spark, str(path)) and not path.exists()


def test_long_ids_are_not_parts_of_others(spark):
    numbered = spark.createDataFrame([(1, 1, "P1-C100", "P1-C105")], "doc_id int, seg_no int, chunk_id string, new_chunk_id string")
    items = spark.createDataFrame([(1, 1, "P1-C1000, P1-C100-Q2: P1-C100")], "doc_id int, seg_no int, item string")
    assert segment.remap_exceptions(items, numbered).first().item == "P1-C1000, P1-C105-Q2: P1-C105"


def test_merge_keeps_the_last_of_repeated_chunks(spark):
    stage2 = spark.createDataFrame([(1, 1, "P1-C001", "a", "old", ""), (1, 2, "P1-C002", "b", "x", "r"), (1, 3, "P1-C001", "c", "new", "")], "doc_id int, chunk_no int, chunk_id string, title string, content string, remark string")
    stage3 = spark.createDataFrame([(1, "P1-C001", 0, ["q"]), (1, "P1-C001", 1, ["q", "r"])], "doc_id int, chunk_id string, pos int, qa_pairs array<string>")
    stage4 = spark.createDataFrame([], f"doc_id int, chunk_id string, metadata {TAGS}, doc_type string, remark string")
    out = merge.assemble(stage2, stage3, stage4, spark.createDataFrame([(1, "FAQ")], "doc_id int, doc_type string"))
    rows = [(r.chunk_no, r.chunk_id, r.content, r.qa_pairs, r.remark, r.doc_type) for r in out.orderBy("chunk_no").collect()]
    assert rows == [(1, "P1-C001", "new", ["q", "r"], merge.UNTAGGED, "FAQ"), (2, "P1-C002", "x", [], "r" + merge.UNTAGGED, "FAQ")]
    exceptions = spark.createDataFrame([(1, 2, "missing_info", 0, "z"), (1, 3, "missing_info", 0, "z")], "doc_id int, stage int, field string, pos int, item string")
    merged = merge.merge_exceptions(exceptions, missing=merge.missing_parts(out)).first()
    assert merged["items"] == ["z", "P1-C001: Stage 4 缺少 metadata", "P1-C002: Stage 3 缺少 qa_pairs", "P1-C002: Stage 4 缺少 metadata"]


def test_format_checks_tell_absent_from_null(spark):
    raw = ['{"document_info":null,"knowledge_atoms":[]}', '{"knowledge_atoms":[{}]}', json.dumps({"document_info": {}, "knowledge_atoms": [{"chunk_id": "P1-C001", "metadata": {"summary": ""}, "qa_pairs": [{"question": "q"}]}]})]
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id int, raw string")
    errors = {(r.doc_id, r.error) for r in validate.check_document(docs).collect()}
    assert (0, "knowledge_atoms empty") in errors and (0, "missing: document_info") not in errors and (1, "missing: document_info") in errors
    atoms = {(r.doc_id, r.error) for r in validate.check_atoms(docs).collect()}
    assert {d for d, _ in atoms} == {2} and {(2, "QA[0] missing: answer"), (2, "metadata missing: business_module")} <= atoms and (2, "metadata missing: summary") not in atoms
    assert {r.doc_id for r in validate.check_lists(docs, ("vague_items",)).collect()} == {0, 2}
    titles = spark.createDataFrame([(1, "a", "", "s"), (1, "b", None, None), (1, "c", "x", "s")], "doc_id int, chunk_id string, title string, summary string")
    assert [r.chunk_id for r in validate.warn_atoms(titles).collect()] == ["c"]
    qa = spark.createDataFrame([(1, "a", 1, []), (1, "a", 2, ["k"])], "doc_id int, chunk_id string, qa_no int, keywords array<string>")
    assert [r.qa_no for r in validate.warn_keywords(qa).collect()] == [1]


def test_exports_of_documents_without_pairs(spark, tmp_path):
    atom = f"struct<chunk_no:int,chunk_id:string,title:string,content:string,doc_type:string,metadata:{TAGS},qa_pairs:array<struct<question:string,answer:string,keywords:array<string>,confidence_score:int,remark:string>>,remark:string>"
    lists = "struct<" + ",".join(f"{f}:array<string>" for f in merge.FIELDS) + ">"
    docs = spark.createDataFrame(
        [(1, "s", "FAQ", 1, 0, [(1, "P1-C001", "t", "c", "FAQ", None, [], "")], None, (83.5, 0.5, 2))],
        f"doc_id int, source string, doc_type string, total_chunks int, total_qa_pairs int, knowledge_atoms array<{atom}>, exception_list {lists}, quality_summary struct<avg_confidence:double,coverage_rate:double,exception_count:int>",
    )
    assert [list(r) for r in export.to_summary_csv(docs).collect()] == [[""] * 7]
    assert export.to_markdown(docs).first()["value"].split("\n")[4] == "> 覆盖率: 50% | 平均置信度: 8350% | 异常项: 2"
    export.export(docs, "coze_text", str(tmp_path / "out"))
    assert b'"\r\n"t","c"\r\n' in b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*.csv"))


def test_review_list_of_every_section(spark):
    documents = spark.createDataFrame([(1, 5), (2, 0), (3, 1)], "doc_id int, exception_count int")
    atoms = spark.createDataFrame([(1, 1, "P1-C001", "【账号】- 开户"), (1, 2, "P1-C002", "【账号】- "), (2, 1, "P1-C001", "t")], "doc_id int, chunk_no int, chunk_id string, title string")
    qa = spark.createDataFrame([(1, "P1-C001", 1, "q1", 90), (1, "P1-C001", 2, "q2", 60), (1, "P1-C009", 1, "q9", 60)], "doc_id int, chunk_id string, qa_no int, question string, confidence_score int")
    items = [
        (1, "expired_items", 1, "P1-C002: 旧版  内容"), (1, "truncated_items", 1, "P1-C001: 截断"), (1, "truncated_items", 2, "P1-C002: 截断"),
        (1, "chunk_anomalies", 1, "P1-C001: 拆分颗粒度异常-内容12字"), (1, "low_confidence_qa", 1, "P1-C001-Q9: 置信分60-【低置信】"),
        (1, "low_confidence_qa", 2, "P1-C009-Q1: 置信分60-答案不全"), (1, "sensitive_items", 1, "P1-C001: 手机号"), (2, "expired_items", 1, "P1-C001: x"),
    ]
    exceptions = spark.createDataFrame(items, "doc_id int, field string, pos int, item string")
    got = {r.doc_id: r for r in review.review_list(documents, exceptions, atoms, qa).collect()}
    assert got[1].summary.split("\n") == [
        "共处理出 2 个知识片段、2 条问答，其中 5 项需要你关注", "", "需要关注的内容：", "", "**包含敏感信息的**（需确认脱敏是否正确）：", "- 手机号", "",
        "**答案不确定的**（原文信息不够，AI给出的回答可能不准）：", "- 关于「q2」，原文信息不够明确", "- 答案不全", "", "**拆分可能不合理的**（知识片段过长或过短）：",
        "- 「开户」这段内容内容12字", "- 「开户」可能被截断，内容不完整", "- 截断", "", "**可能已过期的**（内容可能不再适用）：", "- 旧版 内容", "",
        "✅ 以上内容确认无误后，我将交付完整的JSON文件；如需修改请直接告诉我。",
    ]
    assert got[1].needs_review and not got[2].needs_review and not got[3].needs_review and got[3].summary == review.ALL_PASSED


def test_stage_schemas(spark):
    tags = dict.fromkeys(merge.TAGS, "x")
    pair = {"question": "q", "answer": "a", "keywords": ["k"], "confidence_score": 90}
    cases = [
        (1, {"cleaned_text": "t", "doc_type": "FAQ"}, []),
        (1, {"cleaned_text": " ", "doc_type": "other"}, ["cleaned_text: " + stages.STAGE_TEXTS["empty_text"], UNKNOWN_TYPE]),
        (2, {"chunks": [{"chunk_id": "P1-C001", "title": "t", "content": "c"}], "exception_list": {"vague_items": []}}, []),
        (2, {"chunks": []}, ["chunks: " + stages.STAGE_TEXTS["empty_chunks"]]),
        (2, {"chunks": [{"chunk_id": "P1-C001", "title": "t", "content": "c"}, {"chunk_id": "C1", "title": "t"}]}, ["chunks.1.chunk_id: Value error, chunk_id 格式错误: 'C1'，应为 P{N}-C{NNN}（如 P1-C001）", "chunks.1.content: Field required"]),
        (3, {"chunks": [{"chunk_id": "P1-C001", "qa_pairs": [pair, {**pair, "confidence_score": 101}]}]}, ["chunks.0.qa_pairs.1.confidence_score: Input should be less than or equal to 100"]),
        (3, {"chunks": [{"chunk_id": "P1-C001", "qa_pairs": []}]}, ["chunks.0.qa_pairs: " + stages.STAGE_TEXTS["empty_pairs"]]),
        (3, {}, ["chunks: Field required"]),
        (4, {"chunks": [{"chunk_id": "P1-C001", "doc_type": "FAQ", "metadata": tags}]}, []),
        (4, {"chunks": [{"chunk_id": "P1-C001", "doc_type": "FAQ", "metadata": {**tags, "summary": None}}]}, ["chunks.0.metadata.summary: Input should be a valid string"]),
        (4, {"chunks": [{"chunk_id": "P1-C001", "doc_type": "FAQ"}]}, ["chunks.0.metadata: Field required"]),
        (4, {"chunks": [{"chunk_id": "P1-C001", "doc_type": 7, "metadata": [], "remark": None}]}, ["chunks.0." + UNKNOWN_TYPE, "chunks.0.metadata: Input should be a valid dictionary or instance of Metadata", "chunks.0.remark: Input should be a valid string"]),
        (3, {"chunks": [{"chunk_id": "P1-C001", "qa_pairs": [{**pair, "confidence_score": 90.5, "keywords": "k"}]}]}, [f"{Q}.keywords: Input should be a valid list", f"{Q}.confidence_score: Input should be a valid integer, got a number with a fractional part"]),
        (3, {"chunks": [{"chunk_id": "P1-C001", "qa_pairs": [{**pair, "question": 7, "keywords": ["k", 1]}]}]}, [f"{Q}.question: Input should be a valid string", f"{Q}.keywords.1: Input should be a valid string"]),
        (3, {"chunks": [{"chunk_id": "P1-C001", "qa_pairs": [{**pair, "confidence_score": x} for x in (90.0, "90", " 7 ", True)]}]}, []),
        (3, {"chunks": [{"chunk_id": "P1-C001", "qa_pairs": [{**pair, "confidence_score": "high"}, {**pair, "confidence_score": None}, {**pair, "confidence_score": -1}, 5]}]}, [f"{Q}.confidence_score: Input should be a valid integer, unable to parse string as an integer", f"{Q[:-1]}1.confidence_score: Input should be a valid integer", f"{Q[:-1]}2.confidence_score: Input should be greater than or equal to 0", f"{Q[:-1]}3: Input should be a valid dictionary or instance of QaPair"]),
        (2, {"chunks": {"chunk_id": 1}, "exception_list": {"vague_items": ["a", None], "missing_info": None}}, ["chunks: Input should be a valid list", "exception_list.missing_info: Input should be a valid list", "exception_list.vague_items.1: Input should be a valid string"]),
        (1, {"cleaned_text": None, "sensitive_items": "x"}, ["cleaned_text: Input should be a valid string", "doc_type: Field required", "sensitive_items: Input should be a valid list"]),
    ]
    for stage in (1, 2, 3, 4):
        rows = [(k, json.dumps(x, ensure_ascii=False)) for k, (n, x, _) in enumerate(cases) if n == stage] + [(99, "no json")]
        good, bad = stages.stage_gate(spark.createDataFrame(rows, "id int, content string"), stage)
        got = {r.id: [] for r in good.collect()} | {r.id: r.errors for r in bad.collect()}
        assert got == {k: want for k, (n, _, want) in enumerate(cases) if n == stage} | {99: ["no JSON object"]}


def test_admission_equals_a_walk_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), float(k), f"t{k:03}", rng.choice([0, 5, None])) for k in range(120)]
    df = spark.createDataFrame(rows, "user_id string, created_at double, task_id string, file_size long")
    for tasks, uploads in ((10, 4), (4, 10), (0, 3), (3, 0), (200, 200), (8, 3), (6, 2)):
        counts, want = {}, {}
        for user, _, task, size in rows:
            n, u = counts.get(user, (0, 0))
            want[task] = "admitted" if user is None else "task" if n >= tasks else "upload" if u >= uploads else "admitted"
            if want[task] == "admitted":
                counts[user] = n + 1, u + ((size or 0) > 0)
        assert {r.task_id: r.verdict for r in usage.admit(df, tasks, uploads).collect()} == want
