import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.operators import access, export, usage, validate
from sluice.streaming import jobs


def tasks(spark, rows):
    return spark.createDataFrame(rows, "task_id string, user_id string, created_at double, file_size long, token_consumed long, status string")


def test_quota_admits_in_order(spark):
    arrivals = tasks(spark, [(f"t{i:02d}", "u", 1000.0 + i, 0, 0, "") for i in range(20)] + [("x", None, 1.0, 1, 0, "")])
    out = usage.admit(arrivals, 3, 10).collect()
    assert sorted(r.task_id for r in out if r.verdict == "admitted") == ["t00", "t01", "t02", "x"]
    uploads = usage.admit(tasks(spark, [("a", "u", 1.0, 5, 0, ""), ("b", "u", 2.0, 5, 0, ""), ("c", "u", 3.0, 0, 0, "")]), 9, 1).collect()
    assert {r.task_id: r.verdict for r in uploads} == {"a": "admitted", "b": "upload", "c": "upload"}


def test_today_counts_ledger_and_the_rest(spark):
    now = 10 * 86400.0 + 5000
    t = tasks(spark, [("a", "u", now - 10, 1, 100, ""), ("b", "u", now - 86400, 0, 70, "")])
    led = spark.createDataFrame([("a", "u", now - 5, 40), ("b", "u", now - 5, 30)], "task_id string, user_id string, consumed_at double, tokens long")
    assert [tuple(r) for r in usage.today_by_user(t, led, now).collect()] == [("u", 1, 1, 130)]


def test_retention_zero_keeps_for_ever(spark):
    t = tasks(spark, [("a", "u", 0.0, 1, 0, ""), ("b", "u", 0.0, 1, 0, "")])
    files = spark.createDataFrame([("p", "a", "upload", 0.0), ("q", "a", "result", 0.0), ("r", "b", "result", 90 * 86400.0)], "path string, task_id string, kind string, modified_at double")
    kept, left = usage.retention(files, t, 0, 90, 100 * 86400.0)
    assert {r.path for r in kept.collect()} == {"p", "r"} and [r.task_id for r in left.collect()] == ["b"]


def test_screening(spark):
    rules = spark.createDataFrame([("ip_whitelist", "10.0.0.0/8", None), ("ip_whitelist", "2001:db8::/32", None), ("ip_whitelist", "junk", None), ("domain_whitelist", "@Ok.example", None), ("user_blacklist", "Bad@ok.example", None)], "type string, value string, note string")
    people = [("10.1.2.3", "a@ok.EXAMPLE"), ("11.1.1.1", "a@ok.example"), ("2001:db8::9", "a@ok.example"), ("::1", "a@no.example"), ("garbage", "a@ok.example"), ("127.0.0.1", "bad@OK.example")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(people)], "id int, ip string, email string")
    got = [r.decision for r in access.screen(df, rules).orderBy("id").collect()]
    assert got == ["allowed", "ip", "allowed", "domain", "ip", "blacklisted"]
    assert [r.valid for r in access.check_rules(rules).collect()] == [True, True, False, True, True]


def test_lockouts(spark):
    rows = [("e", float(i), i, False) for i in range(5)] + [("e", 10.0, 5, False), ("e", 1805.0, 6, False), ("e", 4000.0, 7, True), ("e", 4001.0, 8, False)]
    out = jobs.lockouts(spark.createDataFrame(rows, "email string, at double, seq int, ok boolean"), 5, 30).collect()
    assert sorted((r.at, r.locked_until) for r in out) == [(4.0, 1804.0), (1805.0, 3605.0)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("call 13812345678\n\nend")
    for expected in (1, 1, 2):
        jobs.start_refine(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        if expected == 1 and (tmp_path / "mark").exists():
            (tmp_path / "in" / "b.txt").write_text("more")
        (tmp_path / "mark").write_text("")
    t = dt.datetime(2024, 1, 1, 5)
    ledger = spark.createDataFrame([(t, "u", 30), (t, "u", 30), (t + dt.timedelta(days=1), "u", 1)], "consumed_at timestamp, user_id string, tokens long")
    assert {(str(r.day), r.tokens, r.over) for r in jobs.stream_daily_tokens(ledger, 50).collect()} == {("2024-01-01", 60, True), ("2024-01-02", 1, False)}
    events = spark.createDataFrame([("t", 1, 0, "success"), ("t", 2, 1, "calling"), ("f", 1, 3, "failed")], "task_id string, at int, stage int, step string")
    got = {r.task_id: round(r.progress, 3) for r in jobs.stream_progress(events).collect()}
    assert got == {"t": 0.24, "f": 0.6}


def test_metrics_and_repairs(spark):
    qa = spark.createDataFrame([("d", "P1-C001", 1, "q", "an answer", 95, ""), ("d", "P1-C001", 2, "q", "文档未说明", 72, "")], "doc_id string, chunk_id string, qa_no int, question string, answer string, confidence_score int, remark string")
    m = validate.confidence_metrics(qa).first()
    assert (m.avg_confidence, m.low_confidence_count, m.scored) == (83.5, 1, 2)
    assert [(r.location, r.issue) for r in validate.score_marks(qa).collect()] == [("P1-C001 第2条QA", "unmarked low score")]
    assert [r.remark for r in validate.repair_marks(qa).orderBy("qa_no").collect()] == ["", "【低置信-人工复核】"]
    secrets = qa.withColumn("answer", F.lit("密码：abc123 token：x"))
    assert {r.issue for r in validate.unmasked_answers(secrets).collect()} == {"密码值未脱敏", "Token值未脱敏"}
    advice = qa.withColumn("answer", F.lit("建议您可以尝试"))
    assert sorted(r.phrase for r in validate.warn_advice(advice.filter("qa_no = 1")).collect()) == ["可以尝试", "建议您"]


def test_unknown_format_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        export.export(spark.range(1), "nothing", str(tmp_path))
    assert len(export.FORMATS) == 8


def test_addresses_are_those_of_the_standard_library(spark):
    import ipaddress

    from sluice.functions import addresses

    texts = """1.2.3.4 0.0.0.0 255.255.255.255 01.2.3.4 1.2.3 1.2.3.4.5 256.1.1.1 1.2.3.4/8 10.0.0.0/33 10.0.0.0/0 10.1.0.0/255.255.0.0 10.1.0.0/0.0.255.255 10.1.0.0/255.0.255.0 10.0.0.0/ 1.1.1.1/2/3
    :: ::1 1:: 1::8 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 1:2:3:4:5:6:7:8:9 1::2::3 ::: :1 1: ::ffff:1.2.3.4 1:2:3:4:5:6:1.2.3.4 1.2.3.4:: ::1.2.3 ::01.2.3.4 2001:DB8::/32 fd00::/129
    fe80::1%eth0 12345::1 g::1 ::/0 localhost x . 1:2:3:4::5:6:7:8 ::1.2.3.4/127""".split() + ["", " 1.2.3.4", None]

    def expected(text, make, host):
        try:
            found = make(text)
        except ValueError:
            return None
        first = found if host else found.network_address
        size, length = (32, 4) if found.version == 4 else (128, 6)
        return f"{length}" + f"{int(first):0{size}b}"[: None if host else found.prefixlen]

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", addresses.address(F.col("t")).alias("a"), addresses.network(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.a == (expected(r.t, ipaddress.ip_address, True) if r.t is not None else None), r.t
        if r.t is not None and "%" not in r.t and r.t == r.t.strip():
            assert r.n == expected(r.t, lambda t: ipaddress.ip_network(t, strict=False), False), r.t


def test_the_longest_network_is_named_and_the_plan_has_no_nested_loop(spark):
    rules = spark.createDataFrame([("ip_whitelist", v) for v in ("10.0.0.0/8", "10.1.0.0/16", "10.1.2.3", "fd00::/8", "0.0.0.0/33")] + [("domain_whitelist", "@@Ok.example ")], "type string, value string")
    people = ["10.1.2.3", "10.1.9.9", "10.9.9.9", "11.0.0.1", "fdff::1", "localhost", "127.0.0.2", None, "10.1.2.3"]
    df = spark.createDataFrame([(k, ip, "a@ok.example" if k else "ok.example") for k, ip in enumerate(people)], "id int, ip string, email string")
    out = access.screen(df, rules)
    assert [(r.ip_ok, r.ip_rule) for r in out.orderBy("id").collect()] == [
        (True, "10.1.2.3"), (True, "10.1.0.0/16"), (True, "10.0.0.0/8"), (False, None), (True, "fd00::/8"), (True, None), (False, None), (False, None), (True, "10.1.2.3")
    ]
    assert [r.domain_ok for r in out.orderBy("id").collect()] == [False] + [True] * 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_term_pairs_of_any_script(spark):
    import itertools
    import random

    from sluice.operators import stages

    texts = ["Kubernetes Cubernetes Microservice Mikroservice Straßenverkehr Strassenverkehr développement developpement Straßenverkehre xxxxxxx xxxxxxy", None, "", "Алгоритмы Алгоритма 日本語日本語日本 日本語日本語日木"]
    rng = random.Random(1)
    texts.append(" ".join("".join(rng.choice("ab") for _ in range(rng.choice([8, 9]))) for _ in range(60)))
    got = {(r.k, r.item) for r in stages.term_pairs(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()}

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = {k: sorted({w for w in (t or "").split() if len(w) >= 8}) for k, t in enumerate(texts)}
    assert got == {(k, f"{a} / {b}") for k, own in words.items() for a, b in itertools.combinations(own, 2) if apart(a, b) == 1}
    assert (0, "développement / developpement") not in got and (0, "developpement / développement") in got and (0, "Microservice / Mikroservice") in got


def test_messages_by_type_status_and_title(spark):
    rows = [(1, "all", "sent", 0.0, 1.0, "notice", "Maintenance window"), (2, "all", "scheduled", 5.0, None, "notice", "maintenance"), (3, "all", "draft", 0.0, None, "alert", "Maintenance"), (4, "all", "sent", 0.0, 1.0, "notice", None)]
    messages = spark.createDataFrame(rows, "id int, target_users string, status string, scheduled_at double, sent_at double, type string, title string")
    users = spark.createDataFrame([("u", "U")], "id string, username string")
    got = lambda **by: sorted(r.id for r in access.message_list(messages, users, 10.0, **by).collect())
    assert got() == [1, 2, 3, 4] and got(msg_type="notice", status="sent", title="MAINT") == [1, 2] and got(status="draft") == [3]


def test_expired_chunks_have_an_entry(spark):
    from sluice.operators import stages

    tags = spark.createDataFrame([(1, "P1-C001", "2023-01-01~2023-06-30"), (1, "P1-C002", "2030-01-01"), (1, "P1-C003", None)], "doc_id int, chunk_id string, version_timeliness string")
    assert [r["item"] for r in stages.expired_items(tags, "2024-01-01").collect()] == ["P1-C001: 2023-01-01~2023-06-30-已过期"]


def test_csv_files_begin_with_a_byte_order_mark(spark, tmp_path):
    import csv
    import io

    rows = [('a "b", c', "x\ny"), ("é", None), ("", "z")]
    export.register_format("plain", lambda df: df, ".csv")
    try:
        export.export(spark.createDataFrame(rows, "`问题` string, b string").repartition(2), "plain", str(tmp_path / "out"))
        export.export(spark.createDataFrame([], "`问题` string, b string"), "plain", str(tmp_path / "none"))
    finally:
        del export.FORMATS["plain"]
    got = []
    for f in sorted((tmp_path / "out").glob("part-*")):
        data = f.read_bytes()
        if data:
            assert data.startswith(b'\xef\xbb\xbf"') and data.count(b"\r\n") >= 2
            head, *body = csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""))
            assert head == ["问题", "b"]
            got += body
    assert sorted(map(tuple, got)) == sorted((a, b or "") for a, b in rows)
    assert [f.read_bytes() for f in (tmp_path / "none").glob("part-*") if f.stat().st_size] == [b'\xef\xbb\xbf"\xe9\x97\xae\xe9\xa2\x98","b"\r\n']


def test_markdown_pages(spark):
    from sluice.operators import merge

    meta = {"business_module": ""}
    atoms = [{"chunk_id": "P1-C001", "title": "", "content": "c", "doc_type": "FAQ", "metadata": meta, "qa_pairs": [{"question": "q", "answer": "a", "confidence_score": None}], "remark": ""}, {"chunk_id": "", "title": None, "content": None, "doc_type": None, "metadata": meta, "qa_pairs": [], "remark": "r"}]
    lists = {f: (["x"] if f == "vague_items" else []) for f in merge.FIELDS}
    kind = "doc_id int, source string, doc_type string, total_chunks int, total_qa_pairs int, knowledge_atoms array<struct<chunk_id:string,title:string,content:string,doc_type:string,metadata:struct<business_module:string>,qa_pairs:array<struct<question:string,answer:string,confidence_score:int>>,remark:string>>, exception_list struct<" + ",".join(f"{f}:array<string>" for f in merge.FIELDS) + ">, quality_summary struct<coverage_rate:double,avg_confidence:double,exception_count:int>"
    docs = spark.createDataFrame([(1, "s", "FAQ", 2, 1, atoms, lists, {"coverage_rate": 0.125, "avg_confidence": 0.875, "exception_count": 1}), (2, "s", "FAQ", 2, 1, atoms[1:], None, {"coverage_rate": 0.135, "avg_confidence": 1.0, "exception_count": 0})], kind)
    one, two = (r.value for r in export.to_markdown(docs).orderBy("doc_id").collect())
    assert one == (
        "# s\n\n> 文档类型: FAQ | 知识原子: 2 | QA 对: 1\n\n> 覆盖率: 12% | 平均置信度: 88% | 异常项: 1\n\n---\n\n## 1. P1-C001\n\n*ID: P1-C001, 类型: FAQ*\n\nc\n\n### QA 对\n\n**Q: q**\n\nA: a\n*置信度: 0%*\n\n---\n\n"
        "## 2. 未命名\n\n*ID: , 类型: *\n\n\n\n> 备注: r\n\n---\n\n## 异常清单\n\n- **模糊表述**: x\n"
    )
    assert "覆盖率: 14%" in two and two.endswith("> 备注: r\n\n---\n")


def test_a_day_of_one_user_is_dealt_over_pieces(spark):
    rows = spark.range(20_000).select(F.lit("u").alias("user_id"), (F.col("id") * 4.0).alias("consumed_at"), F.col("id").cast("string").alias("task_id"), (F.col("id") % 3).alias("tokens"))
    assert [tuple(r) for r in usage.quota_breaches(rows, 15_001).select("task_id", "total").collect()] == [("15001", 15_001)]
    assert usage.quota_breaches(rows, 10**9).count() == 0 and [r.task_id for r in usage.quota_breaches(rows, 0).collect()] == ["0"]
    days = spark.createDataFrame([("u", float(t), str(k), n) for k, (t, n) in enumerate([(1, 5), (1, 5), (61, 0), (200, 5), (86_401, 9)])], "user_id string, consumed_at double, task_id string, tokens long")
    assert sorted((str(r.day), r.task_id, r.total) for r in usage.quota_breaches(days, 10).collect()) == [("1970-01-01", "1", 10)]
    arrivals = rows.select("user_id", F.col("consumed_at").alias("created_at"), "task_id", F.when(F.col("task_id") % 2 == 0, 1).alias("file_size"))
    got = {r.verdict: r.n for r in usage.admit(arrivals, 15_000, 100).groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    assert got == {"admitted": 199, "upload": 19_801}


def test_pairs_out_of_order(spark):
    from sluice.operators import review

    atoms = spark.createDataFrame([(1, f"P1-C00{k}", k) for k in (1, 2, 3)], "doc_id int, chunk_id string, chunk_no int")
    qa = spark.createDataFrame([(1, c, p, ["a", "b", "c"], "q") for c, p in (("P1-C001", 0), ("P1-C001", 1), ("P1-C001", 5), ("P1-C002", 2), ("P1-C002", 3), ("P1-C002", 4), ("P1-C003", -1), ("P1-C003", 7), ("P1-C003", 8))], "doc_id int, chunk_id string, pos int, keywords array<string>, question string")
    assert [(r.chunk_id, r.issue) for r in review.lint_qa(atoms, qa).collect()] == [("P1-C003", "order")]
