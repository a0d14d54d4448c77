from pyspark.sql import functions as F

from sluice.functions import extract, sensitive
from sluice.operators import segment, stages
from sluice.sources import documents as sources

# One text per default rule.
POSITIVE = {
    "password": "密码：abc12345 后", "api_key": "api_key = ABCD1234efgh", "secret_key": "密钥：zxcv-1234_x", "token": "Token: abc.def-123456", "salt": "salt=ab12",
    "phone": "电13812345678话", "id_card": "号11010519491231002X。", "email": "写 a.b@c.example 好", "bank_card": "卡6222021234567890 完", "internal_ip": "连192.168.1.20 上",
}


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def test_each_rule_hits_once(spark):
    df = texts(spark, [*POSITIVE.values(), "123456789012", "8.8.8.8", "", None])
    got = {r.id: [h.rule for h in r.hits] for r in sensitive.detect(df, "text").collect()}
    assert [got[i] for i in range(len(POSITIVE))] == [[name] for name in POSITIVE]
    assert all(got[len(POSITIVE) + k] == [] for k in range(4))


def test_spans_masks_and_markers(spark):
    df = texts(spark, ["😀 13812345678 and a@b.cn", "【敏感数据】 密码：hunter22", "x【敏感数据-禁止向量化入库】y"])
    rows = {r.id: r for r in sensitive.mask(df, "text").collect()}
    assert [(h.start, h.end, h.rule) for h in rows[0].hits] == [(2, 13, "phone"), (18, 24, "email")]
    assert rows[0].masked == "😀 【敏感数据】 and a@b.cn"
    assert rows[1].masked == "【敏感数据】 【敏感数据】" and rows[2].masked == "x【敏感数据-禁止向量化入库】y"
    flagged = {r.id: r.flagged for r in sensitive.flag(df, "text").collect()}
    assert flagged[0].count(sensitive.FLAGGED) == 2
    custom = sensitive.detect(texts(spark, ["EMP123456 emp123456"]), "text", [sensitive.Rule("emp", r"EMP\d{6}", case_sensitive=True)])
    assert [h.text for h in custom.first().hits] == ["EMP123456"]
    only = sensitive.detect(df, "text", action="detect").collect()
    assert [len(r.hits) for r in only] == [1, 0, 0]
    entry = sensitive.detect(texts(spark, ["13812345678 a@b.cn"]), "text").select(F.transform("hits", sensitive.report_entry).alias("e")).first().e
    assert entry == ["phone: 13812345678 → 【敏感数据】", "email: a@b.cn → "]


def test_segments_rejoin(spark):
    t = ["a" * 59 + "\n\n" + "b" * 20 + "\n\n" + "c" * 59, "x" * 300 + "\n\n" + "y" * 300, "short", "", None]
    rows = segment.split_segments(texts(spark, t), 100).orderBy("id", "seg_no").collect()
    assert [sum(r.id == k for r in rows) for k in range(5)] == [2, 2, 1, 1, 0]
    for k in range(4):
        assert "\n\n".join(r.segment for r in rows if r.id == k) == t[k]
    assert segment.split_segments(texts(spark, t), 0).count() == 4


def test_renumber_and_remap_crossing_ids(spark):
    parts = spark.createDataFrame([(1, 0, 0, "P1-C001"), (1, 0, 1, "P1-C002"), (1, 1, 0, "P1-C001"), (1, 1, 1, "P1-C002")], "doc_id int, seg_no int, chunk_pos int, chunk_id string")
    numbered = segment.renumber_chunks(parts)
    assert [r.new_chunk_id for r in numbered.orderBy("chunk_no").collect()] == ["P1-C001", "P1-C002", "P1-C003", "P1-C004"]
    items = spark.createDataFrame([(1, 1, "P1-C001 and P1-C002"), (2, 0, "P1-C001")], "doc_id int, seg_no int, item string")
    got = {r.doc_id: r.item for r in segment.remap_exceptions(items, numbered).collect()}
    assert got == {1: "P1-C003 and P1-C004", 2: "P1-C001"}
    big = spark.createDataFrame([(1, k) for k in range(9)], "doc_id int, chunk_no int")
    assert sorted(r.batch_no for r in segment.batch_chunks(big).collect()) == [0] * 4 + [1] * 4 + [2]


def test_structure(spark):
    md = "# A\n## B b \n| x | y |\n|---|---|\n| 1 | 2 |\ntext $a$ and $$b$c$$\n<TABLE>\n</table> $\n####### no"
    df = spark.createDataFrame([(1, md), (2, "")], "doc_id int, markdown string")
    h = {r.doc_id: [(x.level, x.text, x.line) for x in r.headings] for r in extract.headings(df).collect()}
    assert h == {1: [(1, "A", 0), (2, "B b", 1)], 2: []}
    assert [(t.start, t.end) for t in extract.pipe_tables(df).first().pipe_tables] == [(2, 4)]
    assert [(t.start, t.end) for t in extract.html_tables(df).first().html_tables] == [(6, 7)]
    assert [(x.latex, x.line) for x in extract.formulas(df).first().formulas] == [("b$c", 5), ("a", 5)]


def test_sources(spark, tmp_path):
    for name, content in {"a.md": "# x".encode(), "b.TXT": "中文".encode("gb18030"), "c.xlsx": b"x", "d.txt": b" \n", "e.pdf": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    docs, rejects = sources.read_documents(spark, str(tmp_path))
    assert {r.source: r.markdown for r in docs.collect()} == {"a.md": "# x", "b.TXT": "中文"}
    assert {r.source: r.reason for r in rejects.collect()} == {"c.xlsx": "unsupported type", "d.txt": "blank", "e.pdf": "needs an extractor"}


def test_checkpoint_builds_only_the_rest(spark, tmp_path):
    seen = []

    def build(units):
        seen.append(units.count())
        return units

    path = str(tmp_path / "stage")
    sources.with_checkpoint(spark.range(3).withColumnRenamed("id", "k"), path, "k", build)
    out = sources.with_checkpoint(spark.range(5).withColumnRenamed("id", "k"), path, "k", build)
    assert seen == [3, 2] and out.count() == 5


def test_responses(spark):
    rows = ['{"k": 1}', '```json\n{"k": 2}\n```', '{"k": "a\nb"}', '{"k": ', "[1]", ""]
    got = [(r.ok, r.parsed and r.parsed.k) for r in stages.parse_responses(texts(spark, rows), "k string", "text").orderBy("id").collect()]
    assert got == [(True, "1"), (True, "2"), (True, "a\nb"), (False, None), (False, None), (False, None)]


def expected_hits(text, rules):
    import re

    taken, out = [m.span() for m in re.finditer(sensitive.MARKERS, text)], []
    for rule in sorted(rules, key=lambda r: r.priority):
        for m in re.finditer(rule.pattern, text, 0 if rule.case_sensitive else re.IGNORECASE):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                taken.append(m.span())
                out.append((*m.span(), rule.name, rule.action, m.group()))
    return sorted(out)


def test_hits_equal_those_found_rule_by_rule(spark):
    import random

    rng = random.Random(8)
    parts = ["password: abc@mail.example", "pwd=1234", "13812345678", "1" * 17 + "X", "6" * 16, "6" * 19, "7" * 20, "10.0.0.1", "172.20.1.2", "a.b@c.de", "api key: abcdefgh1", "API\tKey：zzzzzzzzz", "secret-key==12345678", "密钥：a_b-c-d-e", "令牌 x.y.z.1234", "TOKEN: ab", "salt:1234", sensitive.FLAGGED, sensitive.MASKED, "密码：【敏感数据】", " ", ",", "。", "x", "é日", "\n", "192.168.1.1", "paſſwd: longvalue", "toKen=abcdefghi", "1", "@"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(600)] + ["", None]
    more = (*sensitive.RULES, sensitive.Rule("word", "[a-z]{3}x?", "flag", 5, True), sensitive.Rule("pair", "(a|b)(c|d)", "mask", 60))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for rules in (sensitive.RULES, more):
        for r in sensitive.detect(df, "t", rules).collect():
            assert [tuple(h) for h in r.hits] == expected_hits(r.t or "", rules), r.t


def test_very_many_hits_in_one_text(spark):
    n = 20_000
    text = " ".join(f"u{k}@mail.example" for k in range(n))
    row = sensitive.detect(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert len(row.hits) == n and row.hits[-1].end == len(text) and row.hits[-1].text == f"u{n - 1}@mail.example"
