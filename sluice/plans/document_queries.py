"""Queries over assembled documents: merging, validation, review and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.functions import sensitive
from sluice.operators import export, merge, records, review, validate
from sluice.plans import base
from sluice.plans.base import EXCEPTIONS, LINES, QA, table

QUERIES, ORACLES = {}, {}
BASE = f"WITH {LINES}, {QA}, {EXCEPTIONS}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pairs(spark, sf_dir):
    """Q&A lists by chunk, as stage 3 gives them."""
    row = F.struct("qa_no", "question", "answer", F.array(F.lit("k"), F.lit("w")).alias("keywords"), "confidence_score", "remark")
    lists = base.qa(spark, sf_dir).groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    return lists.select("doc_id", "chunk_id", F.transform("p", lambda q: q.dropFields("qa_no")).alias("qa_pairs"))


def _assembled(spark, sf_dir):
    atoms = base.lines(spark, sf_dir)
    tags = table(spark, sf_dir, "labels").select(
        "doc_id", F.lit("P1-C001").alias("chunk_id"), F.struct(*[F.lit("x").alias(t) for t in merge.TAGS]).alias("metadata"), F.lit("FAQ").alias("doc_type"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("remark")
    )
    types = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type"))
    return merge.assemble(atoms.drop("doc_type"), _pairs(spark, sf_dir), tags, types)


JOINED = BASE + """, pairs AS (SELECT doc_id, chunk_id, count(*) AS n FROM qa GROUP BY doc_id, chunk_id), joined AS (
  SELECT l.doc_id, l.chunk_no, l.chunk_id, coalesce(p.n, 0) AS n_qa, p.n IS NULL AS no_qa, t.doc_id IS NULL AS no_tags, CASE WHEN t.doc_id IS NULL THEN l.doc_type ELSE 'FAQ' END AS doc_type,
         CASE WHEN t.doc_id IS NULL THEN coalesce(l.remark, '') || '；Stage 4 缺少 metadata' ELSE concat_ws('；', nullif(l.remark, ''), CASE WHEN t.toxic = 1 THEN 'toxic' END) END AS remark
  FROM lines AS l LEFT JOIN pairs AS p USING (doc_id, chunk_id) LEFT JOIN labels AS t ON t.doc_id = l.doc_id AND l.chunk_no = 1
)"""


@query(JOINED + " SELECT doc_id, chunk_id, CAST(n_qa AS INT) AS n_qa, doc_type, remark, CASE WHEN no_tags THEN '【人工补全项】' ELSE 'x' END AS summary FROM joined")
def assembled_atoms(spark, sf_dir):
    a = _assembled(spark, sf_dir)
    return a.select("doc_id", "chunk_id", F.coalesce(F.size("qa_pairs"), F.lit(0)).alias("n_qa"), "doc_type", "remark", F.col("metadata.summary").alias("summary"))


@query(JOINED + " SELECT doc_id, chunk_no, chunk_id || ': Stage 3 缺少 qa_pairs' AS item FROM joined WHERE no_qa UNION ALL SELECT doc_id, chunk_no, chunk_id || ': Stage 4 缺少 metadata' FROM joined WHERE no_tags")
def missing_parts(spark, sf_dir):
    return merge.missing_parts(_assembled(spark, sf_dir)).select("doc_id", "chunk_no", "item")


@query(BASE + ", e AS (SELECT doc_id, field, item, min(stage * 100000 + pos) AS a FROM exceptions GROUP BY doc_id, field, item) SELECT doc_id, field, string_agg(item, '|' ORDER BY a) AS items FROM e GROUP BY doc_id, field")
def merged_exceptions(spark, sf_dir):
    e = base.exceptions(spark, sf_dir)
    return merge.merge_exceptions(e, e).select("doc_id", "field", F.array_join("items", "|").alias("items"))


@query(JOINED + " SELECT doc_id, count(*) AS total_chunks, CAST(sum(n_qa) AS BIGINT) AS total_qa_pairs, '2024-02-01' AS processing_date FROM joined GROUP BY doc_id")
def document_info(spark, sf_dir):
    return merge.document_info(_assembled(spark, sf_dir), "2024-02-01")


def _documents(spark, sf_dir):
    atoms = _assembled(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("doc_type"))
    info = merge.document_info(atoms, "2024-02-01").join(d, "doc_id")
    summary = validate.confidence_metrics(base.qa(spark, sf_dir)).select("doc_id", F.struct("avg_confidence", "low_confidence_count").alias("quality_summary"))
    return merge.nest_documents(info, atoms, merge.merge_exceptions(base.exceptions(spark, sf_dir)), summary)


@query(JOINED + """, x AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, field, item FROM exceptions) GROUP BY doc_id)
SELECT j.doc_id, count(*) AS n_atoms, CAST(sum(n_qa) AS BIGINT) AS n_qa, CAST(coalesce(any_value(x.n), 0) AS BIGINT) AS n_exceptions, string_agg(chunk_id, ',' ORDER BY chunk_no) AS ids FROM joined AS j LEFT JOIN x USING (doc_id) GROUP BY j.doc_id""")
def nested_documents(spark, sf_dir):
    sizes = [F.coalesce(F.size(f"exception_list.{f}"), F.lit(0)) for f in merge.FIELDS]
    pairs = F.aggregate(F.transform("knowledge_atoms", lambda a: F.coalesce(F.size(a["qa_pairs"]), F.lit(0))), F.lit(0), lambda s, n: s + n)
    return _documents(spark, sf_dir).select(
        "doc_id", F.size("knowledge_atoms").cast("long").alias("n_atoms"), pairs.cast("long").alias("n_qa"), sum(sizes[1:], sizes[0]).cast("long").alias("n_exceptions"), F.array_join("knowledge_atoms.chunk_id", ",").alias("ids")
    )


@query(BASE + " SELECT doc_id, count(*) AS scored, count(*) FILTER (confidence_score < 80) AS low_confidence_count, CAST(round_even(CAST(sum(confidence_score) AS DECIMAL(18, 6)) / count(*), 1) AS DOUBLE) AS avg_confidence FROM qa GROUP BY doc_id")
def confidence_metrics(spark, sf_dir):
    return validate.confidence_metrics(base.qa(spark, sf_dir))


@query(BASE + " SELECT doc_id, count(*) AS exception_count, true AS needs_review FROM exceptions GROUP BY doc_id")
def exception_metrics(spark, sf_dir):
    return validate.exception_metrics(base.exceptions(spark, sf_dir))


@query(BASE + ", y AS (SELECT DISTINCT doc_id, chunk_id FROM qa WHERE trim(answer) <> '') SELECT l.doc_id, count(*) AS atoms, count(y.doc_id) AS answered, CAST(round_even(CAST(count(y.doc_id) AS DECIMAL(18, 6)) / count(*), 2) AS DOUBLE) AS coverage_rate FROM lines AS l LEFT JOIN y USING (doc_id, chunk_id) GROUP BY l.doc_id")
def coverage(spark, sf_dir):
    return validate.coverage(base.lines(spark, sf_dir), base.qa(spark, sf_dir))


@query(BASE + """, c AS (SELECT doc_id, count(*) AS scored, count(*) FILTER (confidence_score < 80) AS low FROM qa GROUP BY doc_id)
SELECT doc_id, 'low_confidence_count' AS field, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) END AS old, CAST(low AS DOUBLE) AS new FROM c WHERE doc_id % 3 = 0 OR low <> 1""")
def fixed_metrics(spark, sf_dir):
    c = validate.confidence_metrics(base.qa(spark, sf_dir))
    stored = c.select("doc_id", F.when(F.col("doc_id") % 3 != 0, 1.0).alias("low_confidence_count"))
    return validate.fix_metrics(stored, c, ("low_confidence_count",))


@query(BASE + """ SELECT doc_id, chunk_id || ' 第' || qa_no || '条QA' AS location, CASE WHEN confidence_score < 80 THEN 'unmarked low score' ELSE 'marked high score' END AS issue FROM qa WHERE (confidence_score < 80) = (remark = '')""")
def score_marks(spark, sf_dir):
    return validate.score_marks(base.qa(spark, sf_dir))


@query(BASE + " SELECT doc_id, chunk_id AS location, CASE WHEN remark = '' THEN 'unmarked size' ELSE 'marked size' END AS issue FROM lines WHERE (length(content) BETWEEN 300 AND 800) = (remark <> '')")
def length_marks(spark, sf_dir):
    return validate.length_marks(base.lines(spark, sf_dir))


@query(BASE + " SELECT doc_id, chunk_id FROM lines WHERE NOT length(content) BETWEEN 300 AND 800 AND chunk_no % 2 = 0")
def unregistered_lengths(spark, sf_dir):
    return validate.unregistered_lengths(base.lines(spark, sf_dir), base.exceptions(spark, sf_dir))


@query(BASE + " SELECT doc_id, chunk_id, qa_no, CAST(length(trim(answer)) AS INT) AS n_chars FROM qa WHERE length(trim(answer)) BETWEEN 1 AND 299")
def short_answers(spark, sf_dir):
    return validate.short_answers(base.qa(spark, sf_dir), 300)


@query(BASE + " SELECT doc_id, qa_no, confidence_score < 80 AND remark = '' AS fixed, CASE WHEN confidence_score < 80 AND remark = '' THEN '【低置信-人工复核】' ELSE remark END AS remark FROM qa")
def repaired_marks(spark, sf_dir):
    return validate.repair_marks(base.qa(spark, sf_dir)).select("doc_id", "qa_no", "fixed", "remark")


@query(BASE + """, c AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY doc_id), p AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM qa GROUP BY doc_id),
d AS (SELECT doc_id, CAST(ceil(n_chars / 80) AS BIGINT) AS chunks, CAST(length(source) AS BIGINT) AS pairs, coalesce(c.n, 0) AS has_chunks, coalesce(p.n, 0) AS has_pairs FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT doc_id, 'total_chunks' AS field, chunks AS declared, has_chunks AS actual FROM d WHERE chunks IS DISTINCT FROM has_chunks
UNION ALL SELECT doc_id, 'total_qa_pairs', pairs, has_pairs FROM d WHERE pairs IS DISTINCT FROM has_pairs""")
def checked_totals(spark, sf_dir):
    """Declared are a chunk for each 80 characters and as many pairs as the source has letters."""
    info = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") / 80).alias("total_chunks"), F.length("source").alias("total_qa_pairs"))
    return validate.check_totals(info, base.lines(spark, sf_dir), base.qa(spark, sf_dir))


def _raw(spark, sf_dir):
    """The assembled documents as JSON records. What a document does not have is absent from its record: the exception lists of
    one without entries, the averages of one without pairs."""
    q = validate.confidence_metrics(base.qa(spark, sf_dir)).select("doc_id", "avg_confidence", "low_confidence_count")
    x = validate.exception_metrics(base.exceptions(spark, sf_dir))
    summary = q.join(x, "doc_id", "full").select("doc_id", F.struct("avg_confidence", "low_confidence_count", "exception_count", "needs_review").alias("_s"))
    docs = _documents(spark, sf_dir).join(summary, "doc_id", "left")
    info = F.struct("source", "doc_type", "total_chunks", "total_qa_pairs", "processing_date")
    return docs.select("doc_id", F.to_json(F.struct(info.alias("document_info"), "knowledge_atoms", "exception_list", F.col("_s").alias("quality_summary"))).alias("raw"))


# What the records lack, with how often the pairs and chunks of each have which fault.
RECORDS = BASE + """, seen AS (SELECT q.* FROM qa AS q SEMI JOIN lines AS l ON l.doc_id = q.doc_id AND l.chunk_id = q.chunk_id),
lists AS (SELECT doc_id, count(DISTINCT item) AS n, count(*) AS rows FROM exceptions GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(round_even(CAST(sum(confidence_score) AS DECIMAL(18, 6)) / count(*), 1) AS DOUBLE) AS avg, count(*) FILTER (confidence_score < 80) AS low FROM qa GROUP BY doc_id),
pairs AS (
  SELECT doc_id, count(*) AS n, CAST(round_even(CAST(sum(confidence_score) AS DECIMAL(18, 6)) / count(*), 1) AS DOUBLE) AS avg, count(*) FILTER (confidence_score < 80) AS low,
         count(*) FILTER (confidence_score > 100) AS over, count(*) FILTER (confidence_score < 80 AND remark = '') AS fixed, count(*) FILTER ((confidence_score < 80) = (remark = '')) AS marks,
         count(*) FILTER (length(trim(answer)) BETWEEN 1 AND 19) AS short, count(DISTINCT chunk_id) AS covered, max(question || answer) FILTER (regexp_matches(question || answer, '[“”‘’]')) AS curly,
         sum(CASE WHEN contains(answer, '【敏感数据】') THEN 0 ELSE CAST(regexp_matches(answer, '密码[：:]\\s*\\S+') AS INT) + CAST(regexp_matches(answer, '密钥[：:]\\s*\\S+') AS INT) + CAST(regexp_matches(answer, '[Kk]ey[：:]\\s*\\S+') AS INT)
           + CAST(regexp_matches(answer, '[Tt]oken[：:]\\s*\\S+') AS INT) + CAST(regexp_matches(answer, 'salt[：:]\\s*\\S+') AS INT) END) AS open
  FROM seen GROUP BY doc_id),
chunks AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER ((length(content) BETWEEN 300 AND 800) = (remark <> '')) AS marks, count(*) FILTER (NOT length(content) BETWEEN 300 AND 800 AND chunk_no % 2 = 0) AS unlisted,
         max(content) FILTER (regexp_matches(content, '[“”‘’]')) AS curly FROM lines GROUP BY doc_id),
r AS (SELECT d.doc_id, l.n IS NULL AS no_lists, s.avg IS NULL AS no_scores, coalesce(l.n, 0) AS listed, l.rows, coalesce(p.n, 0) AS pairs, coalesce(p.over, 0) AS over, coalesce(p.avg, 0.0) AS avg, s.avg AS old_avg, coalesce(p.low, 0) AS low, s.low AS old_low,
  coalesce(p.fixed, 0) AS fixed, coalesce(p.marks, 0) + coalesce(p.short, 0) + coalesce(p.open, 0) + c.marks + c.unlisted AS issues, CAST(round_even(CAST(coalesce(p.covered, 0) AS DECIMAL(18, 6)) / c.n, 2) AS DOUBLE) AS coverage,
  CASE WHEN c.curly IS NULL AND p.curly IS NULL THEN 0 ELSE 1 END AS warnings
  FROM documents AS d JOIN chunks AS c USING (doc_id) LEFT JOIN lists AS l USING (doc_id) LEFT JOIN scored AS s USING (doc_id) LEFT JOIN pairs AS p USING (doc_id))"""


@query(RECORDS + """, e AS (
SELECT doc_id, 'missing: exception_list' AS error FROM r WHERE no_lists UNION ALL SELECT doc_id, 'missing: quality_summary' FROM r WHERE no_lists AND no_scores
UNION ALL SELECT doc_id, 'quality_summary missing: ' || k FROM r, (VALUES ('avg_confidence'), ('low_confidence_count')) AS v(k) WHERE no_scores
UNION ALL SELECT doc_id, 'quality_summary missing: ' || k FROM r, (VALUES ('exception_count'), ('needs_review')) AS v(k) WHERE no_lists
UNION ALL SELECT doc_id, f || ': no list' FROM r, (VALUES ('content_conflicts'), ('missing_info'), ('vague_items'), ('expired_items'), ('chunk_anomalies'), ('truncated_items'), ('sensitive_items'), ('low_confidence_qa'), ('terminology_pending')) AS v(f) WHERE no_lists)
SELECT * FROM e""")
def format_errors(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    atoms = validate.check_atoms(raw).select("doc_id", F.concat_ws(" ", F.col("atom").cast("string"), "error").alias("error"))
    return validate.check_document(raw).unionByName(atoms).unionByName(validate.check_lists(raw, merge.FIELDS))


@query(BASE + " SELECT doc_id, chunk_id, qa_no, 'score out of range' AS error FROM qa WHERE confidence_score > 100")
def score_errors(spark, sf_dir):
    return validate.check_qa(base.qa(spark, sf_dir))


@query(RECORDS + """ SELECT doc_id, CAST(CASE WHEN no_lists THEN 1 + 9 + 2 ELSE 0 END + CASE WHEN no_scores THEN 2 ELSE 0 END + CASE WHEN no_lists AND no_scores THEN 1 ELSE 0 END + over AS INT) AS n_errors,
CASE WHEN no_lists THEN '缺少顶层字段: exception_list' WHEN no_scores AND over = 0 THEN 'quality_summary缺少字段: avg_confidence' WHEN over > 0 THEN '知识原子' END AS first_error, warnings AS n_warnings, avg AS avg_confidence, coverage AS coverage_rate,
concat_ws(',', CASE WHEN avg IS DISTINCT FROM old_avg THEN 'avg_confidence' END, CASE WHEN low IS DISTINCT FROM old_low THEN 'low_confidence_count' END, CASE WHEN listed IS DISTINCT FROM rows THEN 'exception_count' END, 'coverage_rate', CASE WHEN no_lists THEN 'needs_review' END) AS fixes,
CAST(issues AS INT) AS n_issues, CAST(fixed AS INT) AS n_fixed, CASE WHEN no_lists THEN '✅ 本次处理全部通过，无需人工复核，直接交付JSON文件。' ELSE '共处理出 ' || (SELECT n FROM chunks AS c WHERE c.doc_id = r.doc_id) || ' 个知识片段、' || pairs || ' 条问答，其中 ' || listed || ' 项需要你关注' END AS head,
NOT no_lists AND NOT no_scores AND over = 0 AND issues = fixed AS passed FROM r""")
def validated_records(spark, sf_dir):
    """Format, numbers, consistency, repairs and review of every record in one pass."""
    first = F.get("errors", 0)
    return records.validate_all(_raw(spark, sf_dir)).select(
        "doc_id", F.size("errors").alias("n_errors"), F.when(F.startswith(first, F.lit("知识原子")), "知识原子").otherwise(first).alias("first_error"), F.size("warnings").alias("n_warnings"),
        F.col("numbers.avg_confidence").alias("avg_confidence"), F.col("numbers.coverage_rate").alias("coverage_rate"), F.array_join("fixes.field", ",").alias("fixes"), F.size("issues").alias("n_issues"),
        F.size("fixed").alias("n_fixed"), F.split("summary", "\n")[0].alias("head"), "passed",
    )


@query(BASE + """, t AS (SELECT doc_id, chunk_id, CASE WHEN doc_type = 'en' THEN title ELSE substr(content, 1, 12) END AS title, substr(content, 1, 24) AS summary FROM lines)
SELECT doc_id, chunk_id, 'bare title' AS warning FROM t WHERE title <> '' AND NOT regexp_matches(title, '^【.+】') UNION ALL SELECT doc_id, chunk_id, 'long summary' FROM t WHERE length(summary) > 20""")
def atom_warnings(spark, sf_dir):
    content = F.col("content")
    atoms = base.lines(spark, sf_dir).withColumns({"title": F.when(F.col("doc_type") == "en", F.col("title")).otherwise(F.substring(content, 1, 12)), "summary": F.substring(content, 1, 24)})
    return validate.warn_atoms(atoms)


@query(BASE + """, t AS (SELECT doc_id, chunk_id, qa_no, answer || CASE WHEN confidence_score < 60 THEN '，建议您再试' WHEN confidence_score < 80 THEN '，文档未说明，可以尝试' WHEN confidence_score < 90 THEN '，可以尝试并可以联系' ELSE '' END AS answer FROM qa)
SELECT doc_id, chunk_id, qa_no, p AS phrase FROM t, (VALUES ('建议联系'), ('建议您'), ('可以尝试'), ('可以联系')) AS v(p) WHERE contains(answer, p) AND NOT contains(answer, '文档未说明')""")
def advice_warnings(spark, sf_dir):
    score = F.col("confidence_score")
    said = F.when(score < 60, "，建议您再试").when(score < 80, "，文档未说明，可以尝试").when(score < 90, "，可以尝试并可以联系").otherwise("")
    return validate.warn_advice(base.qa(spark, sf_dir).withColumn("answer", F.concat("answer", said)))


@query("SELECT doc_id, 'curly quotes' AS warning FROM documents WHERE regexp_matches(CASE lang WHEN 'fr' THEN replace(text, '''', '’') WHEN 'de' THEN replace(text, ',', '“') ELSE text END, '[“”‘’]')")
def quote_warnings(spark, sf_dir):
    raw = F.when(F.col("lang") == "fr", F.replace("text", F.lit("'"), F.lit("’"))).when(F.col("lang") == "de", F.replace("text", F.lit(","), F.lit("“"))).otherwise(F.col("text"))
    return validate.warn_quotes(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")))


@query(BASE + " SELECT doc_id, chunk_id FROM lines WHERE regexp_matches(content, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}') OR len(list_filter(regexp_extract_all(content, '[0-9]+'), lambda x: length(x) BETWEEN 16 AND 19)) > 0")
def unregistered_sensitive(spark, sf_dir):
    """Chunks with masked values that no entry names."""
    atoms = sensitive.flag(base.lines(spark, sf_dir), "content").withColumn("content", F.col("flagged"))
    return validate.unregistered_sensitive(atoms, base.exceptions(spark, sf_dir))


@query(BASE + """, t AS (SELECT *, answer || CASE WHEN confidence_score < 60 THEN ' token: ' || doc_id || ' 密码：x' WHEN confidence_score < 70 THEN ' 【敏感数据】 Key: y' ELSE '' END AS a FROM qa)
SELECT doc_id, chunk_id, qa_no, issue FROM t, (VALUES ('密码[：:]\\s*\\S+', '密码值未脱敏'), ('密钥[：:]\\s*\\S+', '密钥值未脱敏'), ('[Kk]ey[：:]\\s*\\S+', 'Key值未脱敏'), ('[Tt]oken[：:]\\s*\\S+', 'Token值未脱敏'), ('salt[：:]\\s*\\S+', 'Salt值未脱敏')) AS v(p, issue)
WHERE NOT contains(a, '【敏感数据】') AND regexp_matches(a, p)""")
def unmasked_answers(spark, sf_dir):
    score = F.col("confidence_score")
    said = F.when(score < 60, F.concat(F.lit(" token: "), F.col("doc_id").cast("string"), F.lit(" 密码：x"))).when(score < 70, " 【敏感数据】 Key: y").otherwise("")
    return validate.unmasked_answers(base.qa(spark, sf_dir).withColumn("answer", F.concat("answer", said)))


@query(JOINED + " SELECT j.doc_id, count(*) AS n_atoms, CAST(sum(n_qa) AS BIGINT) AS n_qa, md5(string_agg(l.content, chr(10) ORDER BY j.chunk_no)) AS content_md5 FROM joined AS j JOIN lines AS l ON l.doc_id = j.doc_id AND l.chunk_no = j.chunk_no GROUP BY j.doc_id")
def export_json(spark, sf_dir):
    """Records as JSON, read again."""
    atoms = F.from_json(F.get_json_object("value", "$.knowledge_atoms"), "array<struct<content:string,qa_pairs:array<string>>>")
    out = export.to_json_docs(_documents(spark, sf_dir)).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), atoms.alias("a"))
    pairs = F.aggregate("a", F.lit(0).cast("long"), lambda n, x: n + F.size(x["qa_pairs"]))
    return out.select("doc_id", F.size("a").cast("long").alias("n_atoms"), pairs.alias("n_qa"), F.md5(F.array_join("a.content", "\n")).alias("content_md5"))


@query(RECORDS + """, i AS (SELECT doc_id, count(*) FILTER (confidence_score < 80 AND remark = '') AS f, count(*) FILTER ((confidence_score < 80) = (remark = '')) AS n FROM qa GROUP BY doc_id)
SELECT r.doc_id, NOT no_lists AND NOT no_scores AS valid, coalesce(n - f, 0) AS unfixable, NOT no_lists AND NOT no_scores AND coalesce(n - f, 0) = 0 AS passed FROM r LEFT JOIN i USING (doc_id)""")
def verdicts(spark, sf_dir):
    docs, q = table(spark, sf_dir, "documents"), base.qa(spark, sf_dir)
    verdict = validate.format_verdict(docs, format_errors(spark, sf_dir), validate.warn_quotes(_raw(spark, sf_dir)))
    return validate.final_verdict(verdict, validate.score_marks(q), validate.repair_marks(q).filter("fixed"))


@query(BASE + " SELECT e.doc_id, e.item, q.question FROM exceptions AS e JOIN qa AS q ON q.doc_id = e.doc_id AND e.item LIKE q.chunk_id || '-Q' || q.qa_no || ':%' WHERE field = 'low_confidence_qa'")
def item_questions(spark, sf_dir):
    return review.item_questions(base.exceptions(spark, sf_dir), base.qa(spark, sf_dir))


@query(BASE + " SELECT e.doc_id, e.field, e.item, substr(l.content, 1, 12) AS title FROM exceptions AS e JOIN lines AS l ON l.doc_id = e.doc_id AND e.item LIKE l.chunk_id || ':%' WHERE field = 'chunk_anomalies'")
def item_titles(spark, sf_dir):
    return review.item_titles(base.exceptions(spark, sf_dir), base.lines(spark, sf_dir))


@query(BASE + " SELECT doc_id, field, item, CASE field WHEN 'low_confidence_qa' THEN '低置信 QA' ELSE '拆分异常' END AS label, CASE field WHEN 'low_confidence_qa' THEN 'qa' ELSE 'atoms' END AS tab FROM exceptions")
def worklist(spark, sf_dir):
    return review.worklist(base.exceptions(spark, sf_dir)).select("doc_id", "field", "item", "label", "tab")


@query(BASE + """, seen AS (SELECT q.* FROM qa AS q SEMI JOIN lines AS l ON l.doc_id = q.doc_id AND l.chunk_id = q.chunk_id),
i AS (
  SELECT e.doc_id, 2 AS no, pos, item, coalesce('关于「' || nullif(question, '') || '」，原文信息不够明确', item) AS t
  FROM exceptions AS e LEFT JOIN seen AS q ON q.doc_id = e.doc_id AND e.item LIKE q.chunk_id || '-Q' || q.qa_no || ':%' WHERE field = 'low_confidence_qa'
  UNION ALL
  SELECT e.doc_id, 6, pos, item, coalesce('「' || nullif(substr(l.content, 1, 12), '') || '」这段内容' || regexp_extract(item, '-(内容[0-9]+字)$', 1), regexp_replace(item, '^P1-C[0-9]+: ', ''))
  FROM exceptions AS e LEFT JOIN lines AS l ON l.doc_id = e.doc_id AND e.item LIKE l.chunk_id || ':%' WHERE field = 'chunk_anomalies'
),
b AS (
  SELECT doc_id, no, count(*) AS n, CASE no WHEN 2 THEN '**答案不确定的**（原文信息不够，AI给出的回答可能不准）：' ELSE '**拆分可能不合理的**（知识片段过长或过短）：' END || chr(10) || string_agg('- ' || t, chr(10) ORDER BY pos, item) AS t
  FROM i GROUP BY doc_id, no
),
r AS (SELECT doc_id, sum(n)::BIGINT AS n, string_agg(t, chr(10) || chr(10) ORDER BY no) AS t FROM b GROUP BY doc_id)
SELECT d.doc_id, r.t IS NOT NULL AS needs_review, CASE WHEN r.t IS NULL THEN '✅ 本次处理全部通过，无需人工复核，直接交付JSON文件。' ELSE
  '共处理出 ' || (SELECT count(*) FROM lines AS l WHERE l.doc_id = d.doc_id) || ' 个知识片段、' || (SELECT count(*) FROM seen AS q WHERE q.doc_id = d.doc_id) || ' 条问答，其中 ' || r.n || ' 项需要你关注'
  || chr(10) || chr(10) || '需要关注的内容：' || chr(10) || chr(10) || r.t || chr(10) || chr(10) || '✅ 以上内容确认无误后，我将交付完整的JSON文件；如需修改请直接告诉我。' END AS summary
FROM documents AS d LEFT JOIN r USING (doc_id)""")
def review_lists(spark, sf_dir):
    return review.review_list(table(spark, sf_dir, "documents"), base.exceptions(spark, sf_dir), base.lines(spark, sf_dir), base.qa(spark, sf_dir))


@query(BASE + """, q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY qa_no) AS pos FROM qa), c AS (SELECT doc_id, chunk_id, count(*) AS n, min(pos) AS pos FROM q GROUP BY doc_id, chunk_id),
j AS (SELECT l.doc_id, l.chunk_id, coalesce(n, 0) AS n, pos, max(pos) OVER (PARTITION BY l.doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM lines AS l LEFT JOIN c USING (doc_id, chunk_id))
SELECT doc_id, chunk_id, 'unanswered' AS issue FROM j WHERE n = 0 UNION ALL SELECT doc_id, chunk_id, 'pair count' FROM j WHERE n > 0 AND NOT n BETWEEN 3 AND 5
UNION ALL SELECT doc_id, chunk_id, 'keyword count' FROM j WHERE n > 0 UNION ALL SELECT doc_id, chunk_id, 'order' FROM j WHERE pos < reached""")
def linted_qa(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("qa_no"))
    return review.lint_qa(base.lines(spark, sf_dir), base.qa(spark, sf_dir).withColumns({"keywords": F.array(F.lit("k"), F.lit("w")), "pos": place}))


SEEN = BASE + ", seen AS (SELECT q.* FROM qa AS q SEMI JOIN lines AS l ON l.doc_id = q.doc_id AND l.chunk_id = q.chunk_id)"


@query(SEEN + ' SELECT question AS "问题", answer AS "答案" FROM seen')
def export_coze_qa(spark, sf_dir):
    return export.to_coze_qa(_documents(spark, sf_dir))


@query(BASE + ' SELECT title AS "标题", content AS "正文" FROM lines')
def export_coze_text(spark, sf_dir):
    return export.to_coze_text(_documents(spark, sf_dir))


@query(SEEN + " SELECT question, answer FROM seen")
def export_dify_qa(spark, sf_dir):
    return export.to_dify_qa(_documents(spark, sf_dir))


@query(BASE + " SELECT title AS content, content AS segment FROM lines")
def export_dify_text(spark, sf_dir):
    return export.to_dify_text(_documents(spark, sf_dir))


@query(JOINED + """ SELECT j.doc_type AS doc_type, CAST(n_qa AS INT) AS qa_count, l.title AS name, md5(l.content) AS text_md5 FROM joined AS j JOIN lines AS l USING (doc_id, chunk_no)""")
def export_dify_jsonl(spark, sf_dir):
    lines = export.to_dify_jsonl(_documents(spark, sf_dir))
    get = lambda p: F.get_json_object("value", p)
    return lines.select(get("$.metadata.doc_type").alias("doc_type"), get("$.metadata.qa_count").cast("int").alias("qa_count"), get("$.name").alias("name"), F.md5(get("$.text")).alias("text_md5"))


@query(SEEN + """ SELECT s.chunk_id AS "知识原子ID", l.title AS "标题", question AS "问题", answer AS "答案", CAST(confidence_score AS VARCHAR) AS "置信度(%)",
CASE WHEN t.doc_id IS NULL THEN l.doc_type ELSE 'FAQ' END AS "类型", 'k, w' AS "关键词" FROM seen AS s JOIN lines AS l USING (doc_id, chunk_id) LEFT JOIN labels AS t ON t.doc_id = s.doc_id AND l.chunk_no = 1
UNION ALL SELECT '', '', '', '', '', '', '' FROM (SELECT DISTINCT doc_id FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM seen))""")
def export_summary_csv(spark, sf_dir):
    return export.to_summary_csv(_documents(spark, sf_dir))


@query(JOINED + """, q AS (SELECT doc_id, chunk_id, string_agg('**Q: ' || question || '**' || chr(10) || chr(10) || 'A: ' || answer || chr(10) || '*置信度: ' || confidence_score || '%*' || chr(10), chr(10) ORDER BY qa_no) AS t FROM qa GROUP BY doc_id, chunk_id),
a AS (SELECT j.doc_id, string_agg('## ' || j.chunk_no || '. ' || coalesce(nullif(l.title, ''), j.chunk_id) || chr(10) || chr(10) || '*ID: ' || j.chunk_id || ', 类型: ' || j.doc_type || ', 模块: ' || CASE WHEN no_tags THEN '【人工补全项】' ELSE 'x' END || '*'
  || chr(10) || chr(10) || l.content || chr(10) || chr(10) || coalesce('### QA 对' || chr(10) || chr(10) || q.t || chr(10), '') || CASE WHEN j.remark <> '' THEN '> 备注: ' || j.remark || chr(10) || chr(10) ELSE '' END || '---' || chr(10) || chr(10), '' ORDER BY j.chunk_no) AS t,
  count(*) AS n, sum(n_qa) AS pairs FROM joined AS j JOIN lines AS l ON l.doc_id = j.doc_id AND l.chunk_no = j.chunk_no LEFT JOIN q ON q.doc_id = j.doc_id AND q.chunk_id = j.chunk_id GROUP BY j.doc_id),
e AS (SELECT doc_id, string_agg('- **' || CASE field WHEN 'chunk_anomalies' THEN '拆分异常' ELSE '低置信 QA' END || '**: ' || item, chr(10) ORDER BY field, first) AS t FROM (SELECT doc_id, field, item, min(stage * 100000 + pos) AS first FROM exceptions GROUP BY doc_id, field, item) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(round_even(CAST(sum(confidence_score) AS DECIMAL(18, 6)) / count(*), 1) * 100 AS BIGINT) AS avg FROM qa GROUP BY doc_id)
SELECT d.doc_id, md5('# ' || d.source || chr(10) || chr(10) || '> 文档类型: ' || d.lang || ' | 知识原子: ' || a.n || ' | QA 对: ' || CAST(a.pairs AS BIGINT) || chr(10) || chr(10)
  || '> 覆盖率: 0% | 平均置信度: ' || coalesce(s.avg, 0) || '% | 异常项: 0' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN e.t IS NULL THEN left(a.t, -1) ELSE a.t || '## 异常清单' || chr(10) || chr(10) || e.t || chr(10) END) AS page_md5
FROM documents AS d JOIN a USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN s USING (doc_id)""")
def export_markdown(spark, sf_dir):
    return export.to_markdown(_documents(spark, sf_dir)).select("doc_id", F.md5("value").alias("page_md5"))


@query("SELECT event_id AS task_id, 'doc ' || event_id || '_md.md' AS export_name FROM events")
def export_names(spark, sf_dir):
    return export.export_names(base.tasks(spark, sf_dir), "md").select(F.col("task_id").cast("long").alias("task_id"), "export_name")
