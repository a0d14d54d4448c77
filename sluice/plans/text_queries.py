"""Queries over document text: sensitive values, structure, segments, chunks, exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import extract, sensitive
from sluice.operators import segment, stages
from sluice.plans import base
from sluice.plans.base import LINES, table
from sluice.sources import documents as sources

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_segments(_docs(spark, sf_dir).select("doc_id", "source", "text"), 2000, "\n")


# The lines of a text are packed greedily: the recursion carries the size of the open segment.
PACKED = """
parts AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS k, length(text) AS total FROM documents
), packed AS (
  WITH RECURSIVE r AS (
    SELECT doc_id, k, CAST(length(p) + 2 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seg FROM parts WHERE k = 1
    UNION ALL
    SELECT parts.doc_id, parts.k, CASE WHEN {cut} THEN length(p) + 2 ELSE n + length(p) + 2 END, CASE WHEN {cut} THEN seg + 1 ELSE seg END
    FROM r JOIN parts ON parts.doc_id = r.doc_id AND parts.k = r.k + 1
  ) SELECT * FROM r
), segments AS (
  SELECT doc_id, any_value(source) AS source, seg AS seg_no, string_agg(p, chr(10) ORDER BY k) AS segment
  FROM packed JOIN parts USING (doc_id, k) GROUP BY doc_id, seg
)"""
SEGMENTS = "WITH " + PACKED.replace("{cut}", "(n + length(p) + 2 > 2000 AND total > 2000)")
CHUNKS = "WITH " + PACKED.replace("{cut}", "(n >= 300 OR n + length(p) + 2 > 800)")


@query(SEGMENTS + """, found AS (
  SELECT source, 'email' AS rule, len(regexp_extract_all(segment, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS n FROM segments
  UNION ALL
  SELECT source, 'bank_card', len(list_filter(regexp_extract_all(segment, '[0-9]+'), lambda x: length(x) BETWEEN 16 AND 19)) FROM segments
) SELECT source, rule, CAST(sum(n) AS BIGINT) AS n_hits FROM found GROUP BY source, rule HAVING sum(n) > 0""")
def sensitive_by_source(spark, sf_dir):
    """Flagship: segment all documents, scan every segment for sensitive values, and count hits by source and rule."""
    found = sensitive.exploded(sensitive.detect(_segments(spark, sf_dir), "segment"), "source")
    return found.groupBy("source", F.col("h.rule").alias("rule")).agg(F.count("*").alias("n_hits"))


@query(SEGMENTS + " SELECT doc_id, CAST(seg_no AS INT) AS seg_no, md5(segment) AS segment_md5 FROM segments")
def segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("doc_id", "seg_no", F.md5("segment").alias("segment_md5"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}', '【敏感数据-禁止向量化入库】', 'g'), '(^|[^0-9])[0-9]{16,19}([^0-9]|$)', '\\1【敏感数据-禁止向量化入库】\\2', 'g'), '(^|[^0-9])[0-9]{16,19}([^0-9]|$)', '\\1【敏感数据-禁止向量化入库】\\2', 'g')) AS flagged_md5 FROM documents")
def flagged_documents(spark, sf_dir):
    return sensitive.flag(_docs(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", F.md5("flagged").alias("flagged_md5"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(^|[^0-9])[0-9]{16,19}([^0-9]|$)', '\\1【敏感数据】\\2', 'g'), '(^|[^0-9])[0-9]{16,19}([^0-9]|$)', '\\1【敏感数据】\\2', 'g')) AS masked_md5 FROM documents")
def masked_documents(spark, sf_dir):
    return sensitive.mask(_docs(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", F.md5("masked").alias("masked_md5"))


@query("""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS t, 'email' AS rule FROM documents
UNION ALL SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 16 AND 19)), 'bank_card' FROM documents)
SELECT doc_id, rule, count(*) AS n_hits, string_agg(t, '|' ORDER BY t) AS texts FROM h GROUP BY doc_id, rule""")
def scan_report(spark, sf_dir):
    return sensitive.scan_report(_docs(spark, sf_dir), "doc_id", "text")


# A text for each customer that holds a value of every rule: what stands before the value, the value, its rule.
SECRETS = (
    ("", "'pwd=x' || lpad(k, 6, '0')", "password"), (" 电话", "'13' || lpad(k, 9, '0')", "phone"), ("，证件", "lpad(k, 17, '1') || 'X'", "id_card"),
    ("；", "'API Key: ak_' || lpad(k, 8, '0')", "api_key"), (", ", "'secret_key=sk' || lpad(k, 8, '0')", "secret_key"), (" ", "'ToKeN：tk.' || lpad(k, 8, '0')", "token"),
    (" ", "'salt=s' || lpad(k, 5, '0')", "salt"), (" 卡", "lpad(k, 16, '6')", "bank_card"), (" ip ", "'10.0.1.' || right(k, 2)", "internal_ip"), (" mail ", "'u' || k || '@mail.example'", "email"),
)
CUSTOMERS = "SELECT c_custkey, CAST(c_custkey + 10 AS STRING) AS k FROM customer"


@query(f"SELECT c_custkey, '{','.join(r for _, _, r in SECRETS)}' AS rules, md5('{''.join(b + sensitive.FLAGGED for b, _, _ in SECRETS)} end') AS flagged_md5, CAST("
       + " + ".join(f"length({v})" for _, v, _ in SECRETS) + f" AS BIGINT) AS n_chars, '{sensitive.MASKED}' || ' 电话' AS masked_head FROM ({CUSTOMERS})")
def secrets_of_every_rule(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") + 10).cast("string").alias("k"))
    texts = customers.select("c_custkey", F.expr(" || ".join(f"'{b}' || {v}" for b, v, _ in SECRETS) + " || ' end'").alias("text"))
    both = sensitive.mask(sensitive.flag(texts, "text"), "text")
    size = F.aggregate("hits", F.lit(0), lambda n, h: n + h["end"] - h["start"]).cast("long")
    return both.select("c_custkey", F.array_join("hits.rule", ",").alias("rules"), F.md5("flagged").alias("flagged_md5"), size.alias("n_chars"), F.substring("masked", 1, len(sensitive.MASKED) + 3).alias("masked_head"))


@query(f"WITH {base.QA}" + """ SELECT doc_id, qa_no, md5(regexp_replace(regexp_replace(answer, '(^|[^0-9])[0-9]{16,19}([^0-9]|$)', '\\1【敏感数据】\\2', 'g'), '(^|[^0-9])[0-9]{16,19}([^0-9]|$)', '\\1【敏感数据】\\2', 'g')) AS answer_md5,
len(list_filter(regexp_extract_all(answer, '[0-9]+'), lambda x: length(x) BETWEEN 16 AND 19)) + len(regexp_extract_all(answer, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS n_hits FROM qa""")
def masked_answers(spark, sf_dir):
    return sensitive.mask_answers(base.qa(spark, sf_dir)).select("doc_id", "qa_no", F.md5("answer").alias("answer_md5"), F.size("hits").cast("long").alias("n_hits"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 16 AND 19)) AS INT) AS n_masked, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS INT) AS n_detected FROM documents")
def hits_by_action(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    masked = sensitive.detect(docs, "text", action="mask").select("doc_id", "text", F.size("hits").alias("n_masked"))
    return sensitive.detect(masked, "text", action="detect").select("doc_id", "n_masked", F.size("hits").alias("n_detected"))


@query("SELECT doc_id, CASE WHEN length(source || '-' || lang) <= 8 THEN '****' ELSE substr(source || '-' || lang, 1, 3) || '****' || right(source || '-' || lang, 4) END AS shown FROM documents")
def masked_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sensitive.mask_key(F.concat_ws("-", "source", "lang")).alias("shown"))


@query(CHUNKS + " SELECT doc_id, CAST(seg_no + 1 AS INT) AS chunk_no, format('P1-C{:03d}', seg_no + 1) AS chunk_id, md5(segment) AS content_md5, CASE WHEN NOT length(segment) BETWEEN 300 AND 800 THEN format('P1-C{:03d}', seg_no + 1) || ': 拆分颗粒度异常-内容' || length(segment) || '字' END AS granularity FROM segments")
def chunks(spark, sf_dir):
    out = segment.flag_granularity(segment.chunk(_docs(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", "chunk_no", "chunk_id", F.md5("content").alias("content_md5"), "granularity")


# Every third line of a document, from the first, is made a heading, every ninth one of the first level.
MARKED = """
src AS (SELECT doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS p FROM documents WHERE regexp_matches(text, '[^\\n]')),
lined AS (SELECT *, CASE WHEN k % 3 = 1 THEN CASE WHEN k % 9 = 1 THEN 1 ELSE 2 END ELSE 0 END AS level, CASE WHEN k % 3 = 1 THEN CASE WHEN k % 9 = 1 THEN '# h' ELSE '## h' END || k || chr(10) || p ELSE p END AS unit FROM src)"""


@query("WITH " + MARKED + """, packed AS (WITH RECURSIVE r AS (
  SELECT doc_id, k, CAST(length(unit) + 1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seg, level AS topic, level AS depth FROM lined WHERE k = 1
  UNION ALL SELECT doc_id, k, CASE WHEN cut THEN size ELSE n + size END, CASE WHEN cut THEN seg + 1 ELSE seg END, CASE WHEN cut THEN depth ELSE topic END, depth FROM (
    SELECT l.doc_id, l.k, n, seg, topic, length(unit) + 1 AS size, CASE WHEN level > 0 THEN level ELSE depth END AS depth, n >= 300 OR n + length(unit) + 1 > 800 OR (level > 0 AND level < topic) AS cut
    FROM r JOIN lined AS l ON l.doc_id = r.doc_id AND l.k = r.k + 1)
) SELECT * FROM r),
pieces AS (SELECT doc_id, seg, any_value(source) AS source, min(k) AS k, string_agg(unit, chr(10) ORDER BY k) AS content FROM packed JOIN lined USING (doc_id, k) GROUP BY doc_id, seg)
SELECT doc_id, CAST(seg + 1 AS INT) AS chunk_no, format('P1-C{:03d}', seg + 1) AS chunk_id, md5(content) AS content_md5, CAST(length(content) AS INT) AS n_chars,
'【' || CASE WHEN (k - 1) // 3 * 3 % 9 = 0 THEN source ELSE 'h' || ((k - 1) // 9 * 9 + 1) END || '】- h' || ((k - 1) // 3 * 3 + 1) AS title FROM pieces""")
def structured_chunks(spark, sf_dir):
    """The structural chunker over documents as Markdown."""
    lines = F.split("text", "\n")
    mark = lambda x, i: F.when(i % 3 == 0, F.concat(F.when(i % 9 == 0, "# h").otherwise("## h"), (i + 1).cast("string"), F.lit("\n"), x)).otherwise(x)
    docs = _docs(spark, sf_dir).select("doc_id", "source", F.array_join(F.transform(lines, mark), "\n").alias("marked"), "text").filter(F.col("text").rlike(r"[^\n]"))
    out = segment.chunk_sections(docs.drop("text"), sep="\n", col="marked")
    return out.select("doc_id", "chunk_no", "chunk_id", F.md5("content").alias("content_md5"), F.length("content").alias("n_chars"), "title")


@query("WITH " + base.QA + """, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY qa_no) AS r, string_split('问：' || question, chr(10))[1] AS head FROM qa)
SELECT doc_id, CAST(r AS INT) AS chunk_no, md5(rtrim('问：' || question || chr(10) || '答：' || answer, chr(10))) AS content_md5, '【list】- ' || trim(head, ' *') AS title FROM n""")
def question_chunks(spark, sf_dir):
    """The pairs of every conversation as a question list, and each pair a chunk of it again."""
    pair = F.concat(F.lit("问："), "question", F.lit("\n答："), "answer")
    lists = base.qa(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("qa_no", pair.alias("p")))).getField("p"), "\n\n").alias("text"))
    out = segment.chunk_sections(lists.select("doc_id", "text", F.lit("list").alias("source"), F.lit("FAQ").alias("doc_type")), doc_type="doc_type")
    return out.select("doc_id", "chunk_no", F.md5("content").alias("content_md5"), "title")


@query(SEGMENTS + " SELECT doc_id, md5(string_agg(trim(segment, ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(10) ORDER BY seg_no)) AS text_md5 FROM segments WHERE trim(segment, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY doc_id")
def merged_segments(spark, sf_dir):
    return segment.merge_cleaned(_segments(spark, sf_dir).withColumnRenamed("segment", "cleaned_text")).select("doc_id", F.md5("text").alias("text_md5"))


@query("WITH " + LINES + """, t AS (SELECT doc_id, chunk_no, CASE WHEN length(content) < 200 THEN 'FAQ' WHEN length(content) < 600 THEN '技术运维' ELSE '制度合规' END AS y FROM lines),
c AS (SELECT doc_id, y, count(*) AS n, min(chunk_no) AS f FROM t GROUP BY doc_id, y)
SELECT doc_id, y AS doc_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def majority_types(spark, sf_dir):
    n = F.length("content")
    kind = F.when(n < 200, "FAQ").when(n < 600, "技术运维").otherwise("制度合规")
    return segment.majority_doc_type(base.lines(spark, sf_dir).select("doc_id", F.col("chunk_no").alias("seg_no"), kind.alias("doc_type")))


@query("WITH " + LINES + """, i AS (SELECT doc_id, chunk_no, k, 'n' || (length(content) % 4 + k) AS x FROM lines, (VALUES (0), (1)) AS v(k)), f AS (SELECT doc_id, x, min(chunk_no * 2 + k) AS a FROM i GROUP BY doc_id, x)
SELECT doc_id, string_agg(x, ',' ORDER BY a) AS items FROM f GROUP BY doc_id""")
def merged_items(spark, sf_dir):
    n = F.length("content") % 4
    items = F.array(*[F.concat(F.lit("n"), (n + k).cast("string")) for k in (0, 1)])
    return segment.merge_items(base.lines(spark, sf_dir).select("doc_id", F.col("chunk_no").alias("seg_no"), items.alias("items"))).select("doc_id", F.array_join("items", ",").alias("items"))


@query("WITH " + LINES + """ SELECT doc_id, chunk_id, format('P2-C{:03d}', row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no % 3, chunk_no)) AS new_chunk_id,
CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no % 3, chunk_no) - 1) / 4) AS INT) AS batch_no FROM lines""")
def renumbered_chunks(spark, sf_dir):
    parts = base.lines(spark, sf_dir).select("doc_id", (F.col("chunk_no") % 3).alias("seg_no"), F.col("chunk_no").alias("chunk_pos"), "chunk_id")
    return segment.batch_chunks(segment.renumber_chunks(parts, "P2")).select("doc_id", "chunk_id", "new_chunk_id", "batch_no")


@query("WITH " + LINES + """, n AS (SELECT doc_id, chunk_no % 3 AS s, chunk_no, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no % 3, chunk_no) AS r FROM lines)
SELECT a.doc_id, a.s AS seg_no, format('P1-C{:03d}', a.r) || ' repeats P1-C999' AS item FROM n AS a""")
def remapped_exceptions(spark, sf_dir):
    parts = base.lines(spark, sf_dir).select("doc_id", (F.col("chunk_no") % 3).alias("seg_no"), F.col("chunk_no").alias("chunk_pos"), "chunk_id")
    entries = parts.select("doc_id", "seg_no", F.concat("chunk_id", F.lit(" repeats P1-C999")).alias("item"))
    return segment.remap_exceptions(entries, segment.renumber_chunks(parts)).select("doc_id", "seg_no", "item")


@query("WITH " + LINES + " SELECT doc_id, string_agg('n' || length(content), ',' ORDER BY chunk_no DESC) AS items FROM lines GROUP BY doc_id")
def concatenated_batches(spark, sf_dir):
    parts = base.lines(spark, sf_dir).select("doc_id", (-F.col("chunk_no")).alias("batch_no"), F.array(F.concat(F.lit("n"), F.length("content").cast("string"))).alias("items"))
    return segment.concat_batches(parts).select("doc_id", F.array_join("items", ",").alias("items"))


@query("WITH " + LINES + " SELECT doc_id, chunk_id, md5(title || content) AS body_md5, 'P1' AS prefix FROM lines")
def handed_over(spark, sf_dir):
    return segment.handover(base.lines(spark, sf_dir)).select("doc_id", "chunk_id", F.md5(F.concat("title", "content")).alias("body_md5"), "prefix")


def _markdown(spark, sf_dir):
    """A Markdown page per part: headings, a pipe and an HTML table, formulas and page marks."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    text = F.concat(
        F.lit("# "), F.col("p_name"), F.lit("\n<!-- page 1 -->\n## Size\n| a | b |\n| --- | --- |\n| 1 | "), key.cast("string"), F.lit(" |\nend\n$$x^"), (key % 7).cast("string"),
        F.lit("$$ and $y$\n<!-- page 2 -->\n<table><tr><td>"), key.cast("string"), F.lit("</td></tr>\n</table>\n#no heading\n<!-- page "), (key % 3 + 1).cast("string"), F.lit(" -->"),
    )
    return p.select(key.alias("doc_id"), text.alias("markdown"))


MARKDOWN = "m AS (SELECT p_partkey AS doc_id, p_name, p_partkey % 7 AS e, p_partkey % 3 + 1 AS g FROM part)"


@query("WITH " + MARKDOWN + """ SELECT doc_id, 2 AS n_headings, '1 ' || p_name || ' 0;2 Size 2' AS headings, '3-5' AS pipe_tables, '9-10' AS html_tables, 'x^' || e || '@7;y@7' AS formulas,
CASE WHEN g = 3 THEN 3 ELSE 2 END AS pages, 4 AS separators FROM m""")
def structure(spark, sf_dir):
    df = _markdown(spark, sf_dir)
    for step in (extract.headings, extract.pipe_tables, extract.html_tables, extract.formulas, extract.page_count):
        df = step(df)
    df = extract.page_count(df.withColumnRenamed("page_count", "pages"), mode="separators")
    join = lambda c, f, sep=";": F.array_join(F.transform(c, f), sep)
    return df.select(
        "doc_id", F.size("headings").alias("n_headings"), join("headings", lambda h: F.concat_ws(" ", h["level"].cast("string"), h["text"], h["line"].cast("string"))).alias("headings"),
        join("pipe_tables", lambda t: F.concat_ws("-", t["start"].cast("string"), t["end"].cast("string"))).alias("pipe_tables"), join("html_tables", lambda t: F.concat_ws("-", t["start"].cast("string"), t["end"].cast("string"))).alias("html_tables"),
        join("formulas", lambda x: F.concat_ws("@", x["latex"], x["line"].cast("string"))).alias("formulas"), "pages", F.col("page_count").alias("separators"),
    )


@query("SELECT doc_id, CAST(length(text) AS INT) AS char_count, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS is_empty FROM documents")
def profiles(spark, sf_dir):
    return extract.profile(_docs(spark, sf_dir), "text").select("doc_id", "char_count", "is_empty")


@query("WITH " + LINES + " SELECT doc_id, md5(string_agg('<!-- page ' || chunk_no || ' -->' || chr(10) || content, chr(10) || chr(10) ORDER BY chunk_no)) AS markdown_md5 FROM lines WHERE trim(content) <> '' GROUP BY doc_id")
def assembled_pages(spark, sf_dir):
    pages = base.lines(spark, sf_dir).select("doc_id", F.col("chunk_no").alias("page_no"), F.col("content").alias("text"))
    return sources.assemble_pages(pages).select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query("WITH " + LINES + " SELECT doc_id, md5(string_agg(CASE chunk_no % 3 WHEN 0 THEN '## ' || trim(content) WHEN 1 THEN '# ' || trim(content) ELSE trim(content) END, chr(10) || chr(10) ORDER BY chunk_no)) AS markdown_md5 FROM lines WHERE trim(content) <> '' GROUP BY doc_id")
def assembled_paragraphs(spark, sf_dir):
    style = F.when(F.col("chunk_no") % 3 == 0, "Heading 2").when(F.col("chunk_no") % 3 == 1, "heading x").otherwise("Normal")
    rows = base.lines(spark, sf_dir).select("doc_id", F.col("chunk_no").alias("pos"), style.alias("style"), F.col("content").alias("text"))
    return sources.assemble_paragraphs(rows).select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query("""SELECT n_regionkey AS doc_id, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || '\\|x |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def pipe_tables(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    head = n.select(F.col("n_regionkey").alias("doc_id"), F.lit(-1).alias("row_no"), F.posexplode(F.array(F.lit("key"), F.lit("name"))).alias("col_no", "text")).distinct()
    body = n.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").cast("int").alias("row_no"), F.posexplode(F.array(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit("|x ")))).alias("col_no", "text"))
    return sources.cells_to_markdown(head.unionByName(body))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' END AS file_type FROM documents")
def file_types(spark, sf_dir):
    ext = F.when(F.col("doc_id") % 4 == 0, "Md").when(F.col("doc_id") % 4 == 1, "PDF").when(F.col("doc_id") % 4 == 2, "doc").otherwise("pptx")
    return sources.file_type(_docs(spark, sf_dir).select("doc_id", F.concat(F.lit("/in/x."), ext).alias("path"))).select("doc_id", "file_type")


@query("SELECT doc_id, CASE WHEN a >= greatest(b, c, d, e) THEN '制度合规' WHEN b >= greatest(c, d, e) THEN 'FAQ' WHEN c >= greatest(d, e) THEN '产品活动' WHEN d >= e THEN '技术运维' ELSE '教学知识' END AS doc_type FROM (SELECT doc_id, "
       + ", ".join(f"len(regexp_extract_all(lower(text), '{'|'.join(w)}')) AS {n}" for n, w in zip("abcde", stages.FAMILIES.values(), strict=True)) + " FROM documents)")
def document_types(spark, sf_dir):
    return stages.classify(_docs(spark, sf_dir)).select("doc_id", "doc_type")


# The distance is one of bytes, of which a letter has four at most; then one place where the words' letters part is looked for.
@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\p{L}{8,}')) AS w FROM documents),
p AS (SELECT a.doc_id, a.w AS a, b.w AS b FROM w AS a JOIN w AS b ON a.doc_id = b.doc_id AND a.w < b.w AND abs(length(a.w) - length(b.w)) <= 1 AND levenshtein(a.w, b.w) <= 4)
SELECT doc_id, a || ' / ' || b AS item FROM p WHERE len(list_filter(range(0, length(a) + 1), lambda i: a[:i] = b[:i]
  AND (a[i + 2:] = b[i + 2:] OR a[i + 1:] = b[i + 2:] OR a[i + 2:] = b[i + 1:]))) > 0""")
def terminology_pairs(spark, sf_dir):
    return stages.term_pairs(_docs(spark, sf_dir), "doc_id", "text")


def _tags(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumn("d", F.col("doc_id") % 28 + 1)
    date = F.format_string("2024-01-%02d", F.col("d"))
    return lab.select(
        "doc_id", F.lit("P1-C001").alias("chunk_id"), F.when(F.col("quality") == 1, "FAQ").otherwise("制度合规").alias("doc_type"), F.when(F.col("toxic") == 1, "未知").otherwise("all").alias("target_audience"),
        F.lit(" ").alias("business_module"), F.lit("note").alias("knowledge_type"), F.concat(F.lit("2023-01-01~"), date).alias("version_timeliness"), F.concat(F.lit("a summary of a good many characters "), F.col("d").cast("string")).alias("summary"),
    )


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN '【人工补全项】' ELSE 'all' END AS target_audience, '【人工补全项】' AS business_module, CASE WHEN quality = 1 THEN 'FAQ' ELSE 'note' END AS knowledge_type,
'a summary of a good ' AS summary, doc_id % 28 + 1 < 15 AS expired, CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS n_missing FROM labels""")
def tags(spark, sf_dir):
    clean = stages.expire(stages.normalise_tags(_tags(spark, sf_dir)), "2024-01-15")
    missing = stages.missing_tags(clean).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_missing"))
    return clean.join(missing, "doc_id", "left").select("doc_id", "target_audience", "business_module", "knowledge_type", "summary", "expired", "n_missing")


@query("SELECT doc_id, 1 AS stage, md5('# ' || source || chr(10) || text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Errors: a; b' || chr(10) || 'Previous: {}' ELSE '' END) AS user_md5 FROM documents")
def model_requests(spark, sf_dir):
    units = _docs(spark, sf_dir).select("doc_id", F.lit(0).alias("unit"), F.lit(None).cast("string").alias("title"), "source", "text")
    failures = units.filter("doc_id % 5 = 0").select("doc_id", "unit", F.array(F.lit("a"), F.lit("b")).alias("errors"), F.lit("{}").alias("previous"))
    return stages.requests(units, 1, failures).select("doc_id", "stage", F.md5("user").alias("user_md5"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INT) END AS k, event_id % 4 <> 3 AS ok, event_id % 4 <> 3 AND CAST(json_extract(props, '$.k') AS INT) < 50 AS accepted FROM events""")
def model_responses(spark, sf_dir):
    k = F.col("event_id") % 4
    content = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 3, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    parsed = stages.parse_responses(table(spark, sf_dir, "events").select("event_id", content.alias("content")), "k int")
    good, bad = stages.gate(parsed, {"k: must be under 50": F.col("parsed.k") < 50})
    columns = ("event_id", F.col("parsed.k").alias("k"), "ok")
    return good.select(*columns, F.lit(True).alias("accepted")).unionByName(bad.select(*columns, F.lit(False).alias("accepted")))


UNKNOWN_TYPE = "Input should be " + ", ".join(f"''{n}''" for n in list(stages.FAMILIES)[:-1]) + f" or ''{list(stages.FAMILIES)[-1]}''"
SCORE = "chunks.0.qa_pairs.0.confidence_score: Input should be"


@query(f"""WITH d AS (SELECT *, lang = 'en' AS typed, length(text) AS n FROM documents), e AS (
SELECT doc_id, 1 AS stage, concat_ws('; ', CASE WHEN trim(text) = '' THEN 'cleaned_text: Value error, cleaned_text 不能为空' END,
  CASE WHEN NOT typed THEN 'doc_type: {UNKNOWN_TYPE}' END, CASE WHEN n > 5000 THEN 'sensitive_items: Input should be a valid list' END) AS errors FROM d
UNION ALL SELECT doc_id, 2, concat_ws('; ', CASE WHEN NOT typed THEN 'chunks.0.chunk_id: Value error, chunk_id 格式错误: ''' || lang || '''，应为 P{{N}}-C{{NNN}}（如 P1-C001）' END,
  CASE WHEN n > 3000 THEN 'chunks.0.title: Field required' END, CASE WHEN trim(text) = '' THEN 'chunks.0.content: Value error, chunk content 不能为空' END) FROM d
UNION ALL SELECT doc_id, 3, CASE WHEN n % 10 > 0 THEN '{SCORE} a valid integer, got a number with a fractional part' WHEN n > 1000 THEN '{SCORE} less than or equal to 100' ELSE '' END FROM d
UNION ALL SELECT doc_id, 4, concat_ws('; ', CASE WHEN NOT typed THEN 'chunks.0.doc_type: {UNKNOWN_TYPE}' END, 'chunks.0.metadata.summary: Input should be a valid string', CASE WHEN n > 3000 THEN 'chunks.0.remark: Input should be a valid string' END) FROM d)
SELECT * FROM e WHERE errors <> ''""")
def stage_rejects(spark, sf_dir):
    """Documents as answers of all four stages, with faults by their language and length."""
    docs, n, english = _docs(spark, sf_dir), F.length("text"), F.col("lang") == "en"
    kind = F.when(english, "FAQ").otherwise(F.col("lang"))
    pair = F.struct(F.col("source").alias("question"), F.col("source").alias("answer"), F.array(F.lit("k")).alias("keywords"), (n / 10).alias("confidence_score"))
    tags = F.struct(*[F.lit("x").alias(t) for t in stages.TAGS[:-1]], n.alias(stages.TAGS[-1]))
    answers = {
        1: F.struct(F.col("text").alias("cleaned_text"), kind.alias("doc_type"), F.when(n > 5000, "none").alias("sensitive_items")),
        2: F.struct(F.array(F.struct(F.when(english, "P1-C001").otherwise(F.col("lang")).alias("chunk_id"), F.when(n <= 3000, F.col("source")).alias("title"), F.col("text").alias("content"))).alias("chunks")),
        3: F.struct(F.array(F.struct(F.lit("P1-C001").alias("chunk_id"), F.array(pair).alias("qa_pairs"))).alias("chunks")),
        4: F.struct(F.array(F.struct(F.lit("P1-C001").alias("chunk_id"), kind.alias("doc_type"), tags.alias("metadata"), F.when(n > 3000, n).alias("remark"))).alias("chunks")),
    }
    rejects = [stages.stage_gate(docs.select("doc_id", F.to_json(answer).alias("content")), k)[1].select("doc_id", F.lit(k).alias("stage"), F.concat_ws("; ", "errors").alias("errors")) for k, answer in answers.items()]
    return reduce(DataFrame.unionByName, rejects)


@query("""WITH a AS (SELECT user_id AS doc_id, event_id % 20 AS unit, 1 + count(*) OVER (PARTITION BY user_id, event_id % 20 ORDER BY event_id) AS attempt, event_id % 11 = 0 AS ok FROM events),
l AS (SELECT doc_id, unit, max(attempt) AS attempt, bool_or(ok) AS y FROM a GROUP BY doc_id, unit)
SELECT doc_id, unit, CAST(attempt AS BIGINT) AS attempt, attempt < 3 AS again FROM l WHERE NOT y""")
def next_attempts(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", F.col("event_id") % 20).orderBy("event_id")
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 20).alias("unit"), (F.count("*").over(w) + 1).alias("attempt"), (F.col("event_id") % 11 == 0).alias("ok"))
    again, failed = stages.next_attempts(attempts)
    return again.drop("ok").withColumn("again", F.lit(True)).unionByName(failed.drop("ok").withColumn("again", F.lit(False)))


@query("SELECT user_id AS task_id, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 10 END) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 5) AS BIGINT) AS completion_tokens, CAST(sum(event_id % 15) AS BIGINT) AS total_tokens FROM events GROUP BY user_id")
def model_usage(spark, sf_dir):
    e = F.col("event_id")
    return stages.usage_by_task(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.when(e % 3 != 0, e % 10).alias("prompt_tokens"), (e % 5).alias("completion_tokens"), (e % 15).alias("total_tokens")))
