"""Review worklists of finished documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Label, guidance and tab of each exception field; the sections of the review list in order and its sentences;
# the patterns of ids, scores, marks and title prefixes in entries.
LABELS = (
    ("content_conflicts", "内容冲突", "查看对应知识原子，核对并修正冲突内容", "atoms"),
    ("missing_info", "缺失信息", "补充缺失的前提条件、参数或步骤说明", "atoms"),
    ("vague_items", "模糊表述", "将模糊表述替换为具体数值或明确范围", "atoms"),
    ("expired_items", "过期内容", "更新为最新版本信息或标注「以最新文档为准」", "atoms"),
    ("chunk_anomalies", "拆分异常", "重新审视分块边界，合并或重新拆分", "atoms"),
    ("truncated_items", "截断位置", "扩展该知识原子的取文本长度或手动拼接", "atoms"),
    ("sensitive_items", "敏感数据", "脱敏处理或删除敏感字段后再上线", "atoms"),
    ("low_confidence_qa", "低置信 QA", "逐条复核低置信 QA，人工校验答案", "qa"),
    ("terminology_pending", "术语待确认", "确认术语后更新术语库或添加同义词", "atoms"),
)
SECTIONS = (
    ("sensitive_items", 1, "**包含敏感信息的**（需确认脱敏是否正确）："),
    ("low_confidence_qa", 2, "**答案不确定的**（原文信息不够，AI给出的回答可能不准）："),
    ("vague_items", 2, "**答案不确定的**（原文信息不够，AI给出的回答可能不准）："),
    ("missing_info", 3, "**需要你补充的**（原文缺失，留了空等你填写）："),
    ("content_conflicts", 4, "**内容有冲突的**（不同地方说法不一致）："),
    ("terminology_pending", 5, "**专业术语待确认的**（内部叫法可能不标准）："),
    ("chunk_anomalies", 6, "**拆分可能不合理的**（知识片段过长或过短）："),
    ("truncated_items", 6, "**拆分可能不合理的**（知识片段过长或过短）："),
    ("expired_items", 7, "**可能已过期的**（内容可能不再适用）："),
)
ALL_PASSED = "✅ 本次处理全部通过，无需人工复核，直接交付JSON文件。"
HEADER = "共处理出 %d 个知识片段、%d 条问答，其中 %d 项需要你关注\n\n需要关注的内容：\n\n"
CLOSING = "\n\n✅ 以上内容确认无误后，我将交付完整的JSON文件；如需修改请直接告诉我。"
UNSURE = "关于「%s」，原文信息不够明确"
SIZED = "「%s」这段内容%s"
CUT = "「%s」可能被截断，内容不完整"
GRANULARITY = "拆分颗粒度异常"
CHUNK_ID = r"^(P\d+-C\d+)"
QUESTION_NO = r"^P\d+-C\d+-Q(\d+)"
ENTRY_PREFIX = r"^P\d+-C\d+(-Q\d+)?:\s*"
SCORE = r"置信分\d+-?"
MARK = "【[^】]*】"
TITLE_PREFIX = r"^【[^】]*】\s*[-–]\s*"


def clean_item(item: Column) -> Column:
    """The entry without its id prefix, score and 【…】 marks, blanks squeezed; itself where nothing is left."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(item, ENTRY_PREFIX, ""), SCORE, ""), MARK, "")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(text == "", item).otherwise(text)


def _with_questions(items: DataFrame, qa: DataFrame) -> DataFrame:
    """Adds question: the n-th pair of the entry's chunk where it says Qn, else the chunk's first pair with a low score, else null."""
    items = items.withColumns({"chunk_id": F.regexp_extract("item", CHUNK_ID, 1), "qa_no": F.regexp_extract("item", QUESTION_NO, 1).try_cast("int")})
    named = qa.groupBy("doc_id", "chunk_id", "qa_no").agg(F.min("question").alias("_named"))
    low = qa.filter("confidence_score < 80").groupBy("doc_id", "chunk_id").agg(F.min_by("question", "qa_no").alias("_low"))
    both = items.join(named, ["doc_id", "chunk_id", "qa_no"], "left").join(low, ["doc_id", "chunk_id"], "left")
    return both.withColumn("question", F.coalesce("_named", "_low")).drop("chunk_id", "qa_no", "_named", "_low")


def _with_titles(items: DataFrame, atoms: DataFrame) -> DataFrame:
    """Adds title: that of the entry's chunk (of the first one with the id) without its 【module】- prefix."""
    titles = atoms.groupBy("doc_id", "chunk_id").agg(F.regexp_replace(F.min_by("title", "chunk_no"), TITLE_PREFIX, "").alias("title"))
    return items.withColumn("chunk_id", F.regexp_extract("item", CHUNK_ID, 1)).join(titles, ["doc_id", "chunk_id"], "left").drop("chunk_id")


def item_questions(exceptions: DataFrame, qa: DataFrame) -> DataFrame:
    """low_confidence_qa entries with their question: the n-th pair of the chunk where the entry says Qn, else the chunk's
    first pair with a low score, else the cleaned entry."""
    items = _with_questions(exceptions.filter("field = 'low_confidence_qa'"), qa)
    return items.select("doc_id", "item", F.coalesce("question", clean_item(F.col("item"))).alias("question"))


def item_titles(exceptions: DataFrame, atoms: DataFrame) -> DataFrame:
    """Size and truncation entries with their chunk's title, without its 【module】- prefix."""
    return _with_titles(exceptions.filter("field IN ('chunk_anomalies', 'truncated_items')"), atoms).select("doc_id", "field", "item", "title")


def worklist(exceptions: DataFrame) -> DataFrame:
    """Entries with label, guidance and tab of their field."""
    labels = exceptions.sparkSession.createDataFrame(list(LABELS), "field string, label string, guidance string, tab string")
    return exceptions.join(F.broadcast(labels), "field")  # nine rows


def review_list(documents: DataFrame, exceptions: DataFrame, atoms: DataFrame, qa: DataFrame) -> DataFrame:
    """(doc_id, needs_review, summary): per document how much there is, the sections in fixed order with what a reader needs to
    know of each entry, and a closing line. Documents without entries, or whose exception_count (where documents have that
    column) is 0, have passed."""
    qa = qa.join(atoms.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_semi")
    sections = exceptions.sparkSession.createDataFrame([(f, n, k, t) for k, (f, n, t) in enumerate(SECTIONS)], "field string, no int, k int, section string")
    items = exceptions.join(F.broadcast(sections), "field").select("doc_id", "field", "no", "k", "section", "pos", "item")  # nine rows
    answers = _with_questions(items.filter("field = 'low_confidence_qa'"), qa).withColumn("title", F.lit(None).cast("string"))
    sized = _with_titles(items.filter("field IN ('chunk_anomalies', 'truncated_items')"), atoms).withColumn("question", F.lit(None).cast("string"))
    others = items.filter("field NOT IN ('low_confidence_qa', 'chunk_anomalies', 'truncated_items')")
    every = answers.unionByName(sized).unionByName(others, allowMissingColumns=True)
    plain, titled = clean_item(F.col("item")), F.coalesce(F.col("title") != "", F.lit(False))
    text = (
        F.when(F.col("question") != "", F.format_string(UNSURE, "question"))
        .when((F.col("field") == "chunk_anomalies") & titled & plain.contains(GRANULARITY), F.format_string(SIZED, "title", F.replace(plain, F.lit(GRANULARITY + "-"), F.lit(""))))
        .when((F.col("field") == "truncated_items") & titled, F.format_string(CUT, "title"))
        .otherwise(plain)
    )
    parts = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "k", "pos", "item", "section", text.alias("text")))).alias("p"), F.count("*").alias("_entries"))
    section = lambda no: F.filter("p", lambda x: x.no == no)
    lines = lambda p: F.concat(F.get(p, F.lit(0)).section, F.lit("\n"), F.array_join(F.transform(p, lambda x: F.concat(F.lit("- "), x.text)), "\n"))
    body = F.array_join(F.array_compact(F.array(*[F.when(F.size(section(no)) > 0, lines(section(no))) for no in sorted({n for _, n, _ in SECTIONS})])), "\n\n")
    given = F.col("exception_count") if "exception_count" in documents.columns else F.lit(None)
    sizes = atoms.groupBy("doc_id").agg(F.count("*").alias("_atoms"))
    pairs = qa.groupBy("doc_id").agg(F.count("*").alias("_pairs"))
    documents = documents.select("doc_id", given.cast("long").alias("_given")).join(parts, "doc_id", "left").join(sizes, "doc_id", "left").join(pairs, "doc_id", "left")
    count = F.coalesce("_given", "_entries", F.lit(0))
    needed = (count != 0) & F.col("_entries").isNotNull()
    header = F.format_string(HEADER, F.coalesce("_atoms", F.lit(0)), F.coalesce("_pairs", F.lit(0)), count)
    return documents.select("doc_id", needed.alias("needs_review"), F.when(needed, F.concat(header, body, F.lit(CLOSING))).otherwise(ALL_PASSED).alias("summary"))


def lint_qa(atoms: DataFrame, qa: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, issue): chunks without 3 to 5 pairs, pairs without 3 to 5 keywords, questions with a 【…】 prefix; and,
    where qa has pos (its place in the answer), chunks whose first pair stands before a pair of an earlier chunk."""
    place = F.min("pos") if "pos" in qa.columns else F.lit(None).cast("int")
    counts = qa.groupBy("doc_id", "chunk_id").agg(
        F.count("*").alias("n"), F.count_if(~F.size("keywords").between(3, 5)).alias("k"), F.count_if(F.col("question").rlike("^【")).alias("b"), place.alias("_pos")
    )
    both = atoms.select("doc_id", "chunk_id", *[c for c in ("chunk_no",) if c in atoms.columns]).join(counts, ["doc_id", "chunk_id"], "left").fillna(0, ["n", "k", "b"])
    late = F.lit(False)
    if "pos" in qa.columns:
        order = Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn("_reached", F.max("_pos").over(order))
        late = F.coalesce(F.col("_pos") < F.col("_reached"), F.lit(False))
    issues = F.array_compact(F.array(F.when(F.col("n") == 0, "unanswered"), F.when((F.col("n") > 0) & ~F.col("n").between(3, 5), "pair count"), F.when(F.col("k") > 0, "keyword count"), F.when(F.col("b") > 0, "question prefix"), F.when(late, "order")))
    return both.select("doc_id", "chunk_id", F.explode(issues).alias("issue"))
