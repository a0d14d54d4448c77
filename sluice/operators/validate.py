"""Format checks, metrics, consistency checks, repairs and the verdict on finished documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format and consistency rules.
TOP_KEYS = ("document_info", "knowledge_atoms", "exception_list", "quality_summary")
INFO_KEYS = ("source", "doc_type", "total_chunks", "total_qa_pairs", "processing_date")
ATOM_KEYS = ("chunk_id", "title", "content", "doc_type", "metadata", "qa_pairs", "remark")
META_KEYS = ("target_audience", "business_module", "knowledge_type", "version_timeliness", "summary")
QA_KEYS = ("question", "answer", "keywords", "confidence_score", "remark")
SUMMARY_KEYS = ("avg_confidence", "low_confidence_count", "exception_count", "needs_review")
ADVICE = ("建议联系", "建议您", "可以尝试", "可以联系")
NOT_STATED = "文档未说明"
LOW_MARK = "低置信"
LOW_REMARK = "【低置信-人工复核】"
SIZE_MARK = "拆分颗粒度异常"
SECRETS = ((r"密码[：:]\s*\S+", "密码值未脱敏"), (r"密钥[：:]\s*\S+", "密钥值未脱敏"), (r"[Kk]ey[：:]\s*\S+", "Key值未脱敏"), (r"[Tt]oken[：:]\s*\S+", "Token值未脱敏"), (r"salt[：:]\s*\S+", "Salt值未脱敏"))
CHUNK_ID = r"^P\d+-C\d+$"
LOW, SHORT, LEAST, MOST = 80, 20, 300, 800


def _keys(raw: Column) -> Column:
    return F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))


def _lacking(keys: Column, wanted: tuple[str, ...], prefix: str) -> Column:
    return F.transform(F.array_except(F.array(*[F.lit(k) for k in wanted]), keys), lambda k: F.concat(F.lit(prefix), k))


def _with_info(docs: DataFrame, raw: str) -> DataFrame:
    """Only records with document_info are checked any further."""
    return docs.filter(F.array_contains(_keys(F.col(raw)), "document_info"))


def check_document(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """(doc_id, error): keys missing from the record and its info, no atoms; a record without info is checked no further."""
    top, info = F.col(raw), F.get_json_object(raw, "$.document_info")
    lists, atoms = F.get_json_object(raw, "$.quality_summary"), F.from_json(F.get_json_object(raw, "$.knowledge_atoms"), "array<string>")
    no_atoms = F.when(F.coalesce(F.size(atoms), F.lit(0)) <= 0, F.array(F.lit("knowledge_atoms empty"))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(
        _lacking(_keys(top), TOP_KEYS, "missing: "),
        F.when(~F.array_contains(_keys(top), "document_info"), F.array().cast("array<string>"))
        .otherwise(F.concat(_lacking(_keys(info), INFO_KEYS, "document_info missing: "), no_atoms, _lacking(_keys(lists), SUMMARY_KEYS, "quality_summary missing: "))),
    )
    return docs.select("doc_id", F.explode(errors).alias("error"))


def check_atoms(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """(doc_id, atom, error): keys of atoms, their metadata and their pairs that are missing, told by the raw JSON, and
    malformed chunk ids."""
    atoms = _with_info(docs, raw).select("doc_id", F.posexplode(F.from_json(F.get_json_object(raw, "$.knowledge_atoms"), "array<string>")).alias("atom", "_a"))
    bad_id = ~F.coalesce(F.get_json_object("_a", "$.chunk_id").rlike(CHUNK_ID), F.lit(False))
    pairs = F.coalesce(F.from_json(F.get_json_object("_a", "$.qa_pairs"), "array<string>"), F.array().cast("array<string>"))
    of_pair = lambda q, i: F.transform(F.array_except(F.array(*[F.lit(k) for k in QA_KEYS]), _keys(q)), lambda k: F.concat(F.lit("QA["), i.cast("string"), F.lit("] missing: "), k))
    errors = F.concat(
        _lacking(_keys(F.col("_a")), ATOM_KEYS, "missing: "), _lacking(_keys(F.get_json_object("_a", "$.metadata")), META_KEYS, "metadata missing: "),
        F.flatten(F.transform(pairs, of_pair)), F.array_compact(F.array(F.when(bad_id, F.lit("bad chunk_id")))),
    )
    return atoms.select("doc_id", "atom", F.explode(errors).alias("error"))


def warn_keywords(qa: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, qa_no, warning): pairs without keywords."""
    return qa.filter(F.coalesce(F.size("keywords"), F.lit(0)) <= 0).select("doc_id", "chunk_id", "qa_no", F.lit("no keywords").alias("warning"))


def check_qa(qa: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, qa_no, error): scores out of range. A null is no error; whether a key is there at all, check_atoms() tells."""
    out = ~F.col("confidence_score").between(0, 100)
    return qa.filter(out).select("doc_id", "chunk_id", "qa_no", F.lit("score out of range").alias("error"))


def warn_atoms(atoms: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, warning): titles that lack their 【…】 prefix (empty ones do not count), summaries over 20 characters."""
    bare = (F.coalesce("title", F.lit("")) != "") & ~F.coalesce(F.col("title").rlike("^【.+】"), F.lit(False))
    warnings = F.array_compact(F.array(F.when(bare, "bare title"), F.when(F.length("summary") > 20, "long summary")))
    return atoms.select("doc_id", "chunk_id", F.explode(warnings).alias("warning"))


def warn_advice(qa: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, qa_no, phrase): advice phrases in answers that do not say the document is silent."""
    found = F.filter(F.array(*[F.lit(p) for p in ADVICE]), lambda p: F.contains("answer", p))
    return qa.filter(~F.contains("answer", F.lit(NOT_STATED))).select("doc_id", "chunk_id", "qa_no", F.explode(found).alias("phrase"))


def warn_quotes(docs: DataFrame, raw: str = "raw") -> DataFrame:
    return docs.filter(F.col(raw).rlike("[“”‘’]")).select("doc_id", F.lit("curly quotes").alias("warning"))


def check_totals(info: DataFrame, atoms: DataFrame, qa: DataFrame) -> DataFrame:
    """(doc_id, field, declared, actual) where they differ."""
    have = atoms.groupBy("doc_id").agg(F.count("*").alias("chunks")).join(qa.groupBy("doc_id").agg(F.count("*").alias("pairs")), "doc_id", "full")
    both = info.join(have, "doc_id", "left").fillna(0, ["chunks", "pairs"])
    rows = F.array(
        F.struct(F.lit("total_chunks").alias("field"), F.col("total_chunks").cast("long").alias("declared"), F.col("chunks").alias("actual")),
        F.struct(F.lit("total_qa_pairs").alias("field"), F.col("total_qa_pairs").cast("long").alias("declared"), F.col("pairs").alias("actual")),
    )
    return both.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*").filter(~F.col("declared").eqNullSafe(F.col("actual")))


def check_lists(docs: DataFrame, fields: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """(doc_id, error): exception fields that are absent or no arrays, needs_review that is there and no boolean; absent is not
    null, and check_document() tells whether needs_review is there."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant"))
    errors = [F.when(~F.coalesce(F.startswith(kind(f"$.exception_list.{f}"), F.lit("ARRAY")), F.lit(False)), F.lit(f"{f}: no list")) for f in fields]
    errors.append(F.when(kind("$.quality_summary.needs_review") != "BOOLEAN", F.lit("needs_review: no boolean")))
    return _with_info(docs, raw).select("doc_id", F.explode(F.array_compact(F.array(*errors))).alias("error"))


def format_verdict(docs: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, n_errors, n_warnings, valid) of every document."""
    e, w = (x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((errors, "n_errors"), (warnings, "n_warnings")))
    return docs.select("doc_id").distinct().join(e, "doc_id", "left").join(w, "doc_id", "left").fillna(0).withColumn("valid", F.col("n_errors") == 0)


def confidence_metrics(qa: DataFrame) -> DataFrame:
    """(doc_id, scored, low_confidence_count, avg_confidence): over scores that are given; one decimal, half to even."""
    score = F.col("confidence_score")
    return qa.groupBy("doc_id").agg(
        F.count(score).alias("scored"), F.count_if(score < LOW).alias("low_confidence_count"),
        F.coalesce(F.bround(F.sum(score).cast("decimal(18,0)") / F.when(F.count(score) > 0, F.count(score)).cast("decimal(18,0)"), 1).cast("double"), F.lit(0.0)).alias("avg_confidence"),
    )


def exception_metrics(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("doc_id").agg(F.count("*").alias("exception_count")).withColumn("needs_review", F.col("exception_count") > 0)


def coverage(atoms: DataFrame, qa: DataFrame) -> DataFrame:
    """(doc_id, atoms, answered, coverage_rate): atoms with an answer that says something."""
    says = (F.trim(F.coalesce("answer", F.lit(""))) != "") & (F.trim("answer") != NOT_STATED)
    answered = qa.filter(says).select("doc_id", "chunk_id").distinct().withColumn("_y", F.lit(1))
    rate = F.bround(F.sum(F.coalesce("_y", F.lit(0))).cast("decimal(18,0)") / F.count("*").cast("decimal(18,0)"), 2).cast("double")
    return atoms.select("doc_id", "chunk_id").join(answered, ["doc_id", "chunk_id"], "left").groupBy("doc_id").agg(F.count("*").alias("atoms"), F.count("_y").alias("answered"), rate.alias("coverage_rate"))


def fix_metrics(stored: DataFrame, computed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(doc_id, field, old, new): stored numbers that are missing or differ from the computed ones."""
    a, b = (x.select("doc_id", *[F.col(f).cast("double").alias(f"{p}{f}") for f in fields]) for x, p in ((stored, "o_"), (computed, "n_")))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new")) for f in fields])
    return b.join(a, "doc_id", "left").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*").filter(~F.col("old").eqNullSafe(F.col("new")))


def score_marks(qa: DataFrame) -> DataFrame:
    """(doc_id, location, issue): low scores without their mark, marks on scores that are not low."""
    marked, low = F.contains(F.coalesce("remark", F.lit("")), F.lit(LOW_MARK)), F.col("confidence_score") < LOW
    issue = F.when(low & ~marked, "unmarked low score").when(~low & marked, "marked high score")
    return qa.select("doc_id", F.format_string("%s 第%d条QA", "chunk_id", "qa_no").alias("location"), issue.alias("issue")).filter("issue IS NOT NULL")


def length_marks(atoms: DataFrame) -> DataFrame:
    marked, odd = F.contains(F.coalesce("remark", F.lit("")), F.lit(SIZE_MARK)), ~F.length("content").between(LEAST, MOST)
    issue = F.when(odd & ~marked, "unmarked size").when(~odd & marked, "marked size")
    return atoms.select("doc_id", F.col("chunk_id").alias("location"), issue.alias("issue")).filter("issue IS NOT NULL")


def unregistered(atoms: DataFrame, exceptions: DataFrame, field: str, condition: Column) -> DataFrame:
    """(doc_id, chunk_id): atoms that meet the condition and whose exact id no entry of the field names, wherever it stands in it."""
    named = exceptions.filter(F.col("field") == field).select("doc_id", F.explode(F.regexp_extract_all("item", F.lit(r"P\d+-C\d+"), F.lit(0))).alias("chunk_id")).distinct()
    return atoms.filter(condition).select("doc_id", "chunk_id").join(named, ["doc_id", "chunk_id"], "left_anti")


def unregistered_lengths(atoms: DataFrame, exceptions: DataFrame) -> DataFrame:
    return unregistered(atoms, exceptions, "chunk_anomalies", ~F.length("content").between(LEAST, MOST))


def unregistered_sensitive(atoms: DataFrame, exceptions: DataFrame) -> DataFrame:
    return unregistered(atoms, exceptions, "sensitive_items", F.contains("content", F.lit("敏感数据")))


def unmasked_answers(qa: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, qa_no, issue): an issue for each kind of secret that stands unmasked in an answer."""
    issues = F.array_compact(F.array(*[F.when(F.col("answer").rlike(p), F.lit(text)) for p, text in SECRETS]))
    return qa.filter(~F.contains("answer", F.lit("【敏感数据】"))).select("doc_id", "chunk_id", "qa_no", F.explode(issues).alias("issue"))


def short_answers(qa: DataFrame, n: int = SHORT) -> DataFrame:
    size = F.length(F.trim("answer"))
    return qa.filter((size > 0) & (size < n) & (F.trim("answer") != NOT_STATED)).select("doc_id", "chunk_id", "qa_no", size.alias("n_chars"))


def repair_marks(qa: DataFrame) -> DataFrame:
    """The pairs with the low-score mark put where it lacks, and fixed telling where."""
    lacks = (F.col("confidence_score") < LOW) & ~F.contains(F.coalesce("remark", F.lit("")), F.lit(LOW_MARK))
    return qa.withColumn("fixed", F.coalesce(lacks, F.lit(False))).withColumn("remark", F.when(F.col("fixed"), F.trim(F.concat(F.coalesce("remark", F.lit("")), F.lit(" " + LOW_REMARK)))).otherwise(F.col("remark")))


def final_verdict(verdict: DataFrame, issues: DataFrame, fixes: DataFrame) -> DataFrame:
    """(doc_id, valid, unfixable, passed)"""
    i, f = (x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((issues, "_i"), (fixes, "_f")))
    both = verdict.join(i, "doc_id", "left").join(f, "doc_id", "left").fillna(0, ["_i", "_f"])
    left = F.greatest(F.col("_i") - F.col("_f"), F.lit(0))
    return both.select("doc_id", "valid", left.alias("unfixable"), (F.col("valid") & (left == 0)).alias("passed"))
