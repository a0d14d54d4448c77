"""Assembly of chunks, question-answer pairs and tags into document records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The placeholder of a missing tag, the tag fields and the exception fields in order.
MISSING = "【人工补全项】"
UNTAGGED = "；Stage 4 缺少 metadata"
TAGS = ("target_audience", "business_module", "knowledge_type", "version_timeliness", "summary")
FIELDS = (
    "content_conflicts", "missing_info", "vague_items", "expired_items", "chunk_anomalies", "truncated_items", "sensitive_items",
    "low_confidence_qa", "terminology_pending",
)


def last_by_chunk(stage: DataFrame, order: str) -> DataFrame:
    """Of rows with one (doc_id, chunk_id), the last by the order column; where there is none, the one with the greatest hash."""
    last = F.desc(order) if order in stage.columns else F.desc(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(stage.columns)]))
    w = Window.partitionBy("doc_id", "chunk_id").orderBy(last)
    return stage.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def default_tags() -> Column:
    return F.struct(*[F.lit(MISSING).alias(t) for t in TAGS])


def assemble(stage2: DataFrame, stage3: DataFrame, stage4: DataFrame, doc_types: DataFrame) -> DataFrame:
    """Chunks left joined with Q&A (doc_id, chunk_id, qa_pairs) and tags (doc_id, chunk_id, metadata, doc_type, remark): every
    chunk stays, in order; where a side is missing, tags and type get their defaults, Q&A are empty, and missing says which. Of
    rows that repeat a chunk id the last one counts (by chunk_no, and by pos in stages 3 and 4), at the place of the first."""
    place = Window.partitionBy("doc_id", "chunk_id")
    stage2 = last_by_chunk(stage2.withColumn("_first", F.min("chunk_no").over(place)), "chunk_no").withColumn("chunk_no", F.col("_first")).drop("_first")
    stage3, stage4 = last_by_chunk(stage3, "pos"), last_by_chunk(stage4, "pos")
    qa = stage3.select("doc_id", "chunk_id", "qa_pairs")
    tags = stage4.select("doc_id", "chunk_id", "metadata", F.col("doc_type").alias("_t"), F.col("remark").alias("_r4"))
    both = stage2.join(qa, ["doc_id", "chunk_id"], "left").join(tags, ["doc_id", "chunk_id"], "left").join(
        doc_types.select("doc_id", F.col("doc_type").alias("_d")), "doc_id", "left"
    )
    no_qa, no_tags = F.col("qa_pairs").isNull(), F.col("metadata").isNull()
    remarks = F.array(F.coalesce("remark", F.lit("")), F.coalesce("_r4", F.lit("")))
    untagged = F.concat(F.coalesce("remark", F.lit("")), F.lit(UNTAGGED))
    missing = F.array(F.when(no_qa, F.concat("chunk_id", F.lit(": Stage 3 缺少 qa_pairs"))), F.when(no_tags, F.concat("chunk_id", F.lit(": Stage 4 缺少 metadata"))))
    return both.withColumns(
        {
            "missing": F.array_compact(missing),
            "remark": F.when(no_tags, untagged).otherwise(F.array_join(F.filter(remarks, lambda r: F.trim(r) != ""), "；")),
            "qa_pairs": F.coalesce("qa_pairs", F.array().cast(stage3.schema["qa_pairs"].dataType)),
            "doc_type": F.coalesce("_t", "_d"),
            "metadata": F.coalesce("metadata", default_tags()),
        }
    ).drop("_t", "_r4", "_d")


def missing_parts(assembled: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, part, item): the sides a chunk lacks, Q&A before tags."""
    return assembled.select("doc_id", "chunk_no", F.posexplode("missing").alias("part", "item"))


def merge_exceptions(*stages: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, items) of exceptions (doc_id, stage, field, pos, item): appended in stage order, repeats dropped; the
    rows of missing_parts() follow in missing_info as they are."""
    every = reduce(DataFrame.unionByName, stages)
    once = every.groupBy("doc_id", "field", "item").agg(F.min(F.struct("stage", "pos")).alias("at"))
    lists = once.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("p")).select("doc_id", "field", F.col("p.item").alias("items"))
    if missing is None:
        return lists
    more = missing.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "part", "item"))).alias("p")).select("doc_id", F.lit("missing_info").alias("field"), F.col("p.item").alias("more"))
    none = F.array().cast("array<string>")
    return lists.join(more, ["doc_id", "field"], "full").select("doc_id", "field", F.concat(F.coalesce("items", none), F.coalesce("more", none)).alias("items"))


def document_info(atoms: DataFrame, processing_date: str) -> DataFrame:
    return atoms.groupBy("doc_id").agg(
        F.count("*").alias("total_chunks"), F.sum(F.coalesce(F.size("qa_pairs"), F.lit(0)).cast("long")).alias("total_qa_pairs"), F.lit(processing_date).alias("processing_date")
    )


def nest_documents(info: DataFrame, atoms: DataFrame, exceptions: DataFrame, summary: DataFrame) -> DataFrame:
    """One record per document: its info, atoms in order, exception lists by field and quality summary."""
    body = atoms.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_id", "title", "content", "doc_type", "metadata", "qa_pairs", "remark"))).alias("knowledge_atoms")
    )
    empty = F.array().cast("array<string>")
    lists = exceptions.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "items"))).alias("_m"))
    lists = lists.select("doc_id", F.struct(*[F.coalesce(F.try_element_at("_m", F.lit(f)), empty).alias(f) for f in FIELDS]).alias("exception_list"))
    return info.join(body, "doc_id").join(lists, "doc_id", "left").join(summary, "doc_id", "left")
