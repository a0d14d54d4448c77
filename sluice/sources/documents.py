"""Readers: text folders, extracted pages and paragraphs, finished records, and per-document checkpoints."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File types by extension.
TYPES = {"pdf": "pdf", "doc": "docx", "docx": "docx", "md": "markdown", "markdown": "markdown", "txt": "markdown"}


@F.pandas_udf(T.StringType())
def _gb18030(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("gb18030", errors="replace"))


def file_type(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds file_type by the lower-cased extension; null for unsupported ones."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    kinds = F.when(F.lit(False), F.lit(""))
    for ext, kind in TYPES.items():
        kinds = kinds.when(extension == ext, kind)
    return df.withColumn("file_type", kinds)


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs: source, file_type, markdown; rejects: source, reason). Text that is not UTF-8 is read as GB18030."""
    files = file_type(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).withColumn("source", F.regexp_extract("path", r"([^/]+)$", 1))
    text = files.filter("file_type = 'markdown'")
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    good = text.filter(utf8).withColumn("markdown", F.col("content").cast("string"))
    other = text.filter(~utf8).withColumn("markdown", _gb18030("content"))
    read = good.unionByName(other).withColumn("_blank", F.regexp_replace("markdown", r"(?U)\s", "") == "")
    reason = F.when(F.col("file_type").isNull(), "unsupported type").otherwise("needs an extractor")
    rejects = files.filter("file_type IS NULL OR file_type <> 'markdown'").select("source", reason.alias("reason"))
    return read.filter("NOT _blank").select("source", "file_type", "markdown"), rejects.unionByName(read.filter("_blank").select("source", F.lit("blank").alias("reason")))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown) of pages (doc_id, page_no, text): blank pages dropped, physical page numbers kept."""
    full = pages.filter(F.trim("text") != "").withColumn("_p", F.format_string("<!-- page %d -->\n%s", "page_no", "text"))
    return full.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "_p"))).alias("p")).select("doc_id", F.array_join("p._p", "\n\n").alias("markdown"))


def assemble_paragraphs(paragraphs: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown) of paragraphs (doc_id, pos, style, text): 'heading N' becomes N #s (1 where N cannot be read), blank
    ones are dropped, tables (doc_id, pos, markdown) come last."""
    level = F.coalesce(F.expr("try_cast(regexp_extract(lower(style), '^heading (\\\\d+)$', 1) AS INT)"), F.lit(1))
    line = F.when(F.startswith(F.lower("style"), F.lit("heading")), F.concat(F.lpad(F.lit(""), level, "#"), F.lit(" "), F.trim("text"))).otherwise(F.trim("text"))
    parts = paragraphs.filter(F.trim("text") != "").select("doc_id", F.lit(0).alias("k"), "pos", line.alias("t"))
    if tables is not None:
        parts = parts.unionByName(tables.select("doc_id", F.lit(1).alias("k"), "pos", F.col("markdown").alias("t")))
    return parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "pos", "t"))).alias("p")).select("doc_id", F.array_join("p.t", "\n\n").alias("markdown"))


def cells_to_markdown(cells: DataFrame) -> DataFrame:
    """(doc_id, markdown): a pipe table of cells (doc_id, row_no, col_no, text), with a rule after the first row."""
    clean = F.regexp_replace(F.replace(F.trim("text"), F.lit("|"), F.lit("\\|")), "\n", " ")
    rows = cells.groupBy("doc_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", clean.alias("t")))).alias("c"))
    row = F.concat(F.lit("| "), F.array_join("c.t", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", row.alias("r"), rule.alias("u")))).alias("p"))
    return lines.select("doc_id", F.concat_ws("\n", F.col("p")[0]["r"], F.col("p")[0]["u"], F.array_join(F.slice(F.col("p.r"), F.lit(2), F.size("p")), "\n")).alias("markdown"))


QA = "struct<question:string,answer:string,keywords:array<string>,confidence_score:int,remark:string>"
ATOM = f"struct<chunk_id:string,title:string,content:string,doc_type:string,metadata:struct<target_audience:string,business_module:string,knowledge_type:string,version_timeliness:string,summary:string>,qa_pairs:array<{QA}>,remark:string>"
RECORD = (
    "document_info struct<source:string,doc_type:string,total_chunks:int,total_qa_pairs:int,processing_date:string>, "
    f"knowledge_atoms array<{ATOM}>, exception_list map<string,array<string>>, "
    "quality_summary struct<avg_confidence:double,low_confidence_count:int,exception_count:int,coverage_rate:double,needs_review:boolean>, _corrupt_record string"
)


def read_kb_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of finished documents, one JSON file each, both with the file's path; a missing coverage_rate is 0,
    and what is no JSON object is rejected with its text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    raw = files.withColumn("r", F.from_json("value", RECORD, options)).withColumn("_bad", F.col("r").isNull() | F.col("r._corrupt_record").isNotNull())
    rate = F.coalesce("quality_summary.coverage_rate", F.lit(0.0))
    good = raw.filter("NOT _bad").select("path", "r.*").drop("_corrupt_record")
    return good.withColumn("quality_summary", F.col("quality_summary").withField("coverage_rate", rate)), raw.filter("_bad").select("path", F.col("value").alias("_corrupt_record"))


#: What Spark says of a table whose files are no Parquet files.
UNREADABLE = ("CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA", "is not a Parquet file")


def with_checkpoint(units: DataFrame, path: str, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's table at path, after building and appending what it lacks of the units: a resumed run does only the rest.
    A table that cannot be read is dropped and built anew."""
    spark = units.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        try:
            done = spark.read.parquet(path).select(key).distinct()
            done.isEmpty()
        except Exception as e:
            if not any(x in str(e) for x in UNREADABLE):  # a store that fails for a while keeps its table
                raise
            clear_checkpoint(spark, path)
        else:
            units = units.join(done, key, "left_anti")
    build(units).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def clear_checkpoint(spark: SparkSession, path: str) -> bool:
    """Drops the stage's table; False where there is none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
