"""Exports of finished documents in knowledge-base import formats."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.merge import TAGS
from sluice.operators.review import LABELS


UNTITLED = "未命名"
BOM = "\ufeff"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c)


def _qa(docs: DataFrame) -> DataFrame:
    atoms = docs.select("doc_id", F.explode("knowledge_atoms").alias("a"))
    return atoms.select("doc_id", "a.chunk_no", "a.chunk_id", "a.title", "a.doc_type", F.posexplode("a.qa_pairs").alias("qa_no", "q")).select("doc_id", "chunk_no", "chunk_id", "title", "doc_type", "qa_no", "q.*")


def _atoms(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("knowledge_atoms").alias("a")).select("doc_id", "a.*")


def to_coze_qa(docs: DataFrame) -> DataFrame:
    return _qa(docs).select(_text("question").alias("问题"), _text("answer").alias("答案"))


def to_coze_text(docs: DataFrame) -> DataFrame:
    return _atoms(docs).select(_text("title").alias("标题"), _text("content").alias("正文"))


def to_dify_qa(docs: DataFrame) -> DataFrame:
    return _qa(docs).select(_text("question"), _text("answer"))


def to_dify_text(docs: DataFrame) -> DataFrame:
    """The header names are swapped against the values, as consumers of this format expect."""
    return _atoms(docs).select(_text("title").alias("content"), _text("content").alias("segment"))


def to_dify_jsonl(docs: DataFrame) -> DataFrame:
    """(value): a JSON line per atom."""
    meta = F.struct("chunk_id", "doc_type", *[F.col(f"metadata.{t}").alias(t) for t in TAGS], F.coalesce(F.size("qa_pairs"), F.lit(0)).alias("qa_count"))
    return _atoms(docs).select(F.to_json(F.struct(F.col("title").alias("name"), F.col("content").alias("text"), meta.alias("metadata")), {"ignoreNullFields": "false"}).alias("value"))


def to_json_docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def to_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, value): a readable page per document."""
    qa = lambda q: F.concat(F.lit("**Q: "), q["question"], F.lit("**\n\nA: "), q["answer"], F.lit("\n*置信度: "), F.coalesce(q["confidence_score"], F.lit(0)).cast("string"), F.lit("%*\n"))

    def atom(a: Column, i: Column) -> Column:
        pairs = F.when(F.size(a["qa_pairs"]) > 0, F.concat(F.lit("### QA 对\n\n"), F.array_join(F.transform(a["qa_pairs"], qa), "\n"), F.lit("\n"))).otherwise("")
        remark = F.when(F.coalesce(a["remark"], F.lit("")) != "", F.concat(F.lit("> 备注: "), a["remark"], F.lit("\n\n"))).otherwise("")
        module = F.when(F.coalesce(a["metadata"]["business_module"], F.lit("")) != "", F.concat(F.lit(", 模块: "), a["metadata"]["business_module"])).otherwise("")
        head = F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(a["title"], F.lit("")), F.nullif(a["chunk_id"], F.lit("")), F.lit(UNTITLED)), F.lit("\n\n*ID: "), a["chunk_id"], F.lit(", 类型: "), F.coalesce(a["doc_type"], F.lit("")), module, F.lit("*\n\n"))
        return F.concat(head, F.coalesce(a["content"], F.lit("")), F.lit("\n\n"), pairs, remark, F.lit("---\n\n"))

    lists = F.flatten(F.array(*[_labelled(f, label) for f, label, _, _ in LABELS]))
    tail = F.when(F.size(lists) > 0, F.concat(F.lit("## 异常清单\n\n"), F.array_join(lists, "\n"), F.lit("\n"))).otherwise("")
    has = {f.name for f in docs.schema["quality_summary"].dataType.fields}
    number = lambda f: F.coalesce(F.col(f"quality_summary.{f}"), F.lit(0)) if f in has else F.lit(0)
    share = lambda f: F.format_string("%d%%", F.bround(number(f).cast("double") * 100).cast("long"))
    quality = F.format_string("> 覆盖率: %s | 平均置信度: %s | 异常项: %d\n\n---\n\n", share("coverage_rate"), share("avg_confidence"), number("exception_count"))
    head = F.format_string("# %s\n\n> 文档类型: %s | 知识原子: %d | QA 对: %d\n\n", F.coalesce("source", F.lit("")), F.coalesce("doc_type", F.lit("")), "total_chunks", "total_qa_pairs")
    page = F.concat(head, quality, F.array_join(F.transform("knowledge_atoms", atom), ""))  # ends in a blank line that only the lists need
    return docs.select("doc_id", F.when(tail == "", F.regexp_replace(page, r"\n\z", "")).otherwise(F.concat(page, tail)).alias("value"))


def _labelled(field: str, label: str) -> Column:
    items = F.coalesce(F.col(f"exception_list.{field}"), F.array().cast("array<string>"))
    return F.transform(items, lambda x: F.concat(F.lit(f"- **{label}**: "), x))


def to_summary_csv(docs: DataFrame) -> DataFrame:
    """A row per Q&A with its atom, keywords joined by ', '; a blank row for a document without Q&A."""
    rows = _qa(docs).select(
        _text("chunk_id").alias("知识原子ID"), _text("title").alias("标题"), _text("question").alias("问题"), _text("answer").alias("答案"),
        F.coalesce("confidence_score", F.lit(0)).cast("string").alias("置信度(%)"), _text("doc_type").alias("类型"), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", ").alias("关键词"),
    )
    blank = docs.filter(~F.exists("knowledge_atoms", lambda a: F.coalesce(F.size(a["qa_pairs"]), F.lit(0)) > 0))
    return rows.unionByName(blank.select(*[F.lit("").alias(c) for c in rows.columns]))


FORMATS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "coze_qa": (to_coze_qa, ".csv"), "coze_text": (to_coze_text, ".csv"), "dify_qa": (to_dify_qa, ".csv"), "dify_text": (to_dify_text, ".csv"),
    "dify_jsonl": (to_dify_jsonl, ".jsonl"), "json": (to_json_docs, ".json"), "md": (to_markdown, ".md"), "summary_csv": (to_summary_csv, ".csv"),
}


def register_format(name: str, build: Callable[[DataFrame], DataFrame], extension: str = ".csv") -> None:
    FORMATS[name] = (build, extension)


def export(docs: DataFrame, fmt: str, path: str) -> None:
    """Writes one format; an unknown one is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    build, extension = FORMATS[fmt]
    out = build(docs)
    if extension == ".csv":
        _csv_lines(out).write.text(path, lineSep="\r\n")
        _rename(docs.sparkSession, path, ".txt", extension)
    else:
        out.select("value").write.text(path)


def _rename(spark: SparkSession, path: str, before: str, after: str) -> None:
    """Gives the part files of a written folder another ending; what they hold stays where it is."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = paths(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(paths(path)):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(before) and not files.rename(status.getPath(), paths(path, name.removesuffix(before) + after)):
            raise OSError(f"cannot rename {name} in {path}")


def _csv_lines(rows: DataFrame) -> DataFrame:
    """(value): the lines of every file, all values quoted: the names first, after a byte order mark, by which spreadsheets know
    the encoding. A table without rows has one file with the names."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    head = BOM + ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    lines = rows.select(F.concat_ws(",", *[quoted(rows[f"`{c}`"]) for c in rows.columns]).alias("value"))

    def headed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([(head,)], "value string")
    return lines.mapInArrow(headed, "value string")


def export_all(docs: DataFrame, path: str) -> None:
    for fmt in FORMATS:
        export(docs, fmt, f"{path}/{fmt}")


def export_names(tasks: DataFrame, fmt: str) -> DataFrame:
    """Adds export_name: {stem}_{format}{extension}, the stem without quotes and line ends, the task id where there is none."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce("filename", F.lit("")), r"\.[^.]*$", ""), "[\"\r\n]", "")
    return tasks.withColumn("export_name", F.concat(F.when(stem == "", F.col("task_id")).otherwise(stem), F.lit(f"_{fmt}{FORMATS[fmt][1]}")))
