"""Segmentation, merging of parts, chunking, renumbering and the hand-over between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.columns import let

# Fixed values of the refinement rules.
CHUNK_MIN, CHUNK_MAX, SEGMENT_LIMIT, BATCH = 300, 800, 8000, 4
GRANULARITY_MARK = "【拆分颗粒度异常】"


def _fold(text: Column, sep: str, full: object) -> Column:
    """Packs the parts of a text in order; full(n, part) tells whether a non-empty segment of n characters ends before it.
    The fold keeps only part numbers and counts; segments are sliced from the parts afterwards."""
    parts = F.split(text, sep, -1)
    kind = "struct<cuts:array<int>,n:int,i:int>"
    zero = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("n"), F.lit(0).alias("i")).cast(kind)

    def step(s: Column, p: Column) -> Column:
        length = F.length(p) + 2
        cut = (s["n"] > 0) & full(s["n"], length)
        return F.struct(
            F.when(cut, F.concat(s["cuts"], F.array(s["i"]))).otherwise(s["cuts"]).alias("cuts"),
            F.when(cut, length).otherwise(s["n"] + length).alias("n"), (s["i"] + 1).alias("i"),
        ).cast(kind)

    cuts = F.aggregate(parts, zero, step, lambda s: s["cuts"])
    end = lambda k: F.coalesce(F.get(cuts, k + 1), F.size(parts))
    return F.transform(cuts, lambda a, k: F.array_join(F.slice(parts, a + 1, end(k) - a), sep))


def split_segments(df: DataFrame, limit: int = SEGMENT_LIMIT, sep: str = "\n\n", col: str = "text") -> DataFrame:
    """Explodes into seg_no and segment; joined by sep, the segments of a text give it back. Each part counts its length
    plus two; a part over the limit stays whole; a limit of 0 or less does not split. Null texts have no segment."""
    text = F.col(col)
    whole = F.array(text)
    segments = whole if limit <= 0 else F.when(F.length(text) <= limit, whole).otherwise(_fold(text, sep, lambda n, p: n + p > limit))
    kept = df.filter(text.isNotNull())
    return kept.select(*[c for c in df.columns if c != col], F.posexplode(segments).alias("seg_no", "segment"))


def chunk(df: DataFrame, low: int = CHUNK_MIN, high: int = CHUNK_MAX, sep: str = "\n", col: str = "text") -> DataFrame:
    """Explodes into chunk_no (from 1), chunk_id and content: parts are joined until low is reached or high would be passed;
    a part is never broken."""
    chunks = _fold(F.col(col), sep, lambda n, p: (n >= low) | (n + p > high))
    out = df.filter(F.col(col).isNotNull()).select(*[c for c in df.columns if c != col], F.posexplode(chunks).alias("_k", "content"))
    return out.withColumn("chunk_no", F.col("_k") + 1).withColumn("chunk_id", chunk_id(F.lit("P1"), F.col("_k") + 1)).drop("_k")


#: What begins a heading, and a question of a question list.
HEADING = r"^(#{1,6})\s+"
QUESTION = r"(?m)^(?=(?:#{1,6}\s+|\*\*)?(?:Q|问|问题)\s*\d*\s*[:：.]|#{1,6}\s[^\n]*[?？]\s*$)"
_HOLD, _INERT = "\ufdd3", "\ufdd2"  # stand for a break after a heading, and before a # that is none
_UNIT = "struct<cuts:array<struct<at:int,module:string,heading:string>>,n:int,level:int,stack:array<string>,i:int>"


def _units(text: Column, sep: str) -> Column:
    """The paragraphs of a text, each heading being part of what follows it; fenced code is one, and its lines are no headings."""
    fenced = F.transform(F.split(text, "(?m)^```"), lambda p, i: F.when(i % 2 == 1, F.replace(F.regexp_replace(p, "(?m)^#", _INERT + "#"), F.lit(sep), F.lit(_HOLD * len(sep)))).otherwise(p))
    plain = F.when(F.contains(text, F.lit("```")), F.array_join(fenced, "```")).otherwise(text)
    return F.split(F.regexp_replace(plain, rf"(?m)(^#{{1,6}}\s[^\n]*){sep}(?=[^\n])", "$1" + _HOLD * len(sep)), sep)


def _restored(unit: Column, sep: str) -> Column:
    return F.replace(F.replace(unit, F.lit(_HOLD * len(sep)), F.lit(sep)), F.lit(_INERT), F.lit(""))


def _sections(text: Column, sep: str, low: int, high: int) -> Column:
    """(content, module, heading) of the chunks of a text: paragraphs are joined until low is reached, high would be passed, or a
    heading leaves the topic, that is, stands above the heading that the chunk began under."""
    zero = F.struct(
        F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("heading"))).alias("cuts"),
        F.lit(0).alias("n"), F.lit(0).alias("level"), F.array_repeat(F.lit(None).cast("string"), 6).alias("stack"), F.lit(0).alias("i"),
    ).cast(_UNIT)

    def enter(stack: Column, line: Column) -> Column:
        depth = F.length(F.regexp_extract(line, HEADING, 1))
        return F.transform(stack, lambda x, k: F.when(k + 1 < depth, x).when(k + 1 == depth, F.trim(F.regexp_replace(line, HEADING + r"|\s*#*\s*$", ""))))

    def step(s: Column, unit: Column) -> Column:
        lines = F.filter(F.split(unit, f"[\n{_HOLD}]"), lambda x: x.rlike(HEADING))
        level = F.length(F.regexp_extract(unit, HEADING, 1))
        size = F.length(F.replace(unit, F.lit(_INERT), F.lit(""))) + len(sep)
        leaves = (level > 0) & ((s["level"] == 0) | (level < s["level"]))
        cut = (s["n"] > 0) & ((s["n"] >= low) | (s["n"] + size > high) | leaves)

        def put(stack: Column) -> Column:
            named = F.filter(stack, lambda x: x.isNotNull())
            one = F.array(F.struct(s["i"].alias("at"), F.get(named, F.size(named) - 2).alias("module"), F.get(named, F.size(named) - 1).alias("heading")))
            cuts = F.when(s["i"] == 0, one).when(cut, F.concat(s["cuts"], one)).otherwise(s["cuts"])
            inside = F.size(F.filter(F.slice(stack, 1, 6), lambda x: x.isNotNull()))
            begun = F.when(level > 0, level).otherwise(F.when(inside > 0, F.aggregate(F.transform(stack, lambda x, k: F.when(x.isNotNull(), k + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))).otherwise(0))
            return F.struct(cuts.alias("cuts"), F.when(cut, size).otherwise(s["n"] + size).alias("n"), F.when(cut | (s["i"] == 0), begun).otherwise(s["level"]).alias("level"), stack.alias("stack"), (s["i"] + 1).alias("i")).cast(_UNIT)

        return let(F.when(F.size(lines) > 0, F.aggregate(lines, s["stack"], enter)).otherwise(s["stack"]), put)

    def chunks(units: Column) -> Column:
        cuts = F.aggregate(units, zero, step, lambda s: s["cuts"])
        piece = lambda own, c, k: _restored(F.array_join(F.slice(units, c["at"] + 1, F.coalesce(F.get(own, k + 1)["at"], F.size(units)) - c["at"]), sep), sep)
        return let(cuts, lambda own: F.transform(own, lambda c, k: F.struct(piece(own, c, k).alias("content"), c["module"].alias("module"), c["heading"].alias("heading"))))

    return let(_units(text, sep), chunks)


def _questions(text: Column) -> Column:
    """(content, module, heading) of the pairs of a question list, what stands before the first being a chunk of its own."""
    pieces = F.filter(F.transform(F.split(text, QUESTION), lambda p: F.regexp_replace(p, r"\n+$", "")), lambda p: p != "")
    first = lambda p: F.trim(F.regexp_replace(F.split(p, "\n")[0], r"^[#*\s]+|\*+\s*$", ""))
    return F.transform(pieces, lambda p: F.struct(p.alias("content"), F.lit(None).cast("string").alias("module"), first(p).alias("heading")))


def chunk_sections(df: DataFrame, low: int = CHUNK_MIN, high: int = CHUNK_MAX, sep: str = "\n\n", col: str = "text", name: str = "source", doc_type: str | None = None) -> DataFrame:
    """Explodes Markdown into chunk_no (from 1), chunk_id, title and content. Content is the text as it stands: chunks end between
    paragraphs and never between a heading and what follows it, and do not run on into another topic; documents whose doc_type
    column says FAQ have a chunk for each question with its answer, whatever their sizes. Titles are 【module】- heading: the
    heading in force where the chunk begins below the one above it, else below the document's name; a text without headings has
    the first twelve characters. Texts that are null or have no character but line ends have no chunk."""
    text = F.col(col)
    of_type = F.coalesce(F.col(doc_type) == "FAQ", F.lit(False)) if doc_type else F.lit(False)
    chunks = F.when(of_type, _questions(text)).otherwise(_sections(text, sep, low, high))
    keep = [c for c in df.columns if c not in (col, "title", "content", "chunk_no", "chunk_id")]
    out = df.filter(text.rlike(r"[^\n]")).select(*keep, F.col(name).alias("_name"), F.posexplode(chunks).alias("_k", "_c"))
    heading = F.coalesce(F.when(F.col("_c.heading") != "", F.col("_c.heading")), F.substring(F.regexp_replace("_c.content", r"^\n+", ""), 1, 12))
    title = F.concat(F.lit("【"), F.coalesce("_c.module", "_name", F.lit("")), F.lit("】- "), heading)
    return out.select(*keep, (F.col("_k") + 1).alias("chunk_no"), chunk_id(F.lit("P1"), F.col("_k") + 1).alias("chunk_id"), title.alias("title"), F.col("_c.content").alias("content"))


def chunk_id(prefix: Column, number: Column) -> Column:
    return F.format_string("%s-C%03d", prefix, number)


def flag_granularity(atoms: DataFrame, low: int = CHUNK_MIN, high: int = CHUNK_MAX) -> DataFrame:
    """Adds granularity: the exception entry of atoms shorter than low or longer than high, else null."""
    n = F.length("content")
    return atoms.withColumn("granularity", F.when((n < low) | (n > high), F.format_string("%s: 拆分颗粒度异常-内容%d字", "chunk_id", n)))


def merge_cleaned(stage1: DataFrame) -> DataFrame:
    """(doc_id, text): trimmed non-blank segment texts in order, a blank line between them."""
    clean = F.regexp_replace("cleaned_text", r"(?U)^\s+|\s+$", "")
    parts = stage1.withColumn("_t", clean).filter("_t <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "_t"))).alias("p"))
    return parts.select("doc_id", F.array_join("p._t", "\n\n").alias("text"))


def majority_doc_type(stage1: DataFrame) -> DataFrame:
    """(doc_id, doc_type): the most frequent type of the segments, of equals the one seen first."""
    counts = stage1.groupBy("doc_id", "doc_type").agg(F.count("*").alias("n"), F.min("seg_no").alias("first"))
    return counts.groupBy("doc_id").agg(F.max_by("doc_type", F.struct("n", -F.col("first"))).alias("doc_type"))


def merge_items(stage1: DataFrame, col: str = "items") -> DataFrame:
    """(doc_id, items): the items of all segments in order, each once."""
    ordered = stage1.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", F.col(col).alias("x")))).alias("p"))
    return ordered.select("doc_id", F.array_distinct(F.flatten("p.x")).alias(col))


#: A whole chunk id, or a stretch without one.
ID_OR_REST = r"((?<![A-Za-z0-9])(?:P\d+-)?C\d+|(?:(?!(?<![A-Za-z0-9])(?:P\d+-)?C\d+)[\s\S])+)"


def renumber_chunks(stage2: DataFrame, prefix: str = "P1") -> DataFrame:
    """Adds chunk_no and new_chunk_id, consecutive per document over segments and positions."""
    order = Window.partitionBy("doc_id").orderBy("seg_no", "chunk_pos")
    return stage2.withColumn("chunk_no", F.row_number().over(order)).withColumn("new_chunk_id", chunk_id(F.lit(prefix), F.col("chunk_no")))


def remap_exceptions(exceptions: DataFrame, numbered: DataFrame) -> DataFrame:
    """Replaces the old chunk ids of a segment in exception texts by the new ones, each whole id by itself, so that crossing
    ids do not meet and no id is taken for a part of a longer one. exceptions: (doc_id, seg_no, item, ...); numbered: the
    result of renumber_chunks."""
    ids = numbered.groupBy("doc_id", "seg_no").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "new_chunk_id"))).alias("_m"))
    pieces = F.regexp_extract_all("item", F.lit(ID_OR_REST), F.lit(1))
    back = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("_m", p), p)), "")
    return exceptions.join(ids, ["doc_id", "seg_no"], "left").withColumn("item", F.when(F.col("_m").isNull(), F.col("item")).otherwise(back)).drop("_m")


def batch_chunks(chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds batch_no (from 0): size chunks each, in order; a size of 1 or less makes one batch."""
    if size <= 1:
        return chunks.withColumn("batch_no", F.lit(0))
    order = Window.partitionBy("doc_id").orderBy("chunk_no")
    return chunks.withColumn("batch_no", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def concat_batches(stage: DataFrame, col: str = "items") -> DataFrame:
    """(doc_id, items): the lists of all batches in order, repeats kept."""
    ordered = stage.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("batch_no", F.col(col).alias("x")))).alias("p"))
    return ordered.select("doc_id", F.flatten("p.x").alias(col))


def handover(stage2: DataFrame) -> DataFrame:
    """Chunks for the next stages: id, title, content and the document's prefix (P1 where there is no chunk id)."""
    first = F.first(F.split("chunk_id", "-")[0]).over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    return stage2.select("doc_id", "chunk_no", "chunk_id", "title", "content", F.coalesce(first, F.lit("P1")).alias("prefix"))
