"""Structure of Markdown-like text as arrays within the row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line ends that Python's splitlines knows, and page-separator patterns.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
PAGE_MARK = r"<!-- page (\d+) -->"
SEPARATORS = (r"<!-- page \d+ -->", r"---\s*Page\s+\d+\s*---", r"\f")
HEADING = r"^(#{1,6})\s+(.+?)\s*$"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_ENDS)


def headings(df: DataFrame, col: str = "markdown") -> DataFrame:
    """Adds headings: (level, text, line), lines from 0."""
    every = F.transform(lines(F.col(col)), lambda s, i: F.struct(F.length(F.regexp_extract(s, HEADING, 1)).alias("level"), F.regexp_extract(s, HEADING, 2).alias("text"), i.alias("line")))
    return df.withColumn("headings", F.filter(every, lambda h: h["level"] > 0))


def pipe_tables(df: DataFrame, col: str = "markdown") -> DataFrame:
    """Adds pipe_tables: (start, end) lines of tables: a line with '|', a line with '---', and on while lines hold '|'."""
    df = df.withColumn("_l", lines(F.col(col)))
    bar = lambda i: F.coalesce(F.contains(F.get(F.col("_l"), i), F.lit("|")), F.lit(False))
    rule = lambda i: F.coalesce(F.contains(F.get(F.col("_l"), i), F.lit("---")), F.lit(False))
    kind = "struct<open:int,tables:array<struct<start:int,end:int>>>"
    zero = F.struct(F.lit(-1).alias("open"), F.array().alias("tables")).cast(kind)

    def step(s: Column, i: Column) -> Column:
        add = F.concat(s["tables"], F.array(F.struct(s["open"].alias("start"), (i - 1).alias("end"))))
        inside = s["open"] >= 0
        begins = bar(i) & rule(i + 1)
        keep = F.struct(s["open"].alias("open"), s["tables"].alias("tables"))
        close = F.struct(F.when(begins, i).otherwise(-1).alias("open"), add.alias("tables"))
        begin = F.struct(F.when(begins, i).otherwise(-1).alias("open"), s["tables"].alias("tables"))
        goes_on = bar(i) | (i == s["open"] + 1)
        return F.when(inside & goes_on, keep).when(inside, close).otherwise(begin).cast(kind)

    found = F.aggregate(F.sequence(F.lit(0), F.size("_l")), zero, step, lambda s: s["tables"])
    return df.withColumn("pipe_tables", found).drop("_l")


def _placed(text: Column, pattern: str) -> Column:
    """(match, start) of all matches, starts in characters from 0."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = "struct<at:int,hits:array<struct<text:string,start:int>>>"

    def step(s: Column, hit: Column) -> Column:
        start = s["at"] + F.length(F.get(gaps, F.size(s["hits"])))
        return F.struct((start + F.length(hit)).alias("at"), F.concat(s["hits"], F.array(F.struct(hit.alias("text"), start.alias("start")))).alias("hits")).cast(kind)

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().alias("hits")).cast(kind), step)["hits"]


def _line_of(text: Column, start: Column) -> Column:
    return F.length(F.regexp_replace(F.substring(text, 1, start), "[^\n]", ""))


def html_tables(df: DataFrame, col: str = "markdown") -> DataFrame:
    """Adds html_tables: (html, start, end) with the lines of both ends."""
    text = F.coalesce(F.col(col), F.lit(""))
    found = F.transform(
        _placed(text, r"(?is)<table[^>]*>.*?</table>"),
        lambda h: F.struct(h["text"].alias("html"), _line_of(text, h["start"]).alias("start"), _line_of(text, h["start"] + F.length(h["text"])).alias("end")),
    )
    return df.withColumn("html_tables", found)


def formulas(df: DataFrame, col: str = "markdown") -> DataFrame:
    """Adds formulas: (latex, line): blocks first, then inline ones that do not begin within a block."""
    text = F.coalesce(F.col(col), F.lit(""))
    df = df.withColumns({"_b": _placed(text, r"(?s)\$\$.+?\$\$"), "_i": _placed(text, r"(?<!\$)\$(?!\$)[^$\n]+?\$(?!\$)")})
    free = F.filter("_i", lambda x: ~F.exists("_b", lambda b: (x["start"] >= b["start"]) & (x["start"] < b["start"] + F.length(b["text"]))))
    clean = lambda h: F.struct(F.regexp_replace(h["text"], r"^\$+\s*|\s*\$+$", "").alias("latex"), _line_of(text, h["start"]).alias("line"))
    return df.withColumn("formulas", F.concat(F.transform("_b", clean), F.transform(free, clean))).drop("_b", "_i")


def page_count(df: DataFrame, col: str = "markdown", mode: str = "markers") -> DataFrame:
    """Adds page_count: distinct page markers, or (mode 'separators') the most frequent separator's count plus one."""
    text = F.coalesce(F.col(col), F.lit(""))
    if mode == "markers":
        return df.withColumn("page_count", F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1)))))
    most = F.greatest(*[F.regexp_count(text, F.lit(p)) for p in SEPARATORS])
    return df.withColumn("page_count", F.when(most > 0, most + 1).otherwise(0))


def profile(df: DataFrame, col: str = "markdown") -> DataFrame:
    """Adds char_count (code points) and is_empty."""
    text = F.coalesce(F.col(col), F.lit(""))
    return df.withColumns({"char_count": F.length(text), "is_empty": F.regexp_replace(text, r"(?U)\s", "") == ""})
