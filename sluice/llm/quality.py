"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every rule is a row (name, measure, bound, value, least_words); compile_rules() turns the table into a single boolean
column, so adding a rule adds an expression to the same projection and never another pass, a shuffle or a user function.

Defined cases: null text counts as empty (no words, so base_failed); text of white space only likewise; a null doc_id is
kept as it is; repeated rows give repeated results; other columns of the input pass through score() untouched, and its own
columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import table

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    # English
    "the of and to in is that for it was as with be by on not he this are or his from at which but have an had they you "
    # French
    "le la les des du un une et est que qui dans pour par sur au aux ce il pas ne se avec plus de en "
    # German
    "der die das und ist ein eine den von zu mit sich auf für im dem nicht es auch als er bei sie so "
    # Spanish
    "el los las del y es una con su al lo como más pero sus para o por no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document of at least least_words words is rejected when its measure is below ('<') or above ('>') the value."""

    name: str
    measure: str
    bound: str
    value: float
    least_words: int = 0


RULES = (
    Rule("word_length_low", "mean_word_length", "<", 2.0),
    Rule("word_length_high", "mean_word_length", ">", 14.0, 20),
    Rule("symbols", "symbol_ratio", ">", 0.25),
    Rule("stop_words", "stop_ratio", "<", 0.02, 50),
    Rule("duplicate_lines", "dup_line_ratio", ">", 0.5),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), n_lines and n_stop_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike("[^ \\t-\\r]"))
    df = df.withColumns({"_words": _words(t), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))).cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)]),
    )
    df = df.withColumn("_windows", F.when(F.col("n_words") > WINDOW, windows))
    at = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeated, F.sort_array(at)))
    here = lambda k: F.get(F.col("_sorted"), k)["h"]
    starts = F.sort_array(
        F.transform(
            F.filter("_sorted", lambda x, k: (here(k - 1) == x["h"]) | (here(k + 1) == x["h"])), lambda x: x["i"]
        )
    )
    df = df.withColumn("_starts", starts)
    covered = F.aggregate(
        F.col("_starts"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return df.drop("_words", "_lines", "_hashes", "_windows", "_sorted", "_starts")


def ratios() -> dict[str, Column]:
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_length": F.col("word_chars") / per_word,
        "symbol_ratio": F.col("n_symbols") / per_word,
        "stop_ratio": F.col("n_stop_words") / per_word,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one column: true where some rule rejects."""
    measure = ratios()

    def fails(rule: Rule) -> Column:
        x = measure[rule.measure]
        return (F.col("n_words") >= rule.least_words) & ((x < rule.value) if rule.bound == "<" else (x > rule.value))

    return reduce(lambda a, b: a | b, map(fails, rules), F.lit(False))


def score(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The input with its measures, base_failed and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(df, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~compile_rules(rules))


def keep(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows whose verdict is kept, with the columns of df. The row number in the filter keeps Catalyst from moving it
    below the projection, where every measure would be computed again inside the next one's lambdas."""
    scored = score(df, rules, text).withColumn("_row", F.monotonically_increasing_id())
    return scored.filter("kept AND _row >= 0").select(*df.columns)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls
  FROM documents
), starts AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5))
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM starts, (SELECT unnest(range(0, 5)) AS k) WHERE starts.n > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: x IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop
  FROM w LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ({{rejected}}) AS kept
FROM b
"""

# The measures of RULES as SQL over the columns of the query above.
SQL_MEASURES = {
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "stop_ratio": "n_stop / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
}
REJECTED_SQL = " OR ".join(
    f"(n_words >= {r.least_words} AND {SQL_MEASURES[r.measure]} {r.bound} CAST({r.value} AS DOUBLE))" for r in RULES
)
ORACLE_SQL = ORACLE_SQL.replace("{rejected}", REJECTED_SQL)
