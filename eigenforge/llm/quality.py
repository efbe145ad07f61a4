"""Line-first quality rules (operator 5), in DataFrame functions only.

Lines are judged by punctuation, navigation, symbol, capitals and boilerplate rules; failing lines go, and a document
that loses too much of its text with them is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sets the contract names.
SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Shares of a line's characters beyond which it fails, separators that make a line navigation, and the percentage of
#: its text that a document may lose.
MAX_SYMBOL_PERCENT, MAX_CAPITAL_PERCENT, MAX_SEPARATORS, MAX_LOST_PERCENT = 5, 40, 3, 30
SENTENCE_END = "[.!?…。！？]"
SEPARATORS = "[|»›•·]"
CAPITALS = r"\p{Lu}"
MIN_CAPITAL_CHARS = 16
BOILERPLATE = (
    "(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved|accept (all )?cookies|enable javascript"
    "|javascript is (disabled|required)|sign in to|log in to|subscribe to our|click here to|skip to content|lorem ipsum)"
)


def line_fails(line: Column) -> Column:
    """Whether a line with words fails: no sentence mark, navigation separators, symbols, capitals, or boilerplate."""
    n = F.length(line)
    return (
        ~line.rlike(SENTENCE_END)
        | (F.regexp_count(line, F.lit(SEPARATORS)) >= MAX_SEPARATORS)
        | (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > n * MAX_SYMBOL_PERCENT)
        | ((n >= MIN_CAPITAL_CHARS) & (F.regexp_count(line, F.lit(CAPITALS)) * 100 > n * MAX_CAPITAL_PERCENT))
        | line.rlike(BOILERPLATE)
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its counts, line verdicts and cleaned text.

    Gives doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, lost_chars, line_chars,
    base_failed, kept, clean_text, and the columns to carry as a struct `carried`. A null text counts as empty: no words, so it fails the base rules. Repeated rows
    are judged alike and all returned; an empty table gives none; no row is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.struct(*carry).alias("carried"))
    d = d.select(
        "doc_id",
        "carried",
        "text",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(NON_SPACE)).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    d = d.select("*", windows.alias("hashes"), F.filter("lines", line_fails).alias("bad"))
    # Only texts in which some window comes back pay for the rest: hashes sorted with their places, then those with an
    # equal neighbour, then how far their windows reach before the next one begins.
    placed = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.select("*", placed.alias("placed"))
    same = lambda a, b: F.coalesce(F.get("placed", a)["h"] == F.get("placed", b)["h"], F.lit(False))
    again = F.array_sort(F.transform(F.filter("placed", lambda x, j: same(j, j - 1) | same(j, j + 1)), lambda x: x["i"]))
    d = d.select("*", again.alias("again"))
    reach = F.transform("again", lambda p, j: F.coalesce(F.least(F.get("again", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    n_repeat = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    d = d.select(
        "doc_id",
        "carried",
        "text",
        "lines",
        "bad",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.size("bad").cast("long").alias("n_bad_lines"),
        F.length(F.array_join("bad", "")).cast("long").alias("lost_chars"),
        F.length(F.array_join("lines", "")).cast("long").alias("line_chars"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    loses = F.col("lost_chars") * 100 > F.col("line_chars") * MAX_LOST_PERCENT
    clean = F.when(F.col("n_bad_lines") == 0, F.col("text")).otherwise(F.array_join(F.filter("lines", lambda x: ~line_fails(x)), "\n"))
    # A verdict that isn't deterministic to the optimizer stays above these projections: a filter on it, pushed below,
    # would have every expression spelled out again within the functions over arrays.
    kept = ~base & ~loses & (F.spark_partition_id() >= 0)
    return d.select(*[c for c in d.columns if c not in ("text", "lines", "bad")], base.alias("base_failed"), kept.alias("kept"), clean.alias("clean_text"))


def verdicts(docs: DataFrame) -> DataFrame:
    return measure(docs).drop("clean_text", "carried")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
l AS (
  SELECT *, list_filter(lines, lambda x: NOT regexp_matches(x, '{SENTENCE_END}')
      OR len(regexp_extract_all(x, '{SEPARATORS}')) >= {MAX_SEPARATORS}
      OR len(regexp_extract_all(x, '{SYMBOLS}')) * 100 > length(x) * {MAX_SYMBOL_PERCENT}
      OR (length(x) >= {MIN_CAPITAL_CHARS} AND len(regexp_extract_all(x, '{CAPITALS}')) * 100 > length(x) * {MAX_CAPITAL_PERCENT})
      OR regexp_matches(x, '{BOILERPLATE}')) AS bad
  FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY 1),
m AS (
  SELECT l.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(bad) AS BIGINT) AS n_bad_lines,
         CAST(coalesce(length(array_to_string(bad, '')), 0) AS BIGINT) AS lost_chars,
         CAST(coalesce(length(array_to_string(lines, '')), 0) AS BIGINT) AS line_chars
  FROM l LEFT JOIN cov ON l.doc_id = cov.doc_id)
SELECT *, (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AS base_failed,
       (NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT})
        AND NOT lost_chars * 100 > line_chars * {MAX_LOST_PERCENT}) AS kept
FROM m
"""
