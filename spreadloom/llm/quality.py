"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Counts of a text (words are runs outside space and \\t-\\r):

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``#*$%&|<>``);
* ``n_dup_lines``: lines with a word that equal an earlier line;
* ``n_repeat_words``: words inside a window of three words that occurs twice or more in the text;
* ``n_stop_words`` (words of a fixed list, whatever their case and the marks around them), ``n_lines`` (lines with a word).

Defined cases: a null or empty text has zero of everything and fails the base rule; rows are independent, so ties and
repeated rows get equal answers; extra columns pass through ``score`` untouched; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au aux avec dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "auf das dem den der die ein eine für ist im in mit nicht und von zu "
    "con del el es lo los las no para por se su una y"
).split()

#: Marks that may stand around a word.
MARKS = ".,;:!?\"'()[]"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a zero denominator makes the ratio 0."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)


def counts(text: Column) -> dict[str, Column]:
    """Expressions of everything that needs no array of windows."""
    return {
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def compiled(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression for the whole table of rules."""
    verdict = F.lit(True)
    for rule in rules:
        top = F.col(rule.numerator)
        ratio = top if rule.denominator is None else F.coalesce(F.try_divide(top, F.col(rule.denominator)), F.lit(0.0))
        if rule.low is not None:
            verdict = verdict & (ratio >= F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (ratio <= F.lit(rule.high))
    return verdict


def score(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Add the counts, ``base_failed`` and ``kept`` to every row of ``df``; no row is moved or dropped.

    Repeated windows are found on sorted 64-bit hashes of the windows, and only in texts in which two windows hash alike.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACE))
    out = df.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1)))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    out = out.withColumn("_lines", lines).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.slice("_hashes", 1, F.greatest(F.size("_hashes") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)))
    out = out.withColumn("_windows", windows)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(repeats, placed))
    same = lambda e, k, step: F.coalesce(F.get("_sorted", k + step)["h"] == e["h"], F.lit(False))
    starts = F.sort_array(F.filter(F.transform("_sorted", lambda e, k: F.when(same(e, k, -1) | same(e, k, 1), e["i"])), lambda p: p.isNotNull()))
    out = out.withColumn("_starts", starts)
    covered = F.aggregate(F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns(
        counts(body)
        | {
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(F.btrim(w, F.lit(MARKS))).isin(*STOP_WORDS))).cast("long"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
    return out.drop("_words", "_hashes", "_windows", "_sorted", "_starts", "_lines")


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that the rules keep, with their counts.

    The row number holds the filter above the projection; pushed below it, every rule would count its own words anew.
    """
    scored = score(df, text, rules).withColumn("_place", F.monotonically_increasing_id())
    return scored.where(F.col("kept") & (F.col("_place") >= 0)).drop("_place")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: lower(trim(x, '{MARKS.replace("'", "''")}')) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_stop_words, base_failed,
       NOT base_failed AND coalesce(word_chars / nullif(n_words, 0), 0) BETWEEN 2.0 AND 16.0
       AND coalesce(n_symbols / nullif(n_words, 0), 0) <= 0.1 AND coalesce(n_stop_words / nullif(n_words, 0), 0) >= 0.02
       AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AS kept
FROM f
"""
