"""Quality rules: clean texts line by line, then reject documents that lost too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import position

#: A line is boilerplate if it matches, whatever its case.
BOILERPLATE = (
    "all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie|javascript"
    "|lorem ipsum|sign (in|up)|log ?in|click here|read more|subscribe|newsletter|copyright|©|powered by|advertisement"
)
#: A line is navigation if it has at least three cells between such marks.
NAVIGATION = "[|»›•·][^|»›•·]*[|»›•·]"
#: Sentence ends, with closing quotes or brackets; a clean line has one at its end, or is prose cut off after a sentence.
TERMINAL = "[.!?…。！？:;][\"'”’»)\\]]*$"
PROSE = "[.!?…。！？,] \\S"
#: Marks that prose does not hold in runs.
SYMBOLS = "!!|[#$%&*~^=_<>{}]{2,}"
#: A line of at least so many words is repetitive if fewer than this share of them are distinct.
REPEAT_WORDS, REPEAT_SHARE = 8, 0.34
MIN_KEPT = 0.5


def _bare(line: Column) -> Column:
    """The line without blanks, tabs and carriage returns at either end."""
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def line_verdicts(line: Column) -> dict[str, Column]:
    """Rules that fail a line, by name; blank lines fail none. line must be trimmed."""
    words = F.split(line, " ")
    return {
        "repetition": (F.size(words) >= REPEAT_WORDS) & (F.size(F.array_distinct(words)) < F.size(words) * F.lit(REPEAT_SHARE)),
        "boilerplate": F.lower(line).rlike(BOILERPLATE),
        "navigation": line.rlike(NAVIGATION),
        "symbols": line.rlike(SYMBOLS),
        "punctuation": ~line.rlike(TERMINAL) & ~line.rlike(PROSE),
    }


def clean_lines(docs: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    """Evaluates the rules on each line, removes lines that fail and rejects documents that lose too much.

    Result, one row per document row: (doc_id, text, n_lines, removed, kept_share, keep). text holds the lines that
    passed, unchanged and in order, blank ones included; kept_share is their characters over the characters of all
    lines (without ASCII whitespace at either end; a line of such alone is blank); keep is kept_share >= min_kept.

    Defined results: a null text counts as empty; texts without any character have kept_share 0 and are rejected.
    Ties and repeated rows don't matter, as each row is judged on its own. An empty table gives an empty result.

    At scale: one scan, no shuffle and no Python; the text is split once and the rules run as JVM expressions.
    """
    at = {n: position(docs, n) for n in ("doc_id", "text")}
    safe = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(f"__c{at['text']}"), F.lit(""))
    split = safe.select(F.col(f"__c{at['doc_id']}").alias("doc_id"), F.split(text, "\n", -1).alias("all_lines"))

    def passes(x: Column) -> Column:
        t = _bare(x)
        bad = F.lit(False)
        for rule in line_verdicts(t).values():
            bad = bad | rule
        return (t == "") | ~bad

    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(_bare(x)))
    kept = split.withColumn("kept_lines", F.filter("all_lines", passes))
    sized = kept.withColumn("n_before", total(F.col("all_lines"))).withColumn("n_after", total(F.col("kept_lines")))
    share = F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before")).otherwise(0.0)
    out = sized.select(
        "doc_id",
        F.array_join("kept_lines", "\n").alias("text"),
        F.size("all_lines").alias("n_lines"),
        (F.size("all_lines") - F.size("kept_lines")).alias("removed"),
        share.alias("kept_share"),
    )
    return out.withColumn("keep", F.col("kept_share") >= F.lit(min_kept))
