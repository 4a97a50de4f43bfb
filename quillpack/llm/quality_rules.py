"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule bounds a ratio of lengths, symbols, stop words or lines. The measures
are array and string expressions over the whole text, so a row never leaves its
partition and the scan stays one stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# fixed values: frequent function words of the languages in the corpus
STOP_WORDS = """
the of and to in a is that for it as with on by this was are be from at or an not have but
der die das und ist in zu den von mit für auf nicht ein eine des im dem sich als auch es an
le la les de des et un une du en que qui dans est pour pas sur au par ce il elle ne se plus
el los las del y en un una que por con para es no se al lo como su más
""".split()


@dataclass(frozen=True)
class Rule:
    """Passes when least <= measure <= most."""

    name: str
    measure: str
    least: float = float("-inf")
    most: float = float("inf")


RULES = (
    Rule("enough_words", "n_words", 50),
    Rule("word_length", "chars_per_word", 2.5, 12),
    Rule("symbols", "symbols_per_word", 0, 0.1),
    Rule("stop_words", "stop_words", 2),
    Rule("repeated_words", "repeated_word_share", 0, 0.5),
    Rule("repeated_lines", "repeated_line_share", 0, 0.5),
    Rule("ellipsis_lines", "ellipsis_line_share", 0, 0.3),
    Rule("bullet_lines", "bullet_line_share", 0, 0.9),
)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df with every measure that a rule can name; df's own columns are not touched.

    A null text has no words. Column names that the measures need are taken
    from a struct, so clashing columns of df stay what they are.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), text.alias("_text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")).alias("_words"))
    shingle = lambda w, i: F.struct(F.concat_ws(" ", w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("g"), i.alias("i"))
    rows = rows.select(
        "_row", "_text", "_words",
        F.sort_array(F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))), shingle)).alias("_windows"),
        F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_lines"),
    )
    twice = lambda x, i: F.when((x["g"] == F.get("_windows", i - 1)["g"]) | (x["g"] == F.get("_windows", i + 1)["g"]), x["i"])
    rows = rows.withColumn("_repeats", F.sort_array(F.filter(F.transform("_windows", twice), lambda i: i.isNotNull())))
    covered = F.transform("_repeats", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("_repeats", i + 1) - at, F.lit(3))))
    share = lambda part, of: F.when(of > 0, part / of).otherwise(F.lit(0.0))
    lines = F.size("_lines")
    rows = rows.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(without(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda total, n: total + n).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("stop_words"),
        share(F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))), lines).alias("ellipsis_line_share"),
        share(F.size(F.filter("_lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "‣", "·"))), lines).alias("bullet_line_share"),
        lines.cast("long").alias("n_lines"),
    )
    return rows.select(
        "*",
        share(F.col("word_chars"), F.col("n_words")).alias("chars_per_word"),
        share(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeated_word_share"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("repeated_line_share"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True when every rule of the table passes."""
    passed = F.lit(True)
    for rule in rules:
        if rule.least != float("-inf"):
            passed = passed & (F.col(rule.measure) >= rule.least)
        if rule.most != float("inf"):
            passed = passed & (F.col(rule.measure) <= rule.most)
    return passed


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(df: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_row (the input row), all measures, base_failed and kept."""
    return measures(df, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(df: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass, with df's columns."""
    # a filter would be pushed below the projections, and all measures written out again in its condition
    return judge(df, text_col=text_col, rules=rules).select(F.inline(F.when(F.col("kept"), F.array("_row"))))
