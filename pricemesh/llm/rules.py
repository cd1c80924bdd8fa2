"""Quality rules as one native projection: counts and ratios per text, judged by a table of thresholds.

Everything is a built-in column expression: no user function, no shuffle, one pass over the text.
Null text counts as empty. Rows are judged one by one, so ties, repeated rows and an empty table need no
special care; all columns of the input stay, except that columns named like a measure are replaced.
Texts of any length are measured whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it was on are as with be at by this from or an not have has but they we you he she his her "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec être ou son "
    "el los y a del las por con no su para como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser"
).split()


class Rule(NamedTuple):
    """A measure must lie in [low, high]; an open end is None."""

    measure: str
    low: float | None
    high: float | None


#: Texts that fail the base rule are rejected whatever this table says.
THRESHOLDS = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("mark_ratio", None, 0.20),
    Rule("stop_ratio", 0.05, None),
    Rule("upper_ratio", None, 0.50),
    Rule("dup_line_ratio", None, 0.50),
)
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "mean_word_chars",
    "symbol_ratio", "mark_ratio", "stop_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio",
)

#: Names used on the way; columns of docs called so are dropped.
WORKING = ("_words", "_lines", "_marks", "_upper", "_grams", "_ordered")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def _ordered(grams: Column) -> Column:
    """Window hashes with their positions, sorted, so equal windows stand side by side."""
    return F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("h"), i.alias("i"))))


def _covered(ordered: Column) -> Column:
    """Number of words inside windows whose hash stands beside its equal."""

    def same(i: Column, x: Column) -> Column:
        return F.coalesce(x["h"] == F.get(ordered, i)["h"], F.lit(False))

    starts = F.transform(ordered, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["i"]))
    starts = F.filter(starts, lambda p: p.isNotNull())
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures to every row of docs.

    Lengths are code points. n_dup_lines counts lines with a word that equal an earlier line of the text;
    n_repeat_words counts words in 3-word windows found twice or more in the text; windows are told apart by
    64-bit hashes, and only texts in which a hash repeats pay for the sort that finds where.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, *WORKING)]
    split = docs.select(
        *keep,
        F.filter(F.split(body, SPACES), lambda w: w != "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(body, SPACES, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(body, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(body, r"[\p{L}\p{N}\x20\x09-\x0D]+", "")).cast("bigint").alias("_marks"),
        F.length(F.regexp_replace(body, r"\P{Lu}+", "")).cast("bigint").alias("_upper"),
    )
    words = F.col("_words")
    gram = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    grams = split.select("*", F.slice(gram, 1, F.greatest(F.size(words) - 2, F.lit(0))).alias("_grams"))
    repeats = F.size(F.array_distinct(F.col("_grams"))) < F.size(F.col("_grams"))
    ranked = grams.select("*", F.when(repeats, _ordered(F.col("_grams"))).alias("_ordered"))
    n = F.size(words).cast("bigint")
    stops = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
    counted = ranked.select(
        *keep,
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_ordered").isNull(), 0).otherwise(_covered(F.col("_ordered"))).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        _ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), n).alias("symbol_ratio"),
        _ratio(F.col("_marks"), F.col("word_chars")).alias("mark_ratio"),
        _ratio(stops, n).alias("stop_ratio"),
        _ratio(F.col("_upper"), F.col("word_chars")).alias("upper_ratio"),
    )
    return counted.select(
        "*",
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def failed_rules(thresholds: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """Names of the measures outside their bounds, in table order: the whole table as one expression."""
    checks = []
    for rule in thresholds:
        value, outside = F.col(rule.measure), F.lit(False)
        if rule.low is not None:
            outside = outside | (value < rule.low)
        if rule.high is not None:
            outside = outside | (value > rule.high)
        checks.append(F.when(outside, F.lit(rule.measure)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")


def judge(docs: DataFrame, text: str = "text", thresholds: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """docs with measures, base_failed, failed_rules (array) and kept."""
    clean = docs.drop("base_failed", "failed_rules", "kept")
    judged = measure(clean, text).withColumns({"base_failed": base_failed(), "failed_rules": failed_rules(thresholds)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
