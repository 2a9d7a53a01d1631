"""Line-first quality rules, in DataFrame functions only.

Punctuation, symbol, navigation and boilerplate rules judge each line; failing lines are removed, and a document that
loses too large a share of its characters is rejected. Beside them stand document measures (words, symbols, repeated
lines and repeated five-word windows). Everything is computed within the row, by expressions that are linear (or n log n,
for texts with repeats) in the text: no shuffle, no Python, and no row is larger than its own text's arrays.

Defined results: a null or empty text has zero for every measure, fails the base rule (under 10 words) and is not kept;
repeated rows are judged alike; an empty table gives an empty table; only the id and text columns are used, so further
columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import SEPARATOR_CHARS, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A line that starts with one of these words and has a menu separator is navigation.
NAVIGATION = ("home", "menu", "about", "contact", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back", "skip", "share", "search")
#: Phrases of boilerplate lines.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "uses cookies", "enable javascript", "click here", "subscribe to our", "lorem ipsum")

NAVIGATION_PATTERN = "(?i)^(" + "|".join(NAVIGATION) + r")\b.*( [|>»·] |\t)"
BOILERPLATE_PATTERN = "(?i)(" + "|".join(BOILERPLATE) + ")"
TERMINAL_PATTERN = r"""[.!?:;,"')\]…]$"""

#: Words of a window of the repetition measure.
WINDOW = 5
#: A line without a closing mark fails if it has fewer words.
LEAST_LINE_WORDS = 4
#: A line fails if over this per cent of its characters are symbols.
MOST_SYMBOL_PERCENT = 20
#: A document is rejected if its failing lines hold over this per cent of its characters (blank lines aside).
MOST_LOST_PERCENT = 50


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line (trimmed, not blank) fails a rule."""
    short = F.size(F.split(line, r"[\x20\x09-\x0D]+", LEAST_LINE_WORDS)) < LEAST_LINE_WORDS
    return (
        (short & ~line.rlike(TERMINAL_PATTERN))
        | (count_chars(line, SYMBOLS) * 100 > F.length(line) * MOST_SYMBOL_PERCENT)
        | line.rlike(NAVIGATION_PATTERN)
        | line.rlike(BOILERPLATE_PATTERN)
    )


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x))


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, text), text not null, with measures, the cleaned text and the verdict."""
    step = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n", -1).alias("raw_lines"))
    step = step.select("*", F.filter("raw_lines", lambda x: F.btrim(x, F.lit(SEPARATOR_CHARS)) != "").alias("lines"))
    step = step.select(
        "*",
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.filter(F.transform("lines", lambda x: F.btrim(x, F.lit(SEPARATOR_CHARS))), lambda x: ~line_fails(x)).alias("good"),
        F.transform("lines", lambda x: F.btrim(x, F.lit(SEPARATOR_CHARS))).alias("trimmed"),
    )
    # Only a text with a window twice needs its windows in order, with their places.
    step = step.select(
        "*",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("in_order"),
    )
    in_order = F.col("in_order")
    same = lambda x, j: F.coalesce(F.get(in_order, j)["h"] == x["h"], F.lit(False))
    step = step.select("*", F.sort_array(F.transform(F.filter(in_order, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])).alias("found"))
    found = F.col("found")
    covered = F.aggregate(
        F.transform(found, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(found, j + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda n, x: n + x,
    )
    step = step.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.translate("text", SEPARATOR_CHARS, ""))).alias("separators"),
        F.length("text").alias("length"),
        count_chars(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join("good", "\n").alias("clean_text"),
        (_chars(F.col("trimmed")) - _chars(F.col("good"))).alias("lost_chars"),
        _chars(F.col("trimmed")).alias("line_chars"),
    )
    step = step.select(
        "doc_id",
        "n_words",
        (F.col("length") - F.col("separators")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        "clean_text",
        "lost_chars",
        "line_chars",
    )
    return step.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("line_chars") * MOST_LOST_PERCENT))
