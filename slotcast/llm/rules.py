r"""Quality rules: a threshold table compiled into one Spark projection.

Words are runs of ``[^\x20\x09-\x0D]``. Every measure is a built-in expression
over the words, lines and characters of one row, so a document needs no
shuffle, whatever its length. Three-word windows meet as 64-bit hashes; where some
are equal they are sorted within the row, and equal neighbours are compared word
by word.

Defined results: a null or empty text has no words, all counts are 0 and it
fails; a null id keeps its row; repeated rows are judged alike; an empty table
gives an empty result; other columns of ``documents`` are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

# Common function words of the corpus languages.
STOP_WORDS = (
    "the of and to in that is for it was on with as by this",
    "der die das und den von zu mit sich auf für ist im dem nicht",
    "le la les des et en un une du que qui dans pour sur est",
    "el los las y que del una por con para se su al lo como",
)

# measure, least, most; null: no bound. All ratios are between 0 and 1.
THRESHOLDS = (
    ("mean_word_length", 2.0, 25.0),
    ("symbol_ratio", None, 0.1),
    ("dup_line_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("bullet_line_ratio", None, 0.9),
    ("upper_ratio", None, 0.5),
)
LEAST_WORDS = 50
REPEATED_SHARE = 0.5


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each three-word window, in order."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )


def repeated_starts(words: Column, ordered: Column) -> Column:
    """First words of the windows in ``ordered`` (hash h, place i; sorted) that equal a neighbour word by word."""

    def same(a: Column, b: Column) -> Column:
        equal = [F.get(words, a["i"] + k) == F.get(words, b["i"] + k) for k in range(3)]
        return F.coalesce((a["h"] == b["h"]) & reduce(and_, equal), F.lit(False))

    alike = F.filter(ordered, lambda x, k: same(x, F.get(ordered, k + 1)) | same(x, F.get(ordered, k - 1)))
    return F.array_sort(F.transform(alike, lambda x: x["i"]))


def covered_words(starts: Column) -> Column:
    """Words inside the windows at the sorted ``starts``: three each, less what the next one shares."""
    step = lambda seen, i: F.struct(
        (seen["n"] + F.least(F.lit(3), i - seen["last"])).alias("n"), i.alias("last")
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(starts, none, step, lambda seen: seen["n"])


def counts(text: Column) -> dict[str, Column]:
    """Counts of a text from its ``words``, ``lines`` and the ``starts`` of repeated windows."""
    words, lines = F.col("words"), F.col("lines")
    stop = [w for group in STOP_WORDS for w in group.split()]
    return {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered_words(F.col("starts")), F.lit(0)),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
        "n_upper": F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}")), F.lit(0)),
    }


def ratios() -> dict[str, Column]:
    over = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return {
        "mean_word_length": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
        "bullet_line_ratio": over("n_bullets", "n_lines"),
        "upper_ratio": over("n_upper", "word_chars"),
    }


def verdict(thresholds: tuple = THRESHOLDS) -> Column:
    """The threshold table as one condition."""
    measures = ratios()
    tests = [
        test
        for name, least, most in thresholds
        for test in (
            [measures[name] >= least] * (least is not None) + [measures[name] <= most] * (most is not None)
        )
    ]
    return reduce(and_, tests, F.lit(True))


def judge(documents: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``documents``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.select(
        "doc_id",
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    hashed = split.withColumn("hashes", window_hashes(F.col("words")))
    # hashes that are all different belong to windows that are: nothing is sorted then
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.withColumn("ordered", F.when(some, F.sort_array(placed))).drop("hashes")
    found = ordered.withColumn("starts", repeated_starts(F.col("words"), F.col("ordered"))).drop("ordered")
    counted = found.select(
        "doc_id", *[c.cast("long").alias(name) for name, c in counts(F.col("text")).items()]
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > int(100 * REPEATED_SHARE) * F.col("n_words")
    )
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(thresholds)).alias("kept"),
    )
