r"""Fill-in-middle: texts cut into prefix, middle and suffix by one regular expression per row.

A unit is a code point, ``(?s:.)``. ``regexp_count`` gives the number n of units;
two seeded draws give the cuts a <= b. The pattern of the row,
``\A(unit{a}+)(unit{b-a}+)(unit*+)\z``, has possessive counted quantifiers: each
group takes its units once and never gives one back, so the whole text is
captured in one pass, whatever its length, and the replacement ``<P>$1<S>$3<M>$2``
(or ``<S>$3<P>$1<M>$2``) writes the output of that same match. Units are counted in
blocks first, so that a very long text does not become an array of its characters.

Everything is a built-in column expression over one row: no shuffle, no Python.

Defined results: a null or empty text stays plain and empty; a text that holds a
marker stays plain, so an output can always be read back (``restored``); a null id
draws like an empty one; repeated rows get equal results; an empty table gives an
empty result; other columns of ``documents`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNIT = "."
BLOCK = 1024


@dataclass(frozen=True)
class Settings:
    """Percentages of texts that are cut, and of these with the suffix first; the seed."""

    cut: int = 90
    suffix_first: int = 20
    seed: int = 1


def units(text: Column) -> Column:
    """Number of code points of ``text``.

    ``regexp_count`` lists its matches: whole blocks are counted, then the units
    after them, so that list never has more than one entry per block and rest unit.
    """
    blocks = F.regexp_count(text, F.lit(f"(?s){UNIT}{{{BLOCK}}}")).cast("long") * BLOCK
    after = F.concat(F.lit(f"(?s)\\A{UNIT}{{"), blocks.cast("string"), F.lit(f"}}+({UNIT}*+)\\z"))
    rest = F.call_function("regexp_extract", text, after, F.lit(1))
    return blocks + F.regexp_count(rest, F.lit(f"(?s){UNIT}"))


def draws(doc_id: Column, seed: int) -> Column:
    """Four numbers below 2**32 that follow from the id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def pattern(a: Column, b: Column) -> Column:
    """The expression that captures prefix, middle and suffix of one row."""
    return F.concat(
        F.lit(f"(?s)\\A({UNIT}{{"), a.cast("string"), F.lit(f"}}+)({UNIT}{{"), (b - a).cast("string"),
        F.lit(f"}}+)({UNIT}*+)\\z"),
    )


def cut(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``documents``."""
    text, h = F.col("text"), F.col("h")
    drawn = documents.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).select(
        "doc_id", "text", units(text).alias("n"), draws(F.col("doc_id"), settings.seed).alias("h")
    )
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(marker)
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = (
        F.when((F.col("n") == 0) | marked | (h[2] % 100 >= settings.cut), PLAIN)
        .when(h[3] % 100 < settings.suffix_first, SPM).otherwise(PSM)
    )
    placed = drawn.select(
        "doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b")
    )
    parts = F.when(
        F.col("form") == SPM, F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    ).otherwise(F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"))
    is_cut = F.col("form") != PLAIN
    output = F.when(is_cut, F.regexp_replace(text, pattern(F.col("a"), F.col("b")), parts)).otherwise(text)
    return placed.select(
        "doc_id", "n", "form", F.when(is_cut, F.col("a")).alias("prefix_chars"),
        F.when(is_cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A text that is cut holds no marker,
    so the first of each marker in the output is the one that was written."""
    psm = rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z"
    spm = rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z"
    return (
        F.when(form == PSM, F.regexp_replace(output, psm, "$1$3$2"))
        .when(form == SPM, F.regexp_replace(output, spm, "$2$3$1")).otherwise(output)
    )


def digests(cut_texts: DataFrame) -> DataFrame:
    """The rows of ``cut`` with digests in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut_texts.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
