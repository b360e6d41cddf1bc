r"""Benchmark decontamination by a prefix-filtered set join.

Texts are lower-cased (A-Z) and cut into words of letters and digits. A window
is ``WINDOW`` consecutive words of an item, or the whole item if it is shorter,
as the set of its shingles with their places. A document holds a window if it
holds all of them, so one shingle of each window is a necessary prefix: the
rarest. Documents meet windows on that shingle alone.

1. Shingles are ordered by rarity in the benchmark, and each window has the first
   one of its own as prefix.
2. A place of a document whose shingle is the prefix of a window is a candidate,
   if the window around it fits into the document (positional and length bound).
   It takes the words around it along, as many as a window can reach, and the
   window's words are compared with them one by one.

One pass looks at every shingle of every text, but only those go into a shuffle
whose bit is set in a bitmap of the prefixes. It has ``BITS`` bits, whatever the
benchmark's size: shingles that share a bit with a prefix cost a row and are told
apart by their hash, and windows by their words, so results are exact. A shingle
that many documents hold meets its windows in a join that adaptive execution splits.

Defined results: null and empty texts have no words; an item without words is
ignored; a null item id counts as an empty string and rows of one item id as
one item; null ids keep their rows; repeated rows get equal results; texts of any
length are searched whole; with an empty benchmark nothing is hit; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm.store import settled, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, said by what they are made of: listed characters are looked up
# in one table, ranges are tried one after the other, which takes ten times as long.
_OTHERS = r"0123456789\x{80}-\x{10FFFF}"
WORD = f"[{_LOWER}{_OTHERS}]+"
ANY_CASE = f"[{_LOWER}{_UPPER}{_OTHERS}]+"
WINDOW = 10
SHINGLE = 3
BITS = 1 << 18


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), 0)


def _gram_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash of each run of ``width`` words, in order."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))


def _bit(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(BITS))


def _bitmap(hashes: DataFrame) -> Column:
    """The bits of the column ``gram``, as one array of 64 bits each: one value of fixed size."""
    word, value = F.shiftright("bit", 6).alias("i"), F.expr("shiftleft(1L, cast(bit % 64 AS int))")
    bits = hashes.select(_bit(F.col("gram")).alias("bit")).distinct()
    some = bits.select(word, value.alias("value")).groupBy("i").agg(F.bit_or("value").alias("value"))
    every = hashes.sparkSession.range(BITS // 64).withColumnRenamed("id", "i").join(some, "i", "left")
    pairs = F.array_sort(F.collect_list(F.struct("i", F.coalesce("value", F.lit(0).cast("long")).alias("value"))))
    return every.agg(F.transform(pairs, lambda x: x["value"]).alias("bits")).scalar()


def _places(documents: DataFrame, width: int, sought: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, pos and gram of the places of the documents whose shingle has a bit of ``sought`` (gram).

    ``keep`` may use the columns id, h, words and pos.
    """
    words = documents.select(*_keys(), words_of(F.col("text")).alias("words"))
    hashed = words.withColumn("grams", _gram_hashes(F.col("words"), width))

    def set_(i: Column) -> Column:
        bit = _bit(F.get("grams", i))
        return F.bit_get(F.get("bits", F.shiftright(bit, 6).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1

    places = F.when(F.size("grams") > 0, F.filter(F.sequence(F.lit(0), F.size("grams") - 1), set_))
    marked = hashed.withColumn("bits", _bitmap(sought)).withColumn("places", places).drop("bits")
    # outer, since Spark would move a filter on the size of ``places`` below the hashes, which are then
    # worked out anew for every place
    found = marked.withColumn("pos", F.explode_outer("places")).filter(F.col("pos").isNotNull())
    return found.select(*keep, "pos", F.get("grams", F.col("pos")).alias("gram"))


def _keys() -> list[Column]:
    return [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"),
    ]


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, wid, len, words): every window of every item."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    items = benchmark.select(item, words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return (
        items.select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at"), window).alias("words"))
        .select("item", F.array_join("words", " ").alias("wid"), F.size("words").alias("len"), "words")
        .distinct()
    )


def prefixes(windows: DataFrame, width: int, shingle: int) -> DataFrame:
    """(gram, wid, at, words): the rarest shingle of each window and its place in it.

    ``windows`` has distinct (wid, words); those with shingles of another width are
    left out. Rare is what few windows hold; of equals the longest in characters,
    as long words are rare in any text.
    """
    own = windows.filter(F.least(F.size("words"), F.lit(shingle)) == width)
    grams = own.select("wid", "words", F.posexplode(_gram_hashes(F.col("words"), width)).alias("at", "gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    size = F.char_length(F.array_join(F.slice("words", F.col("at") + 1, width), ""))
    rarest = F.min(F.struct(F.col("n"), (-size).alias("short"), F.col("gram"), F.col("at"))).alias("least")
    return (
        grams.join(often, "gram").groupBy("wid").agg(rarest, F.any_value("words").alias("words"))
        .select("least.gram", "wid", "least.at", "words")
    )


def candidates(documents: DataFrame, prefix: DataFrame, width: int, window: int) -> DataFrame:
    """(id, h, start, wid, words, there) of the places where a window's prefix
    stands and the window fits: the words of the window and those that stand there."""
    reach = window - 1
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.slice("words", low + 1, F.col("pos") - low + 1 + reach)
    places = _places(
        documents, width, prefix.select("gram"), F.col("id"), F.col("h"), F.size("words").alias("n_words"),
        low.alias("low"), around.alias("around"),
    )
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    return places.join(prefix, "gram").filter(fits).select(
        "id", "h", start.alias("start"), "wid", "words",
        F.slice("around", start - F.col("low") + 1, F.size("words")).alias("there"),
    )


def occurrences(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE):
    """(id, h, start, len, wid) of every window in every document, and the windows (item, wid)."""
    if shingle > window:
        raise ValueError("a shingle is longer than a window")
    windows = stored(item_windows(benchmark, window))
    distinct = windows.select("wid", "words").distinct()
    widths = [r[0] for r in windows.select(F.least("len", F.lit(shingle))).distinct().collect()] or [shingle]
    found = []
    for width in widths:
        prefix = stored(prefixes(distinct, width, shingle))
        met = candidates(documents, prefix, width, window).filter(F.col("there") == F.col("words"))
        found.append(met.select("id", "h", "start", F.size("words").alias("len"), "wid"))
    return reduce(DataFrame.union, found).distinct(), windows.select("item", "wid").distinct()


def _hit_rows(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(id, h, n_hit, items) of the documents that hold a window."""
    found, windows = occurrences(documents, benchmark, window)
    found = stored(found)
    before = Window.partitionBy("id", "h").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = end - F.greatest("start", F.least(end, F.coalesce(F.max(end).over(before), F.lit(0))))
    words = (
        found.select("id", "h", "start", "len").distinct().withColumn("fresh", fresh)
        .groupBy("id", "h").agg(F.sum("fresh").alias("n_hit"))
    )
    items = (
        found.select("id", "h", "wid").distinct().join(windows, "wid")
        .groupBy("id", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return words.join(items, ["id", "h"])


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings) and contaminated of every row."""
    found = settled(documents.sparkSession, lambda: _hit_rows(documents, benchmark, window))
    n_words = F.coalesce(F.regexp_count("text", F.lit(ANY_CASE)), F.lit(0)).cast("long").alias("n_words")
    rows = documents.select("doc_id", n_words, *_keys())
    return rows.join(found, ["id", "h"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` without the rows that hold a window of the benchmark."""
    found = settled(
        documents.sparkSession,
        lambda: occurrences(documents, benchmark, window)[0].select("id", "h").distinct(),
    )
    rows = documents.select(F.struct("*").alias("row"), *_keys())
    return rows.join(found, ["id", "h"], "left_anti").select("row.*")
