"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotcast.llm import decontaminate, language, mixing, quality, rules, simhash, store, substrings, toxicity
from tests.llm import brute, data


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    data.documents(spark).write.parquet(path)
    return spark.read.parquet(path)


def given():
    return [r[:4] for r in data.rows()]


def test_mix_plan(docs):
    found = [tuple(r) for r in mixing.mix_table(docs).select(
        "doc_id", "size", "source_size", "target", "copies").collect()]
    assert Counter(found) == Counter(brute.mix([(i, t, s) for i, t, _, s in given()]))


def test_mix_rows(docs):
    want = Counter({i: 0 for i, *_ in given()})
    for i, _, _, _, copies in brute.mix([(i, t, s) for i, t, _, s in given()]):
        want[i] += copies
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert Counter(r[0] for r in got.select("doc_id").collect()) == +want


def test_near_copies(docs):
    rows = given()
    want = brute.near_copies([(k, t) for k, (_, t, *_) in enumerate(rows)])
    groups = {}
    for k, (i, *_) in enumerate(rows):
        groups.setdefault(want[k][1], []).append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    expected = Counter((i, want[k][0], low[want[k][1]]) for k, (i, *_) in enumerate(rows))
    found = simhash.near_copies(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, found)) == expected
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(low.values())


def test_large_buckets_are_split(spark):
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a, 40)} | {base ^ (7 << 50)})
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    from slotcast.llm.components import components

    whole = {frozenset(x) for x in _classes(components(simhash.links(frame)).collect())}
    split = {frozenset(x) for x in _classes(components(simhash.links(frame, block=32)).collect())}
    assert whole == split == {frozenset(prints)}


def _path(size, seed):
    """Fingerprints of one key, in random order: neighbours of the path are linked, no others."""
    draw = np.random.default_rng(seed)
    path = [0x0123456789ABCDEF]
    while len(path) < size:
        low, high = draw.choice(np.arange(32, 48)), draw.choice(np.arange(48, 64), 2, replace=False)
        step = path[-1] ^ (1 << int(low)) ^ (1 << int(high[0])) ^ (1 << int(high[1]))
        if all((step ^ other).bit_count() > simhash.DISTANCE for other in path[:-1]):
            path.append(step)
    return draw.permutation(np.array(path, np.uint64))


def test_forest_keeps_all_links():
    assert simhash._forest(4, np.array([1, 2, 0]), np.array([2, 3, 3])).tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("size", [4, 50, 500])
def test_paths_in_one_key(spark, size):
    from slotcast.llm.components import components

    for seed in range(5):
        rings = _path(size, seed)
        assert not simhash._group_links(np.array([0]), rings, simhash.SEGMENTS, simhash.DISTANCE).any()
    prints = rings.view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    for block in (size // 3 + 1, 2 * size):
        assert {frozenset(x) for x in _classes(components(simhash.links(frame, block=block)).collect())} == {frozenset(prints)}


def _classes(rows):
    groups = {}
    for member, component in rows:
        groups.setdefault(component, set()).add(member)
    return groups.values()


@pytest.mark.parametrize("hot", [8000, 1])
def test_repeated_bytes(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings.repeated_starts, "__defaults__", (400, hot))
    monkeypatch.setattr(substrings, "SHARD_BYTES", 4000 if hot == 1 else 2 << 20)
    monkeypatch.setattr(substrings, "PIECE", 3000 if hot == 1 else 1 << 20)
    rows = given()
    sizes = [len((t or "").encode()) for _, t, *_ in rows]
    want = Counter((i, n, *x) for (i, *_), n, x in zip(rows, sizes, brute.repeated_bytes([t for _, t, *_ in rows])))
    found = substrings.span_table(docs).drop("cuts").collect()
    assert Counter(map(tuple, found)) == want


def test_fingerprints_follow_from_the_bytes(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(0, 3, 3000).astype(np.uint8)) * 2
    starts = np.sort(rng.choice(len(text) - 70, 900, replace=False))
    whole = substrings.string_prints(text, starts, 70)
    monkeypatch.setattr(substrings, "_BLOCK", 256)
    monkeypatch.setattr(substrings, "_POWERS", {})
    assert (substrings.string_prints(text, starts, 70) == whole).all()
    of = {}
    for s, p in zip(starts.tolist(), map(tuple, whole.tolist())):
        assert of.setdefault(text[s : s + 70], p) == p
    assert len(set(of.values())) == len(of)


def test_fingerprints_met_twice():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 4, (500, 2)).astype(np.uint64) * np.uint64(2**62) + rng.integers(0, 9, (500, 2)).astype(np.uint64)
    counts = Counter(map(tuple, prints.tolist()))
    assert substrings.found_twice(prints).tolist() == [counts[tuple(p)] > 1 for p in prints.tolist()]
    assert substrings.found_twice(prints[:0]).tolist() == []


@pytest.mark.parametrize("text", [b"", b"a", b"a" * 3000, b"ab" * 900 + b"b" * 300, bytes(range(1, 256)) * 6, b"the cat the hat " * 60])
def test_suffix_array_is_sorted(text):
    """By all bytes up to the depth; equals in order of the text."""
    if not text:
        return
    order, rank, words = substrings.suffix_array(text, 64)
    padded = text + bytes(128)
    want = sorted(range(len(text)), key=lambda i: (padded[i : i + 64], min(64, len(text) - i), i))
    deep = 64
    got = order.tolist()
    assert sorted(got) == list(range(len(text)))
    assert [text[i : i + deep] for i in got] == [text[i : i + deep] for i in want]
    for a, b in zip(got, got[1:]):
        if rank[a] == rank[b]:
            assert a < b and text[a : a + deep] == text[b : b + deep]
    shared = substrings.common_prefixes(order, rank, words, deep)
    for a, b in zip(got, got[1:]):
        x, y = text[a : a + deep], text[b : b + deep]
        n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert min(shared[b], len(x), len(y)) == n


def test_passages_about_the_length(spark):
    """Passages of 50 to 70 words, some below and some above 400 bytes, in several documents."""
    found = []
    for i in range(24):
        passage = data.prose(500 + i // 3, 50 + i // 3 * 3)
        found.append((i, data.prose(900 + i, 40) + " " + passage + " " + data.prose(1900 + i, 30)))
    sizes = [len(data.prose(500 + k, 50 + 3 * k).encode()) for k in range(8)]
    assert min(sizes) < 400 < max(sizes)
    want = Counter((i, len(t.encode()), *x) for (i, t), x in zip(found, brute.repeated_bytes([t for _, t in found])))
    frame = spark.createDataFrame(found, "doc_id long, text string").repartition(9)
    got = [tuple(r) for r in substrings.span_table(frame).drop("cuts").collect()]
    assert Counter(got) == want
    assert {i for i, _, n, *_ in got if n} == {i for i in range(24) if sizes[i // 3] >= 398}


@pytest.mark.parametrize("partitions", [4, 64])
def test_copies_over_many_partitions_cost_a_copy_each(spark, partitions):
    """A text that every task has met is one candidate, with its anchors once."""
    text, other = data.prose(77, 2000), data.prose(78, 700)
    rows = [(i, text) for i in range(128)] + [(1000, other), (1001, text[3000:6000] + other[:800])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    spans, texts = substrings.repeated_starts(frame)
    kept = texts.collect()
    assert len(kept) == len({r["key"] for r in kept}) == 3
    got = {r["doc_id"]: tuple(r)[1:-1] for r in substrings.span_table(frame).collect()}
    want = brute.repeated_bytes([t for _, t in rows])
    assert got == {i: (len(t.encode()), *x) for (i, t), x in zip(rows, want)}


def test_cut_repeats(docs):
    rows = given()
    cut = brute.cut_texts([t for _, t, *_ in rows])
    got = substrings.cut_repeats(docs)
    assert got.columns == docs.columns
    want = Counter((i, c, None if c is None else len(c)) for (i, *_), c in zip(rows, cut))
    assert Counter(map(tuple, got.select("doc_id", "text", "n_chars").collect())) == want


def test_decontamination(spark, docs):
    bench = data.benchmark(spark)
    items = [tuple(r) for r in bench.collect()]
    want = Counter()
    clean = Counter()
    for i, t, *_ in given():
        n, hit, ids = brute.benchmark_hits(t, items)
        want[(i, n, hit, tuple(ids), hit > 0)] += 1
        clean[i] += hit == 0
    found = decontaminate.hits(docs, bench).collect()
    assert Counter((r[0], r[1], r[2], tuple(r[3]), r[4]) for r in found) == want
    assert Counter(r[0] for r in decontaminate.drop_contaminated(docs, bench).select("doc_id").collect()) == +clean
    none = decontaminate.hits(docs, bench.limit(0)).collect()
    assert len(none) == len(given()) and not any(r["contaminated"] for r in none)


def test_words_of_all_characters(spark):
    """Every ASCII character, and characters about the ends of what counts."""
    odd = [chr(c) for c in range(128)] + ["\x80", "\xff", "é", "\ud7ff", "\ue000", "\uffff", "\U00010000", "\U0010ffff", "İ", "ẞ", "K"]
    rows = [f"aB{c}Cd {c}{c} x" for c in odd]
    frame = spark.createDataFrame([(t,) for t in rows], "text string")
    contract = F.regexp_extract_all(
        F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)
    count = F.regexp_count("text", F.lit(decontaminate.ANY_CASE))
    for r in frame.select("text", decontaminate.words_of(F.col("text")).alias("w"), contract.alias("c"), count.alias("n")).collect():
        assert r["w"] == r["c"] == brute.plain_words(r["text"]) and r["n"] == len(r["w"])


def test_only_prefixes_are_joined(spark):
    """Candidates are places of one shingle a window, far fewer than the places of all its shingles; a
    passage that most texts hold is found in each."""
    item = data.prose(1, 60)
    hot = " ".join(item.split()[10:25])
    docs = spark.createDataFrame(
        [(i, data.prose(100 + i, 80) + (" " + hot if i % 3 else "") + " " + data.prose(500 + i, 20)) for i in range(300)],
        "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, data.prose(2, 9)), (3, data.prose(3, 2))], "item_id long, text string")
    with store.owned(spark):
        windows = store.stored(decontaminate.item_windows(bench, 10)).select("wid", "words").distinct()
        prefix = store.stored(decontaminate.prefixes(windows, 3, 3))
        assert prefix.count() == windows.filter("size(words) >= 3").count() == 52
        met = decontaminate.candidates(docs, prefix, 3, 10)
        # all 13 shingles of the passage in up to 8 windows each would be over 90 candidates a text
        assert met.count() <= 200 * 20 and met.filter("there = words").count() >= 200 * 6
        looked = decontaminate._places(docs, 3, prefix.select("gram"), F.col("id")).count()
        assert looked < 0.1 * docs.selectExpr("sum(size(split(text, ' ')))").first()[0]
        found = decontaminate.hits(docs, bench).collect()
    items = [tuple(r) for r in bench.collect()]
    for r, (i, text) in zip(sorted(found), sorted(map(tuple, docs.collect()))):
        assert (r["doc_id"], r["n_words"], r["n_hit"]) == (i, *brute.benchmark_hits(text, items)[:2])


def passes(text, words, lines, n_symbols, n_dup_lines):
    """The threshold table, written out."""
    stop = {w for group in rules.STOP_WORDS for w in group.split()}
    chars, n, n_lines = max(1, sum(map(len, words))), max(1, len(words)), max(1, len(lines))
    bullets = sum(x.lstrip(" \t")[:1] in ("-", "*", "•") and x.lstrip(" \t") != "" for x in lines)
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    return (
        2 <= sum(map(len, words)) / n <= 25 and n_symbols / chars <= 0.1 and n_dup_lines / n_lines <= 0.5
        and sum(w.lower() in stop for w in words) / n >= 0.02 and bullets / n_lines <= 0.9 and upper / chars <= 0.5
    )


def test_rule_counts_of_repeats(spark):
    """Overlapping, adjacent and nested repeats, and texts whose windows all differ."""
    texts = [
        "a b c a b c", "a a a a a", "a b c d a b c d a b c", "x a b c y a b c z", "a b a b a b a", "a b c d e f", "a b c",
        "a b", "", "a b c " * 40, "q a b c " * 2 + "r a b c s b c q", " ".join(str(i % 7 * (i % 3)) for i in range(300)),
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.judge(frame).collect():
        w = texts[r["doc_id"]].split()
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        assert r["n_repeat_words"] == len(inside), texts[r["doc_id"]]


def test_rules(docs):
    found = {}
    for r in rules.judge(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    texts = {i: t for i, t, *_ in given() if i is not None}
    for i, t in texts.items():
        w = brute.words(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        r = found[i][0]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(inside))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"] and passes(t or "", w, lines, r["n_symbols"], r["n_dup_lines"]))
    assert any(r["kept"] for rows in found.values() for r in rows)
    assert sum(map(len, found.values())) == len(given())


def test_statistics_stay_above_the_filter(spark, docs):
    """Judging a text works its statistics out once, not once per rule."""
    known = quality.statistics(docs)
    kept = quality.keep_good(docs, quality.fit(known, data.labels(spark)), 0.5)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp" in line for line in plan.splitlines() if "Filter" in line)
    assert kept.columns == docs.columns


def test_scores(spark, docs):
    labels = data.labels(spark)
    known = quality.statistics(docs)
    good = known.select("doc_id", quality.fit(known, labels).expression().alias("score")).collect()
    toxic = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    for scored in (good, toxic):
        assert len(scored) == len(given())
        assert all(0 <= r["score"] <= 1 for r in scored)
    assert quality.fit(known.limit(0), labels).expression() is not None
    assert toxicity.fit(docs, labels.limit(0)) is None
    ones = labels.filter("quality = 1")
    assert all(r[0] > 0.99 for r in known.select(quality.fit(known, ones).expression()).collect())


def test_languages(docs):
    found = language.detect(docs, language.fit(docs)).collect()
    assert len(found) == len(given())
    texts = {i: t for i, t, *_ in given() if i is not None}
    for r in found:
        if r["doc_id"] in texts:
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert r["lang_pred"] in (("en", "de") if letters else ("und",))
            assert 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language.detect(docs, language.fit(docs.limit(0))).collect()} == {"und"}


def test_empty_tables(spark, tmp_path):
    none = data.nothing(spark)
    labels = data.labels(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    data.benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (
        mixing.mix_table(none), simhash.near_copies(none), substrings.span_table(none),
        decontaminate.hits(none, data.benchmark(spark)), rules.judge(none),
        toxicity.score(none, toxicity.fit(none, labels)), language.detect(none, language.fit(none)),
        quality.statistics(none), *[f(spark, none, str(tmp_path)) for _, f in corpus_pipeline.STAGES],
    ):
        assert frame.collect() == []


def test_stages_keep_columns(spark, docs, tmp_path):
    data.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    data.benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and now.schema == docs.schema, name
        now.count()


def test_key_of_text(docs):
    found = docs.select("text", substrings.text_key(F.col("text")).alias("key")).collect()
    assert all(r["key"] == hashlib.sha256((r["text"] or "").encode()).digest()[:16] for r in found)
