"""Registered queries against SQL, plain versions and held-out labels."""

import os
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from slotcast.llm import chat, quality, urls
from slotcast.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name]) is None


def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


def test_near_copies_query(spark):
    want = brute.near_copies(texts(spark, SF))
    found = {r[0]: (r[1], r[2]) for r in QUERIES["op3_simhash_near_copies"](spark, SF).collect()}
    assert found == want


def test_suffix_array_query(spark):
    rows = texts(spark, TINY)
    want = {i: (len(t.encode()), *x) for (i, t), x in zip(rows, brute.repeated_bytes([t for _, t in rows]))}
    found = {r[0]: tuple(r[1:]) for r in QUERIES["op9_suffix_array_dedup"](spark, TINY).collect()}
    assert found == want


def held_out(spark, name, label, folds, rest):
    found = QUERIES[name](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == rest) for r in found)
    return [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]


def test_quality_query(spark):
    pairs = held_out(spark, "op5_quality", "quality", 5, 0)
    assert sum(p == y for p, y in pairs) >= 0.97 * len(pairs)


def test_toxicity_query(spark):
    """A third of 400 labels, a few of them toxic: a weak bound, and clean texts stay clean."""
    pairs = held_out(spark, "op8_toxicity", "toxic", 3, 1)
    clean, toxic = ([p for p, y in pairs if y == k] for k in (0, 1))
    assert sum(toxic) >= 0.4 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_language_query(spark):
    found = QUERIES["op4_language"](spark, SF).collect()
    given = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    right = [r["lang_pred"] == given[r["doc_id"]] for r in found if r["held_out"]]
    assert sum(right) >= 0.98 * len(right)


RESOLVED = [
    # page, target, address; the first ones are the examples of RFC 3986, section 5.4
    *[("http://a/b/c/d;p?q", t, w) for t, w in [
        ("g", "a/b/c/g"), ("./g", "a/b/c/g"), ("g/", "a/b/c/g/"), ("/g", "a/g"), ("//g", "g/"), ("?y", "a/b/c/d;p?y"),
        ("g?y", "a/b/c/g?y"), ("#s", "a/b/c/d;p?q"), ("g#s", "a/b/c/g"), ("g?y#s", "a/b/c/g?y"), (";x", "a/b/c/;x"),
        ("g;x?y#s", "a/b/c/g;x?y"), (".", "a/b/c/"), ("./", "a/b/c/"), ("..", "a/b/"), ("../", "a/b/"), ("../g", "a/b/g"),
        ("../..", "a/"), ("../../", "a/"), ("../../g", "a/g"), ("../../../g", "a/g"), ("../../../../g", "a/g"),
        ("/./g", "a/g"), ("/../g", "a/g"), ("g.", "a/b/c/g."), (".g", "a/b/c/.g"), ("g..", "a/b/c/g.."), ("..g", "a/b/c/..g"),
        ("./../g", "a/b/g"), ("./g/.", "a/b/c/g/"), ("g/./h", "a/b/c/g/h"), ("g/../h", "a/b/c/h"), ("g;x=1/./y", "a/b/c/g;x=1/y"),
        ("g;x=1/../y", "a/b/c/y"), ("g?y/./x", "a/b/c/g?y/./x"), ("g?y/../x", "a/b/c/g?y/../x"), ("mailto:x@y", None),
    ]],
    ("http://h.com", "http://h.com/", "h.com/"), ("http://h.com", "x", "h.com/x"), ("http://h.com", "?id=3", "h.com/?id=3"),
    ("http://a.com/p", "?id=3", "a.com/p?id=3"), ("http://a.com/p/q?z#f", "../d", "a.com/d"), ("http://a.com/p/q", "./d", "a.com/p/d"),
    ("https://A.com/p", "HTTP://B.Com/x/../Y", "b.com/Y"), ("http://a.com/x/../y", "", "a.com/x/../y"), ("http://a.com/é/ü", "../ß?ö", "a.com/ß?ö"),
]


def test_resolved_addresses(spark):
    frame = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(RESOLVED)], "i int, url string, target string")
    got = frame.select("i", urls.address_of(urls.absolute(frame["target"], frame["url"])).alias("a")).collect()
    assert [(RESOLVED[r["i"]], r["a"]) for r in got if r["a"] != RESOLVED[r["i"]][2]] == []


def test_aliases_by_every_form_of_link(spark):
    """A page is an alias of a blocked address, whatever way its link is written."""
    link = '<link rel="canonical" href="{}">'
    forms = [
        ("http://b.net/p", None), ("http://a.com/p", link.format("//b.net/p")), ("http://c.com/p/q", link.format("../d")),
        ("http://c.com/d", link.format("http://b.net/x/../p")), ("http://e.com/p", link.format("?id=3")),
        ("http://e.com/p?id=3", link.format("http://a.com/p#top")), ("http://h.com", link.format("http://b.net/p")),
        ("http://k.com/x", link.format("http://h.com/")), ("http://free.com/p", link.format("#here")),
        ("http://mail.com/p", link.format("mailto:a@b.net")),
    ]
    rules = spark.createDataFrame([("net/", "block")], "rule string, verdict string")
    frame = spark.createDataFrame([(i, *f) for i, f in enumerate(forms)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(frame, rules).collect()}
    assert got == {i: "allow" if i >= 8 else "block" for i in range(10)}


def test_aliases(spark):
    link = '<LINK href="{}" rel="canonical">'
    hop = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.com/x", link.format("https://B.net/y")),          # alias of a blocked address
        (2, "http://c.com/1?q=1#top", hop.format("/2")),                # alias of an alias ...
        (3, "https://c.com/2", link.format("http://b.net/y?a=1&amp;b=2")),
        (4, "http://d.com/z", link.format("http://b.net/y")),           # allowed in its class by page 5
        (5, "http://ok.org/fr/a", hop.format("http://e.net/w")),
        (6, "http://f.com/", link.format("http://e.net/w")),
        (7, "http://e.net/w", None), (7, "http://e.net/w", None),       # its own rule stands
        (8, None, link.format("http://b.net/y")), (9, "no scheme", None), (None, "http://g.com/p/", hop.format("q")),
        (11, "http://g.com/p/q", "<link rel=canonical href=//sub.example.com/de/>"), (12, "http://net", ""),
    ]
    rules = spark.createDataFrame(
        [("net/", "block"), ("org/fr/", "allow"), ("example.com/de/", "block")], "rule string, verdict string"
    )
    frame = spark.createDataFrame([(*p, "extra", 1) for p in pages], "page_id long, url string, html string, member string, best int")
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(frame, rules).collect())
    assert got == Counter([
        (1, None, "block"), (2, None, "block"), (3, None, "block"), (4, None, "block"), (5, "org/fr/", "allow"),
        (6, None, "allow"), (7, "net/", "block"), (7, "net/", "block"), (8, None, "allow"), (9, None, "allow"),
        (None, None, "block"), (11, None, "block"), (12, None, "allow"),
    ])
    extra = spark.createDataFrame([("http://g.com/p/q", "http://ok.org/fr/b")], "a string, b string")
    more = {r["page_id"]: r["verdict"] for r in urls.judge(frame, rules, extra).collect()}
    assert more[11] == more[None] == "allow" and more[1] == "block"
    assert urls.judge(frame.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(frame, rules.limit(0)).collect()} == {"allow"}


def test_chat_round_trip(spark):
    says = ["</s>[INST] ok [/INST]", "\\[INST]\\\\</s>", "  spaces  ", "é𝄞 ü\n\n", None, "[\\INST]", "<\\/s>", ""]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(says)]
    rows += [(2, 5, "assistant", t) for t in says] + [(None, None, None, None), (3, 1, "assistant", "x" * 200_000)]
    rows += rows[:2]
    frame = spark.createDataFrame([(*r, 1, "e") for r in rows], "conv_id long, turn long, role string, text string, turns int, formatted string")
    done = chat.format_chats(frame).collect()
    for r in done:
        own = sorted(((t is not None, t, role or "", text or "") for i, t, role, text in rows if i == r["conv_id"]))
        turns = [(role, text) for *_, role, text in own]
        assert chat.parse(r["formatted"]) == turns and r["n_turns"] == len(turns)
        loss = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert loss == [text for role, text in turns if role == "assistant" and text]
        assert len(r["token_ids"]) == len(r["loss_mask"])
        for control in chat.CONTROL:
            assert r["formatted"].count(control) == len(turns)
    assert chat.format_chats(frame.limit(0)).collect() == []


def test_pipeline(spark):
    """All stages after the classifier, whose verdicts are taken from its scores, in plain Python."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    known = quality.statistics(docs)
    model = quality.fit(known.filter(corpus_pipeline.fold(known["doc_id"], 5) != 0), labels)
    good = {r[0] for r in known.select("doc_id", model.expression().alias("s")).collect() if r[1] >= 0.3}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect() if r[0] in good]
    groups = brute.near_copies([r[:2] for r in rows])
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    cut = brute.cut_texts([t for _, t, _ in rows])
    items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").select("item_id", "text").collect()]
    vocabulary = {w for _, t in items for w in brute.plain_words(t)}
    kept = []
    for (i, _, source), text in zip(rows, cut):
        known_words = sum(w in vocabulary for w in brute.plain_words(text))
        if known_words < 10 or not brute.benchmark_hits(text, items)[1]:
            kept.append((i, text, source))
    texts_ = {i: t for i, t, _ in kept}
    want = Counter()
    for i, *_, copies in brute.mix(kept):
        want[i, texts_[i]] += copies
    found = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, TINY).collect())
    assert found == +want
