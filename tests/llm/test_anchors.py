"""Anchors of texts that repeat themselves closely, and of texts that share short passages only."""

from __future__ import annotations

import numpy as np
import pytest

from slotcast.llm import substrings
from tests.llm import brute, data

PERIODS = ["a", "ab ", "The ", "stop here now. ", data.prose(11, 30) + "\n"]


@pytest.mark.parametrize("length", [64, 200, 400])
@pytest.mark.parametrize("period", PERIODS)
def test_few_anchors_of_periodic_text(length, period):
    """One anchor in about ``length`` bytes, whatever the period; every string keeps its lowest hash."""
    text = (data.prose(5, 150) + " " + period * (20_000 // len(period)) + data.prose(6, 150)).encode()
    gram = substrings.gram_of(length)
    pos, hashes, stands = substrings.anchors(text, length)
    width = length - gram + 1
    assert len(pos) < 4 * len(text) / width + 20
    all_ = substrings.gram_hashes(text, gram)
    least = substrings.sliding(np.minimum, all_, width)
    every = np.flatnonzero(substrings.sliding(np.maximum, np.concatenate((
        np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64))), width) == all_)
    assert stands.sum() == len(every) and (np.diff(pos) > 0).all() and (all_[pos] == hashes).all()
    kept = set(zip(pos.tolist(), hashes.tolist()))
    for s in range(0, len(least), 7):
        assert any((p, int(least[s])) in kept for p in range(s, s + width) if all_[p] == least[s])


@pytest.mark.parametrize("length", [100, 200, 400])
def test_periodic_texts_by_bytes(spark, length):
    """Texts that repeat themselves, alone, in company, and by one period more or less than the length."""
    texts = [p * (n // len(p) + 1) for p in PERIODS for n in (length - 2, length + len(p), 3000)]
    texts += [data.prose(20, 100) + "ab " * 400 + data.prose(21, 100), data.prose(22, 80) + "ab " * 170 + data.prose(23, 80)]
    texts += [("x" * (length // 2) + str(i)) * 9 for i in range(3)] + [("x" * 700 + "y") * 3]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:-1] for r in substrings.span_table(frame, length).collect()}
    want = brute.repeated_bytes(texts, length)
    assert got == {i: (len(t.encode()), *x) for (i, t), x in zip(rows, want)}
    for i, t in rows:
        alone = spark.createDataFrame([(i, t)], "doc_id long, text string") if i in (1, 5, 15) else None
        if alone is not None:
            assert tuple(substrings.span_table(alone, length).first())[1:-1] == (len(t.encode()), *brute.repeated_bytes([t], length)[0])


def test_short_passages_are_no_candidates(spark):
    """Texts that share passages of some forty bytes only are left alone before their texts are read."""
    shared = [data.prose(300 + k, 7)[:40] for k in range(4)]
    texts = [" ".join(data.prose(1000 + 50 * i + k, 3) + " " + shared[k % 4] for k in range(40)) for i in range(30)]
    assert not any(n for n, *_ in brute.repeated_bytes(texts))
    spans, kept = substrings.repeated_starts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept.count() == 0 and spans.count() == 0
