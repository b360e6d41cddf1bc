"""Fill-in-middle against a plain version."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slotcast.llm import infill
from tests.llm import data


def plain(doc_id, text, settings=infill.Settings()):
    text = text or ""
    digest = hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= settings.cut:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < settings.suffix_first:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, settings=infill.Settings()):
    frame = spark.createDataFrame([(*r, "x", 1, 2, "f") for r in rows], "doc_id long, text string, output string, n int, h int, form string")
    done = infill.cut(frame, settings).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in done) == Counter(plain(i, t, settings) for i, t in rows)
    assert Counter((r["doc_id"], r["back"]) for r in done) == Counter((i, t or "") for i, t in rows)
    return Counter(r["form"] for r in done)


def test_edges(spark):
    check(spark, [r[:2] for r in data.rows()])
    assert infill.cut(data.nothing(spark)).collect() == []


@pytest.mark.parametrize("settings", [infill.Settings(), infill.Settings(100, 50, 7), infill.Settings(0, 0, 1)])
def test_forms(spark, settings):
    odd = [
        "a", "é", "𝄞", "𝄞" * 7 + "\n\r\n", "<P", "<<S", "P><S", "a<P>b", "<S>", "x<M>", "$1\\2{3}", "\u0000 \u0085", "<", "<M<",
        "é" * 5, "<P" * 9, "M>" * 5 + "<", "﻿b", "x" * 1024, "é" * 1025, "𝄞" * 2047, "ab\n" * 2048,
    ]
    rows = [(i, t) for i, t in enumerate(odd * 9)]
    forms = check(spark, rows, settings)
    assert set(forms) == ({"plain"} if settings.cut == 0 else {"plain", "psm", "spm"})


def test_very_long_text(spark):
    rows = [(i, "wörd 𝄞\n" * 400_000) for i in range(4)]
    check(spark, rows)


def test_one_projection_without_python(spark):
    plan = infill.digests(infill.cut(data.documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
