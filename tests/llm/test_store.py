"""Stored tables, folds, labels and the rows a model learns from."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from slotcast.llm import store
from slotcast.llm.components import components
from slotcast.llm.queries import QUERIES


def tables(spark):
    folder = store.shared_folder(spark).removeprefix("file:")
    return {d for d in os.listdir(folder) if d.startswith("llm-")} if os.path.isdir(folder) else set()


def test_settled_keeps_the_result_alone(spark):
    before = tables(spark)

    def make():
        first = store.stored(spark.range(10))
        inner = store.settled(spark, lambda: store.stored(first.filter("id > 4")).filter("id < 9"))
        return inner.filter("id <> 6")

    result = store.settled(spark, make)
    assert sorted(r[0] for r in result.collect()) == [5, 7, 8]
    assert len(tables(spark) - before) == 1


def test_settled_cleans_up_after_a_failure(spark):
    before = tables(spark)

    def fails():
        store.stored(spark.range(3))
        raise ValueError("stop")

    try:
        store.settled(spark, fails)
    except ValueError:
        pass
    assert tables(spark) == before


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in (None, 0, 7, -3, 123456789012)], "doc_id long")
    found = {r[0]: r[1] for r in rows.select("doc_id", store.fold(F.col("doc_id"), 5)).collect()}
    assert found == {
        i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in (None, 0, 7, -3, 123456789012)
    }


def test_labels_and_training_rows(spark):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 0), (5, 0), (6, 0), (9, 1)], "doc_id long, quality int"
    )
    settled = store.settled_labels(labels, "quality")
    assert sorted(map(tuple, settled.collect())) == [(1, 1), (4, 0), (5, 0), (6, 0), (9, 1)]
    docs = spark.createDataFrame(
        [(1, "a"), (1, "a"), (4, "b"), (5, None), (6, "d"), (None, "e"), (7, "f")], "doc_id long, text string"
    )
    rows = store.training_rows(docs, settled, F.lit(2), 2).collect()
    assert sorted(r["label"] for r in rows) == [0, 0, 1]
    again = store.training_rows(docs.repartition(3), settled, F.lit(2), 2).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60) if i != 30]
    edges += [("n005", "n005"), ("n007", "n002"), (None, "x"), ("n001", "n000"), ("n001", "n000")]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a string, b string")).collect()))
    assert found == {f"n{i:03d}": "n000" if i <= 30 else "n031" for i in range(61)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_star_of_a_third_of_all_vertices(spark):
    star = spark.range(1, 3000).selectExpr("id AS a", "0L AS b")
    chain = spark.range(10_000, 10_050).selectExpr("id AS a", "id + 1 AS b")
    found = components(star.union(chain))
    sizes = {r[0]: r[1] for r in found.groupBy("component").count().collect()}
    assert sizes == {0: 3000, 10_000: 51}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_table_but_the_result_outlives_a_query(spark, name):
    before = tables(spark)
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert rows and len(tables(spark) - before) <= 1


def test_a_table_is_released(spark):
    before = tables(spark)
    store.release(store.stored(spark.range(4)))
    assert tables(spark) == before


def test_no_shared_folder_on_a_cluster():
    """Neither is a machine-local folder taken instead, nor is the setting ignored."""
    def session(master, **conf):
        known = {"spark.sql.warehouse.dir": "file:/home/x/warehouse"} | conf
        context = type("Context", (), {"master": master})
        return type("Session", (), {"conf": known, "sparkContext": context})

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_folder(session(master))
    assert store.shared_folder(session("local[2]")) == "file:/home/x/warehouse/_llm"
    assert store.shared_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs:///c/"})) == "hdfs:///c"
    assert store.shared_folder(session("yarn", **{"spark.sql.warehouse.dir": "s3a://b/w"})) == "s3a://b/w/_llm"
