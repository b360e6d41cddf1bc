"""Where lineage is cut, and folders that all machines share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, one in the
    warehouse, if all machines see it: in local mode, or on a store of its own. A
    cluster whose warehouse is a folder of one machine has none, which is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), spark.sparkContext.master
    if not re.match(r"local(\[|$)", master) and re.match(r"file:|/", warehouse):
        raise ValueError(
            "set spark.checkpoint.dir to a folder that the driver and all executors share: "
            f"it is unset, and the warehouse {warehouse} is a folder of one machine"
        )
    return f"{warehouse}/_checkpoints"


def with_checkpoint_folder(spark: SparkSession) -> SparkSession:
    """Sees to it that the context has a folder for checkpoints."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes it once
    nothing refers to it."""
    with_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def work_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder all machines share, removed with all it holds at the end."""
    path = f"{shared_folder(spark)}/work-{uuid4().hex}"
    try:
        yield path
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
