"""Reading raw demand and organisation text, and keeping panels as Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.functions.dates import parse_day, parse_hour, since_until
from slotcast.functions.rows import quoted

# Column names of the raw files and the names used here.
DEMAND_COLUMNS = {"idservico": "service_id", "data": "date", "hora": "hour", "consultas": "demand"}
ORGANISATION_COLUMNS = {
    "idservico": "service_id",
    "setor": "sector",
    "unidade": "unit",
    "cliente": "client",
    "servico": "service_name",
}


# The column that holds the whole line where a row has too few or too many fields.
MALFORMED = "malformed"


def read_text_table(
    spark: SparkSession, path: str, columns: Mapping[str, str], sep: str = ";", names: Sequence[str] | None = None
) -> DataFrame:
    """Delimited text, picked by column name and left as text, with the line of
    each row that has too few or too many fields in ``MALFORMED``.

    Names come from the header, or are ``names`` where the file has none. No type
    is inferred, so the files are read once; columns may come in any order. Fields
    that a short row lacks are null, those a long row has too many are dropped.
    """
    reader = spark.read.option("sep", sep).option("header", names is None)
    given = list(names) if names is not None else reader.csv(path).columns
    schema = ", ".join(f"{quoted(name)} string" for name in (*given, MALFORMED))
    checked = reader.option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False)
    raw = checked.schema(schema).csv(path)
    return raw.select(*[F.col(quoted(source)).alias(name) for source, name in columns.items()], MALFORMED)


def read_raw_demand(
    spark: SparkSession, path: str, sep: str = ";", names: Sequence[str] | None = None
) -> DataFrame:
    """Demand as text, for ``typed_demand`` and ``rejected_demand``."""
    return read_text_table(spark, path, DEMAND_COLUMNS, sep, names)


def read_demand(
    spark: SparkSession, path: str, sep: str = ";", strict: bool = False, names: Sequence[str] | None = None
) -> DataFrame:
    return typed_demand(read_raw_demand(spark, path, sep, names), strict)


def _typed() -> dict[str, Column]:
    return {
        "service_id": F.col("service_id").try_cast("long"),
        "date": parse_day("date"),
        "hour": parse_hour("hour"),
        "demand": F.col("demand").try_cast("double"),
    }


def typed_demand(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Text columns to a demand table. Text that does not parse becomes null, and
    rows with a wrong number of fields are left out; where ``strict``, either ends
    the job. ``rejected_demand`` lists such rows."""
    columns = _typed()
    if strict:
        columns = {
            name: F.when(
                value.isNull() & F.col(name).isNotNull(),
                F.raise_error(F.concat(F.lit(f"{name} does not parse: "), F.col(name))),
            ).otherwise(value)
            for name, value in columns.items()
        }
    if MALFORMED in raw.columns:
        wrong = F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col(MALFORMED))).cast("boolean")
        whole = F.col(MALFORMED).isNull()
        raw = raw.filter(F.when(whole, F.lit(True)).otherwise(wrong) if strict else whole)
    return raw.select(*[value.alias(name) for name, value in columns.items()])


def rejected_demand(raw: DataFrame) -> DataFrame:
    """The raw rows with text that does not parse, and the names of its columns;
    ``fields`` stands for a wrong number of them."""
    names = [
        F.when(value.isNull() & F.col(name).isNotNull(), F.lit(name)) for name, value in _typed().items()
    ]
    if MALFORMED in raw.columns:
        names.insert(0, F.when(F.col(MALFORMED).isNotNull(), F.lit("fields")))
    return raw.withColumn("rejected", F.array_compact(F.array(*names))).filter(F.size("rejected") > 0)


def read_organisation(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    raw = read_text_table(spark, path, ORGANISATION_COLUMNS, sep).filter(F.col(MALFORMED).isNull())
    return raw.drop(MALFORMED).withColumn("service_id", F.col("service_id").try_cast("long"))


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite", years: bool = False) -> None:
    """Parquet by year. The rebalance hint lets Spark split a year that holds
    most of the rows and merge small ones, so files come out of even size.

    With ``years`` only the years that ``panel`` has are replaced, each as a whole
    when the job commits; other years stay. So a year can be written again, and a
    job that is repeated does no harm.
    """
    (
        panel.withColumn("year", F.year("date"))
        .hint("rebalance", "year")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic" if years else "static")
        .partitionBy("year")
        .parquet(path)
    )


def read_panel(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """A written panel from ``start`` up to, not including, ``end``. The year
    bounds prune folders, the date bounds reach the Parquet scan."""
    panel = spark.read.parquet(path)
    if start is not None:
        panel = panel.filter(F.col("year") >= int(start[:4]))
    if end is not None:
        panel = panel.filter(F.col("year") <= int(end[:4]))
    return panel.filter(since_until("date", start, end)).drop("year")
