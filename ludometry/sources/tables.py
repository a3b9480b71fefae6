"""CSV and parquet tables, JSON reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row and an explicit schema (no inference pass).

    Dates may carry a midnight time part, as CSV writers often emit one. A
    value that does not fit its type becomes NULL.
    """
    text = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DateType) else f.dataType) for f in schema]
    )
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    dates = {
        f.name: F.col(f.name).substr(1, 10).try_cast("date")
        for f in schema
        if isinstance(f.dataType, T.DateType)
    }
    return raw.withColumns(dates) if dates else raw


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs its schema")
        return read_csv(spark, path, schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] | str | None = None,
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Table sink; partition fact tables by date so readers can prune."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def report(sections: dict[str, DataFrame], most_rows: int = 10_000) -> DataFrame:
    """One row with one array-of-records column per result table.

    For report tables, which are small by construction (tiers, stages, tests);
    a section of more than ``most_rows`` rows is an error, not a cut.
    """
    spark = next(iter(sections.values())).sparkSession
    columns = {}
    for name, df in sections.items():
        listed = F.collect_list(F.struct(*[F.col(c) for c in df.columns]))
        rows = df.limit(most_rows + 1).agg(listed.alias("r"))
        too_many = F.raise_error(F.lit(f"section {name} has more than {most_rows} rows; write it as a table"))
        columns[name] = rows.select(F.when(F.size("r") <= most_rows, F.col("r")).otherwise(too_many)).scalar()
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()])


def write_report(sections: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Nested JSON result document; a single small row."""
    report(sections).write.mode(mode).json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON result document, pretty-printed or one line."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)
