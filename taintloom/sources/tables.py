"""Stored tables of scans, findings and projects: files by their suffix or format, databases by their address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, where: str, table: str, file_format: str = "parquet", parts: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table in a folder (`where`/`table`, or with the format as its suffix), or of a database (`where` a jdbc: address).

    parts: (column, lowest, highest, number): a database table is read in that many ranges of a column, one to a task;
    without it one task reads all of it. The database's driver must be on Spark's class path.
    """
    if where.startswith("jdbc:"):
        reader = spark.read.format("jdbc").options(url=where, dbtable=table, **options)
        if parts is not None:
            column, low, high, n = parts
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
        return reader.load()
    path = where.rstrip("/") + "/" + table
    return spark.read.format(file_format).options(**options).load(path if "." in table else f"{path}.{file_format}")
