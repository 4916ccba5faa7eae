"""CSV sinks. Rows go from the executors to part files; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write(df: DataFrame, path: str, rows_per_file: int = 0, mode: str = "overwrite") -> None:
    """Part files with a header each, quotes doubled, null and '' both empty.

    ``rows_per_file`` splits large exports; 0 leaves one file per partition.
    """
    writer = df.write.mode(mode).options(**_OPTIONS)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


def read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Read such files back, every column text, empty cells as ''."""
    ddl = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(ddl).options(**_OPTIONS).option("multiLine", "true").csv(path).fillna("")
