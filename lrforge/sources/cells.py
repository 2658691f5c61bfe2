"""Headerless CSV files as cells. Workbooks are in the module of that name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lrforge.functions.text import na_to_null
from lrforge.operators.numbering import numbered


def scan_csv(spark: SparkSession, path: str, width: int, scenario: str) -> DataFrame:
    """cells of headerless CSV files of a stated width; several files count as one sheet, in the order of their names.

    Files are read a task each, and rows are numbered from the row counts of files.
    """
    schema = ", ".join(f"c{i} string" for i in range(width))
    lines = spark.read.schema(schema).csv(path, multiLine=True, escape='"').select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    rows = numbered(lines, "row_idx", chunks=["_file", "_block"]).select(F.col("row_idx").cast("int").alias("row_idx"), F.posexplode(F.array(*[f"c{i}" for i in range(width)])).alias("col_idx", "value"))
    named = rows.select(F.lit(scenario).alias("scenario_id"), F.lit("csv").alias("sheet"), "row_idx", "col_idx", na_to_null(F.col("value")).alias("value"))
    return named.where("value is not null")
