"""Row numbers over a whole table without a task that sees all of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lrforge.session import Scratch

RANGE_ROWS = 1 << 18


def dealt(df: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """df by ranges of order, sorted within each, and the number of ranges.

    Rows are counted first, so that a range has some range_rows of them at most, whatever the
    input's size: ranges whose number is given aren't put together again by size.
    """
    few = min(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = max(few, -(-df.count() // range_rows))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order), n


def numbered(df: DataFrame, name: str, order: list[str] | None = None, chunks: list[str] | None = None, start: int = 0) -> DataFrame:
    """df with a long column of consecutive numbers from start.

    By order, which is dealt by ranges and sorted within tasks; or, without it, in the order in
    which rows are read, chunks (such as file and block) ascending, whose columns go.
    The rows are written once with their place in their chunk; the rows of each chunk are
    counted, and only these counts (one a chunk or task) come to the driver to be added up.
    Rows that are equal in order are numbered in any order.
    """
    rows = dealt(df, order)[0] if order else df
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    if not chunks:
        rows = rows.withColumn("_chunk", F.shiftright("_id", 33))
        chunks = ["_chunk"]
    stored = Scratch(df.sparkSession, "numbered").kept(rows)
    counts = stored.groupBy(*chunks).agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).orderBy(*chunks)
    offsets, at = [], start
    for r in counts.collect():
        offsets.append((*r[:-2], at - r["_first"]))
        at += r["_n"]
    schema = ", ".join(f"{c} {t}" for c, t in counts.dtypes[:-2]) + ", _offset long"
    known = df.sparkSession.createDataFrame(offsets, schema)
    return stored.join(F.broadcast(known), chunks).withColumn(name, F.col("_id") + F.col("_offset")).drop("_id", "_offset", *chunks)
