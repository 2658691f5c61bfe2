"""Scans along an order that no task sees as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lrforge.operators.numbering import RANGE_ROWS, dealt
from lrforge.session import Scratch


def fill_forward(df: DataFrame, key: list[str], order: list[str], value: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with nulls in value replaced by the last value before them, in order, of the same key.

    Rows are dealt by ranges of key and order and written with their place and the number of
    their range. What each range ends with, its last row and its last row with a value, is
    found by place and comes to the driver, two rows a range at most; key and value are
    carried on to the next ranges; then ranges fill themselves. So a key of any size is spread
    over tasks, and a task holds a few ranges of some range_rows rows, whatever the input's
    size. Null keys are keys like others.
    """
    ranges, n = dealt(df, [*key, *order], range_rows)
    stored = Scratch(df.sparkSession, "filled").kept(ranges.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    same = F.struct(*[F.col(k) for k in key])
    ends = stored.groupBy("_part").agg(F.max("_id").alias("_last"), F.max(F.when(F.col(value).isNotNull(), F.col("_id"))).alias("_filled"))  # of longs alone, so tasks hash and don't sort
    found = stored.join(F.broadcast(ends), "_part").where("_id = _last or _id = _filled").select("_part", "_id", same.alias("k"), F.col(value).alias("v"))
    carried, key_now, value_now = [], None, None
    for r in found.orderBy("_id").collect():
        if not carried or carried[-1][0] != r["_part"]:
            carried.append((r["_part"], key_now, value_now))
        if r["k"] != key_now:
            key_now, value_now = r["k"], None
        if r["v"] is not None:
            value_now = r["v"]
    fields = stored.schema
    kind = ", ".join(f"{k}: {fields[k].dataType.simpleString()}" for k in key)
    known = df.sparkSession.createDataFrame(carried, f"_part int, _key struct<{kind}>, _carried {fields[value].dataType.simpleString()}")
    rows = stored.join(F.broadcast(known), "_part").repartition(n, "_part", *key)
    own = F.last(value, ignorenulls=True).over(W.partitionBy("_part", *key).orderBy("_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn(value, F.coalesce(own, F.when(F.col("_key").eqNullSafe(same), F.col("_carried")))).select(*df.columns)
