"""Incremental estimation: cells arrive as streams of files; each batch is classified once, and the latest status of every cell is kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lrforge.functions.numeric import classify_cell
from lrforge.schemas import CELLS

CELL = ["model_id", "scenario_id", "row_index"]
OUTPUTS = "model_id string, scenario_id string, row_index int, value string, written_at timestamp"
LATEST = "model_id string, scenario_id string, row_index int, value string, written_at timestamp, status string, change long"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def classified_stream(spark: SparkSession, path: str, schema: str = CELLS) -> DataFrame:
    cell = classify_cell(F.col("value"))
    return spark.readStream.schema(schema).parquet(path).withColumn("status", cell["status"]).withColumn("numeric_value", cell["numeric_value"])


def run_once(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Classifies what has come since the last run and appends it to the target, each file once."""
    query = classified_stream(spark, source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class LatestStatus(StatefulProcessor):
    """Keeps what was last written into a cell; a row that is older than it, however late it comes, changes nothing.

    Of rows of one moment the largest value counts, so that the order of arrival doesn't matter.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "value string, written_at timestamp, change long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        held = self.latest.get() if self.latest.exists() else None
        value, moment, change = (held[0], pd.Timestamp(held[1]), held[2]) if held else (None, None, 0)
        rank = lambda v, t: (t, v is not None, v or "")
        status, newer = None, False
        for batch in rows:
            for v, t, s in zip(batch["value"], batch["written_at"], batch["status"], strict=True):
                v = None if pd.isna(v) else v
                if not pd.isna(t) and (moment is None or rank(v, t) > rank(value, moment)):
                    value, moment, status, newer = v, t, s, True
        if newer:
            self.latest.update((value, moment.to_pydatetime(), change + 1))
            yield pd.DataFrame([(*key, value, moment, status, change + 1)], columns=[f.split()[0] for f in LATEST.split(", ")])

    def close(self) -> None:
        pass


def latest_changes(outputs: DataFrame) -> DataFrame:
    """A row for every change of a cell's latest value: OUTPUTS with status and the number of the change. outputs is a stream."""
    rows = outputs.where("written_at is not null").withColumn("status", classify_cell(F.col("value"))["status"])
    return rows.groupBy(*CELL).transformWithStateInPandas(LatestStatus(), LATEST, "Update", "None")


def track_once(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Takes in the files of OUTPUTS that have come since the last run; changes go to the target, numbered by cell.

    A batch that is run again after a failure writes its own folder again. State lies in RocksDB below
    the checkpoint; the provider is set for the time of the query's start.
    """
    held = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        changes = latest_changes(spark.readStream.schema(OUTPUTS).parquet(source))
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        query = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(STATE_STORE, held)


def current(changes: DataFrame) -> DataFrame:
    """Of each cell its latest row."""
    nth = F.row_number().over(W.partitionBy(*CELL).orderBy(F.desc("change")))
    return changes.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "change")


def open_work(changes: DataFrame) -> DataFrame:
    """Cells whose latest value isn't a positive number: what is left to be estimated."""
    return current(changes).where("status <> 'valid'").select(*CELL, "value", "status")
