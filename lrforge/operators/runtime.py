"""What remains to be done: resume modes, repairs, ledgers and write guards, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lrforge.functions.numeric import classify_cell
from lrforge.schemas import require_columns
from lrforge.session import Scratch

MODES = ("recompute", "skip_passing", "repair_invalid")


def resume_mode(mode: str | None, repair_flag: bool = False) -> str:
    """The mode to run in; the older flag asks for repairs unless another mode than recompute is named."""
    mode = mode or "recompute"
    if mode not in MODES:
        raise ValueError(f"resume mode must be one of {MODES}, not {mode!r}")
    return "repair_invalid" if repair_flag and mode == "recompute" else mode


def passing(output: DataFrame, by: list[str]) -> DataFrame:
    """Keys whose every output cell is valid."""
    status = classify_cell(F.col("value"))["status"]
    return output.groupBy(*by).agg(F.bool_and(status == "valid").alias("ok")).where("ok").select(*by)


def to_run(work: DataFrame, output: DataFrame, by: list[str], mode: str = "recompute", invalid: DataFrame | None = None) -> DataFrame:
    """Rows of a work list that a mode leaves to be run: all, those whose output doesn't pass, or those that the list of invalid rows names.

    These joins come before the costly estimator. An empty list of invalid rows is an error, as nothing can be repaired then.
    """
    mode = resume_mode(mode)
    if mode == "skip_passing":
        return work.join(passing(output, by), by, "left_anti")
    if mode == "repair_invalid":
        if invalid is None or invalid.isEmpty():
            raise ValueError("no invalid rows to repair")
        return work.join(invalid.select(*by).distinct(), by, "left_semi")
    return work


def repair_list(invalid: DataFrame, model: str | None = None, scenarios: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Invalid rows to estimate again: of a model and of some scenarios, in order, the first few."""
    require_columns(invalid, ["model_id", "scenario_id", "row_index"], "invalid rows")
    if model is not None:
        invalid = invalid.where(F.col("model_id") == model)
    if scenarios is not None:
        invalid = invalid.where(F.col("scenario_id").isin(scenarios))
    order = [c for c in ("scenario_id", "pair_index", "output_workbook", "row_index") if c in invalid.columns]
    rows = invalid.orderBy(*order)
    return rows.limit(most) if most is not None else rows


def upsert(old: DataFrame, new: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Old rows with the new value where there is one."""
    return old.join(new.select(*key, F.col(value).alias("_new")), key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def repair_table(spark: SparkSession, path: str, patches: DataFrame, key: list[str], value: str = "value", partitions: tuple[str, ...] = ("model_id", "scenario_id")) -> DataFrame:
    """Writes patches (key, value) into a Parquet table that is partitioned by model and scenario; returns the table.

    Only partitions that a patch touches are read and written, by dynamic partition
    overwrite: their new files are staged and take the old ones' place when the job
    commits, and all other partitions keep their files. Patches for keys that the table
    doesn't have change nothing; of several for one key the largest value counts; a null value is no patch.
    """
    parts = list(partitions)
    with Scratch(spark, "repair") as scratch:
        new = scratch.table(patches.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max(value).alias(value)))
        table = _partitioned(spark, path, parts)
        columns = table.columns
        touched = table.join(F.broadcast(new.select(*parts).distinct()), parts, "left_semi")
        changed = scratch.table(upsert(touched, new, key, value).select(*columns))
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    spark.catalog.refreshByPath(path)
    return _partitioned(spark, path, parts)


def _partitioned(spark: SparkSession, path: str, partitions: list[str]) -> DataFrame:
    """The table, with partition values as the texts they are."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name in partitions else f.dataType) for f in found])).parquet(path)


def fill_blank(old: DataFrame, new: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """As upsert, but only blank cells take the new value."""
    joined = old.join(new.select(*key, F.col(value).alias("_new")), key, "left")
    return joined.withColumn(value, F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.coalesce("_new", value)).otherwise(F.col(value))).drop("_new")


def unfinished(scenarios: DataFrame, ledger: DataFrame) -> DataFrame:
    """Scenarios without a success in the ledger."""
    return scenarios.join(ledger.where("status = 'success'").select("scenario_id").distinct(), "scenario_id", "left_anti")


def append_ledger(ledger_path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(ledger_path)


def write_guarded(df: DataFrame, path: str, overwrite: bool = False, partial: bool = False, allow_partial: bool = False) -> None:
    """Writes Parquet; existing output stays unless overwrite, a partial result is refused unless allowed."""
    if partial and not allow_partial:
        raise ValueError("a limited run writes only if partial output is allowed")
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first of these paths that exists, in any store that Spark reads; None if none does."""
    for path in filter(None, paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    return None


def repair_input(spark: SparkSession, explicit: str | None, root: str, model_id: str, name: str = "invalid_rows") -> str:
    """The list of rows to repair: the one that was named, else the model's, else the general one. A named one must exist."""
    found = first_existing(spark, explicit) if explicit else first_existing(spark, f"{root}/{model_id.replace('/', '_')}/{name}", f"{root}/{name}")
    if found is None:
        raise FileNotFoundError(explicit or f"{root}/{name}")
    return found


def failure_input(spark: SparkSession, explicit: str | None, root: str, models: list[str], name: str = "projection_failures") -> str | None:
    """The solver's failures: the list that was named, else the model's own if there is exactly one model; None if there is none."""
    if explicit:
        return repair_input(spark, explicit, root, "", name)
    return first_existing(spark, f"{root}/{models[0].replace('/', '_')}/{name}") if len(models) == 1 else None
