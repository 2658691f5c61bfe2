"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Arrow batches that go to Python workers are cut at this many bytes, so that
#: long texts can't make one batch outgrow a worker's memory.
ARROW_BATCH_BYTES = 8 << 20
BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own;
    on a cluster, where such a folder isn't shared, that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lrforge-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table or files in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later reads don't recompute, and no lost executor loses it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Writes a Parquet table into the shared folder and reads it back.

    Spark then knows the table's true size, so it broadcasts only what is below
    spark.sql.autoBroadcastJoinThreshold.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's byte limit of Arrow batches to ARROW_BATCH_BYTES if it is higher."""
    spark = df.sparkSession
    held = spark.conf.get(BATCH_BYTES_KEY)
    if not held.isdigit() and not held.endswith("b") or int(held.rstrip("b")) > ARROW_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES_KEY, str(ARROW_BATCH_BYTES))
    return df


def release_memory() -> None:
    """Hands freed memory back to the system: Python workers outlive their tasks, and idle ones should be small."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns as one struct, `row`, in which their names can't clash with others."""
    return F.struct(*[named(c) for c in df.columns]).alias("row")


def map_texts(df: DataFrame, text_col: str, work: Callable[[list[str | None]], list[pa.Array]], added: list[T.StructField], drop_text: bool = True) -> DataFrame:
    """Adds columns that work returns for the texts of a batch; the other columns pass through, but for those whose names the new ones take."""
    taken = {f.name.lower() for f in added}
    if text_col.lower() in taken:
        df, text_col = df.withColumnRenamed(text_col, f"{text_col}__text"), f"{text_col}__text"
    kept = [f for f in df.schema.fields if f.name.lower() not in taken and (f.name != text_col or not drop_text)]
    names = [f.name for f in kept]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = work(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names] + new
                yield pa.RecordBatch.from_arrays(columns, names=names + [f.name for f in added])
        release_memory()

    return bounded_batches(df).mapInArrow(go, T.StructType(kept + added))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", most_rows: int = 20_000) -> DataFrame:
    """Joins with a table of one row a key that is expected to be small.

    Its rows are counted: up to most_rows it is broadcast; beyond that the join
    is a sort-merge join, whose hot keys adaptive execution splits.
    """
    if len(small.limit(most_rows + 1).select(F.lit(1)).take(most_rows + 1)) <= most_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


#: CRC-32 of the text {0} in DuckDB, bit by bit; for the SQL of queries that deal rows by it.
CRC32_SQL = (
    "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT), lambda a, c: list_reduce(range(8), lambda b, i: xor(b >> 1, 3988292384::UBIGINT * (b & 1)), xor(a, c)), 4294967295::UBIGINT), 4294967295::UBIGINT)"
)

KEY_DIGITS = 13  # 52 bits, which a double holds exactly


def random_key(id_col: Column, seed: str) -> Column:
    """A hash-random long below 16^KEY_DIGITS, from the id as text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, KEY_DIGITS), 16, 10).cast("long")


def bounded_sample(rows: DataFrame, id_col: str, most: int, seed: str = "fit") -> DataFrame:
    """All rows, or about `most` of them (within chance) whose hash-random keys are lowest.

    For fitting models only. Which rows are taken depends on ids and their number alone.
    """
    n = rows.count()
    return rows if n <= most else rows.where(random_key(F.col(id_col), seed) < int(16**KEY_DIGITS * (most / n)))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into this fold; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
