"""Estimators of likelihood ratios: empirical ones from counts, and external ones behind a protocol."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lrforge.functions.text import TRANSIENT_MARKERS
from lrforge.operators.plan import with_result_column
from lrforge.session import Scratch
from lrforge.sources.stores import store_of

REMINDER = "Answer with a positive finite number only."


class Estimator(Protocol):
    """Answers one request, a dict of its row's columns; attempt counts from 0. May raise."""

    def __call__(self, request: dict, attempt: int) -> float | str: ...


def empirical(counts: DataFrame, group: list[str], smoothing: float = 0.0) -> DataFrame:
    """One-vs-rest ratios of a cube (group, category, finding, n): P(finding | category) / P(finding | rest), and priors.

    With smoothing 0 the ratios of one finding are exactly coherent under the priors.
    """
    n = F.col("n")
    total = lambda *by: F.sum("n").over(W.partitionBy(*group, *by))
    rows = counts.withColumn("n_category", total("category")).withColumn("n_finding", total("finding")).withColumn("n_all", total())
    inside = (n + smoothing) / (F.col("n_category") + 2 * smoothing)
    outside = (F.col("n_finding") - n + smoothing) / (F.col("n_all") - F.col("n_category") + 2 * smoothing)
    defined = (F.col("n_all") > F.col("n_category")) & (outside > 0)
    order = F.dense_rank().over(W.partitionBy(*group).orderBy("category"))
    return rows.withColumn("prior", F.col("n_category") / F.col("n_all")).withColumn("lr", F.when(defined, inside / outside)).withColumn("category_order", order)


def differential(counts: DataFrame, group: list[str], smoothing: float = 0.5) -> DataFrame:
    """Ratio P(finding | left) / P(finding | right) for every pair of a group's categories."""
    shares = counts.withColumn("share", (F.col("n") + smoothing) / (F.sum("n").over(W.partitionBy(*group, "category")) + 2 * smoothing))
    left = shares.select(*group, "finding", F.col("category").alias("category_left"), F.col("share").alias("left"))
    right = shares.select(*group, "finding", F.col("category").alias("category_right"), F.col("share").alias("right"))
    return left.join(right, [*group, "finding"]).where("category_left < category_right").withColumn("lr", F.col("left") / F.col("right"))


def transient(error: Exception) -> bool:
    return any(m in str(error).lower() for m in TRANSIENT_MARKERS)


def fallback(*backends: Estimator) -> Estimator:
    """An estimator that asks one backend after the other until one answers; if none does, the error names what each of them said."""

    def ask(request: dict, attempt: int) -> float | str:
        errors = []
        for backend in backends:
            try:
                return backend(request, attempt)
            except Exception as e:  # noqa: BLE001 - whatever it is, the next backend is asked
                errors.append(f"{getattr(backend, '__name__', type(backend).__name__)}: {e}")
        raise RuntimeError("no backend answered: " + " | ".join(errors))

    return ask


def laddered(call: Callable[[dict, int, dict], float | str], ladder: list[dict]) -> Estimator:
    """A backend that is asked with one set of optional parameters after the other (each once), until one is taken."""

    def ask(request: dict, attempt: int) -> float | str:
        tried, error = [], None
        for parameters in ladder:
            if parameters not in tried:
                tried.append(parameters)
                try:
                    return call(request, attempt, parameters)
                except Exception as e:  # noqa: BLE001 - the backend may not know a parameter
                    error = e
        raise RuntimeError(f"refused with all {len(tried)} sets of parameters: {error}") from error

    return ask


def backend(kind: str, responses: Estimator, chat: Estimator) -> Estimator:
    """The backend of a setting: responses, chat, or auto, which asks the first and then the second."""
    known = {"responses": responses, "chat": chat, "auto": fallback(responses, chat)}
    if kind.strip().lower() not in known:
        raise ValueError(f"the backend must be one of {sorted(known)}, not {kind!r}")
    return known[kind.strip().lower()]


def attempt_all(call: Callable[[int], float | str], retries: int, backoff: float, sleep: Callable[[float], None] = time.sleep, longest: float | None = None) -> tuple[str | None, str | None]:
    """(value, None) of the first answer that is a positive number, else (None, error).

    Waits backoff * 2^attempt seconds, longest at most, and only after errors that may
    pass; with longest set, after any error.
    """
    error = None
    for attempt in range(retries + 1):
        try:
            value = float(call(attempt))
            if not 0 < value < float("inf"):
                raise ValueError(f"not a positive finite number: {value}")
            return repr(value), None
        except Exception as e:  # noqa: BLE001 - an estimator's failure is data
            error = f"{type(e).__name__}: {e}"
            if attempt < retries and (longest is not None or transient(e)):
                sleep(min(backoff * 2**attempt, longest or float("inf")))
    return None, error


def estimate(requests: DataFrame, make: Callable[[], Estimator], retries: int = 2, backoff: float = 1.0, sentinel: str | None = None, longest: float | None = None) -> DataFrame:
    """Adds value and error to requests. make builds one client a partition, on the executor.

    After the last retry value is the sentinel (such as ERROR, which audits class as
    non-numeric) or null, and error says why. Estimators cost money and may answer
    differently each time: write the result before it is used twice.
    """

    names = requests.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for batch in batches:
            rows = [attempt_all(lambda attempt, r=r: client(r | {"reminder": REMINDER if attempt else None}, attempt), retries, backoff, longest=longest) for r in batch.to_pylist()]
            added = [pa.array([v if v is not None else sentinel for v, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, "value", "error"])

    text = T.StringType()
    return requests.mapInArrow(go, T.StructType([*requests.schema.fields, T.StructField("value", text), T.StructField("error", text)]))


REQUEST_KEY = "request_key"
ANSWERS = f"{REQUEST_KEY} string, value string, error string"


def request_keys(requests: DataFrame) -> DataFrame:
    """Adds a key of all columns' values; requests that are equal in all of them are one."""
    return requests.withColumn(REQUEST_KEY, F.sha2(F.to_json(F.struct(*sorted(requests.columns)), {"ignoreNullFields": "false"}), 256))


class _Journal:
    """Answers of this folder that tasks have written, one small file each, so that a task that starts again finds them."""

    def __init__(self, folder: str):
        self.store, top = store_of(folder)
        self.top, self.known, self.read = top, {}, set()

    def find(self, key: str) -> list | None:
        """[value, error] of a key, after reading what lies beside it."""
        shelf = key[:2]
        if shelf not in self.read:
            self.read.add(shelf)
            self.store.create_dir(f"{self.top}/{shelf}", recursive=True)
            for info in self.store.get_file_info(fs.FileSelector(f"{self.top}/{shelf}")):
                if info.path.endswith(".json"):
                    with self.store.open_input_stream(info.path) as f, contextlib.suppress(ValueError):  # a torn file is no answer
                        self.known[info.base_name.split(".")[0]] = json.loads(f.read())
        return self.known.get(key)

    def keep(self, key: str, answer: list) -> None:
        """Under a name that is not read, then moved, so that half an answer is none."""
        self.known[key] = answer
        path = f"{self.top}/{key[:2]}/{key}"
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.store.open_output_stream(part) as f:
            f.write(json.dumps(answer).encode())
        self.store.move(part, f"{path}.json")


def estimate_once(requests: DataFrame, make: Callable[[], Estimator], ledger: str, retries: int = 2, backoff: float = 1.0, sentinel: str | None = None, longest: float | None = None) -> DataFrame:
    """As estimate, but each different request is asked once, in this run and all others with this ledger (a folder that executors reach).

    Answered keys are joined away before a client is made. A task writes each answer into
    a journal at once, so that its next attempt, a speculative copy that starts later, or a run
    after a failed one finds it; at the end the answers go to the ledger's table and the journal
    goes. Only two attempts that ask at the same moment can both ask. Failed requests aren't
    kept: they are asked again by the next run, but not by another attempt of their task.
    """
    spark = requests.sparkSession
    names = requests.columns
    keyed = request_keys(requests)
    table, journal = f"{ledger}/answers", f"{ledger}/journal"
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    known = spark.read.schema(ANSWERS).parquet(table) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else spark.createDataFrame([], ANSWERS)
    open_ = keyed.join(known.select(REQUEST_KEY), REQUEST_KEY, "left_anti").dropDuplicates([REQUEST_KEY]).select(REQUEST_KEY, *names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, held = None, _Journal(journal)
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                key = r.pop(REQUEST_KEY)
                answer = held.find(key)
                if answer is None:
                    client = client or make()
                    answer = list(attempt_all(lambda attempt, r=r: client(r | {"reminder": REMINDER if attempt else None}, attempt), retries, backoff, longest=longest))
                    held.keep(key, answer)
                out.append((key, *answer))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=[REQUEST_KEY, "value", "error"]) if out else pa.RecordBatch.from_pylist([], pa.schema([(c, pa.string()) for c in (REQUEST_KEY, "value", "error")]))

    shelves = open_.repartition(F.substring(REQUEST_KEY, 1, 2)).sortWithinPartitions(REQUEST_KEY)
    with Scratch(spark, "estimates") as scratch:
        asked = scratch.table(shelves.mapInArrow(go, ANSWERS))
        asked.where("value is not null").write.mode("append").parquet(table)
        top = spark._jvm.org.apache.hadoop.fs.Path(journal)
        top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)
        answers = known.unionByName(asked) if known.columns else asked
        told = keyed.join(known.unionByName(asked), REQUEST_KEY, "left").select(*names, F.coalesce("value", F.lit(sentinel)).alias("value"), "error")
        return scratch.kept(told)


def with_model_column(cells: DataFrame, estimates: DataFrame, model_id: str) -> DataFrame:
    """Sheets with a column lr_<model> more: estimates (scenario_id, sheet, row_idx, value), ERROR where value is null."""
    results = estimates.select("scenario_id", "sheet", "row_idx", F.coalesce("value", F.lit("ERROR")).alias("value"))
    return with_result_column(cells, results, "lr_" + model_id.replace("/", "_"))
