"""Manifests, configurations and partitioned outputs."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lrforge.schemas import SCENARIO_CONFIG, require_columns

TRUE = ("1", "true", "yes", "on")
SCENARIO_DEFAULTS = {
    "sheet_name": "0", "parser_profile": "matrix_simple", "key_feature_token": "^key feature", "pair_scope": "all", "expected_category_count": None,
    "exemplar_strategy": "parenthetical", "max_exemplars_per_category": 3, "exclude_categories": [],
}


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] = ()) -> DataFrame:
    """A CSV file with a header and an explicit schema; quotes are doubled, values may span lines."""
    return require_columns(spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False), list(required), path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, also if there are no rows."""
    (df if not df.isEmpty() else df.coalesce(1)).write.mode("overwrite").csv(path, header=True, escape='"')


def read_scenarios(spark: SparkSession, text: str) -> DataFrame:
    """Scenario configuration from YAML (or JSON) text: a list under `scenarios` that isn't empty, defaults filled in."""
    try:
        import yaml

        loaded = yaml.safe_load(text)
    except ImportError:
        loaded = json.loads(text)
    scenarios = loaded.get("scenarios") if isinstance(loaded, dict) else None
    if not isinstance(scenarios, list) or not scenarios:
        raise ValueError("scenarios must be a list with an entry at least")
    fields = [f.split()[0] for f in SCENARIO_CONFIG.split(", ")]
    return spark.createDataFrame([tuple((SCENARIO_DEFAULTS | s).get(f) for f in fields) for s in scenarios], SCENARIO_CONFIG)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON manifest, whose top level must be an object."""
    loaded = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(loaded, dict):
        raise ValueError(f"{path} holds no JSON object")
    return loaded


def run_manifest(df: DataFrame, hashes: dict[str, str], warnings: list[str]) -> DataFrame:
    """One row of provenance: when, how many rows and scenarios, hashes of inputs, warnings, and all of it as JSON."""
    row = df.agg(F.count("*").alias("rows"), F.countDistinct("scenario_id").alias("scenarios")).withColumns({
        "created_utc": F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'"),
        "hashes": F.create_map(*[F.lit(x) for kv in hashes.items() for x in kv]).cast("map<string,string>"),
        "warnings": F.array(*map(F.lit, warnings)).cast("array<string>"),
    })
    return row.withColumn("json", F.to_json(F.struct(*row.columns)))


def models(spark: SparkSession, root: str) -> list[str]:
    """Model ids of an output root that is partitioned by model_id, in order; an error if there are none."""
    found = sorted(r[0] for r in spark.read.parquet(root).select("model_id").distinct().collect())  # a partition column: few values
    if not found:
        raise ValueError(f"no model's outputs below {root}")
    return found


def write_by_model(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("model_id", "scenario_id").parquet(root)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, bytes) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


@dataclass(frozen=True)
class RuntimeConfig:
    """Settings of a run, from variables with a common prefix."""

    resume_mode: str = "recompute"
    max_pairs: int | None = None
    scenarios: tuple[str, ...] | None = None
    max_retries: int = 2
    backoff_s: float = 1.0
    allow_partial: bool = False

    @classmethod
    def from_env(cls, prefix: str = "LRFORGE_", env: dict[str, str] | None = None) -> RuntimeConfig:
        env = os.environ if env is None else env
        raw = {k.removeprefix(prefix).lower(): v.strip() for k, v in env.items() if k.startswith(prefix) and v.strip()}
        return cls(
            raw.get("resume_mode", "recompute"), int(raw["max_pairs"]) if "max_pairs" in raw else None,
            tuple(x.strip() for x in raw["scenarios"].split(",") if x.strip()) if "scenarios" in raw else None,
            int(raw.get("max_retries", 2)), float(raw.get("backoff_s", 1.0)), raw.get("allow_partial", "").lower() in TRUE,
        )
