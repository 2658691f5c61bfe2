"""Explicit schemas of the tables that stages exchange, and their contract check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "scenario_id string, sheet string, row_idx int, col_idx int, value string"
SCENARIO_CONFIG = (
    "scenario_id string, source_workbook string, sheet_name string, parser_profile string, key_feature_token string, pair_scope string, "
    "expected_category_count int, exemplar_strategy string, max_exemplars_per_category int, exclude_categories array<string>"
)
INPUTS_MANIFEST = (
    "scenario_id string, source_workbook string, source_sheet string, schema_order int, schema_row_idx int, schema_sheet_name string, "
    "categories_count int, findings_count int, normalized_input_workbook string, warnings string"
)
PAIRS_MANIFEST = (
    "scenario_id string, pair_index int, source_workbook string, source_sheet string, parser_profile string, category_left string, "
    "category_right string, findings_count int, input_workbook string, output_workbook string"
)
SCHEMA_PRIORS = (
    "scenario_id string, source_workbook string, source_sheet string, schema_order int, schema_row_idx int, schema_sheet_name string, prior_row_idx int, "
    "category_order int, category string, prior_raw double, prior_normalized double, prior_vector_sum_raw double"
)
LEDGER = "scenario_id string, status string, start_utc string, end_utc string, exit_code int, log_path string"


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    """The table itself, or an error that names every column it lacks."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Adds optional columns that are absent, with a literal or a Column each."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value if hasattr(value, "alias") else F.lit(value))
    return df
