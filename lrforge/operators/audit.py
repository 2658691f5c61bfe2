"""Audits: what was expected against what is there, and whether projected ratios are coherent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lrforge.functions.numeric import SIGN_MARGIN, classify_cell, ovr_posterior
from lrforge.functions.text import is_example_header, normalize_cell
from lrforge.operators.quantiles import summarized

SUM_TOLERANCE = 1e-6


def classified(expected: DataFrame, output: DataFrame, position: list[str], value: str = "value") -> DataFrame:
    """Every expected cell with raw_value, status and numeric_value; what the output lacks is missing."""
    joined = expected.join(output.select(*position, F.col(value).alias("raw_value")), position, "left")
    return joined.withColumn("cell", classify_cell(F.col("raw_value"))).withColumn("status", F.col("cell.status")).withColumn("numeric_value", F.col("cell.numeric_value")).drop("cell")


def ovr_positions(cells: DataFrame) -> DataFrame:
    """(scenario_id, sheet, row_idx, col_idx, finding, category): the cells of one-vs-rest sheets that should hold a ratio.

    Columns whose header names a category, without example columns, by rows that name a finding.
    """
    sheet = ["scenario_id", "sheet"]
    text = normalize_cell(F.col("value"), True)
    heads = cells.where((F.col("row_idx") == 0) & (F.col("col_idx") >= 1) & (text != "") & ~is_example_header(text)).select(*sheet, "col_idx", text.alias("category"))
    sides = cells.where((F.col("col_idx") == 0) & (F.col("row_idx") >= 1) & (text != "")).select(*sheet, "row_idx", text.alias("finding"))
    return sides.join(heads, sheet).select(*sheet, "row_idx", "col_idx", "finding", "category")


def model_audit(positions: DataFrame, output: DataFrame, models: list[str], by: list[str] = ("scenario_id", "sheet")) -> tuple[DataFrame, DataFrame]:
    """(cells, summary) of every model and every sheet of the positions, whether or not the model has written it.

    models is a stated list; output: (model_id, by, row_idx, col_idx, value). sheet_exists
    tells a sheet that is wholly absent from one with gaps.
    """
    by = list(by)
    key = ["model_id", *by, "row_idx", "col_idx"]
    expected = positions.withColumn("model_id", F.explode(F.array(*map(F.lit, models))))
    cells = classified(expected, output, key)
    there = output.select("model_id", *by).distinct().withColumn("sheet_exists", F.lit(True))
    summary = quality_summary(cells, ["model_id", *by]).join(there, ["model_id", *by], "left")
    return cells, summary.withColumn("sheet_exists", F.coalesce("sheet_exists", F.lit(False)))


def invalid_cells(cells: DataFrame) -> DataFrame:
    return cells.where("status <> 'valid'")


def _counts() -> list[Column]:
    of = lambda status: F.count_if(F.col("status") == status).alias(f"{status}_cells")
    return [F.count("*").alias("expected_cells"), F.count_if(F.col("status") == "valid").alias("valid_positive_cells"), of("missing"), of("non_numeric"), of("non_positive"), F.count_if(F.col("status") != "valid").alias("total_invalid_cells")]


def quality_summary(cells: DataFrame, by: list[str], manifest: DataFrame | None = None) -> DataFrame:
    """Status counts of each sheet and whether it passes: nothing invalid, and the shape that the manifest states.

    manifest: (by, categories_count, findings_count); sheets that it alone has come with
    zero cells, and pass if they should have none.
    """
    counts = cells.groupBy(*by).agg(*_counts())
    if manifest is None:
        return counts.withColumn("passes", (F.col("total_invalid_cells") == 0) & (F.col("valid_positive_cells") == F.col("expected_cells")))
    joined = manifest.select(*by, (F.col("categories_count") * F.col("findings_count")).cast("long").alias("expected_cells_manifest")).join(counts, by, "left")
    zeros = [c for c in counts.columns if c not in by]
    joined = joined.select(*by, "expected_cells_manifest", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros])
    same = F.col("expected_cells_manifest") == F.col("expected_cells")
    return joined.withColumn("schema_shape_matches_manifest", same).withColumn("passes", (F.col("total_invalid_cells") == 0) & (F.col("valid_positive_cells") == F.col("expected_cells")) & same)


def totals(summary: DataFrame) -> DataFrame:
    """One row over all sheets, with the exit codes: 1 if a cell is invalid, 1 if a sheet doesn't pass."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in summary.columns if c.endswith("_cells")]
    rows = summary.agg(F.count("*").alias("sheets"), F.count_if(~F.col("passes")).alias("failed_sheets"), *sums)
    return rows.withColumn("exit_by_cells", (F.col("total_invalid_cells") > 0).cast("int")).withColumn("exit_by_sheets", (F.col("failed_sheets") > 0).cast("int"))


def quantiles(df: DataFrame, by: list[str], columns: list[str], poisoned: bool = False) -> DataFrame:
    """Median and 90th percentile with linear interpolation; NaN is skipped, or makes them null if poisoned."""
    wanted = {f"{name}_{c}": (F.col(c).cast("double"), p) for c in columns for name, p in (("median", 0.5), ("p90", 0.9))}
    found = summarized(df, by, [F.count_if(F.isnan(c)).alias(f"_nan_{c}") for c in columns], wanted)
    whole = lambda name: F.when(F.col("_nan_" + name.split("_", 1)[1]) == 0, F.col(name)).alias(name) if poisoned else F.col(name)
    return found.select(*by, *map(whole, wanted))


def coherence_rows(raw: DataFrame, fitted: DataFrame, row: list[str], priors: DataFrame, tolerance: float = SUM_TOLERANCE) -> DataFrame:
    """Per finding row that is complete on both sides: gaps before and after, signs before and after, problems.

    raw, fitted: (row, category_order, status, numeric_value); priors: (scenario_id,
    category_order, prior). Rows with an invalid fitted cell are counted by nobody, as
    they can't be checked; `checked` is false for them.
    """
    key = [*row, "category_order"]
    both = raw.select(*key, F.col("numeric_value").alias("raw"), (F.col("status") == "valid").alias("raw_ok")).join(fitted.select(*key, F.col("numeric_value").alias("fit"), (F.col("status") == "valid").alias("fit_ok")), key, "left")
    both = both.join(priors, ["scenario_id", "category_order"], "left")
    gap = lambda lr: F.abs(F.sum(ovr_posterior(F.col("prior"), F.col(lr))) - 1)
    signs = lambda lr: F.bool_and(F.col(lr) > 1 + SIGN_MARGIN) | F.bool_and(F.col(lr) < 1 - SIGN_MARGIN)
    rows = both.groupBy(*row).agg(
        F.bool_and(F.coalesce("fit_ok", F.lit(False))).alias("checked"), F.bool_and(F.coalesce("fit_ok", F.lit(False)) & F.col("raw_ok")).alias("complete"),
        gap("raw").alias("raw_gap"), gap("fit").alias("after_gap"), signs("raw").alias("sign_impossible_before"), signs("fit").alias("sign_impossible_after"),
        F.percentile(F.exp(F.abs(F.ln("fit") - F.ln("raw"))), F.lit(0.5)).alias("median_adjustment_mult"),
    )
    status = F.when(~F.col("checked"), None).when(F.col("after_gap") > tolerance, "posterior_sum_mismatch").when(F.col("sign_impossible_after"), "sign_impossible_after")
    return rows.withColumn("status", status)


def coherence_summary(rows: DataFrame, by: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Coherence audit of a model and scenario; solver failures (by, failures) default to 0."""
    checked, complete = F.col("checked"), F.col("complete")
    counts = [
        F.count_if(checked).alias("rows_checked"), F.count_if(~checked).alias("rows_skipped"),
        F.count_if(complete & F.col("sign_impossible_before")).alias("sign_impossible_rows_before"), F.count_if(checked & F.col("sign_impossible_after")).alias("sign_impossible_rows_after"),
        F.count_if(F.col("status").isNotNull()).alias("coherence_invalid_rows"),
    ]
    of = {"raw_gap": ("raw_gap", complete), "after_gap": ("after_gap", checked), "adjustment_mult": ("median_adjustment_mult", complete)}
    summary = summarized(rows, by, counts, {f"{name}_{out}": (F.when(ok, F.col(c)), q) for out, (c, ok) in of.items() for name, q in (("median", 0.5), ("p90", 0.9))})
    if failed is None:
        return summary.withColumn("solver_failures", F.lit(0).cast("long"))
    return summary.join(failed.select(*by, F.col("failures").alias("solver_failures")), by, "left").withColumn("solver_failures", F.coalesce("solver_failures", F.lit(0)).cast("long"))


def projection_summary(projected: DataFrame, by: list[str]) -> DataFrame:
    """Rows projected and failed, gaps and changes, sign-impossible rows before and after."""
    ok = F.col("result.success")
    flat = projected.select(
        *by, ok.alias("ok"), F.when(ok, F.abs(F.col("result.sum_q_init") - 1)).alias("gap"), F.col("result.sign_impossible_raw").alias("before"), F.col("result.sign_impossible_fitted").alias("after"),
        F.when(ok, F.array_max(F.zip_with("ovr_lr", "result.fitted_ovr_lr", lambda a, b: F.abs(F.ln(a) - F.ln(b))))).alias("largest"),
    )
    counts = [
        F.count("*").alias("rows_total"), F.count_if("ok").alias("rows_projected"), F.count_if(~F.col("ok")).alias("rows_failed"),
        F.count_if("before").alias("sign_impossible_rows_before"), F.count_if("after").alias("sign_impossible_rows_after"),
    ]
    of = {"sum_q_init_gap": "gap", "max_abs_log_change": "largest"}
    return summarized(flat, by, counts, {f"{name}_{out}": (F.col(c), q) for out, c in of.items() for name, q in (("median", 0.5), ("p90", 0.9))})


def adjustment_tail(adjusted: DataFrame, by: list[str]) -> DataFrame:
    """Median, 90th and 99th percentile and largest of the factors by which ratios were changed, up or down."""
    rows = adjusted.select(*by, F.exp("abs_log_change").alias("change"))
    return summarized(rows, by, [F.max("change").alias("max_mult_change")], {f"{name}_mult_change": (F.col("change"), q) for name, q in (("median", 0.5), ("p90", 0.9), ("p99", 0.99))})


def top_adjustments(adjusted: DataFrame, row: list[str], n: int = 500) -> DataFrame:
    """The n categories that the projection changed most, ties by key."""
    return adjusted.orderBy(F.desc("abs_log_change"), *row, "category_order").limit(n)
