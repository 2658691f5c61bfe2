"""Parsing headerless matrices: from a sparse table of cells to blocks, schemas, findings and priors.

cells: (scenario_id, sheet, row_idx, col_idx, value), a row a non-empty cell. Positions
carry the order, so every result has an order column. All work is partitioned by
sheet; one sheet's header rows are the largest group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lrforge.functions.numeric import is_numeric_label, to_number
from lrforge.functions.text import KEY_FEATURE, is_key_feature, is_tier_row, normalize_cell, schema_sheet_name

SHEET = ["scenario_id", "sheet"]


def key_rows(cells: DataFrame, pattern: str = KEY_FEATURE) -> DataFrame:
    """(sheet, key_row): the first row whose first cell names the key feature. Sheets without one are absent."""
    return cells.where((F.col("col_idx") == 0) & is_key_feature(F.col("value"), pattern)).groupBy(*SHEET).agg(F.min("row_idx").alias("key_row"))


def header_cells(cells: DataFrame, pattern: str = KEY_FEATURE) -> DataFrame:
    """Cells above the key row with key_row and the grid's width. One shuffle by sheet, which later steps keep."""
    sheet = W.partitionBy(*SHEET)
    is_key = (F.col("col_idx") == 0) & is_key_feature(F.col("value"), pattern)
    marked = cells.select(*SHEET, "row_idx", "col_idx", "value", F.min(F.when(is_key, F.col("row_idx"))).over(sheet).alias("key_row"), (F.max("col_idx").over(sheet) + 1).alias("width"))
    return marked.where("row_idx < key_row")


def filled_rows(cells: DataFrame, pattern: str = KEY_FEATURE) -> DataFrame:
    """Rows above the key row on a dense grid, each cell filled from the left, the first column included.

    A cell reaches to the next one of its row, so that the grid is made from pairs of
    neighbours: time is linear in its width, and no row is held as a whole.
    """
    row = W.partitionBy(*SHEET, "row_idx").orderBy("col_idx")
    spans = header_cells(cells, pattern).select(
        *SHEET, "row_idx", "width", "col_idx", normalize_cell(F.col("value")).alias("v"),
        F.when(F.lag("col_idx").over(row).isNull(), 0).otherwise(F.col("col_idx")).alias("from"), (F.coalesce(F.lead("col_idx").over(row), F.col("width")) - 1).alias("to"),
    )
    dense = spans.select(*SHEET, "row_idx", "width", "v", F.col("col_idx").alias("own"), F.explode(F.sequence("from", "to")).alias("col_idx"))
    return dense.select(*SHEET, "row_idx", "col_idx", "width", F.when(F.col("col_idx") >= F.col("own"), F.col("v")).otherwise("").alias("label"))


def category_blocks(filled: DataFrame) -> DataFrame:
    """(sheet, row_idx, block, label, start_col, end_col): runs of equal labels from column 1 on, end exclusive.

    Only adjacent equals merge; the last block ends at the grid's width.
    """
    row = [*SHEET, "row_idx"]
    order = W.partitionBy(*row).orderBy("col_idx")
    named = filled.where("col_idx >= 1 and label <> ''")
    runs = named.withColumn("new", (F.coalesce(F.lag("label").over(order), F.lit("")) != F.col("label")).cast("int")).withColumn("block", F.sum("new").over(order))
    blocks = runs.groupBy(*row, "block").agg(F.first("label").alias("label"), F.min("col_idx").alias("start_col"), F.max("width").alias("width"))
    following = F.lead("start_col").over(W.partitionBy(*row).orderBy("block"))
    return blocks.select(*row, F.col("block").cast("int").alias("block"), "label", "start_col", F.coalesce(following, F.col("width")).cast("int").alias("end_col"))


def _labels(blocks: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("block", "label", "start_col", "end_col")))
    rows = blocks.groupBy(*SHEET, "row_idx").agg(ordered.alias("blocks"))
    return rows.withColumn("labels", F.transform("blocks", lambda b: b["label"]))


def schema_rows(blocks: DataFrame) -> DataFrame:
    """Header rows that classify: two blocks or more, not all numeric, the first of equal label lists; schema_order from 1."""
    rows = _labels(blocks).where((F.size("labels") >= 2) & ~F.forall("labels", is_numeric_label))
    first = W.partitionBy(*SHEET, "labels").orderBy("row_idx")
    kept = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return kept.withColumn("schema_order", F.row_number().over(W.partitionBy(*SHEET).orderBy("row_idx"))).withColumn("categories_count", F.size("labels"))


def category_row(blocks: DataFrame, profile: str = "matrix_simple") -> DataFrame:
    """(sheet, row_idx, labels) of the category header: row 0, or with a preamble the row of most distinct labels that isn't all tiers."""
    rows = _labels(blocks).withColumn("labels", F.array_distinct("labels"))
    if profile == "matrix_simple":
        return rows.where("row_idx = 0").select(*SHEET, "row_idx", "labels")
    if profile != "matrix_with_preamble":
        raise ValueError(f"unknown profile {profile}")
    best = W.partitionBy(*SHEET).orderBy(F.desc(F.size("labels")), "row_idx")
    fits = rows.where((F.size("labels") >= 2) & ~is_tier_row(F.col("labels")))
    return fits.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(*SHEET, "row_idx", "labels")


def findings(cells: DataFrame, pattern: str = KEY_FEATURE) -> DataFrame:
    """(sheet, finding_order, row_idx, finding): non-empty first cells below the key row, duplicates kept."""
    below = cells.where("col_idx = 0").join(key_rows(cells, pattern), SHEET).where("row_idx > key_row").withColumn("finding", normalize_cell(F.col("value"))).where("finding <> ''")
    return below.select(*SHEET, F.row_number().over(W.partitionBy(*SHEET).orderBy("row_idx")).alias("finding_order"), "row_idx", "finding")


def parse_matrix(cells: DataFrame, profile: str = "matrix_simple", expected: DataFrame | None = None, allow_mismatch: bool = False, pattern: str = KEY_FEATURE) -> DataFrame:
    """One row a sheet: key_row, category_row, categories, findings, their counts, warnings, and error.

    expected: (scenario_id, expected_category_count). Another count is an error, or a
    warning if it is allowed. A sheet without key row, header or labels has an error
    and nulls; a sheet's failure is its own row, not the job's. categories are the
    labels of all blocks, so A, B, A are three.
    """
    blocks = category_blocks(filled_rows(cells, pattern))
    header = category_row(blocks, profile).select(*SHEET, F.col("row_idx").alias("category_row"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("block", "label"))), lambda b: b["label"])
    labels = blocks.join(header.withColumnRenamed("category_row", "row_idx"), [*SHEET, "row_idx"]).groupBy(*SHEET).agg(F.first("row_idx").alias("category_row"), named.alias("categories"))
    found = findings(cells, pattern).groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(F.struct("finding_order", "finding"))), lambda f: f["finding"]).alias("findings"))
    rows = cells.select(*SHEET).distinct().join(key_rows(cells, pattern), SHEET, "left").join(labels, SHEET, "left").join(found, SHEET, "left")
    rows = rows.withColumn("findings", F.when(F.col("key_row").isNotNull(), F.coalesce("findings", F.array().cast("array<string>")))).withColumn("categories_count", F.when(F.col("categories").isNotNull(), F.size("categories")))
    missing = F.when(F.col("key_row").isNull(), "no key feature row").when(F.col("categories").isNull(), "no category header")
    mismatch = F.lit(None).cast("string")
    if expected is not None:
        rows = rows.join(expected.select("scenario_id", "expected_category_count"), "scenario_id", "left")
        text = F.format_string("category count: %d expected, %d found", "expected_category_count", "categories_count")
        mismatch = F.when(F.col("expected_category_count") != F.col("categories_count"), text)
        rows = rows.withColumn("mismatch", mismatch)
        mismatch = F.col("mismatch")
    warnings = F.array_compact(F.array(mismatch)) if allow_mismatch else F.array().cast("array<string>")
    error = missing if allow_mismatch else F.coalesce(missing, mismatch)
    return rows.select(*SHEET, "key_row", "category_row", "categories", "categories_count", "findings", F.size("findings").alias("findings_count"), warnings.alias("warnings"), error.alias("error"))


def qa_summary(parsed: DataFrame) -> DataFrame:
    """(scenario_id, sheets, observed_categories, findings, warnings, failed): sums over a scenario's sheets, warnings in order of the sheets."""
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "warnings"))), lambda s: s["warnings"]))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return parsed.groupBy("scenario_id").agg(
        F.count("*").alias("sheets"), total("categories_count").alias("observed_categories"), total("findings_count").alias("findings"), F.array_join(ordered, "; ").alias("warnings"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )


def columns_by_header(cells: DataFrame, pattern: str, row: int = 0) -> DataFrame:
    """(sheet, col_idx, header): columns whose cell in the header row matches, by case."""
    return cells.where((F.col("row_idx") == row) & F.col("value").rlike(pattern)).select(*SHEET, "col_idx", F.col("value").alias("header"))


def ensure_priors(manifest: DataFrame, priors: DataFrame, cells: DataFrame, pattern: str = KEY_FEATURE) -> DataFrame:
    """priors, and for schemas of the manifest that have none those derived from their sheets; derived says which.

    manifest: (scenario_id, sheet, schema_order, schema_row_idx); priors: the columns of schema_priors.
    Only sheets with a missing schema are parsed.
    """
    key = [*SHEET, "schema_order"]
    missing = manifest.select(*key, F.col("schema_row_idx").alias("row_idx")).join(priors.select(*key).distinct(), key, "left_anti")
    found = schema_priors(cells.join(missing.select(*SHEET).distinct(), SHEET, "left_semi"), missing, pattern=pattern)
    return priors.select(*found.columns, F.lit(False).alias("derived")).unionByName(found.withColumn("derived", F.lit(True)))


def _schema_details(cells: DataFrame, schemas: DataFrame, least: int, pattern: str) -> DataFrame:
    """Per schema: spans before and after clipping, the prior row and its numbers, as arrays.

    A sheet's header is gathered once and joined with its schemas by sheet; all that
    follows is worked out within the row, without another shuffle.
    """
    number = to_number(F.col("value"))
    heads = header_cells(cells, pattern).where("col_idx >= 1").groupBy(*SHEET).agg(
        F.first("width").alias("width"),
        F.array_sort(F.collect_list(F.struct("col_idx", "row_idx", normalize_cell(F.col("value")).alias("label"), number.alias("number")))).alias("head"),
    )
    rows = schemas.select(*SHEET, "schema_order", F.col("row_idx").alias("at")).join(heads, SHEET)
    rows = rows.withColumn("own", F.expr("filter(head, c -> c.row_idx = at and c.label <> '')")).where("size(own) >= 2")
    end = "if(i < size(own) - 1, get(own, i + 1).col_idx, least(width, 2 * c.col_idx - get(own, i - 1).col_idx))"
    rows = rows.withColumn("spans", F.expr(f"transform(own, (c, i) -> named_struct('category_order', i + 1, 'category', c.label, 'start_col', c.col_idx, 'end_col', {end}))"))
    rows = rows.withColumn("numbers", F.expr("filter(head, c -> c.row_idx > at and c.number is not null)"))
    enough = f"size(filter(numbers, c -> c.row_idx = r)) >= greatest({least}, least(2, size(own)))"
    rows = rows.withColumn("prior_row", F.expr(f"array_max(filter(array_distinct(transform(numbers, c -> c.row_idx)), r -> {enough}))"))
    rows = rows.withColumn("numbers", F.expr("filter(numbers, c -> c.row_idx = prior_row)")).withColumn("last", F.expr("element_at(spans, -1)"))
    stop = F.expr("array_min(transform(filter(numbers, c -> c.col_idx > last.start_col and not exists(own, o -> o.col_idx = c.col_idx)), c -> c.col_idx))")
    rows = rows.withColumn("last_end", F.greatest(F.least("last.end_col", F.coalesce(stop, "last.end_col")), F.col("last.start_col") + 1))
    cut = "named_struct('category_order', s.category_order, 'category', s.category, 'start_col', s.start_col, 'end_col', if(i = size(spans) - 1, last_end, s.end_col))"
    return rows.withColumn("clipped", F.expr(f"transform(spans, (s, i) -> {cut})"))


def category_spans(cells: DataFrame, schemas: DataFrame, least: int = 2, pattern: str = KEY_FEATURE) -> DataFrame:
    """(sheet, schema_order, row_idx, category_order, category, start_col, end_col) from the labels as they stand, not filled.

    A span ends where the next begins; the last is as wide as the one before it, up to
    the grid's width. Rows with fewer than two labels give none.
    """
    return _schema_details(cells, schemas, least, pattern).select(*SHEET, "schema_order", F.col("at").alias("row_idx"), F.inline("spans"))


def prior_rows(cells: DataFrame, schemas: DataFrame, least: int = 2, pattern: str = KEY_FEATURE) -> DataFrame:
    """(sheet, schema_order, prior_row): the last row between schema and key row with enough numbers."""
    return _schema_details(cells, schemas, least, pattern).where("prior_row is not null").select(*SHEET, "schema_order", "prior_row")


def schema_priors(cells: DataFrame, schemas: DataFrame, least: int = 2, pattern: str = KEY_FEATURE) -> DataFrame:
    """Raw and normalized prior of every category, and the raw sum; null normalized if the sum isn't positive."""
    inside = "aggregate(filter(numbers, c -> c.col_idx >= s.start_col and c.col_idx < s.end_col), 0D, (t, c) -> t + c.number)"
    rows = _schema_details(cells, schemas, least, pattern).where("prior_row is not null").withColumn("raw", F.expr(f"transform(clipped, s -> {inside})"))
    rows = rows.withColumn("total", F.expr("aggregate(raw, 0D, (t, x) -> t + x)"))
    name = schema_sheet_name(F.col("schema_order"), F.col("at"), F.size("clipped"))
    each = rows.select(*SHEET, "schema_order", F.col("at").alias("schema_row_idx"), name.alias("schema_sheet_name"), F.col("prior_row").alias("prior_row_idx"), "total", F.inline(F.arrays_zip("clipped", "raw")))
    return each.select(
        *SHEET, "schema_order", "schema_row_idx", "schema_sheet_name", "prior_row_idx", "clipped.category_order", "clipped.category", F.col("raw").alias("prior_raw"),
        F.when(F.col("total") > 0, F.col("raw") / F.col("total")).alias("prior_normalized"), F.col("total").alias("prior_vector_sum_raw"),
    )


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    """Cells of columns that hold some text."""
    some = cells.where(normalize_cell(F.col("value")) != "").select(*SHEET, "col_idx").distinct()
    return cells.join(some, [*SHEET, "col_idx"], "left_semi")
