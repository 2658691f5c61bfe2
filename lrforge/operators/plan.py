"""Units of work: category pairs, one-vs-rest grids, sheets and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lrforge.functions.text import is_example_header, pair_filename, signed_findings
from lrforge.operators.numbering import numbered
from lrforge.schemas import require_columns, with_defaults

SHEET = ["scenario_id", "sheet"]


def distinct_categories(categories: DataFrame, group: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """(group, category, category_order): first places of categories, renumbered, without excluded (group[0], category)."""
    first = categories.groupBy(*group, "category").agg(F.min("category_order").alias("at"))
    if excluded is not None:
        first = first.join(excluded, [group[0], "category"], "left_anti")
    return first.select(*group, "category", F.row_number().over(W.partitionBy(*group).orderBy("at")).alias("category_order"))


def unknown_exclusions(categories: DataFrame, excluded: DataFrame, group: str = "scenario_id") -> DataFrame:
    return excluded.join(categories.select(group, "category").distinct(), [group, "category"], "left_anti")


def category_pairs(categories: DataFrame, group: list[str]) -> DataFrame:
    """All pairs of a group's categories in order, numbered from 1."""
    left = categories.select(*group, F.col("category").alias("category_left"), F.col("category_order").alias("left_order"))
    right = categories.select(*group, F.col("category").alias("category_right"), F.col("category_order").alias("right_order"))
    pairs = left.join(right, group).where("left_order < right_order")
    return pairs.withColumn("pair_index", F.row_number().over(W.partitionBy(*group).orderBy("left_order", "right_order")))


def pairs_manifest(pairs: DataFrame, findings_count: DataFrame, profile: str = "matrix_simple", root_in: str = "inputs", root_out: str = "outputs") -> DataFrame:
    """One row a pair: its files, and how many findings wait."""
    name = pair_filename(F.col("pair_index"), F.col("category_left"), F.col("category_right"))
    path = lambda root: F.concat_ws("/", F.lit(root), F.col("scenario_id"), name)
    counted = pairs.join(findings_count, "scenario_id")
    return counted.select("scenario_id", "pair_index", F.lit(profile).alias("parser_profile"), "category_left", "category_right", "findings_count", path(root_in).alias("input_workbook"), path(root_out).alias("output_workbook"))


def ovr_grid(findings: DataFrame, categories: DataFrame, group: list[str]) -> DataFrame:
    """Every finding with every category of its group; example columns are no targets."""
    return findings.join(categories.where(~is_example_header(F.col("category"))), group)


def ovr_sheet(findings: DataFrame, categories: DataFrame, group: list[str]) -> DataFrame:
    """Cells of an empty one-vs-rest sheet: a header row, then a row a finding."""
    corner = categories.select(*group).distinct().select(*group, F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Diagnosis:").alias("value"))
    head = categories.select(*group, F.lit(0).alias("row_idx"), F.col("category_order").cast("int").alias("col_idx"), F.col("category").alias("value"))
    side = findings.select(*group, F.col("finding_order").cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("finding").alias("value"))
    return corner.unionByName(head).unionByName(side)


def pair_sheet(pairs: DataFrame, findings: DataFrame, width: int) -> DataFrame:
    """Cells of pair sheets: labels at columns 0 and width, exemplars below them, findings from row 2 on.

    pairs: (scenario_id, pair_index, category_left, category_right, exemplars_left, exemplars_right).
    """
    key = ["scenario_id", "pair_index"]
    cell = lambda row, col, value: F.struct(F.lit(row).alias("row_idx"), F.lit(col).alias("col_idx"), value.alias("value"))
    labels = F.array(cell(0, 0, F.col("category_left")), cell(0, width, F.col("category_right")))
    spread = lambda column, start: F.transform(column, lambda x, i: F.struct(F.lit(1).alias("row_idx"), (i + start).alias("col_idx"), x.alias("value")))
    heads = pairs.select(*key, F.explode(F.concat(labels, spread("exemplars_left", 0), spread("exemplars_right", width))).alias("c")).select(*key, "c.*")
    rows = pairs.select(*key).join(findings, "scenario_id").select(*key, (F.col("finding_order") + 1).cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("finding").alias("value"))
    return heads.unionByName(rows)


def pair_categories(cells: DataFrame) -> DataFrame:
    """(sheet, label, exemplars) of sheets whose first row has two labels: what stands under each in row 1."""
    head = cells.where("row_idx = 0 and value <> ''").select(*SHEET, F.col("col_idx").alias("start_col"), F.col("value").alias("label"))
    end = F.coalesce(F.lead("start_col").over(W.partitionBy(*SHEET).orderBy("start_col")), F.lit(1 << 30))
    spans = head.withColumn("end_col", end).withColumn("n", F.count("*").over(W.partitionBy(*SHEET))).where("n = 2")
    under = cells.where("row_idx = 1 and value <> ''").select(*SHEET, "col_idx", "value")
    inside = spans.join(under, SHEET, "left").where("col_idx is null or (col_idx >= start_col and col_idx < end_col)")
    return inside.groupBy(*SHEET, "start_col", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda x: x["value"]).alias("exemplars"))


def plus_minus(findings: DataFrame) -> DataFrame:
    """Each finding as present and as absent; sub_order keeps the two in order."""
    return findings.select("*", F.posexplode(signed_findings(F.col("finding"))).alias("sub_order", "signed_finding"))


def with_result_column(cells: DataFrame, results: DataFrame, header: str) -> DataFrame:
    """Appends a column: its header in row 0, an empty cell in row 1, results (sheet, row_idx, value) below."""
    at = cells.groupBy(*SHEET).agg((F.max("col_idx") + 1).cast("int").alias("col_idx"))
    top = at.select(*SHEET, F.explode(F.array(F.struct(F.lit(0).alias("row_idx"), F.lit(header).alias("value")), F.struct(F.lit(1).alias("row_idx"), F.lit("").alias("value")))).alias("c"), "col_idx")
    top = top.select(*SHEET, "c.row_idx", "col_idx", "c.value")
    return cells.unionByName(top).unionByName(results.join(at, SHEET).select(*SHEET, "row_idx", "col_idx", "value"))


def with_title_row(cells: DataFrame, titles: DataFrame, blank_from: int | None = None) -> DataFrame:
    """Puts titles (sheet, title) in a new first row; from column blank_from on values are blanked if it is given."""
    value = F.col("value") if blank_from is None else F.when(F.col("col_idx") < blank_from, F.col("value")).otherwise("")
    moved = cells.select(*SHEET, (F.col("row_idx") + 1).cast("int").alias("row_idx"), "col_idx", value.alias("value"))
    return titles.select(*SHEET, F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.col("title").alias("value")).unionByName(moved)


def wide(cells: DataFrame, columns: int) -> DataFrame:
    """Rows of one sheet side by side, for export: c0, c1, ... up to a stated number of columns."""
    return cells.groupBy(*SHEET, "row_idx").pivot("col_idx", list(range(columns))).agg(F.first("value")).select(*SHEET, "row_idx", *[F.col(str(i)).alias(f"c{i}") for i in range(columns)])


def work_list(manifest: DataFrame, scenarios: list[str] | None = None, most: int | None = None) -> DataFrame:
    """A manifest's rows in order, those of some scenarios, the first few; optional columns get their defaults."""
    require_columns(manifest, ["input_workbook", "output_workbook"], "manifest")
    rows = with_defaults(manifest, {"scenario_id": "unknown"})
    if "pair_index" not in rows.columns:
        rows = numbered(rows, "pair_index", order=["input_workbook"], start=1).withColumn("pair_index", F.col("pair_index").cast("int"))
    if scenarios is not None:
        rows = rows.where(F.col("scenario_id").isin(scenarios))
    rows = rows.orderBy("scenario_id", "pair_index", "input_workbook")
    return rows.limit(most) if most is not None else rows


def first_scenarios(manifest: DataFrame, n: int) -> DataFrame:
    """Rows of the first n scenarios by name."""
    return manifest.join(manifest.select("scenario_id").distinct().orderBy("scenario_id").limit(n), "scenario_id", "left_semi")


def first_findings(findings: DataFrame, n: int, group: list[str]) -> DataFrame:
    return findings.withColumn("nth", F.row_number().over(W.partitionBy(*group).orderBy("finding_order"))).where(F.col("nth") <= n).drop("nth")


def other_diagnoses(cases: DataFrame, diagnoses: DataFrame, correct: str = "correct") -> DataFrame:
    """Each case with every diagnosis (a column of that name) but its correct one, as `other`; a case without a correct one has all.

    Diagnoses, which are as many as the results of a case, come as one array in one row.
    """
    every = diagnoses.agg(F.array_sort(F.collect_set("diagnosis")).alias("_all"))
    return cases.join(every).select(*cases.columns, F.explode(F.array_except("_all", F.array(correct))).alias("other"))


def union_distinct(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows that any of the frames has, each once."""
    for df in more:
        first = first.unionByName(df)
    return first.distinct()


def canonical_json(payload: Column) -> Column:
    """JSON text with the fields of all objects in order, at every depth, and types as they were; null where it doesn't parse.

    An object that repeats a field doesn't parse.
    """
    return F.to_json(F.try_parse_json(payload))


def distinct_payloads(rows: DataFrame, group: list[str], order: str, payload: str) -> DataFrame:
    """Of JSON values that are equal but for white space and the order of fields, the first of each group.

    1 and "1" differ, as do arrays in another order. Texts that don't parse are kept, each different one once; null is a payload too.
    """
    canonical = canonical_json(F.col(payload))
    key = F.struct(canonical.alias("json"), F.when(canonical.isNull(), F.col(payload)).alias("text"))
    return rows.groupBy(*group, key.alias("_key")).agg(F.min_by(payload, order).alias(payload), F.min(order).alias(order)).drop("_key")
