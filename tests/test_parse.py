"""Parsing and planning, on sheets that are drawn at random and read by a plain version as well."""

import random

import pytest
from pyspark.sql import functions as F

from lrforge.operators import parse, plan
from lrforge.schemas import CELLS

SHEET = ["scenario_id", "sheet"]


def cells(spark, *rows, name="orchard"):
    """Rows as lists; None is an empty cell."""
    return spark.createDataFrame([(name, "main", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None], CELLS)


def schemas_of(c):
    return parse.schema_rows(parse.category_blocks(parse.filled_rows(c)))


def drawn(seed):
    """A sheet with header rows of merged labels, a row of weights, and findings; and what should be read from it."""
    rng = random.Random(seed)
    n = rng.randint(2, 5)
    labels, widths = [f"Fruit {seed}-{i}" for i in range(n)], [rng.randint(1, 3) for _ in range(n)]
    starts = [1 + sum(widths[:i]) for i in range(n)]
    width = starts[-1] + widths[-1]
    head, weights = [None] * width, [None] * width
    numbers = [[round(rng.uniform(0.05, 0.9), 3) for _ in range(rng.randint(1, w))] for w in widths]
    for label, start, own in zip(labels, starts, numbers, strict=True):
        head[start] = label
        weights[start : start + len(own)] = map(str, own)
    weights[-1] = weights[-1] or "0.001"
    if weights[-1] == "0.001" and len(numbers[-1]) < widths[-1]:
        numbers[-1].append(0.001)
    findings = [[f"sign {i}"] if rng.random() < 0.7 else [""] for i in range(rng.randint(1, 6))]
    rows = [head, weights, ["KEY FEATURES of the harvest"], *findings]
    return rows, labels, starts, widths, numbers, [f[0] for f in findings if f[0]]


@pytest.mark.parametrize("seed", range(6))
def test_drawn_sheets(spark, seed):
    rows, labels, starts, widths, numbers, findings = drawn(seed)
    c = cells(spark, *rows)
    assert parse.key_rows(c).first()["key_row"] == 2
    assert [r["finding"] for r in parse.findings(c).orderBy("finding_order").collect()] == findings
    blocks = parse.category_blocks(parse.filled_rows(c)).where("row_idx = 0").orderBy("block").collect()
    assert [(b["label"], b["start_col"], b["end_col"]) for b in blocks] == [(x, s, s + w) for x, s, w in zip(labels, starts, widths, strict=True)]
    schemas = schemas_of(c)
    assert [(r["schema_order"], r["row_idx"]) for r in schemas.collect()] == [(1, 0)]
    spans = parse.category_spans(c, schemas).orderBy("category_order").collect()
    assert [(s["category"], s["start_col"]) for s in spans] == list(zip(labels, starts, strict=True)) and [s["end_col"] for s in spans[:-1]] == starts[1:]
    one = parse.parse_matrix(c).first()
    assert (one["categories"], one["findings"], one["key_row"], one["category_row"], one["warnings"], one["error"]) == (labels, findings, 2, 0, [], None)


def test_weights_and_their_total(spark):
    """The last span ends before a total that no label stands over; sums of a span's columns are its prior."""
    head, weights = [None, "Plum", None, "Pear", "Quince", None], [None, "1.5", "0.5", "4", "2", "8"]
    c = cells(spark, head, [None, "soft", "hard"], weights, ["key feature"], ["x"])
    schemas = schemas_of(c).where("row_idx = 0")
    assert [(s["start_col"], s["end_col"]) for s in parse.category_spans(c, schemas).orderBy("category_order").collect()] == [(1, 3), (3, 4), (4, 5)]
    got = parse.schema_priors(c, schemas).orderBy("category_order").collect()
    assert [r["prior_raw"] for r in got] == [2.0, 4.0, 2.0] and [r["prior_normalized"] for r in got] == [0.25, 0.5, 0.25]
    assert (got[0]["prior_row_idx"], got[0]["prior_vector_sum_raw"]) == (2, 8.0)
    # Of several rows of numbers the lowest that is full enough counts.
    more = cells(spark, head, weights, [None, "7", None, "1", "2"], [None, "9"], ["key feature"])
    assert parse.prior_rows(more, schemas_of(more).where("row_idx = 0")).first()["prior_row"] == 2


def test_header_rows_above_the_weights(spark):
    c = cells(spark, [None, "Tier one", None, "Tier two"], [None, "Plum", "Pear", "Fig"], [None, "Plum", "Pear", "Fig"], [None, "12", "13", "14"], ["Key feature: none"], ["f"])
    blocks = parse.category_blocks(parse.filled_rows(c))
    assert [(r["schema_order"], r["row_idx"], r["labels"]) for r in schemas_of(c).orderBy("schema_order").collect()] == [(1, 0, ["Tier one", "Tier two"]), (2, 1, ["Plum", "Pear", "Fig"])]
    assert parse.category_row(blocks, "matrix_with_preamble").first()["row_idx"] == 1 and parse.category_row(blocks).first()["row_idx"] == 0
    with pytest.raises(ValueError, match="unknown profile"):
        parse.category_row(blocks, "other")


def test_counts_that_differ(spark):
    c = cells(spark, [None, "Plum", "Pear"], [None, "1", "3"], ["Key feature"], ["f"]).unionByName(cells(spark, [None, "Fig"], ["nothing"], name="barren"))
    expected = spark.createDataFrame([("orchard", 5), ("barren", 1)], "scenario_id string, expected_category_count int")
    strict = {r["scenario_id"]: r for r in parse.parse_matrix(c, expected=expected).collect()}
    assert strict["orchard"]["error"] == "category count: 5 expected, 2 found" and strict["orchard"]["warnings"] == []
    assert strict["barren"]["error"] == "no key feature row" and strict["barren"]["findings"] is None
    loose = parse.parse_matrix(c, expected=expected, allow_mismatch=True)
    assert {r["scenario_id"]: (r["observed_categories"], r["findings"], r["warnings"], r["failed"]) for r in parse.qa_summary(loose).collect()} == {"orchard": (2, 1, "category count: 5 expected, 2 found", 0), "barren": (0, 0, "", 1)}


def test_repeated_labels_are_blocks_of_their_own(spark):
    """What stands in the first column fills the empty cell beside it, and so becomes a category."""
    c = cells(spark, ["Yield", None, "Plum", "Pear", "Plum"], ["Key feature"], ["f"])
    assert [r["label"] for r in parse.category_blocks(parse.filled_rows(c)).orderBy("block").collect()] == ["Yield", "Plum", "Pear", "Plum"]
    assert parse.parse_matrix(c).first()["categories_count"] == 4
    assert parse.category_row(parse.category_blocks(parse.filled_rows(c))).first()["labels"] == ["Yield", "Plum", "Pear"]


def test_derived_priors(spark):
    c = cells(spark, [None, "Plum", "Pear"], [None, "1", "3"], ["Key feature"], ["f"]).unionByName(cells(spark, [None, "Fig", "Nut"], [None, "2", "2"], ["Key feature"], name="grove"))
    schemas = schemas_of(c)
    manifest = schemas.select(*SHEET, "schema_order", F.col("row_idx").alias("schema_row_idx"))
    given = parse.schema_priors(c, schemas).where("scenario_id = 'grove'").withColumn("prior_raw", F.lit(9.0))
    got = {(r["scenario_id"], r["category"]): (r["prior_raw"], r["derived"]) for r in parse.ensure_priors(manifest, given, c).collect()}
    assert got == {("orchard", "Plum"): (1.0, True), ("orchard", "Pear"): (3.0, True), ("grove", "Fig"): (9.0, False), ("grove", "Nut"): (9.0, False)}


def test_columns_by_header(spark):
    c = cells(spark, ["Sign", "LR one", "lr two", "Note", "LR"])
    assert [r["col_idx"] for r in parse.columns_by_header(c, r"\bLR\b").orderBy("col_idx").collect()] == [1, 4]


@pytest.mark.parametrize("seed", range(3))
def test_pairs_and_exclusions(spark, seed):
    rng = random.Random(seed)
    names = [rng.choice("pqrstu") for _ in range(8)]
    cats = spark.createDataFrame([("orchard", x, i) for i, x in enumerate(names)], "scenario_id string, category string, category_order int")
    unique = list(dict.fromkeys(names))
    pairs = plan.category_pairs(plan.distinct_categories(cats, ["scenario_id"]), ["scenario_id"]).orderBy("pair_index").collect()
    assert [(p["category_left"], p["category_right"]) for p in pairs] == [(x, y) for i, x in enumerate(unique) for y in unique[i + 1 :]]
    gone = spark.createDataFrame([("orchard", unique[0]), ("orchard", "absent")], "scenario_id string, category string")
    assert [r["category"] for r in plan.unknown_exclusions(cats, gone).collect()] == ["absent"]
    assert plan.distinct_categories(cats, ["scenario_id"], gone).count() == len(unique) - 1


def test_pair_sheets(spark):
    c = cells(spark, ["Stone fruit", "", "", "Pome", ""], ["plum", "cherry", None, "pear"], ["sign"])
    assert {r["label"]: r["exemplars"] for r in plan.pair_categories(c).collect()} == {"Stone fruit": ["plum", "cherry"], "Pome": ["pear"]}
    results = spark.createDataFrame([("orchard", "main", 2, "0.75")], "scenario_id string, sheet string, row_idx int, value string")
    rows = plan.with_result_column(c, results, "Ratio").where("col_idx = 5").orderBy("row_idx").collect()
    assert [(r["row_idx"], r["value"]) for r in rows] == [(0, "Ratio"), (1, ""), (2, "0.75")]


def test_work_list_needs_columns(spark):
    with pytest.raises(ValueError, match="output_workbook"):
        plan.work_list(spark.createDataFrame([("a",)], "input_workbook string"))
    rows = spark.createDataFrame([("b", "o"), ("a", "o")], "input_workbook string, output_workbook string")
    assert [r["pair_index"] for r in plan.work_list(rows, most=1).collect()] == [1]
    assert plan.work_list(rows, scenarios=["x"]).count() == 0


def test_title_and_empty_columns(spark):
    c = cells(spark, ["leaf", " ", "bark"])
    assert parse.drop_empty_columns(c).count() == 2
    titles = spark.createDataFrame([("orchard", "main", "Trees")], "scenario_id string, sheet string, title string")
    assert plan.with_title_row(c, titles).where("row_idx = 0").first()["value"] == "Trees"
    assert plan.wide(c, 3).first()["c2"] == "bark"


def test_unions_payloads_and_other_diagnoses(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,), (None,)], "x int")
    assert sorted(str(r["x"]) for r in plan.union_distinct(a, b, b).collect()) == ["1", "2", "3", "None"]
    rows = spark.createDataFrame([("g", 2, '{"b": 1, "a": 2}'), ("g", 1, '{"a": 2, "b": 1}'), ("g", 3, '{"a": 2}'), ("h", 9, '{"a": 2}')], "k string, at int, payload string")
    got = plan.distinct_payloads(rows, ["k"], "at", "payload").collect()
    assert sorted((r["k"], r["at"], r["payload"]) for r in got) == [("g", 1, '{"a": 2, "b": 1}'), ("g", 3, '{"a": 2}'), ("h", 9, '{"a": 2}')]
    cases = spark.createDataFrame([(1, "p"), (2, "zz"), (3, None)], "case int, correct string")
    known = spark.createDataFrame([("p",), ("q",), ("p",)], "diagnosis string")
    assert sorted((r["case"], r["other"]) for r in plan.other_diagnoses(cases, known).collect()) == [(1, "q"), (2, "p"), (2, "q"), (3, "p"), (3, "q")]
    many = spark.range(300).select(F.format_string("d%03d", "id").alias("diagnosis"))
    assert plan.other_diagnoses(cases.select("case", F.lit("d007").alias("correct")), many).groupBy("case").count().collect()[0]["count"] == 299


def test_payloads_are_compared_whole(spark):
    """Types, order of lists, nested fields, white space, repeated fields and texts that are no JSON."""
    same = [['{"k": {"b": [1, {"y": 2, "x": "é"}], "a": null}}', '{"k":{"a":null,"b":[1,{"x":"é","y":2}]}}'], ['{"k": 1}'], ['{"k": "1"}'], ['{"k": true}'], ['{"k": [1, 2]}'], ['{"k": [2, 1]}'], ['{"k"', '{"k"'], ["{k}"], ['{"k":1,"k":1}'], ["[1]", "[ 1 ]"], [None, None], ['""'], [""]]
    rows = [("g", i * 10 + j, p) for i, alike in enumerate(same) for j, p in enumerate(alike)]
    got = plan.distinct_payloads(spark.createDataFrame(rows[::-1], "k string, at int, payload string"), ["k"], "at", "payload").collect()
    assert sorted((r["at"], r["payload"]) for r in got) == [(i * 10, alike[0]) for i, alike in enumerate(same)]


def test_wide_header_is_filled_in_linear_time(spark):
    """200,000 columns of one row, a cell in every seventh, one of them empty text, the first ones blank."""
    width = 200_000
    wide = spark.range(width).where("id >= 3 and (id % 7 = 3 or id = 199999)").select(
        F.lit("s").alias("scenario_id"), F.lit("t").alias("sheet"), F.lit(0).alias("row_idx"), F.col("id").cast("int").alias("col_idx"), F.when(F.col("id") == 17, "").otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("value")
    )
    key = spark.createDataFrame([("s", "t", 1, 0, "Key feature")], CELLS)
    got = parse.filled_rows(wide.unionByName(key)).orderBy("col_idx").toPandas()
    want, last = [], ""
    for i in range(width):
        if i >= 3 and (i % 7 == 3 or i == width - 1):
            last = "" if i == 17 else f"c{i % 5}"
        want.append(last)
    assert got["label"].tolist() == want and (got["width"] == width).all()
