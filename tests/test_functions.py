import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lrforge.functions import numeric, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" if isinstance(v, (str, type(None))) else f"{k} double" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cell", "status", "value"),
    [
        ("17", "valid", 17.0), (" 0.375\t", "valid", 0.375), ("-0", "non_positive", 0.0), ("-3e2", "non_positive", -300.0), ("seldom", "non_numeric", None), (" ", "missing", None), (None, "missing", None),
        ("nan", "non_numeric", None), ("inf", "non_numeric", None), ("1.5d", "non_numeric", None), ("1_000", "valid", 1000.0), ("1e-400", "non_positive", 0.0), (" 2.5 ", "valid", 2.5), ("1e400", "non_numeric", None),
    ],
)
def test_cells_are_classified(spark, cell, status, value):
    got = one(spark, numeric.classify_cell(F.col("v")), v=cell)
    assert (got["status"], got["numeric_value"]) == (status, value)


def test_exemplars(spark):
    label = "Orchard trees (e.g., plum; sour cherry , , fig) (not: fern)"
    assert one(spark, text.exemplars(F.col("v"), 5), v=label) == ["plum", "sour cherry", "fig", "", ""]
    assert one(spark, text.exemplars(F.col("v"), 2), v=label) == ["plum", "sour cherry"]
    assert one(spark, text.exemplars(F.col("v"), 2), v=" Moss ") == ["Moss", ""]
    assert one(spark, text.exemplars(F.col("v"), 2, "label"), v=label) == [label, ""]
    with pytest.raises(ValueError):
        text.exemplars(F.col("v"), 0)


@given(st.text("ab \t\n\u00a0", max_size=12))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_collapse(spark, value):
    assert one(spark, text.collapse(F.col("v")), v=value) == " ".join(value.split())


def test_text(spark):
    assert one(spark, text.slug(F.col("v")), v="--") == "category"
    assert one(spark, text.slug(F.col("v")), v="Bark & Leaf (old)") == "bark_leaf_old"
    assert one(spark, text.slug(F.col("v")), v="x" * 47 + "__tail") == "x" * 47
    assert one(spark, text.schema_sheet_name(F.lit(12), F.lit(3), F.lit(40)), v="") == "s12_r03_40cat"
    assert one(spark, text.unfence(F.col("v")), v='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.answers_file(F.col("v")), v="t1.pdf") == "answers_t1.xlsx"
    assert one(spark, text.is_transient(F.col("v")), v="HTTP 503") and not one(spark, text.is_transient(F.col("v")), v="bad key")
    where = lambda prefix, v: one(spark, text.output_path(F.col("v"), prefix, F.lit("s"), "made/here"), v=v)
    assert where("root/made/", "root/made//a/b.xlsx") == "a/b.xlsx" and where("other/", "/x/made/here/a/b.xlsx") == "a/b.xlsx" and where("other/", "/x/b.xlsx") == "s/b.xlsx"
    assert where("p/", "p/" + "d/" * 4000 + "f") == "d/" * 4000 + "f"
    assert one(spark, text.relative_path(F.col("v"), "/top"), v="/top/a/b") == "a/b" and one(spark, text.relative_path(F.col("v"), "/top/"), v="/topmost/a") == "/topmost/a"
    assert one(spark, text.model_output_path("out/", F.col("v"), F.lit("a/b")), v="org/m") == "out/org_m/a/b"
    assert one(spark, text.references(F.col("v"), r"R\d+"), v="see R1, R22 and R1") == ["R1", "R22"]
    assert one(spark, text.example_list(F.split("v", ",")), v="a,,b") == "a, b" and one(spark, text.example_list(F.split("v", ",")), v="") == "-"
    assert one(spark, text.is_example_header(F.col("v")), v="For examples: x") and not one(spark, text.is_example_header(F.col("v")), v=None)
    assert one(spark, text.model_token(F.col("v")), v="org/model") == "org_model"
    assert one(spark, text.model_capabilities(F.col("v")), v="GPT-5-mini").asDict() == {"reasoning": True, "verbosity": True, "allow_temp": False}
    assert one(spark, text.model_capabilities(F.col("v")), v="o3-x").asDict() == {"reasoning": True, "verbosity": False, "allow_temp": False}
    assert [one(spark, text.answer_of(F.col("v")), v=x) for x in ("yes", "NO", "MISSING", None)] == [True, False, None, None]


def test_messages(spark):
    shots = [("q1", "a1"), ("q2", "a2"), ("q3", "a3")]
    assert len(one(spark, text.messages(["s"], shots, F.col("v"), F.lit(False)), v="ask")) == 8
    assert len(one(spark, text.messages(["s"], shots, F.col("v"), F.lit(True)), v="ask")) == 6


def test_bands(spark):
    assert [one(spark, numeric.evidence_strength(F.col("v")), v=x) for x in (0.1, 0.15, 1.0, 5.0, 11.0)] == ["strong against", "moderate against", "neutral", "weak for", "strong for"]
    assert [one(spark, numeric.odds_label(F.col("v")), v=x) for x in (2.0, 1.5, 1.0, 0.8, 0.5)] == ["STRONG POSITIVE", "WEAK POSITIVE", "NEUTRAL", "WEAK NEGATIVE", "STRONG NEGATIVE"]
    assert one(spark, numeric.fraction_label(F.col("v")), v=0.25) == "1/4"


def test_numeric_labels(spark):
    assert [one(spark, numeric.is_numeric_label(F.col("v")), v=x) for x in ("0.4", "1,200", "40 %", "nan", "Cat A")] == [True, True, True, True, False]


def test_posterior_of_bad_input_is_null(spark):
    assert one(spark, numeric.ovr_posterior(F.col("p"), F.col("r")), p=0.0, r=2.0) is None
    assert one(spark, numeric.ovr_posterior(F.col("p"), F.col("r")), p=0.5, r=-2.0) is None


def test_feedback_prompts(spark):
    said = {}
    for kind in text.FEEDBACK:
        context = F.lit("1. leaf is present.") if kind.startswith("specific") else None
        other = F.lit("elm") if kind.endswith("differential") else None
        p = said[kind] = one(spark, text.feedback_prompt(kind, F.col("v"), F.lit("bark"), context, other), v="oak {d}")
        assert "oak {d}" in p and "bark" in p and '{"for": [...]' in p and '{"short": "long"}' in p
        assert ("elm" in p) == (other is not None) and ("1. leaf is present." in p) == (context is not None)
    assert len({p.split("\n\n")[1][:60] for p in said.values()}) == 4
    with pytest.raises(ValueError, match="specific_overall"):
        text.feedback_prompt("specific_overall", F.lit("oak"), F.lit("bark"))


def test_responses_are_checked(spark):
    rules = {"lr": (0.0, None), "share": (None, 1.0), "label": ["LOW", "HIGH"]}
    said = lambda v: one(spark, text.checked_response(F.col("v"), rules), v=v)
    good = said('```json\n{"label": "HIGH", "lr": "2.5", "share": -3, "x": {}}\n```')
    assert (good["lr"], good["share"], good["label"], good["errors"]) == (2.5, -3.0, "HIGH", [])
    bad = said('{"lr": 0, "share": 1, "label": "high"}')
    assert bad["errors"] == ["lr is out of bounds: 0", "share is out of bounds: 1", "label is none of its values: high"] and bad["lr"] is None and bad["label"] is None
    assert said('{"lr": "NaN", "share": "1.5f", "label": null}')["errors"] == ["lr is no number: NaN", "share is no number: 1.5f", "label is missing"]
    for nothing in ("", "[]", "no", None):
        assert said(nothing)["errors"] == ["lr is missing", "share is missing", "label is missing"], nothing


def test_positive_numbers(spark):
    assert [one(spark, numeric.to_positive(F.col("v")), v=x) for x in ("2.5", "0", "-1", "inf", "x", None)] == [2.5, None, None, None, None, None]
    assert one(spark, numeric.require_positive(F.col("v")), v=" 3 ") == 3.0
    with pytest.raises(Exception, match="not a positive number: -3"):
        one(spark, numeric.require_positive(F.col("v")), v="-3")


def test_parameter_ladder(spark):
    got = {m: one(spark, text.parameter_ladder(F.col("v")), v=m) for m in ("gpt-5", "o4-mini", "other")}
    assert got == {"gpt-5": [["verbosity", "reasoning"], ["reasoning"], ["verbosity"], []], "o4-mini": [["reasoning"], []], "other": [["temperature"], []]}


def test_utc_text(spark):
    time = F.to_timestamp(F.col("v"))
    assert [one(spark, text.utc_text(time, k), v="2031-02-03 04:05:06") for k in ("iso", "stamp", "day")] == ["2031-02-03T04:05:06.000000+00:00", "20310203T040506Z", "2031-02-03"]
