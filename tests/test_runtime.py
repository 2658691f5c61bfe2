import pytest

from lrforge.operators import agreement, assess, audit, estimate, runtime
from lrforge.sources.tables import RuntimeConfig, read_scenarios

KEY = "model_id string, scenario_id string, row_index int"


def test_modes():
    assert [runtime.resume_mode(m) for m in runtime.MODES] == list(runtime.MODES)
    assert [runtime.resume_mode(m, repair_flag=True) for m in (None, *runtime.MODES)] == ["repair_invalid", "repair_invalid", "skip_passing", "repair_invalid"]
    with pytest.raises(ValueError, match="'twice'"):
        runtime.resume_mode("twice")


def test_repair_list(spark):
    rows = spark.createDataFrame([("elm", "north", 40 - i) for i in range(5)] + [("elm", "east", 7), ("oak", "north", 1), ("oak", "west", 2)], KEY)
    listed = lambda *args: [tuple(r) for r in runtime.repair_list(rows, *args).collect()]
    assert listed("elm", ["north", "south"], 2) == [("elm", "north", 36), ("elm", "north", 37)]
    assert listed("oak") == [("oak", "north", 1), ("oak", "west", 2)] and listed("ash") == [] and len(listed()) == 8
    with pytest.raises(ValueError, match="row_index"):
        runtime.repair_list(rows.drop("row_index"))


def test_upsert_and_blank(spark):
    old = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "k int, value string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, value string")
    assert {r["k"]: r["value"] for r in runtime.upsert(old, new.where("k = 1"), ["k"]).collect()} == {1: "x", 2: "", 3: None}
    assert {r["k"]: r["value"] for r in runtime.fill_blank(old, new, ["k"]).collect()} == {1: "a", 2: "y", 3: "z"}


def test_skip_passing(spark):
    out = spark.createDataFrame([("a", "1.5"), ("b", "0")], "k string, value string")
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert sorted(r["k"] for r in runtime.to_run(work, out, ["k"], "skip_passing").collect()) == ["b", "c"]
    assert runtime.to_run(work, out, ["k"]).count() == 3


def test_guards(spark, tmp_path):
    df = spark.range(2)
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        runtime.write_guarded(df, path, partial=True)
    runtime.write_guarded(df, path)
    runtime.write_guarded(spark.range(5), path)
    assert spark.read.parquet(path).count() == 2
    runtime.write_guarded(spark.range(5), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5


def test_ledger(spark, tmp_path):
    from lrforge.schemas import LEDGER

    path = str(tmp_path / "ledger")
    for s, status in (("a", "failed"), ("a", "success"), ("b", "failed")):
        runtime.append_ledger(path, spark.createDataFrame([(s, status, "", "", 0, "")], LEDGER))
    left = runtime.unfinished(spark.createDataFrame([("a",), ("b",), ("c",)], "scenario_id string"), spark.read.parquet(path))
    assert sorted(r[0] for r in left.collect()) == ["b", "c"]


def test_audit_counts(spark):
    """Three trees by four signs: one cell absent, one with a word, one zero, one below it."""
    wanted = [("grove", r, c) for r in (3, 5, 8) for c in (1, 2, 4, 6)]
    expected = spark.createDataFrame(wanted, "scenario_id string, row_index int, col_index int")
    odd = {(3, 4): None, (5, 1): "often", (8, 2): "0.0", (8, 6): "-7"}
    output = spark.createDataFrame([(s, r, c, odd.get((r, c), f"{r}.{c}")) for s, r, c in wanted if (r, c) != (3, 4)] + [("grove", 99, 1, "bad")], "scenario_id string, row_index int, col_index int, value string")
    cells = audit.classified(expected, output, ["scenario_id", "row_index", "col_index"])
    found = audit.quality_summary(cells, ["scenario_id"]).first().asDict()
    assert found == {"scenario_id": "grove", "expected_cells": 12, "valid_positive_cells": 8, "missing_cells": 1, "non_numeric_cells": 1, "non_positive_cells": 2, "total_invalid_cells": 4, "passes": False}
    assert {(r["row_index"], r["col_index"]): r["status"] for r in audit.invalid_cells(cells).collect()} == {(3, 4): "missing", (5, 1): "non_numeric", (8, 2): "non_positive", (8, 6): "non_positive"}


def test_empty_sheet_passes(spark):
    cells = audit.classified(spark.createDataFrame([], "scenario_id string, row_index int"), spark.createDataFrame([], "scenario_id string, row_index int, value string"), ["scenario_id", "row_index"])
    manifest = spark.createDataFrame([("s", 2, 0)], "scenario_id string, categories_count int, findings_count int")
    assert audit.quality_summary(cells, ["scenario_id"], manifest).first()["passes"]


def test_retries():
    seen = []

    def flaky(attempt):
        if attempt == 0:
            raise RuntimeError("rate limit reached")
        return 2.5

    assert estimate.attempt_all(flaky, 2, 1.0, seen.append) == ("2.5", None) and seen == [1.0]
    value, error = estimate.attempt_all(lambda a: -1, 1, 1.0, seen.append)
    assert value is None and "positive" in error and seen == [1.0]


def test_estimate_sentinel(spark):
    def make():
        return lambda request, attempt: {"a": 1.5}[request["finding"]]

    rows = {r["finding"]: r for r in estimate.estimate(spark.createDataFrame([("a",), ("b",)], "finding string"), make, 0, 0.0, "ERROR").collect()}
    assert rows["a"]["value"] == "1.5" and rows["b"]["value"] == "ERROR" and "KeyError" in rows["b"]["error"]


def test_config():
    c = RuntimeConfig.from_env(env={"LRFORGE_MAX_PAIRS": "3", "LRFORGE_SCENARIOS": "a, b", "LRFORGE_ALLOW_PARTIAL": "Yes"})
    assert (c.max_pairs, c.scenarios, c.allow_partial, c.resume_mode) == (3, ("a", "b"), True, "recompute")


def test_scenarios(spark):
    row = read_scenarios(spark, '{"scenarios": [{"scenario_id": "s"}]}').first()
    assert row["parser_profile"] == "matrix_simple" and row["max_exemplars_per_category"] == 3
    with pytest.raises(ValueError):
        read_scenarios(spark, '{"scenarios": []}')


def test_agreement(spark):
    rows = [("g", i, m, (1.0 + i) * (2.0 if m == 2 else 1.0)) for i in range(5) for m in (1, 2)] + [("g", 9, 1, 3.0)]
    df = spark.createDataFrame(rows, "g string, item int, model_order int, lr double")
    r = agreement.bland_altman(df, ["item"], ["g"]).first()
    assert r["n"] == 5 and r["bias_fold"] == pytest.approx(0.5) and r["upper_fold"] == pytest.approx(0.5)
    k = agreement.kde(df.where("model_order = 1"), ["g"]).toPandas().sort_values("i")
    assert len(k) == 700
    assert ((k["density"].to_numpy()[1:] + k["density"].to_numpy()[:-1]) / 2 * (k["x"].to_numpy()[1:] - k["x"].to_numpy()[:-1])).sum() == pytest.approx(1)
    logs = spark.createDataFrame([("ln LR", 1.0), ("LR", 2.0)], "header string, lr double")
    assert sorted(r["log_lr"] for r in agreement.on_log_scale(logs, ["header"]).collect()) == pytest.approx([0.6931, 1.0], abs=1e-3)


def test_waits_and_fallbacks():
    waits = []

    def refuse(attempt):
        raise ValueError("no")

    assert estimate.attempt_all(refuse, 4, 1.0, waits.append, longest=5.0) == (None, "ValueError: no") and waits == [1.0, 2.0, 4.0, 5.0]
    waits.clear()
    assert estimate.attempt_all(refuse, 4, 1.0, waits.append)[0] is None and waits == []

    def broken(request, attempt):
        raise RuntimeError("first")

    ask = estimate.fallback(broken, lambda request, attempt: request["x"] * 2)
    assert ask({"x": 2}, 0) == 4
    with pytest.raises(RuntimeError, match="broken: first | broken: first"):
        estimate.fallback(broken, broken)({}, 0)
    assert estimate.backend(" Auto ", broken, lambda request, attempt: 3)({}, 0) == 3
    with pytest.raises(RuntimeError, match="first"):
        estimate.backend("responses", broken, broken)({}, 0)
    with pytest.raises(ValueError, match="auto"):
        estimate.backend("mail", broken, broken)


def test_ladder_of_parameters():
    asked = []

    def picky(request, attempt, parameters):
        asked.append(parameters)
        if "warmth" in parameters:
            raise ValueError("unknown option: warmth")
        return 2.0

    ask = estimate.laddered(picky, [{"warmth": 1, "effort": 2}, {"warmth": 1, "effort": 2}, {"warmth": 1}, {"effort": 2}, {}])
    assert ask({}, 0) == 2.0 and asked == [{"warmth": 1, "effort": 2}, {"warmth": 1}, {"effort": 2}]
    with pytest.raises(RuntimeError, match="all 2 sets of parameters: unknown option"):
        estimate.laddered(picky, [{"warmth": 1}, {"warmth": 2}])({}, 0)


def test_estimates_keep_whole_numbers(spark):
    big = 2**53 + 1
    seen = estimate.estimate(spark.createDataFrame([(big, 1.0), (None, 2.0)], "id long, x double"), lambda: lambda request, attempt: request["x"], retries=0).collect()
    assert sorted((str(r["id"]), r["value"], r["error"]) for r in seen) == [(str(big), "1.0", None), ("None", "2.0", None)]


def test_model_column(spark):
    cells = spark.createDataFrame([("s", "t", 0, 0, "Sign"), ("s", "t", 2, 0, "a"), ("s", "t", 3, 0, "b")], "scenario_id string, sheet string, row_idx int, col_idx int, value string")
    values = spark.createDataFrame([("s", "t", 2, "1.5"), ("s", "t", 3, None)], "scenario_id string, sheet string, row_idx int, value string")
    got = estimate.with_model_column(cells, values, "org/m").where("col_idx = 1").orderBy("row_idx").collect()
    assert [(r["row_idx"], r["value"]) for r in got] == [(0, "lr_org_m"), (1, ""), (2, "1.5"), (3, "ERROR")]


def test_inputs_are_looked_up(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        runtime.repair_input(spark, None, root, "org/m")
    (tmp_path / "invalid_rows").mkdir()
    assert runtime.repair_input(spark, None, root, "org/m") == f"{root}/invalid_rows"
    (tmp_path / "org_m" / "invalid_rows").mkdir(parents=True)
    assert runtime.repair_input(spark, None, root, "org/m") == f"{root}/org_m/invalid_rows"
    assert runtime.repair_input(spark, f"{root}/invalid_rows", root, "org/m") == f"{root}/invalid_rows"
    (tmp_path / "org_m" / "projection_failures").mkdir()
    assert runtime.failure_input(spark, None, root, ["org/m"]) == f"{root}/org_m/projection_failures"
    assert runtime.failure_input(spark, None, root, ["org/m", "x"]) is None and runtime.failure_input(spark, None, root, ["x"]) is None


def test_models_against_all_sheets(spark):
    cells = spark.createDataFrame([("s", "t", 0, 0, "Diagnosis:"), ("s", "t", 0, 1, "Oak"), ("s", "t", 0, 2, "For examples: x"), ("s", "t", 0, 3, " "), ("s", "t", 1, 0, "leaf"), ("s", "t", 2, 0, ""), ("s", "t", 3, 0, "bark")], "scenario_id string, sheet string, row_idx int, col_idx int, value string")
    positions = audit.ovr_positions(cells)
    assert sorted((r["row_idx"], r["col_idx"], r["finding"], r["category"]) for r in positions.collect()) == [(1, 1, "leaf", "Oak"), (3, 1, "bark", "Oak")]
    output = spark.createDataFrame([("m", "s", "t", 1, 1, "2.0")], "model_id string, scenario_id string, sheet string, row_idx int, col_idx int, value string")
    found, summary = audit.model_audit(positions, output, ["m", "n"])
    assert found.count() == 4
    assert sorted((r["model_id"], r["missing_cells"], r["sheet_exists"], r["passes"]) for r in summary.collect()) == [("m", 1, True, False), ("n", 2, False, False)]


def test_templates(spark):
    rows = spark.createDataFrame([("d", "cough", None, "Y"), ("d", None, "2", "N"), ("d", "fever", "3", None)], "diagnosis string, Information string, LR string, `Y/N` string")
    plain = assess.template(rows)
    assert sorted(r["info"] for r in plain.collect()) == ["cough", "fever"]
    filled = assess.fill_labels(plain, spark.createDataFrame([("d", "cough", 1.5)], "diagnosis string, info string, odds double"))
    assert {r["info"]: r["lr"] for r in filled.collect()} == {"cough": "WEAK POSITIVE", "fever": "3"}


def test_evidence(spark):
    five = ", ".join(f'{{"finding": "f{i}", "explanation": "e", "abbreviations": {{"A": "ash"}}}}' for i in range(5))
    blank = five.replace("f2", " ")
    rows = [(1, f'```json\n{{"for": [{five}], "against": [{five}], "summary": "s"}}\n```'), (2, f'{{"for": [{five}], "against": []}}'), (3, "sorry"), (4, None), (5, f'{{"for": [{five}], "against": [{blank}]}}')]
    items, faults = assess.evidence(spark.createDataFrame(rows, "k int, response string"), ["k"])
    assert {r["k"]: r["fault"] for r in faults.collect()} == {2: "5 for, 0 against", 3: "no lists", 4: "no lists", 5: "a finding without a text"}
    got = [(r["side"], r["rank"], r["finding"], r["abbreviations"]) for r in items.where("k = 1").orderBy("side", "rank").collect()]
    assert len(got) == 10 and got[0] == ("against", 1, "f0", {"A": "ash"}) and got[9] == ("for", 5, "f4", {"A": "ash"}) and items.where("k = 2").count() == 5


def test_combined_findings(spark):
    rows = spark.createDataFrame([(1, "a", 2, "x"), (1, "a", 1, "y"), (1, "b", 1, "z"), (2, "c", 1, "w"), (3, None, 1, "v")], "k int, category string, finding_order int, finding string")
    got = {(r["k"], r["category"]): r["findings"] for r in assess.combined(rows, "k", {"ba": ["b", "a"], "a": ["a"]}).collect()}
    assert got == {(1, "ba"): ["z", "y", "x"], (1, "a"): ["y", "x"]}
