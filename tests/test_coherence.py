import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lrforge.operators import audit, coherence
from lrforge.operators.coherence import project_batch


def implied(q, p):
    return q / (1 - q) / (p / (1 - p))


def drawn(seed, k, spread=1.5):
    rng = np.random.default_rng(seed)
    return rng.dirichlet(np.ones(k) * 2), np.exp(rng.normal(size=k) * spread)


def objective(scores, p, lr, base):
    """From its definition, on plain sums."""
    s = np.insert(scores, base, 0.0)
    mass = p * np.exp(s)
    q = mass / mass.sum()
    return 0.5 * ((np.log(implied(q, p)) - np.log(lr)) ** 2).sum() + 0.5 * coherence.RIDGE * (scores**2).sum()


@pytest.mark.parametrize("k", [2, 3, 6])
def test_optimum_of_drawn_rows(k):
    """No step away from the result, in random directions and of many sizes, lowers the objective, and its slope there is 0."""
    rng = np.random.default_rng(k)
    for seed in range(12):
        p, lr = drawn(100 * k + seed, k)
        r = project_batch([p], [lr]).iloc[0]
        base = int(p.argmax())
        assert r["success"] and r["baseline"] == base and r["sum_q_fitted"] == pytest.approx(1, abs=1e-9)
        s = np.delete(np.array(r["log_scores"]), base)
        value = objective(s, p, lr, base)
        assert value == pytest.approx(r["objective_final"], rel=1e-9, abs=1e-12)
        slope = [(objective(s + h, p, lr, base) - objective(s - h, p, lr, base)) / 2e-5 for h in np.eye(k - 1) * 1e-5]
        assert np.abs(slope).max() < 1e-6
        for size in (1e-3, 0.1, 1.0):
            for _ in range(10):
                assert objective(s + size * rng.normal(size=k - 1), p, lr, base) >= value - 1e-12


def test_ratios_that_no_posterior_can_have():
    for seed in range(20):
        p, lr = drawn(seed, 4)
        up = project_batch([p, p], [1.05 + lr, 0.95 / (1 + lr)])
        assert up["success"].all() and up["sign_impossible_raw"].all() and not up["sign_impossible_fitted"].any()


def test_coherent_input_stays():
    for seed in range(20):
        p, lr = drawn(seed, 5)
        q = p * lr / (p * lr).sum()
        r = project_batch([p], [implied(q, p)]).iloc[0]
        assert np.log(r["fitted_ovr_lr"]) == pytest.approx(np.log(implied(q, p)), abs=1e-4) and r["posterior"] == pytest.approx(q, abs=1e-5)


@pytest.mark.parametrize("spread", [1.0, 4.0, 20.0])
def test_every_valid_row_succeeds(spread):
    rng = np.random.default_rng(int(spread))
    for k in (2, 3, 7, 19):
        p, lr = rng.dirichlet(np.ones(k), 800) + 1e-9, np.exp(rng.uniform(-spread, spread, (800, k)))
        got = project_batch(list(p), list(lr))
        assert got["success"].all(), got.loc[~got["success"].astype(bool), "message"].tolist()
        assert np.abs(got["sum_q_fitted"] - 1).max() < 1e-9


@pytest.mark.parametrize(("p", "lr"), [([0.5, 0.5], [1.0]), ([0.0, 1.0], [1.0, 1.0]), ([0.5, 0.5], [1.0, -1.0]), ([0.5, 0.5], [1.0, float("nan")]), (None, [1.0, 2.0]), ([1.0], [2.0])])
def test_failures_are_rows(p, lr):
    r = project_batch([p], [lr]).iloc[0]
    assert r["success"] is False or r["success"] == False  # noqa: E712
    assert r["message"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.02, 1), st.floats(0.05, 20)), min_size=2, max_size=9), st.randoms())
def test_properties(rows, random):
    p, lr = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    base = int((p / p.sum()).argmax())
    order = list(range(len(p)))
    random.shuffle(order)
    got = project_batch([p, p * 7, p[order]], [lr, lr, lr[order]])
    a, b, c = (np.array(x) for x in got["fitted_ovr_lr"])
    assert got["success"].all() and abs(got["sum_q_fitted"] - 1).max() < 1e-6 and not got["sign_impossible_fitted"].any()
    assert np.log(a) == pytest.approx(np.log(b), abs=1e-9)  # scale of priors
    assert np.log(a)[order] == pytest.approx(np.log(c), abs=1e-3)  # order of categories, up to the base and early stops
    again = project_batch([p], [a], baseline=base).iloc[0]
    assert np.log(np.array(again["fitted_ovr_lr"])) == pytest.approx(np.log(a), abs=1e-3)


def test_frames(spark):
    rows = [("s", f"f{i}", k, f"c{k}", p, lr) for i in range(3) for k, (p, lr) in enumerate([(0.5, 4.0), (0.3, 3.0), (0.2, 2.0 + i)], 1)]
    long = spark.createDataFrame(rows, "scenario_id string, finding string, category_order int, category string, prior double, lr double")
    done = coherence.project(coherence.to_vectors(long, ["scenario_id", "finding"])).cache()
    assert coherence.adjustments(done, ["scenario_id", "finding"]).count() == 9
    assert coherence.failures(done, ["scenario_id", "finding"]).count() == 0
    summary = audit.projection_summary(done, ["scenario_id"]).first()
    assert (summary["rows_projected"], summary["sign_impossible_rows_before"], summary["sign_impossible_rows_after"]) == (3, 3, 0)
    native = coherence.native_projection(done).collect()
    assert all(r["success_native"] and r["fitted_native"] == pytest.approx(r["result"]["fitted_ovr_lr"], rel=1e-6) for r in native)


def test_native_path_finds_the_same_optimum(spark):
    """On drawn rows of several widths, sign-impossible ones too; what it leaves goes the other way, and all rows succeed."""
    rng = np.random.default_rng(3)
    rows = [(i, p.tolist(), lr.tolist()) for i, (p, lr) in enumerate(drawn(i, int(rng.integers(2, 20)), 1.0 + i % 3) for i in range(150))]
    rows += [(1000 + i, rng.dirichlet(np.ones(3)).tolist(), rng.uniform(1, 20, 3).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, priors array<double>, ovr_lr array<double>").repartition(4)
    both = coherence.native_projection(coherence.project(df)).collect()
    assert all(r["result"]["success"] for r in both) and sum(r["success_native"] for r in both) >= 0.97 * len(both)
    for r in both:
        if r["success_native"]:
            assert np.log(r["fitted_native"]) == pytest.approx(np.log(r["result"]["fitted_ovr_lr"]), abs=1e-6)
    whole = coherence.native_or_not(df).collect()
    want = {r["id"]: r["result"]["fitted_ovr_lr"] for r in both}
    assert len(whole) == len(rows) and all(r["success"] and np.log(r["fitted"]) == pytest.approx(np.log(want[r["id"]]), abs=1e-6) for r in whole)


def test_attached_priors(spark):
    rows = spark.createDataFrame([("a", 1, "s1", "f", [1.5, 2.0]), ("a", 1, "s1", "g", [1.0]), ("b", 1, "s1", "f", [3.0])], "scenario_id string, schema_order int, schema_sheet_name string, finding string, ovr_lr array<double>")
    priors = spark.createDataFrame([("a", 1, "s1", 2, "y", 0.25), ("a", 1, "s1", 1, "x", 0.75)], "scenario_id string, schema_order int, schema_sheet_name string, category_order int, category string, prior_normalized double")
    good, failed = coherence.attach_priors(rows, priors)
    assert [(r["finding"], r["categories"], r["priors"]) for r in good.collect()] == [("f", ["x", "y"], [0.75, 0.25])]
    assert sorted((r["scenario_id"], r["reason"]) for r in failed.collect()) == [("a", "1 ratios, 2 priors"), ("b", "no priors for b / 1 / s1")]


def test_summary_counts_failures(spark):
    rows = spark.createDataFrame([("s", "f", True, True, 0.5, 0.0, False, False, 1.0, None), ("t", "f", True, True, float("nan"), 0.0, True, False, 2.0, None)], "scenario_id string, finding string, checked boolean, complete boolean, raw_gap double, after_gap double, sign_impossible_before boolean, sign_impossible_after boolean, median_adjustment_mult double, status string")
    failed = spark.createDataFrame([("t", 3)], "scenario_id string, failures long")
    got = {r["scenario_id"]: r["solver_failures"] for r in audit.coherence_summary(rows, ["scenario_id"], failed).collect()}
    assert got == {"s": 0, "t": 3}
    assert {r["scenario_id"]: r["median_raw_gap"] for r in audit.quantiles(rows, ["scenario_id"], ["raw_gap"], poisoned=True).collect()} == {"s": 0.5, "t": None}
    tail = audit.adjustment_tail(spark.createDataFrame([("s", float(np.log(x))) for x in (1.0, 2.0, 3.0)], "scenario_id string, abs_log_change double"), ["scenario_id"]).first()
    assert (round(tail["median_mult_change"], 9), round(tail["max_mult_change"], 9)) == (2.0, 3.0)


def test_coherence_audit_finds_edited_output(spark):
    key = ["scenario_id", "finding"]
    expected = spark.createDataFrame([("s", f, k) for f in "ab" for k in (1, 2)], "scenario_id string, finding string, category_order int")
    cells = lambda rows: audit.classified(expected, spark.createDataFrame(rows, "scenario_id string, finding string, category_order int, value string"), [*key, "category_order"])
    raw = cells([("s", f, k, v) for f in "ab" for k, v in ((1, "2.0"), (2, "0.5"))])
    fitted = cells([("s", "a", 1, "2.0"), ("s", "a", 2, "0.5"), ("s", "b", 1, "3.0"), ("s", "b", 2, "1.5")])
    priors = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.5)], "scenario_id string, category_order int, prior double")
    rows = {r["finding"]: r for r in audit.coherence_rows(raw, fitted, key, priors).collect()}
    assert rows["a"]["status"] is None and rows["b"]["status"] == "posterior_sum_mismatch"
    summary = audit.coherence_summary(audit.coherence_rows(raw, fitted, key, priors), ["scenario_id"]).first()
    assert (summary["rows_checked"], summary["coherence_invalid_rows"], summary["solver_failures"]) == (2, 1, 0)


def test_priors_that_tie_but_for_rounding_share_a_base():
    """The last category is the larger by a bit in the last place; scaled, rounding can make it a tie."""
    p = np.array([0.5, 0.5, 0.9999999999999999, 1.0, 0.021484375])
    lr = np.array([1.0, 0.5, 1.0, 3.0, 1.0])
    got = project_batch([p * f for f in (1, 7, 3, 1 / 3, 11)], [lr] * 5)
    assert set(got["baseline"]) == {2}
    for fitted in got["fitted_ovr_lr"]:
        assert np.log(fitted) == pytest.approx(np.log(got["fitted_ovr_lr"][0]), abs=1e-9)


def test_wide_rows_in_bounded_memory():
    """10,000 rows of 200 categories in one batch; tracemalloc counts numpy's arrays, the lists of results among them."""
    rng = np.random.default_rng(0)
    p, lr = rng.dirichlet(np.ones(200), 10_000) + 1e-9, np.exp(rng.uniform(-4, 4, (10_000, 200)))
    tracemalloc.start()
    got = project_batch(p, lr)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["success"].all() and np.abs(got["sum_q_fitted"] - 1).max() < 1e-9
    assert peak < 600 << 20
