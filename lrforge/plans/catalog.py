"""The registered queries of the engine's own operators, each with SQL of its own for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lrforge.functions import numeric, text, tokens
from lrforge.functions.numeric import rounded
from lrforge.operators import agreement, assess, audit, coherence, estimate, parse, plan, runtime, scan
from lrforge.operators.quantiles import select_quantiles
from lrforge.plans.projection_sql import PROJECTED_SQL
from lrforge.plans.stand_ins import CUBE_SQL, DIRTY_SQL, SHEETS_SQL, cube, dirty, lr_sql, ratios, sheets, table
from lrforge.session import Scratch
from lrforge.sources import workbooks
from lrforge.sources.html import heading_links, lr_tables, nav_links
from lrforge.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits}::DOUBLE + 0.5) / 1e{digits}::DOUBLE"


ROW = ["scenario_id", "finding"]
LR, RAW = f"WITH {lr_sql()}", f"WITH {lr_sql()}"
LOGIT_Q = "1 / (1 + exp(-(ln(prior) - ln(1 - prior) + ln({0}))))"


# --- the cube and its ratios


@query(f"WITH {CUBE_SQL} SELECT * FROM cube")
def count_cube(spark, sf):
    return cube(spark, sf)


@query(f"WITH {lr_sql(0)} SELECT scenario_id, finding, category, {_r('lr')} AS lr FROM lrs")
def ovr_lr(spark, sf):
    return estimate.empirical(cube(spark, sf), ["scenario_id"]).select(*ROW, "category", rounded(F.col("lr")).alias("lr"))


@query(f"{LR} SELECT DISTINCT scenario_id, category, category_order, {_r('prior', 9)} AS prior FROM ratios")
def ovr_priors(spark, sf):
    return ratios(spark, sf).select("scenario_id", "category", "category_order", rounded(F.col("prior"), 9).alias("prior")).distinct()


@query(f"{RAW} SELECT scenario_id, finding, {_r(f'sum({LOGIT_Q.format("raw")})')} AS sum_q_init, {_r(f'abs(sum({LOGIT_Q.format("raw")}) - 1)')} AS coherence_gap, count(*)::BIGINT AS categories FROM ratios GROUP BY scenario_id, finding")
def ovr_coherence_gap(spark, sf):
    rows = coherence.row_metrics(ratios(spark, sf), ROW, lr="raw")
    return rows.select(*ROW, rounded(F.col("sum_q_init")).alias("sum_q_init"), rounded(F.col("coherence_gap")).alias("coherence_gap"), "categories")


@query(f"WITH {lr_sql(0)} SELECT scenario_id, finding, abs(sum({LOGIT_Q.format('lr')}) - 1) < 1e-9 AS coherent FROM lrs GROUP BY scenario_id, finding HAVING count(lr) = count(*)")
def empirical_coherence(spark, sf):
    rows = coherence.row_metrics(estimate.empirical(cube(spark, sf), ["scenario_id"]), ROW)
    return rows.where("invalid = 0").select(*ROW, (F.col("coherence_gap") < 1e-9).alias("coherent"))


@query(f"{RAW} SELECT scenario_id, finding, bool_and(raw > 1 + 1e-12) OR bool_and(raw < 1 - 1e-12) AS sign_impossible FROM ratios GROUP BY scenario_id, finding")
def ovr_sign_impossible(spark, sf):
    return coherence.row_metrics(ratios(spark, sf), ROW, lr="raw").select(*ROW, "sign_impossible")


@query(f"{RAW}, g AS (SELECT scenario_id, finding, abs(sum({LOGIT_Q.format('raw')}) - 1) AS gap FROM ratios GROUP BY scenario_id, finding) SELECT scenario_id, {_r('quantile_cont(gap, 0.5)')} AS median_coherence_gap, {_r('quantile_cont(gap, 0.9)')} AS p90_coherence_gap FROM g GROUP BY scenario_id")
def gap_quantiles(spark, sf):
    rows = coherence.row_metrics(ratios(spark, sf), ROW, lr="raw")
    q = audit.quantiles(rows, ["scenario_id"], ["coherence_gap"])
    return q.select("scenario_id", *[rounded(F.col(c)).alias(c) for c in ("median_coherence_gap", "p90_coherence_gap")])


@query(
    f"WITH {CUBE_SQL}, sh AS (SELECT *, (n + 0.5::DOUBLE) / (sum(n) OVER (PARTITION BY scenario_id, category)::DOUBLE + 1) AS share FROM cube) "
    f"SELECT a.scenario_id, a.finding, a.category AS category_left, b.category AS category_right, {_r('a.share / b.share')} AS lr FROM sh a JOIN sh b ON a.scenario_id = b.scenario_id AND a.finding = b.finding AND a.category < b.category"
)
def diff_lr_pairs(spark, sf):
    return estimate.differential(cube(spark, sf), ["scenario_id"]).select(*ROW, "category_left", "category_right", rounded(F.col("lr")).alias("lr"))


@query(f"{RAW} SELECT scenario_id, finding, category, {_r('lr / raw')} AS mult_change, {_r('abs(ln(lr) - ln(raw))')} AS abs_log_change FROM ratios")
def adjustment_metrics(spark, sf):
    r = ratios(spark, sf)
    return r.select(*ROW, "category", rounded(numeric.multiplicative_change(F.col("lr"), F.col("raw"))).alias("mult_change"), rounded(numeric.abs_log_change(F.col("lr"), F.col("raw"))).alias("abs_log_change"))


@query(f"{RAW} SELECT scenario_id, finding, category, category_order, {_r('abs(ln(lr) - ln(raw))', 9)} AS abs_log_change FROM ratios ORDER BY abs_log_change DESC, scenario_id, finding, category_order LIMIT 100")
def top_adjustments(spark, sf):
    rows = ratios(spark, sf).select(*ROW, "category", "category_order", rounded(numeric.abs_log_change(F.col("lr"), F.col("raw")), 9).alias("abs_log_change"))
    return audit.top_adjustments(rows, ROW, 100)


def _bands(cuts, names, closed, x) -> str:
    op = "<" if closed == "left" else "<="
    return "CASE " + " ".join(f"WHEN {x} {op} {c} THEN '{n}'" for c, n in zip(cuts, names[:-1], strict=True)) + f" ELSE '{names[-1]}' END"


@query(
    f"{RAW} SELECT scenario_id, {_bands(numeric.STRENGTH_CUTS, numeric.STRENGTH_NAMES, 'right', 'raw')} AS strength, {_bands(numeric.INTERPRETATION_CUTS, numeric.INTERPRETATION_NAMES, 'left', 'raw')} AS reading, count(*)::BIGINT AS n FROM ratios GROUP BY ALL"
)
def evidence_bands(spark, sf):
    raw = F.col("raw")
    return ratios(spark, sf).groupBy("scenario_id", numeric.evidence_strength(raw).alias("strength"), numeric.interpretation(raw).alias("reading")).agg(F.count("*").alias("n"))


@query(f"{RAW} SELECT scenario_id, finding, category, {_bands((0.72, 0.92, 1.18, 1.95), ('STRONG NEGATIVE', 'WEAK NEGATIVE', 'NEUTRAL', 'WEAK POSITIVE', 'STRONG POSITIVE'), 'left', 'raw')} AS label FROM ratios")
def odds_labels(spark, sf):
    return ratios(spark, sf).select(*ROW, "category", numeric.odds_label(F.col("raw")).alias("label"))


@query(
    f"{LR}, k AS (SELECT scenario_id, category AS grp, finding, {_r('lr')} AS lr FROM ratios), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, grp ORDER BY lr DESC, finding) AS rf, row_number() OVER (PARTITION BY scenario_id, grp ORDER BY lr, finding) AS ra FROM k) "
    "SELECT scenario_id, grp AS category, 'for' AS side, rf::INT AS rank, finding, lr FROM r WHERE rf <= 2 UNION ALL SELECT scenario_id, grp, 'against', ra::INT, finding, lr FROM r WHERE ra <= 2"
)
def evidence_top(spark, sf):
    rows = ratios(spark, sf).select("scenario_id", "category", "finding", rounded(F.col("lr")).alias("lr"))
    return assess.top_evidence(rows, ["scenario_id", "category"], 2)


# --- projection


def _vectors(spark, sf):
    return coherence.to_vectors(ratios(spark, sf), ROW, lr="raw")


FITTED = f"WITH RECURSIVE {lr_sql()}, {PROJECTED_SQL}"
CHANGED = ("fitted_ovr_lr", "mult_change", "abs_log_change", "posterior_fitted", "sum_q_init", "rmse_log_lr")
ALL_SIGNS = "list_bool_and(list_transform({0}, lambda x: x > 1 + 1e-12)) OR list_bool_and(list_transform({0}, lambda x: x < 1 - 1e-12))"


@query(
    f"{FITTED} SELECT scenario_id, finding, i::INT AS category_order, cats[i] AS category, {_r('pr[i]', 9)} AS prior, lam[i] AS raw_ovr_lr, {_r('fit[i]', 5)} AS fitted_ovr_lr, {_r('fit[i] / lam[i]', 5)} AS mult_change, "
    f"{_r('abs(r[i])', 5)} AS abs_log_change, {_r('q[i]', 5)} AS posterior_fitted, {_r('list_sum(q0)', 5)} AS sum_q_init, {_r('sqrt(list_sum(list_transform(r, lambda x: x * x)) / n)', 5)} AS rmse_log_lr FROM flat"
)
def coherent_projection(spark, sf):
    rows = coherence.adjustments(coherence.project(_vectors(spark, sf)), ROW)
    return rows.select(*ROW, "category_order", "category", rounded(F.col("prior"), 9).alias("prior"), "raw_ovr_lr", *[rounded(F.col(c), 5).alias(c) for c in CHANGED])


@query(
    f"{FITTED} SELECT scenario_id, finding, true AS success, {_r('v0', 5)} AS objective_initial, {_r('v', 5)} AS objective_final, {_r('list_sum(q)', 5)} AS sum_q_fitted, {ALL_SIGNS.format('lam')} AS sign_impossible_raw, {ALL_SIGNS.format('fit')} AS sign_impossible_fitted FROM fin"
)
def projection_invariants(spark, sf):
    """Per projected row: the objective before and after, the sum of posteriors, and whether the signs are possible."""
    rows = coherence.project(_vectors(spark, sf))
    number = lambda c: rounded(F.col(f"result.{c}"), 5).alias(c)
    return rows.select(*ROW, "result.success", *map(number, ("objective_initial", "objective_final", "sum_q_fitted")), "result.sign_impossible_raw", "result.sign_impossible_fitted")


@query(f"{FITTED} SELECT scenario_id, finding, i::INT AS category_order, true AS success, {_r('fit[i]', 5)} AS fitted_ovr_lr, {_r('q[i]', 5)} AS posterior FROM flat")
def native_projection_agrees(spark, sf):
    """The Catalyst-only solver, whose rows without success take the other path."""
    rows = coherence.native_or_not(_vectors(spark, sf))
    each = rows.select(*ROW, "success", F.posexplode(F.arrays_zip("fitted", "posterior")).alias("i", "z"))
    return each.select(*ROW, (F.col("i") + 1).alias("category_order"), "success", rounded(F.col("z.fitted"), 5).alias("fitted_ovr_lr"), rounded(F.col("z.posterior"), 5).alias("posterior"))


@query(
    f"{FITTED}, g AS (SELECT *, abs(list_sum(q0) - 1) AS gap, list_max(list_transform(r, lambda x: abs(x))) AS largest, {ALL_SIGNS.format('lam')} AS before, {ALL_SIGNS.format('fit')} AS after FROM fin) "
    "SELECT scenario_id, count(*)::BIGINT AS rows_total, count(*)::BIGINT AS rows_projected, 0::BIGINT AS rows_failed, "
    + ", ".join(f"{_r(f'quantile_cont({c}, {q})', 5)} AS {name}_{out}" for c, out, qs in (("gap", "sum_q_init_gap", ((0.5, "median"), (0.9, "p90"))), ("largest", "max_abs_log_change", ((0.5, "median"), (0.9, "p90")))) for q, name in qs)
    + ", count(*) FILTER (WHERE before)::BIGINT AS sign_impossible_rows_before, count(*) FILTER (WHERE after)::BIGINT AS sign_impossible_rows_after FROM g GROUP BY scenario_id"
)
def projection_summary(spark, sf):
    rows = audit.projection_summary(coherence.project(_vectors(spark, sf)), ["scenario_id"])
    return rows.select(*[rounded(F.col(c), 5).alias(c) if t == "double" else c for c, t in rows.dtypes])


@query(
    f"{FITTED}, x AS (SELECT scenario_id, exp(abs(r[i])) AS change FROM flat) SELECT scenario_id, "
    + ", ".join(f"{_r(f'quantile_cont(change, {q})', 5)} AS {name}_mult_change" for q, name in ((0.5, "median"), (0.9, "p90"), (0.99, "p99")))
    + f", {_r('max(change)', 5)} AS max_mult_change FROM x GROUP BY scenario_id"
)
def adjustment_tail(spark, sf):
    rows = audit.adjustment_tail(coherence.adjustments(coherence.project(_vectors(spark, sf)), ROW), ["scenario_id"])
    return rows.select("scenario_id", *[rounded(F.col(c), 5).alias(c) for c in rows.columns[1:]])


# Faults by the number k of a finding in its scenario: no solution, a cell lost, a cell edited.
UNSOLVED, LOST, EDITED = "k % 11 = 4", "k % 11 <> 4 AND k % 7 = 5", "k % 11 <> 4 AND k % 7 = 3"


@query(
    f"{FITTED}, k AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY finding) AS k FROM fin), "
    f"h AS (SELECT *, {UNSOLVED} AS unsolved, {LOST} AS lost, CASE WHEN {EDITED} THEN list_concat([fit[1] * 1.5], fit[2:]) ELSE fit END AS f2 FROM k), "
    f"g AS (SELECT scenario_id, unsolved, NOT unsolved AND NOT lost AS ok, abs(list_sum(q0) - 1) AS raw_gap, {ALL_SIGNS.format('lam')} AS before, {ALL_SIGNS.format('f2')} AS after, "
    "abs(list_sum(list_transform(range(1, n + 1), lambda i: 1 / (1 + exp(-(ln(pr[i]) - ln(1 - pr[i]) + ln(f2[i])))))) - 1) AS after_gap, "
    "list_aggregate(list_transform(range(1, n + 1), lambda i: exp(abs(ln(f2[i]) - ln(lam[i])))), 'quantile_cont', 0.5) AS mult FROM h) "
    "SELECT scenario_id, count(*) FILTER (WHERE ok)::BIGINT AS rows_checked, count(*) FILTER (WHERE NOT ok)::BIGINT AS rows_skipped, "
    + ", ".join(f"{_r(f'quantile_cont({c}, {q}) FILTER (WHERE ok)', 5)} AS {name}_{out}" for c, out in (("raw_gap", "raw_gap"), ("after_gap", "after_gap"), ("mult", "adjustment_mult")) for q, name in ((0.5, "median"), (0.9, "p90")))
    + ", count(*) FILTER (WHERE ok AND before)::BIGINT AS sign_impossible_rows_before, count(*) FILTER (WHERE ok AND after)::BIGINT AS sign_impossible_rows_after, "
    "count(*) FILTER (WHERE ok AND (after_gap > 1e-6 OR after))::BIGINT AS coherence_invalid_rows, count(*) FILTER (WHERE unsolved)::BIGINT AS solver_failures FROM g GROUP BY scenario_id"
)
def coherence_audit(spark, sf):
    """Projected ratios written as cells, some of them edited or lost, read again and audited against the raw ones; rows without a solution are counted."""
    key = [*ROW, "category_order"]
    position = lambda df, v: df.select(*key, F.col(v).cast("string").alias("value"))
    with Scratch(spark, "coherence-audit") as scratch:
        vectors = _vectors(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("scenario_id").orderBy("finding")))
        vectors = vectors.withColumn("ovr_lr", F.when(F.expr(UNSOLVED), F.transform("ovr_lr", lambda x, i: F.when(i == 0, -x).otherwise(x))).otherwise(F.col("ovr_lr")))
        projected = scratch.table(coherence.project(vectors))  # read as vectors, as fitted rows and as failures
        long = projected.select(*ROW, F.posexplode(F.arrays_zip("ovr_lr", "priors")).alias("i", "z")).select(*ROW, (F.col("i") + 1).alias("category_order"), F.col("z.ovr_lr").alias("raw"), F.col("z.priors").alias("prior"))
        expected, priors = long.select(*key), long.groupBy("scenario_id", "category_order").agg(F.first("prior").alias("prior"))
        fitted = coherence.adjustments(projected, [*ROW, "k"]).where(~(F.expr(LOST) & (F.col("category_order") == 2)))
        fitted = fitted.withColumn("fitted_ovr_lr", F.when(F.expr(EDITED) & (F.col("category_order") == 1), F.col("fitted_ovr_lr") * 1.5).otherwise(F.col("fitted_ovr_lr")))
        rows = audit.coherence_rows(audit.classified(expected, position(long, "raw"), key), audit.classified(expected, position(fitted, "fitted_ovr_lr"), key), ROW, priors)
        failed = coherence.failures(projected, ROW).groupBy("scenario_id").agg(F.count("*").alias("failures"))
        summary = audit.coherence_summary(rows, ["scenario_id"], failed)
        return scratch.kept(summary.select(*[rounded(F.col(c), 5).alias(c) if t == "double" else c for c, t in summary.dtypes]))


VALUES = "SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice * (1 - l_discount) / (l_quantity + l_linenumber) AS price, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount - l_tax END AS margin FROM lineitem"
LEVELS = {"least": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99}


@query(f"WITH v AS ({VALUES}) SELECT flag, status, " + ", ".join(f"{_r(f'quantile_cont({c}, {q})', 9)} AS {name}_{c}" for c in ("price", "margin") for name, q in LEVELS.items()) + " FROM v GROUP BY flag, status")
def selected_quantiles(spark, sf):
    """Four quantiles of two columns of all order items, by selection over histograms of bits."""
    rows = table(spark, sf, "lineitem").selectExpr(*[x.strip() for x in ("l_returnflag AS flag", "l_linestatus AS status", "l_extendedprice * (1 - l_discount) / (l_quantity + l_linenumber) AS price", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount - l_tax END AS margin")])
    found = select_quantiles(rows, ["flag", "status"], ["price", "margin"], LEVELS)
    return found.select("flag", "status", *[rounded(F.col(c), 9).alias(c) for c in found.columns[2:]])


@query(
    f"{RAW}, v AS (SELECT scenario_id, finding, count(*) AS n FROM ratios GROUP BY ALL), p AS (SELECT scenario_id, count(DISTINCT category_order) AS n, {_r('sum(prior)')} AS s FROM (SELECT DISTINCT scenario_id, category_order, prior FROM ratios WHERE scenario_id <> 'nation' AND NOT (scenario_id = 'region' AND category_order = 1)) GROUP BY ALL), "
    "tied AS (SELECT v.scenario_id, v.finding, v.n, p.s, CASE WHEN p.n IS NULL THEN 'no priors for ' || v.scenario_id || ' / 1 / s_' || v.scenario_id WHEN p.n <> v.n THEN printf('%d ratios, %d priors', v.n, p.n) END AS reason FROM v LEFT JOIN p ON v.scenario_id = p.scenario_id) "
    "SELECT scenario_id, finding, reason, s AS prior_sum FROM tied WHERE reason IS NULL UNION ALL SELECT DISTINCT scenario_id, NULL, reason, NULL FROM tied WHERE reason IS NOT NULL"
)
def attached_priors(spark, sf):
    """Priors tied to ratios by schema and position; one scenario has none, another lacks one."""
    long = ratios(spark, sf)
    key = [F.col("scenario_id"), F.lit(1).alias("schema_order"), F.concat(F.lit("s_"), F.col("scenario_id")).alias("schema_sheet_name")]
    priors = long.where("scenario_id <> 'nation' and not (scenario_id = 'region' and category_order = 1)").select(*key, "category_order", "category", F.col("prior").alias("prior_normalized")).distinct()
    rows = _vectors(spark, sf).select(*key, "finding", "ovr_lr")
    good, failed = coherence.attach_priors(rows, priors)
    total = rounded(F.aggregate("priors", F.lit(0.0), lambda t, x: t + x)).alias("prior_sum")
    return good.select("scenario_id", "finding", F.lit(None).cast("string").alias("reason"), total).unionByName(failed.select("scenario_id", F.lit(None).cast("string").alias("finding"), "reason", F.lit(None).cast("double").alias("prior_sum")))


# --- plans


def _categories(spark, sf):
    return cube(spark, sf).select("scenario_id", "category").distinct().withColumn("category_order", F.row_number().over(W.partitionBy("scenario_id").orderBy("category")))


def _findings(spark, sf):
    return cube(spark, sf).select("scenario_id", "finding").distinct().withColumn("finding_order", F.row_number().over(W.partitionBy("scenario_id").orderBy("finding")))


CATS = f"{CUBE_SQL}, cats AS (SELECT DISTINCT scenario_id, category, dense_rank() OVER (PARTITION BY scenario_id ORDER BY category)::INT AS o FROM cube), finds AS (SELECT DISTINCT scenario_id, finding, dense_rank() OVER (PARTITION BY scenario_id ORDER BY finding)::INT AS o FROM cube)"
SLUG = "coalesce(nullif(regexp_replace(left(lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 48), '^_+|_+$', '', 'g'), ''), 'category')"
PAIRS = f"{CATS}, pairs AS (SELECT a.scenario_id, a.category AS category_left, b.category AS category_right, row_number() OVER (PARTITION BY a.scenario_id ORDER BY a.o, b.o)::INT AS pair_index FROM cats a JOIN cats b ON a.scenario_id = b.scenario_id AND a.o < b.o)"


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def category_pairs(spark, sf):
    return plan.category_pairs(_categories(spark, sf), ["scenario_id"]).select("scenario_id", "pair_index", "category_left", "category_right")


@query(
    f"WITH {PAIRS}, nf AS (SELECT scenario_id, count(*)::BIGINT AS findings_count FROM finds GROUP BY scenario_id), f AS (SELECT *, printf('%03d__%s__vs__%s.xlsx', pair_index, {SLUG.format('category_left')}, {SLUG.format('category_right')}) AS file FROM pairs JOIN nf USING (scenario_id)) "
    "SELECT scenario_id, pair_index, 'matrix_simple' AS parser_profile, category_left, category_right, findings_count, 'inputs/' || scenario_id || '/' || file AS input_workbook, 'outputs/' || scenario_id || '/' || file AS output_workbook FROM f"
)
def pairs_manifest(spark, sf):
    counts = _findings(spark, sf).groupBy("scenario_id").agg(F.count("*").alias("findings_count"))
    return plan.pairs_manifest(plan.category_pairs(_categories(spark, sf), ["scenario_id"]), counts)


@query(f"WITH {CATS} SELECT f.scenario_id, f.finding, f.o AS finding_order, c.category, c.o AS category_order FROM finds f JOIN cats c USING (scenario_id)")
def ovr_grid(spark, sf):
    return plan.ovr_grid(_findings(spark, sf), _categories(spark, sf), ["scenario_id"])


@query(
    f"WITH {CATS} SELECT DISTINCT scenario_id, 0 AS row_idx, 0 AS col_idx, 'Diagnosis:' AS value FROM cats UNION ALL SELECT scenario_id, 0, o, category FROM cats UNION ALL SELECT scenario_id, o, 0, finding FROM finds"
)
def ovr_sheet(spark, sf):
    return plan.ovr_sheet(_findings(spark, sf), _categories(spark, sf), ["scenario_id"])


@query(
    f"WITH {PAIRS} SELECT scenario_id, pair_index, 0 AS row_idx, 0 AS col_idx, category_left AS value FROM pairs UNION ALL SELECT scenario_id, pair_index, 0, 2, category_right FROM pairs "
    "UNION ALL SELECT scenario_id, pair_index, 1, i, CASE i WHEN 0 THEN category_left WHEN 2 THEN category_right ELSE '' END FROM pairs, (VALUES (0), (1), (2), (3)) x(i) "
    "UNION ALL SELECT p.scenario_id, pair_index, o + 1, 0, finding FROM pairs p JOIN finds f ON p.scenario_id = f.scenario_id"
)
def pair_sheet(spark, sf):
    pairs = plan.category_pairs(_categories(spark, sf), ["scenario_id"])
    pairs = pairs.withColumn("exemplars_left", text.exemplars(F.col("category_left"), 2)).withColumn("exemplars_right", text.exemplars(F.col("category_right"), 2))
    return plan.pair_sheet(pairs, _findings(spark, sf), 2)


@query(
    f"WITH {CATS} SELECT scenario_id, finding, 0 AS sub_order, 'Patient has: ' || finding AS signed_finding FROM finds UNION ALL SELECT scenario_id, finding, 1, 'Patient does not have: ' || finding FROM finds"
)
def plus_minus_expand(spark, sf):
    return plan.plus_minus(_findings(spark, sf).select("scenario_id", "finding"))


@query(f"WITH {CATS} SELECT scenario_id, finding, o AS finding_order FROM finds WHERE o <= 2")
def first_n_findings(spark, sf):
    return plan.first_findings(_findings(spark, sf), 2, ["scenario_id"])


@query(f"WITH {CATS} SELECT scenario_id, category, o AS category_order FROM cats WHERE scenario_id IN (SELECT DISTINCT scenario_id FROM cats ORDER BY 1 LIMIT 2)")
def first_scenarios(spark, sf):
    return plan.first_scenarios(_categories(spark, sf), 2)


@query("SELECT p_type AS scenario_id, p_brand AS category, row_number() OVER (PARTITION BY p_type ORDER BY min(p_partkey))::INT AS category_order FROM part WHERE p_brand <> 'Brand#1' GROUP BY p_type, p_brand")
def ordered_distinct(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("scenario_id"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("category_order"))
    excluded = rows.where("category = 'Brand#1'").select("scenario_id", "category").distinct()
    return plan.distinct_categories(rows, ["scenario_id"], excluded)


# --- parsing


@query(f"WITH {SHEETS_SQL} SELECT * FROM cells")
def sheet_cells(spark, sf):
    return sheets(spark, sf)


@query(f"WITH {SHEETS_SQL} SELECT scenario_id, sheet, min(row_idx) AS key_row FROM cells WHERE col_idx = 0 AND value ILIKE 'key feature%' GROUP BY ALL")
def key_rows(spark, sf):
    return parse.key_rows(sheets(spark, sf))


FILLED = f"""{SHEETS_SQL},
keyed AS (SELECT scenario_id, sheet, min(row_idx) FILTER (WHERE col_idx = 0 AND value ILIKE 'key feature%') AS key_row, max(col_idx) + 1 AS width FROM cells GROUP BY ALL),
grid AS (SELECT DISTINCT k.scenario_id, k.sheet, c.row_idx, x.col_idx::INT AS col_idx, width FROM keyed k JOIN cells c USING (scenario_id, sheet), range(0, 8) x(col_idx) WHERE c.row_idx < key_row AND x.col_idx < width),
filled AS (SELECT g.*, coalesce(last_value(c.value IGNORE NULLS) OVER (PARTITION BY g.scenario_id, g.sheet, g.row_idx ORDER BY g.col_idx ROWS UNBOUNDED PRECEDING), '') AS label FROM grid g LEFT JOIN cells c USING (scenario_id, sheet, row_idx, col_idx)),
runs AS (SELECT *, (label <> coalesce(lag(label) OVER (PARTITION BY scenario_id, sheet, row_idx ORDER BY col_idx), ''))::INT AS new FROM filled WHERE col_idx >= 1 AND label <> ''),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY scenario_id, sheet, row_idx ORDER BY col_idx)::INT AS block FROM runs),
blocks0 AS (SELECT scenario_id, sheet, row_idx, block, min(label) AS label, min(col_idx) AS start_col, max(width) AS width FROM numbered GROUP BY ALL),
blocks AS (SELECT scenario_id, sheet, row_idx, block, label, start_col, coalesce(lead(start_col) OVER (PARTITION BY scenario_id, sheet, row_idx ORDER BY block), width)::INT AS end_col FROM blocks0),
lab AS (SELECT scenario_id, sheet, row_idx, list(label ORDER BY block) AS labels FROM blocks GROUP BY ALL),
sch0 AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, sheet, labels ORDER BY row_idx) AS nth FROM lab WHERE len(labels) >= 2 AND len(list_filter(labels, lambda x: try_cast(x AS DOUBLE) IS NULL)) > 0),
schemas AS (SELECT scenario_id, sheet, row_idx, labels, row_number() OVER (PARTITION BY scenario_id, sheet ORDER BY row_idx)::INT AS schema_order FROM sch0 WHERE nth = 1)
"""


@query(f"WITH {FILLED} SELECT scenario_id, sheet, row_idx, block, label, start_col, end_col FROM blocks")
def ffill_blocks(spark, sf):
    return parse.category_blocks(parse.filled_rows(sheets(spark, sf)))


@query("WITH v AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 50 = 0 THEN l_quantity END AS q FROM lineitem) SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(q IGNORE NULLS) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS q FROM v")
def filled_over_partitions(spark, sf):
    """Three keys that hold all order items, filled along the order of items."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select("l_returnflag", *order, F.when(F.col("l_orderkey") % 50 == 0, F.col("l_quantity")).alias("q"))
    return scan.fill_forward(rows, ["l_returnflag"], order, "q")


@query(f"WITH {FILLED} SELECT scenario_id, sheet, row_idx, schema_order, array_to_string(labels, '|') AS labels, len(labels)::INT AS categories_count, printf('s%02d_r%02d_%dcat', schema_order, row_idx, len(labels)) AS schema_sheet_name FROM schemas")
def schema_rows(spark, sf):
    rows = parse.schema_rows(parse.category_blocks(parse.filled_rows(sheets(spark, sf))))
    name = text.schema_sheet_name(F.col("schema_order"), F.col("row_idx"), F.col("categories_count"))
    return rows.select("scenario_id", "sheet", "row_idx", "schema_order", F.array_join("labels", "|").alias("labels"), "categories_count", name.alias("schema_sheet_name"))


@query(f"WITH {FILLED}, d AS (SELECT *, list_distinct(labels) AS u FROM lab WHERE len(list_filter(labels, lambda x: NOT starts_with(lower(x), 'tier '))) > 0 AND len(labels) >= 2) SELECT scenario_id, sheet, row_idx FROM d QUALIFY row_number() OVER (PARTITION BY scenario_id, sheet ORDER BY len(u) DESC, row_idx) = 1")
def category_row(spark, sf):
    return parse.category_row(parse.category_blocks(parse.filled_rows(sheets(spark, sf))), "matrix_with_preamble").drop("labels")


@query(f"WITH {SHEETS_SQL} SELECT scenario_id, sheet, row_number() OVER (PARTITION BY scenario_id, sheet ORDER BY row_idx)::INT AS finding_order, row_idx, value AS finding FROM cells WHERE col_idx = 0 AND row_idx > 4")
def sheet_findings(spark, sf):
    return parse.findings(sheets(spark, sf))


def _schemas(cells):
    return parse.schema_rows(parse.category_blocks(parse.filled_rows(cells)))


SPANS = f"""{FILLED},
raw_spans AS (
  SELECT c.scenario_id, c.sheet, s.schema_order, c.row_idx, row_number() OVER w::INT AS category_order, c.value AS category, c.col_idx AS start_col, k.width,
         lead(c.col_idx) OVER w AS next_col, lag(c.col_idx) OVER w AS previous_col, count(*) OVER (PARTITION BY c.scenario_id, c.sheet, s.schema_order) AS n
  FROM cells c JOIN schemas s USING (scenario_id, sheet, row_idx) JOIN keyed k USING (scenario_id, sheet) WHERE c.col_idx >= 1
  WINDOW w AS (PARTITION BY c.scenario_id, c.sheet, s.schema_order ORDER BY c.col_idx)),
spans AS (SELECT scenario_id, sheet, schema_order, row_idx, category_order, category, start_col, coalesce(next_col, least(width, 2 * start_col - previous_col))::INT AS end_col FROM raw_spans WHERE n >= 2),
nums AS (SELECT scenario_id, sheet, row_idx, count(*) AS numbers FROM cells WHERE col_idx >= 1 AND try_cast(value AS DOUBLE) IS NOT NULL GROUP BY ALL),
prior_rows AS (SELECT s.scenario_id, s.sheet, s.schema_order, max(n.row_idx) AS prior_row FROM schemas s JOIN keyed k USING (scenario_id, sheet) JOIN nums n USING (scenario_id, sheet) WHERE n.row_idx > s.row_idx AND n.row_idx < k.key_row AND n.numbers >= 2 GROUP BY ALL)
"""


@query(f"WITH {SPANS} SELECT * FROM spans")
def category_spans(spark, sf):
    cells = sheets(spark, sf)
    return parse.category_spans(cells, _schemas(cells))


@query(f"WITH {SPANS} SELECT * FROM prior_rows")
def prior_row(spark, sf):
    cells = sheets(spark, sf)
    return parse.prior_rows(cells, _schemas(cells))


@query(
    f"""WITH {SPANS},
lastspan AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, sheet, schema_order ORDER BY category_order DESC) AS nth FROM spans JOIN prior_rows USING (scenario_id, sheet, schema_order)),
stops AS (SELECT l.scenario_id, l.sheet, l.schema_order, min(c.col_idx) AS stop FROM lastspan l JOIN cells c ON c.scenario_id = l.scenario_id AND c.sheet = l.sheet AND c.row_idx = l.prior_row AND c.col_idx > l.start_col
  WHERE l.nth = 1 AND try_cast(c.value AS DOUBLE) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.scenario_id = l.scenario_id AND s.sheet = l.sheet AND s.schema_order = l.schema_order AND s.start_col = c.col_idx) GROUP BY ALL),
clipped AS (SELECT l.*, CASE WHEN nth = 1 THEN greatest(least(end_col, coalesce(stop, end_col)), start_col + 1) ELSE end_col END AS e FROM lastspan l LEFT JOIN stops USING (scenario_id, sheet, schema_order)),
raws AS (SELECT k.scenario_id, k.sheet, k.schema_order, k.row_idx, k.prior_row, k.category_order, k.category, coalesce(sum(try_cast(c.value AS DOUBLE)), 0) AS prior_raw
  FROM clipped k LEFT JOIN cells c ON c.scenario_id = k.scenario_id AND c.sheet = k.sheet AND c.row_idx = k.prior_row AND c.col_idx >= k.start_col AND c.col_idx < k.e GROUP BY ALL)
SELECT scenario_id, sheet, schema_order, row_idx AS schema_row_idx, prior_row AS prior_row_idx, category_order, category, prior_raw,
  {_r('prior_raw / sum(prior_raw) OVER (PARTITION BY scenario_id, sheet, schema_order)', 9)} AS prior_normalized FROM raws"""
)
def schema_priors(spark, sf):
    with Scratch(spark, "priors") as scratch:
        cells = scratch.table(sheets(spark, sf))
        rows = parse.schema_priors(cells, _schemas(cells))
        return scratch.kept(rows.select("scenario_id", "sheet", "schema_order", "schema_row_idx", "prior_row_idx", "category_order", "category", "prior_raw", rounded(F.col("prior_normalized"), 9).alias("prior_normalized")))


@query(f"WITH {SHEETS_SQL} SELECT scenario_id, sheet, row_idx, " + ", ".join(f"max(value) FILTER (WHERE col_idx = {i}) AS c{i}" for i in range(8)) + " FROM cells GROUP BY scenario_id, sheet, row_idx")
def wide_export(spark, sf):
    return plan.wide(sheets(spark, sf), 8)


@query(f"WITH {SHEETS_SQL} SELECT DISTINCT scenario_id, sheet, 0 AS row_idx, 0 AS col_idx, 'Sheet of ' || scenario_id AS value FROM cells UNION ALL SELECT scenario_id, sheet, row_idx + 1, col_idx, CASE WHEN col_idx < 1 THEN value ELSE '' END FROM cells")
def title_rows(spark, sf):
    cells = sheets(spark, sf)
    titles = cells.select("scenario_id", "sheet", F.concat(F.lit("Sheet of "), F.col("scenario_id")).alias("title")).distinct()
    return plan.with_title_row(cells, titles, 1)


@query(f"WITH {SHEETS_SQL}, b AS (SELECT scenario_id, sheet, row_idx, col_idx, CASE WHEN col_idx = 2 THEN ' ' ELSE value END AS value FROM cells) SELECT * FROM b WHERE col_idx <> 2")
def drop_empty_columns(spark, sf):
    return parse.drop_empty_columns(sheets(spark, sf).withColumn("value", F.when(F.col("col_idx") == 2, " ").otherwise(F.col("value"))))


CATEGORY_ROWS = f"""{FILLED}, d AS (SELECT *, list_distinct(labels) AS u FROM lab WHERE len(list_filter(labels, lambda x: NOT starts_with(lower(x), 'tier '))) > 0 AND len(labels) >= 2),
cr AS (SELECT scenario_id, sheet, row_idx AS category_row, labels FROM d QUALIFY row_number() OVER (PARTITION BY scenario_id, sheet ORDER BY len(u) DESC, row_idx) = 1),
parsed AS (
  SELECT scenario_id, sheet, key_row, category_row, labels, len(labels)::INT AS categories_count, (SELECT count(*) FROM cells c WHERE c.scenario_id = k.scenario_id AND c.sheet = k.sheet AND col_idx = 0 AND row_idx > key_row)::INT AS findings_count,
         CASE WHEN len(labels) <> 3 + replace(scenario_id, 'supp_', '')::INT % 2 THEN printf('category count: %d expected, %d found', 3 + replace(scenario_id, 'supp_', '')::INT % 2, len(labels)) END AS mismatch
  FROM keyed k LEFT JOIN cr USING (scenario_id, sheet))"""


def _expected(cells):
    odd = F.replace("scenario_id", F.lit("supp_"), F.lit("")).cast("int") % 2
    return cells.select("scenario_id").distinct().withColumn("expected_category_count", 3 + odd)


@query(f"WITH {CATEGORY_ROWS} SELECT scenario_id, sheet, key_row, category_row, array_to_string(labels, '|') AS categories, categories_count, findings_count, mismatch AS error FROM parsed")
def parsed_matrices(spark, sf):
    with Scratch(spark, "parsed") as scratch:
        cells = scratch.table(sheets(spark, sf))  # read by each step of the parser
        rows = parse.parse_matrix(cells, "matrix_with_preamble", _expected(cells))
        return scratch.kept(rows.select("scenario_id", "sheet", "key_row", "category_row", F.array_join("categories", "|").alias("categories"), "categories_count", "findings_count", "error"))


@query(f"WITH {CATEGORY_ROWS} SELECT scenario_id, 1::BIGINT AS sheets, categories_count::BIGINT AS observed_categories, findings_count::BIGINT AS findings, coalesce(mismatch, '') AS warnings, 0::BIGINT AS failed FROM parsed")
def qa_summary(spark, sf):
    cells = sheets(spark, sf)
    return parse.qa_summary(parse.parse_matrix(cells, "matrix_with_preamble", _expected(cells), allow_mismatch=True))


@query(f"WITH {SHEETS_SQL} SELECT scenario_id, sheet, col_idx, value AS header FROM cells WHERE row_idx = 1 AND regexp_matches(value, 'Flag [AN]')")
def columns_by_header(spark, sf):
    return parse.columns_by_header(sheets(spark, sf), "Flag [AN]", 1)


@query(f"SELECT *, replace(scenario_id, 'supp_', '')::INT % 2 = 1 AS derived FROM ({SQL['schema_priors']})")
def derived_priors(spark, sf):
    """Suppliers with an even number bring their priors; those of the others are derived from their sheets."""
    cells = sheets(spark, sf)
    schemas = _schemas(cells)
    given = parse.schema_priors(cells, schemas).where(F.replace("scenario_id", F.lit("supp_"), F.lit("")).cast("int") % 2 == 0)
    rows = parse.ensure_priors(schemas.select("scenario_id", "sheet", "schema_order", F.col("row_idx").alias("schema_row_idx")), given, cells)
    return rows.select("scenario_id", "sheet", "schema_order", "schema_row_idx", "prior_row_idx", "category_order", "category", "prior_raw", rounded(F.col("prior_normalized"), 9).alias("prior_normalized"), "derived")


# --- audits and resuming


@query(f"WITH {DIRTY_SQL} SELECT model_id, scenario_id, row_index, value, status, CASE WHEN status IN ('valid', 'non_positive') THEN value::DOUBLE END AS numeric_value FROM graded")
def classify_cells(spark, sf):
    cell = numeric.classify_cell(F.col("value"))
    return dirty(spark, sf).select("model_id", "scenario_id", "row_index", "value", cell["status"].alias("status"), cell["numeric_value"].alias("numeric_value"))


def _audited(spark, sf):
    """All events are expected; every eleventh output row is absent."""
    cells = dirty(spark, sf)
    return audit.classified(cells.select("model_id", "scenario_id", "row_index"), cells.where("row_index % 11 <> 0"), ["model_id", "scenario_id", "row_index"])


AUDITED = f"{DIRTY_SQL}, audited AS (SELECT model_id, scenario_id, row_index, CASE WHEN row_index % 11 <> 0 THEN value END AS raw_value, CASE WHEN row_index % 11 = 0 THEN 'missing' ELSE status END AS status FROM graded)"
COUNTS = "count(*)::BIGINT AS expected_cells, count(*) FILTER (WHERE status = 'valid')::BIGINT AS valid_positive_cells, count(*) FILTER (WHERE status = 'missing')::BIGINT AS missing_cells, count(*) FILTER (WHERE status = 'non_numeric')::BIGINT AS non_numeric_cells, count(*) FILTER (WHERE status = 'non_positive')::BIGINT AS non_positive_cells, count(*) FILTER (WHERE status <> 'valid')::BIGINT AS total_invalid_cells"


@query(f"WITH {AUDITED} SELECT model_id, scenario_id, row_index, raw_value, status FROM audited WHERE status <> 'valid'")
def invalid_cells(spark, sf):
    return audit.invalid_cells(_audited(spark, sf)).drop("numeric_value")


@query(f"WITH {AUDITED} SELECT model_id, scenario_id, count(*)::BIGINT AS missing FROM audited WHERE raw_value IS NULL GROUP BY ALL")
def missing_cells_left_join(spark, sf):
    return _audited(spark, sf).where("raw_value is null").groupBy("model_id", "scenario_id").agg(F.count("*").alias("missing"))


@query(f"WITH {AUDITED}, c AS (SELECT model_id, scenario_id, {COUNTS} FROM audited GROUP BY ALL) SELECT *, total_invalid_cells = 0 AS passes FROM c")
def quality_summary_diff(spark, sf):
    return audit.quality_summary(_audited(spark, sf), ["model_id", "scenario_id"])


@query(
    f"WITH {RAW.removeprefix('WITH ')}, c AS (SELECT scenario_id, {COUNTS} FROM (SELECT scenario_id, CASE WHEN category_order % 4 = 0 THEN 'missing' ELSE 'valid' END AS status FROM ratios WHERE scenario_id <> 'shipping') GROUP BY ALL), "
    "m AS (SELECT scenario_id, count(DISTINCT category) * count(DISTINCT finding) AS expected_cells_manifest FROM cube GROUP BY ALL) "
    "SELECT scenario_id, expected_cells_manifest::BIGINT AS expected_cells_manifest, " + ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("expected_cells", "valid_positive_cells", "missing_cells", "non_numeric_cells", "non_positive_cells", "total_invalid_cells"))
    + ", expected_cells_manifest = coalesce(expected_cells, 0) AS schema_shape_matches_manifest, coalesce(total_invalid_cells, 0) = 0 AND expected_cells_manifest = coalesce(expected_cells, 0) AS passes FROM m LEFT JOIN c USING (scenario_id)"
)
def quality_summary_ovr(spark, sf):
    rows = ratios(spark, sf).where("scenario_id <> 'shipping'")
    key = ["scenario_id", "finding", "category_order"]
    output = rows.where("category_order % 4 <> 0").select(*key, F.col("raw").cast("string").alias("value"))
    manifest = cube(spark, sf).groupBy("scenario_id").agg(F.countDistinct("category").alias("categories_count"), F.countDistinct("finding").alias("findings_count"))
    return audit.quality_summary(audit.classified(rows.select(*key), output, key), ["scenario_id"], manifest)


@query(
    f"WITH {AUDITED}, c AS (SELECT model_id, scenario_id, {COUNTS} FROM audited GROUP BY ALL) SELECT count(*)::BIGINT AS sheets, count(*) FILTER (WHERE total_invalid_cells > 0)::BIGINT AS failed_sheets, "
    + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("expected_cells", "valid_positive_cells", "missing_cells", "non_numeric_cells", "non_positive_cells", "total_invalid_cells"))
    + ", (sum(total_invalid_cells) > 0)::INT AS exit_by_cells, (count(*) FILTER (WHERE total_invalid_cells > 0) > 0)::INT AS exit_by_sheets FROM c"
)
def audit_totals(spark, sf):
    return audit.totals(audit.quality_summary(_audited(spark, sf), ["model_id", "scenario_id"]))


@query(f"WITH {DIRTY_SQL}, ok AS (SELECT row_index % 700 AS k FROM graded GROUP BY k HAVING bool_and(status = 'valid')) SELECT DISTINCT row_index % 700 AS k FROM graded WHERE row_index % 700 NOT IN (SELECT k FROM ok)")
def skip_passing_anti(spark, sf):
    rows = dirty(spark, sf).withColumn("k", F.col("row_index") % 700)
    return runtime.to_run(rows.select("k").distinct(), rows, ["k"], "skip_passing")


@query(f"WITH {DIRTY_SQL} SELECT model_id, scenario_id, row_index, CASE WHEN status <> 'valid' THEN '1.5' ELSE value END AS value FROM graded")
def repair_upsert(spark, sf):
    rows = dirty(spark, sf)
    key = ["model_id", "scenario_id", "row_index"]
    invalid = audit.invalid_cells(rows.withColumn("status", numeric.classify_cell(F.col("value"))["status"]))
    return runtime.upsert(rows, runtime.repair_list(invalid).select(*key, F.lit("1.5").alias("value")), key).select(*key, "value")


REPAIRED = ["s1", "s2", "s3"]


def _to_repair(rows):
    return runtime.repair_list(audit.invalid_cells(rows.withColumn("status", numeric.classify_cell(F.col("value"))["status"])), scenarios=REPAIRED)


@query(f"WITH {DIRTY_SQL} SELECT model_id, scenario_id, row_index, value FROM graded WHERE status <> 'valid' AND scenario_id IN ('s1', 's2', 's3')")
def repair_mode_work(spark, sf):
    """What the mode that repairs leaves to be run."""
    rows = dirty(spark, sf)
    key = ["model_id", "scenario_id", "row_index"]
    return runtime.to_run(rows.select(*key, "value"), rows, key, "repair_invalid", _to_repair(rows))


@query(f"WITH {DIRTY_SQL} SELECT model_id, scenario_id, row_index, CASE WHEN status <> 'valid' AND scenario_id IN ('s1', 's2', 's3') THEN '1.5' ELSE value END AS value, scenario_id IN (SELECT scenario_id FROM graded WHERE status <> 'valid' AND scenario_id IN ('s1', 's2', 's3')) AS rewritten FROM graded")
def repaired_table(spark, sf):
    """A table of outputs by model and scenario, repaired in place; rewritten tells rows whose files are new."""
    key = ["model_id", "scenario_id", "row_index"]
    file = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file")
    with Scratch(spark, "repaired") as scratch:
        path = f"{scratch.root}/outputs"
        dirty(spark, sf).select(*key, "value").write.partitionBy("model_id", "scenario_id").parquet(path)
        before = scratch.table(spark.read.parquet(path).select(file).distinct())
        repaired = runtime.repair_table(spark, path, _to_repair(spark.read.parquet(path)).select(*key, F.lit("1.5").alias("value")), key)
        rows = repaired.select(*key, "value", file).join(before.withColumn("old", F.lit(True)), "file", "left")
        return scratch.kept(rows.select(*key, "value", F.col("old").isNull().alias("rewritten")))


@query("SELECT 'inputs/' || o_orderpriority || '/' || o_orderkey || '.xlsx' AS input_workbook, 'unknown' AS scenario_id, row_number() OVER (ORDER BY 'inputs/' || o_orderpriority || '/' || o_orderkey || '.xlsx')::INT AS pair_index FROM orders")
def work_list(spark, sf):
    """A manifest without scenario and pair number gets both; numbers by the order of input files."""
    name = F.concat(F.lit("inputs/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".xlsx"))
    manifest = table(spark, sf, "orders").select(name.alias("input_workbook"), F.lit("out").alias("output_workbook"))
    return plan.work_list(manifest).select("input_workbook", "scenario_id", "pair_index")


SHEET_CELLS = """
WITH r AS (SELECT 'block_' || l_orderkey % 7 AS scenario_id, 'line <' || l_linenumber || '> & more' AS sheet, row_number() OVER (PARTITION BY l_orderkey % 7, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) - 1 AS row_idx, l_orderkey, l_quantity, l_returnflag FROM lineitem),
c AS (SELECT scenario_id, sheet, row_idx, 'order' AS header, l_orderkey::VARCHAR AS value FROM r UNION ALL SELECT scenario_id, sheet, row_idx, 'amount & unit', l_quantity::BIGINT || ' x' FROM r UNION ALL SELECT scenario_id, sheet, row_idx, 'Unnamed: 3', l_returnflag FROM r)
"""


@query(f"{SHEET_CELLS} SELECT scenario_id, sheet, header, count(*)::BIGINT AS cells, max(row_idx)::BIGINT AS last_row, min(value) AS least, max(value) AS largest, sum(row_idx * length(value))::BIGINT AS moment FROM c GROUP BY ALL")
def workbook_round_trip(spark, sf):
    """All order items as workbooks of seven sheets, one column without a name, written, read again with headers and counted."""
    items = table(spark, sf, "lineitem")
    place = W.partitionBy(F.col("l_orderkey") % 7, "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_suppkey")
    cell = lambda column, value: F.struct(F.lit(column).alias("col_idx"), value.alias("value"))
    sheet = [F.concat(F.lit("block_"), (F.col("l_orderkey") % 7).cast("string")).alias("scenario_id"), F.concat(F.lit("line <"), F.col("l_linenumber").cast("string"), F.lit("> & more")).alias("sheet")]
    values = F.explode(F.array(cell(0, F.col("l_orderkey").cast("string")), cell(1, F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" x"))), cell(3, F.col("l_returnflag"))))
    numbers = items.withColumn("row_idx", F.row_number().over(place))  # before rows become cells
    body = numbers.select(*sheet, "row_idx", values.alias("c")).select("scenario_id", "sheet", "row_idx", "c.*")
    heads = items.select("l_linenumber", (F.col("l_orderkey") % 7).alias("l_orderkey")).distinct().select(*sheet).select("*", F.lit(0).alias("row_idx"), F.explode(F.array(cell(0, F.lit("order")), cell(1, F.lit("amount & unit")))).alias("c")).select("scenario_id", "sheet", "row_idx", "c.*")
    with Scratch(spark, "workbooks") as scratch:
        path = f"{scratch.root}/books"
        workbooks.write_workbooks(body.unionByName(heads), path)
        back = workbooks.scan_workbooks(spark, path, header=True)
        errors = F.collect_set("error")  # an aggregate of objects, so that tasks hash the groups of a sheet and don't sort its cells
        return scratch.kept(back.groupBy("scenario_id", "sheet", "header").agg(
            F.when(F.size(errors) > 0, F.raise_error(F.concat_ws("; ", errors))).otherwise(F.count("*")).alias("cells"), F.max("row_idx").cast("long").alias("last_row"), F.min("value").alias("least"), F.max("value").alias("largest"), F.sum(F.col("row_idx") * F.length("value")).alias("moment")
        ))


@query(f"WITH {DIRTY_SQL} SELECT model_id, scenario_id, row_index, CASE WHEN value = '' THEN '2.0' ELSE value END AS value FROM dirty")
def fill_blank(spark, sf):
    rows = dirty(spark, sf)
    key = ["model_id", "scenario_id", "row_index"]
    return runtime.fill_blank(rows, rows.select(*key, F.lit("2.0").alias("value")), key).select(*key, "value")


@query(f"WITH {DIRTY_SQL} SELECT model_id, scenario_id, row_index, status FROM graded WHERE status <> 'valid' AND scenario_id IN ('s1', 's2', 's3') ORDER BY scenario_id, row_index LIMIT 50")
def repair_list(spark, sf):
    rows = dirty(spark, sf).withColumn("status", numeric.classify_cell(F.col("value"))["status"])
    return runtime.repair_list(audit.invalid_cells(rows), scenarios=["s1", "s2", "s3"], most=50).select("model_id", "scenario_id", "row_index", "status")


@query("SELECT DISTINCT 'u' || user_id AS scenario_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 13 = 0)")
def unfinished_scenarios(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scenario_id"), F.when(F.col("event_id") % 13 == 0, "success").otherwise("failed").alias("status"))
    return runtime.unfinished(rows.select("scenario_id").distinct(), rows)


@query(f"{RAW} SELECT scenario_id, finding, category, CASE WHEN category_order % 5 = 0 THEN 'ERROR' ELSE raw::VARCHAR END AS value, CASE WHEN category_order % 5 = 0 THEN 'non_numeric' ELSE 'valid' END AS status FROM ratios")
def estimator_fill(spark, sf):
    """Cells filled by a pluggable estimator: one that refuses every fifth category."""

    def make():
        def answer(request, attempt):
            if request["category_order"] % 5 == 0:
                raise ValueError("refused")
            return request["raw"]

        return answer

    filled = estimate.estimate(ratios(spark, sf).select(*ROW, "category", "category_order", "raw"), make, retries=1, backoff=0.0, sentinel="ERROR")
    return filled.select(*ROW, "category", "value", numeric.classify_cell(F.col("value"))["status"].alias("status"))


@query(
    f"WITH {CATS}, pos AS (SELECT f.scenario_id, f.o AS row_idx, c.o AS col_idx FROM finds f JOIN cats c USING (scenario_id)), a AS (SELECT m.model_id, p.*, CASE m.model_id WHEN 'm/1' THEN true WHEN 'm/2' THEN (row_idx + col_idx) % 5 <> 0 ELSE scenario_id <> 'shipping' END AS there FROM pos p, (VALUES ('m/1'), ('m/2'), ('m/3')) m(model_id)) "
    "SELECT model_id, scenario_id, 'ovr' AS sheet, count(*)::BIGINT AS expected_cells, count(*) FILTER (WHERE there)::BIGINT AS valid_positive_cells, count(*) FILTER (WHERE NOT there)::BIGINT AS missing_cells, 0::BIGINT AS non_numeric_cells, 0::BIGINT AS non_positive_cells, "
    "count(*) FILTER (WHERE NOT there)::BIGINT AS total_invalid_cells, bool_and(there) AS passes, bool_or(there) AS sheet_exists FROM a GROUP BY ALL"
)
def models_by_manifest(spark, sf):
    """Every model against every expected sheet, though one model lacks a sheet and another has gaps."""
    cells = plan.ovr_sheet(_findings(spark, sf), _categories(spark, sf), ["scenario_id"]).withColumn("sheet", F.lit("ovr"))
    positions = audit.ovr_positions(cells)
    there = F.when(F.col("model_id") == "m/2", (F.col("row_idx") + F.col("col_idx")) % 5 != 0).when(F.col("model_id") == "m/3", F.col("scenario_id") != "shipping").otherwise(True)
    output = positions.withColumn("model_id", F.explode(F.array(*map(F.lit, ("m/1", "m/2", "m/3"))))).where(there).select("model_id", "scenario_id", "sheet", "row_idx", "col_idx", F.lit("1.5").alias("value"))
    return audit.model_audit(positions, output, ["m/1", "m/2", "m/3"])[1]


@query(
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'verbosity+reasoning|reasoning|verbosity|' WHEN 1 THEN 'reasoning|' ELSE 'temperature|' END AS ladder FROM part"
)
def parameter_ladders(spark, sf):
    k = F.col("p_partkey") % 3
    ladder = text.parameter_ladder(F.when(k == 0, "gpt-5-mini").when(k == 1, "o3").otherwise("gpt-4.1"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(ladder, lambda x: F.array_join(x, "+")), "|").alias("ladder"))


@query("SELECT c_custkey, c_mktsegment AS correct, other FROM customer JOIN (SELECT DISTINCT c_mktsegment AS other FROM customer) ON other <> c_mktsegment")
def other_diagnoses(spark, sf):
    cases = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("correct"))
    return plan.other_diagnoses(cases, cases.select(F.col("correct").alias("diagnosis")).distinct())


@query(
    "WITH e AS (SELECT event_type, event_id, json_extract(props, '$.k')::VARCHAR AS k, event_id % 6 AS m FROM events), same AS (SELECT *, CASE m WHEN 1 THEN 0 ELSE m END AS kind FROM e) "
    "SELECT event_type, k, CASE kind WHEN 0 THEN 'number' WHEN 2 THEN 'text' WHEN 3 THEN 'other order' WHEN 4 THEN 'repeated' ELSE 'broken' END AS kind, min(event_id)::BIGINT AS event_id FROM same GROUP BY ALL"
)
def distinct_payloads(spark, sf):
    """Payloads made of each event's number: nested objects in two orders, a number as text, an array the other way round, a repeated field, and no JSON."""
    k = F.get_json_object("props", "$.k")
    forms = ('{"k": %s, "o": {"a": 1, "b": [1, 2]}}', '{"o":{"b":[1,2],"a":1},"k":%s}', '{"k":"%s","o":{"a":1,"b":[1,2]}}', '{"k":%s,"o":{"a":1,"b":[2,1]}}', '{"k":%s,"k":%s}', '{"k":%s')
    made = F.element_at(F.array(*[F.format_string(f, *[k] * f.count("%s")) for f in forms]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = plan.distinct_payloads(table(spark, sf, "events").select("event_type", "event_id", made.alias("payload")), ["event_type"], "event_id", "payload")
    kinds = F.element_at(F.array(*map(F.lit, ("number", "number", "text", "other order", "repeated", "broken"))), (F.col("event_id") % 6 + 1).cast("int"))
    return rows.select("event_type", F.regexp_extract("payload", r'"k": ?"?(\d+)', 1).alias("k"), kinds.alias("kind"), "event_id")


@query(f"WITH {CATS} SELECT scenario_id, finding AS label FROM finds UNION SELECT scenario_id, category FROM cats")
def all_labels(spark, sf):
    return plan.union_distinct(_findings(spark, sf).select("scenario_id", F.col("finding").alias("label")), _categories(spark, sf).select("scenario_id", F.col("category").alias("label")))


@query(f"WITH {PAIRS}, nf AS (SELECT scenario_id FROM finds GROUP BY scenario_id) SELECT scenario_id, pair_index, printf('%03d__%s__vs__%s.xlsx', pair_index, {SLUG.format('category_left')}, {SLUG.format('category_right')}) AS file, 'outputs/' || scenario_id AS folder FROM pairs JOIN nf USING (scenario_id)")
def relative_paths(spark, sf):
    rows = plan.pairs_manifest(plan.category_pairs(_categories(spark, sf), ["scenario_id"]), _findings(spark, sf).groupBy("scenario_id").agg(F.count("*").alias("findings_count")))
    inside = text.output_path(F.col("output_workbook"), "outputs/", F.col("scenario_id"), "outputs")
    return rows.select("scenario_id", "pair_index", F.regexp_extract(inside, "([^/]+)$", 1).alias("file"), F.regexp_replace(text.relative_path(F.concat(F.lit("/repo/"), F.col("output_workbook")), "/repo"), "/[^/]+$", "").alias("folder"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def utc_stamps(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.utc_text(F.col("o_orderdate"), "stamp").alias("stamp"), text.utc_text(F.col("o_orderdate"), "day").alias("day"))


# --- agreement


def _rated(spark, sf):
    r = ratios(spark, sf)
    return r.select("scenario_id", "finding", "category", F.explode(F.array(F.struct(F.lit(1).alias("model_order"), F.col("lr").alias("lr")), F.struct(F.lit(2).alias("model_order"), F.col("raw").alias("lr")), F.struct(F.lit(3).alias("model_order"), (F.col("lr") * 1.25).alias("lr")))).alias("m")).select("scenario_id", "finding", "category", "m.model_order", "m.lr")


@query(
    f"{RAW}, rated AS (SELECT scenario_id, finding, category, 1 AS m, lr FROM ratios UNION ALL SELECT scenario_id, finding, category, 2, raw FROM ratios UNION ALL SELECT scenario_id, finding, category, 3, lr * 1.25 FROM ratios), "
    "d AS (SELECT a.scenario_id, a.m AS model_a, b.m AS model_b, ln(a.lr) - ln(b.lr) AS d FROM rated a JOIN rated b ON a.scenario_id = b.scenario_id AND a.finding = b.finding AND a.category = b.category AND a.m < b.m) "
    f"SELECT scenario_id, model_a, model_b, count(*)::BIGINT AS n, {_r('exp(avg(d))')} AS bias_fold, {_r('exp(avg(d) - 1.96 * stddev_samp(d))')} AS lower_fold, {_r('exp(avg(d) + 1.96 * stddev_samp(d))')} AS upper_fold FROM d GROUP BY ALL HAVING count(*) >= 3"
)
def bland_altman(spark, sf):
    rows = agreement.bland_altman(_rated(spark, sf), ["finding", "category"], ["scenario_id"])
    return rows.select("scenario_id", "model_a", "model_b", "n", *[rounded(F.col(c)).alias(c) for c in ("bias_fold", "lower_fold", "upper_fold")])


@query(
    f"{RAW}, rated AS (SELECT scenario_id, finding, category, 1 AS m, lr FROM ratios UNION ALL SELECT scenario_id, finding, category, 2, raw FROM ratios UNION ALL SELECT scenario_id, finding, category, 3, lr * 1.25 FROM ratios), "
    "d AS (SELECT a.scenario_id, (ln(a.lr) + ln(b.lr)) / 2 AS m, ln(a.lr) - ln(b.lr) AS d FROM rated a JOIN rated b ON a.scenario_id = b.scenario_id AND a.finding = b.finding AND a.category = b.category AND a.m < b.m) "
    f"SELECT scenario_id, {_r('min(m)')} AS x_low, {_r('max(m)')} AS x_high, {_r('-1.1 * max(abs(d))')} AS y_low, {_r('1.1 * max(abs(d))')} AS y_high FROM d GROUP BY scenario_id HAVING count(*) >= 9"
)
def agreement_limits(spark, sf):
    rows = agreement.axis_limits(agreement.bland_altman(_rated(spark, sf), ["finding", "category"], ["scenario_id"]), ["scenario_id"])
    return rows.select("scenario_id", *[rounded(F.col(c)).alias(c) for c in ("x_low", "x_high", "y_low", "y_high")])


@query(
    f"{RAW}, v AS (SELECT scenario_id, log10(raw) AS v FROM ratios), b AS (SELECT scenario_id, count(*) AS n, stddev_samp(v) * pow(count(*)::DOUBLE, -0.2) AS h FROM v GROUP BY ALL HAVING count(*) >= 5 AND stddev_samp(v) > 0), "
    "g AS (SELECT i, log10(1 / 32.0::DOUBLE) + i * (log10(32.0::DOUBLE) - log10(1 / 32.0::DOUBLE)) / 99 AS x FROM range(0, 100) t(i)), "
    "k AS (SELECT scenario_id, i::INT AS i, x, sum(exp(-pow((x - v) / h, 2) / 2)) / any_value(n) / any_value(h) / sqrt(2 * pi()) AS raw FROM v JOIN b USING (scenario_id), g GROUP BY scenario_id, i, x), "
    "p AS (SELECT *, (lead(raw) OVER w + raw) / 2 * (lead(x) OVER w - x) AS part FROM k WINDOW w AS (PARTITION BY scenario_id ORDER BY i)) "
    f"SELECT scenario_id, i, {_r('x')} AS x, {_r('raw / sum(part) OVER (PARTITION BY scenario_id)')} AS density FROM p"
)
def kde_grid(spark, sf):
    rows = agreement.kde(ratios(spark, sf).select("scenario_id", F.col("raw").alias("lr")), ["scenario_id"], points=100)
    return rows.select("scenario_id", "i", rounded(F.col("x")).alias("x"), rounded(F.col("density")).alias("density"))


# --- assessment and text


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id")
def transcript_text(spark, sf):
    return assess.transcripts(table(spark, sf, "conversations"))


TEMPLATES = [("greeting", "turns long", "2.0"), ("greeting", "asks", "0.5"), ("farewell", "asks", "x")]


def _templates(spark):
    return spark.createDataFrame(TEMPLATES, "diagnosis string, info string, lr string")


@query(
    "WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id) SELECT conv_id, diagnosis, md5('For each item of information, answer YES, NO or MISSING from the transcript.' || chr(10) || infos || chr(10) || chr(10) || 'Transcript:' || chr(10) || transcript) AS prompt_md5 "
    "FROM t, (VALUES ('greeting', 'Information: asks' || chr(10) || 'Information: turns long'), ('farewell', 'Information: asks')) d(diagnosis, infos)"
)
def transcript_prompts(spark, sf):
    rows = assess.prompts(assess.transcripts(table(spark, sf, "conversations")), _templates(spark))
    return rows.select("conv_id", "diagnosis", F.md5("prompt").alias("prompt_md5"))


def _responses(spark, sf):
    said = lambda yes, no: F.when(yes, "YES").when(no, "NO").otherwise("MISSING")
    rows = assess.transcripts(table(spark, sf, "conversations"))
    asks = said(F.contains("transcript", F.lit("?")), F.col("turns") > 2)
    response = F.concat(F.lit("asks: "), asks, F.lit("\nturns long : "), said(F.length("transcript") > 500, F.col("turns") > 3), F.lit("\n"))
    return rows.select("conv_id", F.explode(F.array(F.lit("greeting"), F.lit("farewell"))).alias("diagnosis"), response.alias("response"))


ANSWERS = """
t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY conv_id),
answers AS (
  SELECT conv_id, diagnosis, 'asks' AS info, CASE WHEN contains(transcript, '?') THEN true WHEN turns > 2 THEN false END AS answer FROM t, (VALUES ('greeting'), ('farewell')) d(diagnosis)
  UNION ALL SELECT conv_id, diagnosis, 'turns long', CASE WHEN length(transcript) > 500 THEN true WHEN turns > 3 THEN false END FROM t, (VALUES ('greeting'), ('farewell')) d(diagnosis)),
matched AS (SELECT a.*, CASE WHEN diagnosis = 'greeting' AND info = 'asks' THEN 0.5 WHEN diagnosis = 'greeting' THEN 2.0 END::DOUBLE AS lr_value FROM answers a)
"""


@query(f"WITH {ANSWERS} SELECT * FROM answers")
def feature_answers(spark, sf):
    return assess.answers(_responses(spark, sf))


@query(f"WITH {ANSWERS} SELECT conv_id, diagnosis, count(*) FILTER (WHERE answer AND lr_value > 0)::BIGINT AS used, {_r('0.25 * exp(coalesce(sum(ln(lr_value)) FILTER (WHERE answer AND lr_value > 0), 0))')} AS odds FROM matched GROUP BY conv_id, diagnosis")
def answer_odds(spark, sf):
    rows = assess.matched(assess.answers(_responses(spark, sf)), _templates(spark))
    odds = assess.posterior_odds(rows, F.lit(0.25))
    return odds.select("conv_id", "diagnosis", "used", rounded(F.col("odds")).alias("odds"))


@query(
    f"WITH {ANSWERS}, s AS (SELECT conv_id, info, CASE WHEN answer THEN 'present' WHEN NOT answer THEN 'absent' ELSE 'not asked' END AS st FROM answers WHERE diagnosis = 'greeting') "
    "SELECT conv_id, string_agg(CASE info WHEN 'asks' THEN '1. ' ELSE '2. ' END || info || ' is ' || st || '.', chr(10) ORDER BY info) AS context FROM s GROUP BY conv_id"
)
def clinical_contexts(spark, sf):
    return assess.contexts(assess.answers(_responses(spark, sf)).where("diagnosis = 'greeting'"), "conv_id")


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 0)) AS tag, generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 0), 1) - 1 AS link_order FROM pages) SELECT page_id, link_order::INT AS link_order, regexp_extract(tag, 'href="([^"]*)"', 1) AS url, trim(regexp_extract(tag, '>([^<]*)</a>', 1)) AS display_name FROM t""")
def page_links(spark, sf):
    return nav_links(table(spark, sf, "pages"))


@query("SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS chars FROM documents")
def text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed_md5 FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_cell(F.col("text"), True)).alias("collapsed_md5"))


@query(f"SELECT p_partkey, {SLUG.format("p_name || ' & ' || p_type")} AS slug, left(regexp_replace(regexp_replace(p_name || ' @ ' || p_brand, '\\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), 120) AS clean, right('very long sheet name for ' || p_name, 31) AS sheet FROM part")
def slug_names(spark, sf):
    name = F.concat("p_name", F.lit(" & "), "p_type")
    return table(spark, sf, "part").select(
        "p_partkey", text.slug(name).alias("slug"), text.sanitize(F.concat("p_name", F.lit(" @ "), "p_brand")).alias("clean"), text.sheet_name(F.concat(F.lit("very long sheet name for "), "p_name"), "last").alias("sheet")
    )


@query("SELECT p_partkey, [p_brand, p_name, '', ''] AS exemplars, [p_type, ''] AS plain FROM part")
def exemplars(spark, sf):
    label = F.concat("p_type", F.lit(" (e.g. "), "p_brand", F.lit("; "), "p_name", F.lit(" , )"))
    return table(spark, sf, "part").select("p_partkey", text.exemplars(label, 4).alias("exemplars"), text.exemplars(F.col("p_type"), 2).alias("plain"))


@query("SELECT doc_id, regexp_matches(text, 'sk-proj-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}') AS has_secret, regexp_matches(text, '/Users/[A-Za-z0-9._-]+/|Box Sync') AS has_path FROM documents")
def policy_scan(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.matches_any(t, text.SECRET_PATTERNS).alias("has_secret"), text.matches_any(t, text.LOCAL_PATH_PATTERNS).alias("has_path"))


@query("SELECT event_type, json_extract(props, '$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def parsed_props(spark, sf):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").withColumn("k", text.parse_response(fenced, "k long")["k"]).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, ceil(length(text) / 4.0)::INT AS tokens FROM conversations")
def token_estimates(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


@query(
    "SELECT event_id, CASE WHEN m NOT IN (1, 2, 4) AND k > 0 AND k < 50 THEN k::DOUBLE END AS lr, CASE WHEN m NOT IN (2, 3, 4) THEN event_type END AS kind, "
    "CASE WHEN m = 4 THEN 'lr is missing; kind is missing' WHEN m = 2 THEN 'lr is missing; kind is missing' ELSE concat_ws('; ', CASE WHEN m = 1 THEN 'lr is no number: 1.5d' WHEN k <= 0 OR k >= 50 THEN 'lr is out of bounds: ' || k END, CASE WHEN m = 3 THEN 'kind is none of its values: else' END) END AS errors "
    "FROM (SELECT event_id, event_type, event_id % 6 AS m, json_extract(props, '$.k')::BIGINT AS k FROM events)"
)
def checked_responses(spark, sf):
    """Answers made of each event's number and type: as asked for, with a word for a number, empty, of an unknown kind, torn, and fenced."""
    k, m = F.get_json_object("props", "$.k"), F.col("event_id") % 6
    answer = lambda lr, kind: F.concat(F.lit('{"lr": '), lr, F.lit(', "kind": "'), kind, F.lit('", "more": [1]}'))
    whole = answer(k, F.col("event_type"))
    said = F.when(m == 1, answer(F.lit('"1.5d"'), F.col("event_type"))).when(m == 2, "{}").when(m == 3, answer(k, F.lit("else"))).when(m == 4, F.lit("{torn")).when(m == 5, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    kinds = ["add_to_cart", "click", "error", "login", "logout", "purchase", "scroll", "search", "signup", "view"]
    rows = table(spark, sf, "events").select("event_id", text.checked_response(said, {"lr": (0.0, 50.0), "kind": kinds}).alias("r"))
    return rows.select("event_id", "r.lr", "r.kind", F.array_join("r.errors", "; ").alias("errors"))


@query(
    "WITH p AS (SELECT p_size, p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part), f AS (SELECT p_size, 'for' AS side, n AS rank, p_name AS finding, p_brand AS meant FROM p WHERE n <= 5 UNION ALL SELECT p_size, 'against', n - 5, p_name, p_brand FROM p WHERE n BETWEEN 6 AND 10), "
    "c AS (SELECT p_size, count(*) FILTER (WHERE side = 'for') AS a, count(*) FILTER (WHERE side = 'against') AS b FROM f GROUP BY p_size) "
    "SELECT f.p_size, side, rank::INT AS rank, finding, 'as ' || meant AS explanation, meant AS expansion, CASE WHEN a <> 5 OR b <> 5 THEN printf('%d for, %d against', a, b) END AS fault FROM f JOIN c USING (p_size)"
)
def feedback_evidence(spark, sf):
    """Feedback about parts of a size as JSON, read back into ranked findings with what is wrong about it."""
    n = F.row_number().over(W.partitionBy("p_size").orderBy("p_partkey"))
    item = lambda x: F.struct(x["p_name"].alias("finding"), F.concat(F.lit("as "), x["p_brand"]).alias("explanation"), F.create_map(F.lit("B"), x["p_brand"]).alias("abbreviations"))
    side = lambda low: F.transform(F.array_sort(F.collect_list(F.when((F.col("n") > low) & (F.col("n") <= low + 5), F.struct("n", "p_name", "p_brand")))), item)
    said = table(spark, sf, "part").withColumn("n", n).groupBy("p_size").agg(F.to_json(F.struct(side(0).alias("for"), side(5).alias("against"), F.lit("s").alias("summary"))).alias("response"))
    items, faults = assess.evidence(said, ["p_size"])
    return items.join(faults, "p_size", "left").select("p_size", "side", "rank", "finding", "explanation", F.col("abbreviations")["B"].alias("expansion"), "fault")


@query("WITH l AS (SELECT l_orderkey, l_returnflag, l_partkey, l_linenumber FROM lineitem), g(category, of, place) AS (VALUES ('open', 'N', 0), ('done', 'R', 0), ('done', 'A', 1), ('all', 'A', 0), ('all', 'N', 1), ('all', 'R', 2)) SELECT l_orderkey, category, string_agg(l_partkey::VARCHAR, ' ' ORDER BY place, l_linenumber, l_partkey) AS findings FROM l JOIN g ON l_returnflag = of GROUP BY l_orderkey, category")
def combined_findings(spark, sf):
    """Items of orders by three unions of their flags, flag after flag."""
    items = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("finding_order"), F.col("l_partkey").alias("finding"))
    rows = assess.combined(items, "l_orderkey", {"open": ["N"], "done": ["R", "A"], "all": ["A", "N", "R"]})
    return rows.select("l_orderkey", "category", F.array_join("findings", " ").alias("findings"))


@query("SELECT p_size AS page_id, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1)::INT AS link_order, '/part/' || p_partkey AS url, p_name AS display_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def linked_parts(spark, sf):
    """A page a size, with a heading and a list of links for two groups of brands; the links below one of them."""
    link = F.format_string('<li><a class="x" href="/part/%d"> %s </a></li>', "p_partkey", "p_name")
    some = F.col("p_brand").isin("Brand#1", "Brand#2")
    listed = lambda wanted: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("p_partkey", link.alias("t"))))), lambda x: x["t"]), "\n")
    pages = table(spark, sf, "part").groupBy(F.col("p_size").alias("page_id")).agg(F.concat(F.lit("<h3>Others</h3><ul>"), listed(~some), F.lit("</ul><h3 id=1> First (two) </h3>\n<ul class=y>"), listed(some), F.lit("</ul>")).alias("html"))
    return heading_links(pages, "First (two)").where("url <> ''")


@query("SELECT p_size AS page_id, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1)::INT AS finding_order, p_name AS finding, CASE WHEN p_partkey % 4 = 0 THEN 'Not reported' ELSE (p_partkey % 90)::VARCHAR END AS lr FROM part WHERE p_partkey % 5 <> 0")
def ratio_tables(spark, sf):
    """A page a size with a table of ratios, some blank, some rows of three cells, beside a table that isn't it."""
    k = F.col("p_partkey")
    row = F.when(k % 5 == 0, F.format_string("<tr><td>%s</td><td>1</td><td>2</td></tr>", "p_name")).otherwise(F.format_string('<tr><td><a href="#">%s</a> more</td><td> %s\n</td></tr>', "p_name", F.when(k % 4 == 0, "").otherwise((k % 90).cast("string"))))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("t")))), lambda x: x["t"]), "")
    pages = table(spark, sf, "part").groupBy(F.col("p_size").alias("page_id")).agg(F.concat(F.lit('<table><tr><td>no</td><td>1</td></tr></table><article class="a lr_cards_details"><table class="lrtable"><tr><th>Finding</th><th>LR</th></tr>'), rows, F.lit("</table></article>")).alias("html"))
    return lr_tables(pages)


@query(
    "WITH o AS (SELECT 'm' || event_id % 2 AS model_id, event_type AS scenario_id, (user_id % 40)::INT AS row_index, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'often' WHEN 2 THEN '-1' ELSE event_id::VARCHAR END AS value, ts, CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'non_numeric' WHEN 2 THEN 'non_positive' ELSE 'valid' END AS status FROM events), "
    "l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY model_id, scenario_id, row_index ORDER BY ts DESC, value DESC) = 1) SELECT model_id, scenario_id, row_index, CASE WHEN value = '0' THEN '0' ELSE value END AS value, status FROM l WHERE status <> 'valid'"
)
def streamed_work(spark, sf):
    """The open work list, kept by a stream that takes in the outputs of events in two runs, the later ones first."""
    value = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "often").when(F.col("event_id") % 5 == 2, "-1").otherwise(F.col("event_id").cast("string"))
    rows = table(spark, sf, "events").select(F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model_id"), F.col("event_type").alias("scenario_id"), (F.col("user_id") % 40).cast("int").alias("row_index"), value.alias("value"), F.col("ts").cast("timestamp").alias("written_at"), "event_id")
    with Scratch(spark, "streamed") as scratch:
        source, target, check = (f"{scratch.root}/{x}" for x in ("in", "out", "check"))
        for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
            rows.where(part).drop("event_id").write.mode("append").parquet(source)
            incremental.track_once(spark, source, target, check)
        return scratch.kept(incremental.open_work(spark.read.parquet(target)))


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def token_counts(spark, sf):
    """Tokens of every turn under a public vocabulary of 50,000 ranks."""
    return tokens.token_counts(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", tokens.read_ranks(spark, RANKS))


@query("SELECT event_type, event_id % 5 IN (1, 3) AS transient, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def transient_errors(spark, sf):
    k = F.col("event_id") % 5
    error = F.when(k == 1, "HTTP 503 from upstream").when(k == 3, "Read TIMEOUT").otherwise("bad request")
    return table(spark, sf, "events").groupBy("event_type", text.is_transient(error).alias("transient")).agg(F.count("*").alias("n"))
