"""One-vs-rest likelihood ratios and their projection onto ratios that one posterior can have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lrforge.functions.numeric import SIGN_MARGIN, abs_log_change, multiplicative_change, ovr_posterior

RESULT = (
    "struct<posterior:array<double>,log_scores:array<double>,fitted_ovr_lr:array<double>,rmse:double,success:boolean,message:string,iterations:int,"
    "baseline:int,objective_initial:double,objective_final:double,sum_q_init:double,sum_q_fitted:double,sign_impossible_raw:boolean,sign_impossible_fitted:boolean>"
)
TOLERANCE, MOST_STEPS, MOST_HALVINGS, RIDGE = 1e-9, 200, 40, 1e-6
NATIVE_STEPS = 120
TIE = 1e-9  # priors that differ by this share at most are equally likely when the base is chosen
BLOCK_ENTRIES = 1 << 18  # rows times categories that are solved at once


def row_metrics(long: DataFrame, row: list[str], prior: str = "prior", lr: str = "lr") -> DataFrame:
    """Per finding row: sum of independent posteriors, coherence gap, whether no posterior can have these signs."""
    q = ovr_posterior(F.col(prior), F.col(lr))
    grouped = long.withColumn("q", q).groupBy(*row).agg(
        F.sum("q").alias("sum_q_init"),
        (F.bool_and(F.col(lr) > 1 + SIGN_MARGIN) | F.bool_and(F.col(lr) < 1 - SIGN_MARGIN)).alias("sign_impossible"),
        F.count("*").alias("categories"),
        F.count_if(F.col("q").isNull()).alias("invalid"),
    )
    return grouped.withColumn("coherence_gap", F.abs(F.col("sum_q_init") - 1))


def _signs(lr: np.ndarray) -> np.ndarray:
    return (lr > 1 + SIGN_MARGIN).all(axis=1) | (lr < 1 - SIGN_MARGIN).all(axis=1)


def _log_others(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry the logarithm of the sum of exp over all others of its row; that of the whole row; the largest entry's place.

    Entries but the largest have half the sum at most, so that one less their share is
    exact enough; for the largest, the others are added up by themselves.
    """
    at, top = np.arange(len(x)), x.argmax(axis=1)
    rest = x.copy()
    rest[at, top] = -np.inf
    high = rest.max(axis=1, keepdims=True)
    beside = high + np.log(np.exp(rest - high).sum(axis=1, keepdims=True))
    whole = np.logaddexp(x[at, top][:, None], beside)
    with np.errstate(divide="ignore"):  # at the largest entry, which is replaced
        out = whole + np.log1p(-np.exp(x - whole))
    out[at, top] = beside[:, 0]
    return out, whole, top


class _Objective:
    """Half the weighted squares of r = ln fitted - ln raw, and half the ridge times the squares of scores (that of the base is 0).

    ln fitted_k is score k less the logarithm of the others' sum of p exp(s), and a
    constant. With the posterior q, the derivative of r is diag(1 / (1 - q)) (I - 1 q'),
    and the second derivative of the objective is a diagonal and two directions:
        diag(b - C q) - q b' - b q' + t q q',  b = w (1 + r q) / (1 - q)^2,
        C = sum of w r / (1 - q),  t = sum of w (1 + r) / (1 - q)^2.
    Steps are taken in the scores less that of the likeliest category d, and q in shares of
    1 - q_d, so that no two large numbers cancel however sure the posterior is.
    """

    def __init__(self, p: np.ndarray, lr: np.ndarray, weights: np.ndarray, ridge: float, base: np.ndarray):
        self.log_p, self.goal, self.weights, self.ridge, self.base = np.log(p), np.log(lr), weights, ridge, base
        self.logit_p = self.log_p - _log_others(self.log_p)[0]

    def at(self, rows: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        """Value, residuals, ln q, ln (1 - q) and the likeliest category."""
        z = s + self.log_p[rows]
        others, whole, top = _log_others(z)
        log_q, log_rest = z - whole, others - whole
        r = log_q - log_rest - self.logit_p[rows] - self.goal[rows]
        return 0.5 * (self.weights[rows] * r * r).sum(axis=1) + 0.5 * self.ridge * (s * s).sum(axis=1), r, log_q, log_rest, top

    def step(self, rows: np.ndarray, s: np.ndarray, r: np.ndarray, log_q: np.ndarray, log_rest: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, ...]:
        """(step, what it promises, whether it is Newton's): Newton's step where the second derivative is positive, else Gauss and Newton's, which always is."""
        at, w, base = np.arange(len(s)), self.weights[rows], self.base[rows]
        rest = log_rest[at, top][:, None]
        q, share = np.exp(log_q), np.exp(log_q - rest)
        inverse = np.exp(-log_rest)
        sure, others = np.exp(rest), np.ones(s.shape, bool)
        others[at, top] = False
        share[at, top] = inverse[at, top] = 0.0
        w_top, r_top = w[at, top][:, None], r[at, top][:, None]
        ridge = np.full(s.shape, self.ridge)
        ridge[at, base] *= s.shape[1] - 1
        slope = self.ridge * s
        slope[at, base] = -self.ridge * s.sum(axis=1)
        pull = sure * (w * r * inverse).sum(axis=1, keepdims=True) + w_top * r_top
        slope = np.where(others, slope + w * r * inverse - share * pull, 0.0)

        def solved(r: np.ndarray, r_top: np.ndarray | float, pull: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
            """Solution by the matrix for these residuals, and whether that is positive."""
            b = w * (1 + r * q) * inverse**2
            t = (sure**2 * (w * (1 + r) * inverse**2).sum(axis=1, keepdims=True) + w_top * (1 + r_top))[:, 0]
            d = np.where(others, b - pull * share + ridge, 1.0)
            b = b * sure
            bb, bq, qq, bg, qg = ((x * y / d).sum(axis=1) for x, y in ((b, b), (b, share), (share, share), (b, slope), (share, slope)))
            # Woodbury: the inverse of the small matrix [[bb - t, bq - 1], [bq - 1, qq]]. By the signs of its
            # eigenvalues and of the diagonal, the whole is positive if their negative parts make up for each other.
            det = (bb - t) * qq - (bq - 1) ** 2
            minus = (d < 0).sum(axis=1)
            positive = ((minus == 0) & (det < 0)) | ((minus == 1) & (det > 0) & (bb - t + qq < 0))
            along_b, along_q = (qq * bg - (bq - 1) * qg) / det, ((bb - t) * qg - (bq - 1) * bg) / det
            x = (slope - b * along_b[:, None] - share * along_q[:, None]) / d
            return np.where(others, x, 0.0), positive & np.isfinite(x).all(axis=1)

        with np.errstate(all="ignore"):
            x, newton = solved(r, r_top, pull)
            down = (slope * x).sum(axis=1)
            newton &= down >= 0
            if not newton.all():
                plain, _ = solved(np.zeros_like(r), 0.0, 0.0)
                x = np.where(newton[:, None], x, plain)
                down = (slope * x).sum(axis=1)
        return -x, down, newton


def _solve(p: np.ndarray, lr: np.ndarray, weights: np.ndarray, ridge: float, base: np.ndarray) -> dict[str, np.ndarray]:
    """Newton's method for many rows of one width at once, in log scores of all categories but the base.

    A step is halved until the objective falls by a part of what its slope promises. A row
    is done when its step is small, or when what the step promises is below the
    precision of the objective. Time and memory are linear in rows times categories.
    """
    n, k = p.shape
    objective = _Objective(p, lr, weights, ridge, base)
    log_start = -np.logaddexp(0, -(objective.logit_p + objective.goal))  # each category's posterior by itself
    at = np.arange(n)
    s = log_start - objective.log_p
    s -= s[at, base][:, None]
    done, message = np.zeros(n, bool), np.full(n, f"not converged after {MOST_STEPS} steps", object)
    steps, first = np.zeros(n, np.int64), objective.at(at, s)[0]

    def moved(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        to = s[rows] + by
        return to - to[np.arange(len(rows)), base[rows]][:, None]

    live = at
    for _ in range(MOST_STEPS):
        value, *rest = objective.at(live, s[live])
        finite = np.isfinite(value)
        message[live[~finite]] = "the objective is not finite"
        live, value, rest = live[finite], value[finite], [x[finite] for x in rest]
        if not len(live):
            break
        steps[live] += 1
        step, promised, newton = objective.step(live, s[live], *rest)
        # So near an optimum a whole step squares what is left, which the objective's last digits can't show.
        small = newton & ((np.abs(step).max(axis=1) < TOLERANCE) | (promised <= 1e-12 * np.maximum(value, 1e-9)))
        s[live[small]] = moved(live[small], step[small])
        done[live[small]], message[live[small]] = True, "ok"
        live, value, step, promised = live[~small], value[~small], step[~small], promised[~small]
        scale, open_ = np.minimum(1.0, 5.0 / np.maximum(np.abs(step).max(axis=1), 1e-300)), np.ones(len(live), bool)
        for _ in range(MOST_HALVINGS):
            tried = np.nonzero(open_)[0]
            if not len(tried):
                break
            to = moved(live[tried], scale[tried, None] * step[tried])
            good = objective.at(live[tried], to)[0] <= value[tried] - 1e-4 * scale[tried] * promised[tried]
            s[live[tried[good]]] = to[good]
            open_[tried[good]] = False
            scale[tried[~good]] *= 0.5
        # Where no step lowers the objective any more, what is left to gain tells whether this is the optimum.
        stuck = live[open_]
        flat = promised[open_] <= 1e-9 * np.maximum(value[open_], 1e-9)
        done[stuck[flat]], message[stuck] = True, np.where(flat, "ok, at the precision of the objective", "no step lowers the objective")
        live = live[~open_]
        if not len(live):
            break
    last, r, log_q, *_ = objective.at(at, s)
    fitted = r + objective.goal
    with np.errstate(over="ignore"):
        out = np.exp(fitted)
    again = np.exp(-np.logaddexp(0, -(objective.logit_p + fitted)))
    return {
        "posterior": np.exp(log_q), "log_scores": s, "fitted_ovr_lr": out, "rmse": np.sqrt((r * r).mean(axis=1)), "success": done, "message": message, "iterations": steps, "baseline": base,
        "objective_initial": first, "objective_final": last, "sum_q_init": np.exp(log_start).sum(axis=1), "sum_q_fitted": again.sum(axis=1), "sign_impossible_raw": _signs(lr), "sign_impossible_fitted": _signs(out),
    }


def project_batch(priors: list, ratios: list, weights: list | None = None, ridge: float = RIDGE, baseline: int | None = None) -> pd.DataFrame:
    """Results in the order of the rows; what can't be projected has success false and a message, never an exception."""
    fields = [x.split(":")[0] for x in RESULT[7:-1].replace("array<double>", "x").split(",")]
    out: list[dict] = [dict.fromkeys(fields) for _ in priors]
    by_width: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i, (p, lr) in enumerate(zip(priors, ratios, strict=True)):
        try:
            p, lr = np.asarray(p, float), np.asarray(lr, float)
            w = np.ones_like(p) if weights is None or weights[i] is None else np.asarray(weights[i], float)
            if p.ndim != 1 or len(p) < 2 or p.shape != lr.shape or w.shape != p.shape:
                raise ValueError("priors, ratios and weights must be vectors of one length, of two entries at least")
            if not (np.isfinite(p).all() and np.isfinite(lr).all() and np.isfinite(w).all()):
                raise ValueError("all entries must be finite")
            if (p <= 0).any() or (lr <= 0).any() or (w <= 0).any():
                raise ValueError("all entries must be positive")
            if baseline is not None and not 0 <= baseline < len(p):
                raise ValueError("the base is no category")
            by_width.setdefault(len(p), []).append((i, p / p.sum(), lr, w))
        except (ValueError, TypeError) as e:
            out[i] |= {"success": False, "message": str(e), "iterations": 0}
    for k, alike in by_width.items():
        for begin in range(0, len(alike), max(1, BLOCK_ENTRIES // k)):
            rows = alike[begin : begin + max(1, BLOCK_ENTRIES // k)]
            p, lr, w = (np.stack([r[j] for r in rows]) for j in (1, 2, 3))
            # The first category as likely as any but for rounding, so that the scale of priors doesn't matter.
            base = (p >= p.max(axis=1, keepdims=True) * (1 - TIE)).argmax(axis=1) if baseline is None else np.full(len(p), baseline)
            got = _solve(p, lr, w, ridge, base)
            for j, (i, *_) in enumerate(rows):
                out[i] = {f: got[f][j].tolist() if isinstance(got[f][j], np.ndarray) else got[f][j] for f in fields}
    return pd.DataFrame(out, columns=fields)


def project(vectors: DataFrame, ridge: float = RIDGE, baseline: int | None = None) -> DataFrame:
    """Adds struct `result` to rows with arrays priors and ovr_lr (and weights, if there): the ridge path, in Arrow batches."""
    weighted = "weights" in vectors.columns

    @F.pandas_udf(RESULT)
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for priors, ratios, *rest in batches:
            yield project_batch(list(priors), list(ratios), list(rest[0]) if rest else None, ridge, baseline)

    return vectors.withColumn("result", solve("priors", "ovr_lr", *(["weights"] if weighted else [])))


def to_vectors(long: DataFrame, row: list[str], order: str = "category_order", prior: str = "prior", lr: str = "lr") -> DataFrame:
    """Long rows as ordered vectors, one row a finding; category order, not label, ties priors to ratios."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "category", prior, lr)))
    rows = long.groupBy(*row).agg(ordered.alias("v"))
    return rows.select(*row, *[F.col(f"v.{c}").alias(name) for c, name in (("category", "categories"), (prior, "priors"), (lr, "ovr_lr"))])


PRIOR_KEY = ("scenario_id", "schema_order", "schema_sheet_name")


def attach_priors(rows: DataFrame, priors: DataFrame, key: list[str] = PRIOR_KEY) -> tuple[DataFrame, DataFrame]:
    """(vectors, failed): rows (key, finding, ovr_lr in the order of the sheet's columns) with categories and priors of their schema.

    priors: (key, category_order, category, prior_normalized). Ratios and priors are tied
    by position, not by label. A schema without priors, or with another number of them
    than its sheet has columns, gives one row (key, reason) in failed and no vector.
    """
    key = list(key)
    ordered = F.array_sort(F.collect_list(F.struct("category_order", "category", "prior_normalized")))
    known = priors.groupBy(*key).agg(ordered.alias("v")).select(*key, F.col("v.category").alias("categories"), F.col("v.prior_normalized").alias("priors"))
    joined = rows.join(known, key, "left")
    reason = F.when(F.col("priors").isNull(), F.concat(F.lit("no priors for "), F.concat_ws(" / ", *[F.col(c).cast("string") for c in key])))
    reason = reason.when(F.size("priors") != F.size("ovr_lr"), F.format_string("%d ratios, %d priors", F.size("ovr_lr"), F.size("priors")))
    judged = joined.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select(*key, "reason").distinct()


def adjustments(projected: DataFrame, row: list[str]) -> DataFrame:
    """Projected vectors as a row a category, with what the projection changed."""
    zipped = F.arrays_zip("categories", "priors", "ovr_lr", F.col("result.fitted_ovr_lr").alias("fitted"), F.col("result.posterior").alias("posterior"))
    flat = projected.where("result.success").select(*row, "result.rmse", "result.sum_q_init", F.posexplode(zipped).alias("i", "z"))
    raw, fitted = F.col("z.ovr_lr"), F.col("z.fitted")
    return flat.select(
        *row, (F.col("i") + 1).alias("category_order"), F.col("z.categories").alias("category"), F.col("z.priors").alias("prior"), raw.alias("raw_ovr_lr"), fitted.alias("fitted_ovr_lr"),
        multiplicative_change(fitted, raw).alias("mult_change"), abs_log_change(fitted, raw).alias("abs_log_change"), F.col("z.posterior").alias("posterior_fitted"), "sum_q_init", F.col("rmse").alias("rmse_log_lr"),
    )


def failures(projected: DataFrame, row: list[str]) -> DataFrame:
    return projected.where("not result.success").select(*row, F.col("result.message").alias("reason"))


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sum(x: str, body: str = "e") -> str:
    return f"aggregate({x}, 0D, (total, e) -> total + {body})"


def native_projection(vectors: DataFrame, steps: int = NATIVE_STEPS, ridge: float = RIDGE) -> DataFrame:
    """Adds posterior_native, fitted_native and success_native by Catalyst functions alone (unit weights, the likeliest category as base).

    The same objective and optimum as project. Its second derivative is a diagonal and
    two more directions, so a damped Newton step has a closed form with sums over the
    categories (Woodbury). A fold tries one step; the damping falls tenfold where it
    lowers the objective and grows tenfold where it doesn't. success_native says that
    the last step tried was small and the damping low.
    """
    data = vectors.withColumn("p", F.expr(f"transform(priors, x -> x / {_sum('priors')})")).withColumn("base", F.expr(f"array_position(transform(p, x -> x >= array_max(p) * (1 - {TIE!r}D)), true) - 1"))
    # Constants of a category: prior and its logit and the goal, together; i tells the base.
    data = data.withColumn("c", F.expr("zip_with(p, transform(ovr_lr, (x, i) -> struct(ln(x) as g, i as i)), (pp, y) -> struct(pp as p, ln(pp) - ln1p_rest(pp) + y.g as goal, if(y.i = base, 0D, 1D) as free))".replace("ln1p_rest(pp)", "log1p(-pp)")))
    start = "zip_with(c, p, (k, pp) -> -log1p(exp(-k.goal)) - ln(pp))"
    data = data.withColumn("s0", F.expr(start)).withColumn("s0", F.expr("transform(s0, x -> x - s0[cast(base as int)])"))

    mass = "zip_with({s}, c, (x, k) -> exp(x) * k.p)"
    posterior = _let(mass, "m", f"transform(m, x -> x / {_sum('m')})")
    residual = "zip_with({q}, c, (x, k) -> ln(x) - log1p(-x) - k.goal)"
    value = f"0.5D * {_sum('{r}', 'e * e')} + {0.5 * ridge!r}D * {_sum('{s}', 'e * e')}"
    state = lambda s: _let(posterior.format(s=s), "q", _let(residual.format(q="q"), "r", f"named_struct('s', {s}, 'q', q, 'r', r, 'v', {value.format(r='r', s=s)})"))
    terms = "zip_with(zip_with(w.x.q, w.x.r, (q, r) -> struct(q, r / (1 - q) as c, (1 + r * q) / (1 - q) / (1 - q) as b)), c, (t, k) -> struct(t.q as q, t.c as c, t.b as b, k.free as free))"
    sums = f"named_struct('c', {_sum('t', 'e.c')}, 'b', {_sum('t', 'e.b')})"
    parts = f"zip_with(t, w.x.s, (y, s) -> struct(y.q as q, y.b as b, y.free * (y.c - y.q * a.c + {ridge!r}D * s) as g, y.free / (y.b - y.q * a.c + {ridge!r}D + w.mu) as d))"
    dots = "named_struct(" + ", ".join(f"'{n}', {_sum('y', f'e.d * {x} * {z}')}" for n, x, z in (("bb", "e.b", "e.b"), ("bq", "e.b", "e.q"), ("qq", "e.q", "e.q"), ("bg", "e.b", "e.g"), ("qg", "e.q", "e.g"))) + ")"
    # (S^-1 + U'DU)^-1 U'Dg for U = [b q], S^-1 = -[[sum b + sum c, 1], [1, 0]].
    det = "((o.bb - a.b - a.c) * o.qq - (o.bq - 1) * (o.bq - 1))"
    step = f"transform(y, e -> e.d * (e.b * (o.qq * o.bg - (o.bq - 1) * o.qg) / {det} + e.q * ((o.bb - a.b - a.c) * o.qg - (o.bq - 1) * o.bg) / {det} - e.g))"
    tried = _let(step, "m", _let(state("zip_with(w.x.s, m, (x, y) -> x + least(greatest(y, -5D), 5D))"), "n", _let("array_max(transform(m, x -> abs(x)))", "size", "if(n.v <= w.x.v * (1 + 1e-14D), named_struct('x', n, 'mu', greatest(w.mu / 10, 1e-12D), 'size', if(w.mu > 1e-3D, 1D, size)), named_struct('x', w.x, 'mu', w.mu * 10, 'size', if(size < 1e-8D, size, 1D)))")))
    fold = _let(terms, "t", _let(sums, "a", _let(parts, "y", _let(dots, "o", tried))))
    data = data.withColumn("w", F.expr(f"named_struct('x', {state('s0')}, 'mu', 1D, 'size', 1D)"))
    data = data.withColumn("w", F.expr(f"aggregate(sequence(1, {steps}), w, (w, i) -> if(w.size < 1e-10D, w, {fold}))"))
    fitted = F.expr("zip_with(w.x.q, p, (x, pp) -> exp(ln(x) - log1p(-x) - ln(pp) + log1p(-pp)))")
    return data.select(*vectors.columns, F.col("w.x.q").alias("posterior_native"), fitted.alias("fitted_native"), (F.col("w.size") < 1e-7).alias("success_native"))


def native_or_not(vectors: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """vectors with fitted, posterior and success: by the Catalyst path, and where that doesn't converge by the other.

    Rows without native success alone go through Python.
    """
    native = native_projection(vectors, ridge=ridge)
    done = native.where("success_native").select(*vectors.columns, F.col("fitted_native").alias("fitted"), F.col("posterior_native").alias("posterior"), F.lit(True).alias("success"))
    rest = project(native.where("success_native is null or not success_native").select(*vectors.columns), ridge)
    return done.unionByName(rest.select(*vectors.columns, F.col("result.fitted_ovr_lr").alias("fitted"), F.col("result.posterior").alias("posterior"), F.col("result.success").alias("success")))
