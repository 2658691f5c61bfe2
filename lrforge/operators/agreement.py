"""Agreement between estimators: densities of log ratios and Bland-Altman statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Range of ratios and number of grid points of a density.
LOW, HIGH, POINTS, LEAST = 1 / 32, 32.0, 700, 5
TERMS, REACH = 20, 9  # of the series of a box; bandwidths beyond which its kernel counts for nothing (below 1e-15)


def on_log_scale(values: DataFrame, by: list[str], header: str = "header") -> DataFrame:
    """Adds log_lr: values are ratios, unless the header names ln or log, or one of the group isn't positive."""
    logs = F.col(header).rlike(r"(?i)\b(ln|log)\b") | F.bool_or(F.col("lr") <= 0).over(W.partitionBy(*by))
    return values.withColumn("log_lr", F.when(logs, F.col("lr")).otherwise(F.ln("lr")))


def bland_altman(values: DataFrame, item: list[str], group: list[str], model: str = "model_order", least: int = 3) -> DataFrame:
    """Multiplicative bias and limits of agreement of every two models of a group on the items that both rated.

    values: (group, item, model_order, lr). Pairs with fewer items than least are left out.
    """
    logs = values.where("lr > 0 and not isnan(lr)").select(*group, *item, model, F.ln("lr").alias("x"))
    left, right = logs.withColumnsRenamed({model: "model_a", "x": "xa"}), logs.withColumnsRenamed({model: "model_b", "x": "xb"})
    both = left.join(right, [*group, *item]).where("model_a < model_b").withColumn("d", F.col("xa") - F.col("xb")).withColumn("m", (F.col("xa") + F.col("xb")) / 2)
    stats = both.groupBy(*group, "model_a", "model_b").agg(
        F.count("*").alias("n"), F.avg("d").alias("bias_log"), F.stddev_samp("d").alias("sd_log"), F.max(F.abs("d")).alias("widest"), F.min("m").alias("least_mean"), F.max("m").alias("largest_mean")
    )
    fold = lambda c: F.exp(c)
    spread = 1.96 * F.col("sd_log")
    return stats.where(F.col("n") >= least).select(
        "*", fold(F.col("bias_log")).alias("bias_fold"), fold(F.col("bias_log") - spread).alias("lower_fold"), fold(F.col("bias_log") + spread).alias("upper_fold")
    )


def axis_limits(stats: DataFrame, by: list[str], margin: float = 1.1) -> DataFrame:
    """(by, x_low, x_high, y_low, y_high): one frame for all pairs of models of a group: their mean logs, and their widest difference both ways with a margin."""
    wide = margin * F.max("widest")
    return stats.groupBy(*by).agg(F.min("least_mean").alias("x_low"), F.max("largest_mean").alias("x_high"), (-wide).alias("y_low"), wide.alias("y_high"))


def bandwidths(values: DataFrame, by: list[str], method: str | float = "scott") -> DataFrame:
    """n and bandwidth of each group's log10 ratios: Scott or Silverman in one dimension, or a factor of the spread."""
    n = F.col("n").cast("double")
    factor = F.pow(n, F.lit(-0.2)) if method == "scott" else F.pow(n * 0.75, F.lit(-0.2)) if method == "silverman" else F.lit(float(method))
    stats = values.where("lr > 0 and not isnan(lr)").groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp(F.log10("lr")).alias("sd"))
    return stats.where((F.col("n") >= LEAST) & (F.col("sd") > 0)).select(*by, "n", (F.col("sd") * factor).alias("h"))


def kde(values: DataFrame, by: list[str], method: str | float = "scott", points: int = POINTS, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(by, i, x, density) of log10 ratios on an even grid, with an area of 1 by trapezoids.

    A fast Gauss transform: values are summed up in boxes one bandwidth wide, as TERMS
    moments about the box's middle, in one aggregation that is linear in values; a box then
    adds its Hermite series to the grid points within REACH bandwidths of it. Against the
    sum over all values each value's part is off by less than 1e-13 of the kernel's height.
    """
    logs = values.where("lr > 0 and not isnan(lr)").select(*by, F.log10("lr").alias("v"))
    width = bandwidths(values, by, method)
    placed = logs.join(width, by).select(*by, "n", "h", F.floor(F.col("v") / F.col("h")).alias("box"), (F.col("v") / F.col("h")).alias("u"))
    placed = placed.withColumn("t", F.col("u") - F.col("box") - 0.5)
    moments = placed.groupBy(*by, "n", "h", "box").agg(*[F.sum(F.pow("t", F.lit(float(k)))).alias(f"m{k}") for k in range(TERMS)])

    a, step = F.log10(F.lit(low)), (F.log10(F.lit(high)) - F.log10(F.lit(low))) / (points - 1)
    middle = (F.col("box") + 0.5) * F.col("h")
    first, last = F.ceil((middle - REACH * F.col("h") - a) / step), F.floor((middle + REACH * F.col("h") - a) / step)
    spread = moments.select(*by, "h", middle.alias("c"), F.array(*[f"m{k}" for k in range(TERMS)]).alias("m"), F.greatest(first, F.lit(0)).alias("i0"), F.least(last, F.lit(points - 1)).alias("i1")).where("i0 <= i1")
    near = spread.select(*by, "h", "c", "m", F.explode(F.sequence("i0", "i1")).alias("i")).withColumn("z", (a + F.col("i") * step - F.col("c")) / F.col("h"))
    # exp(-(z - t)^2 / 2) = exp(-z^2 / 2) * sum of g_k t^k, with g_0 = 1, g_(k+1) = (z g_k - g_(k-1)) / (k + 1).
    series = F.expr("aggregate(m, struct(0D as before, 1D as g, 1D as k, 0D as total), (s, x) -> struct(s.g as before, (z * s.g - s.before) / s.k as g, s.k + 1 as k, s.total + s.g * x as total), s -> s.total)")
    sums = near.withColumn("part", F.exp(-F.col("z") * F.col("z") / 2) * series).groupBy(*by, "i").agg(F.sum("part").alias("total"))

    grid = width.select(*by, "n", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("i"))
    raw = grid.join(sums, [*by, "i"], "left").select(*by, F.col("i").cast("int").alias("i"), (a + F.col("i") * step).alias("x"), (F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(0.0)) / F.col("n") / F.col("h") / (2 * 3.141592653589793) ** 0.5).alias("raw"))
    order = W.partitionBy(*by).orderBy("i")
    part = (F.lead("raw").over(order) + F.col("raw")) / 2 * (F.lead("x").over(order) - F.col("x"))
    with_parts = raw.withColumn("part", part).withColumn("area", F.sum("part").over(W.partitionBy(*by)))
    return with_parts.select(*by, "i", "x", F.when(F.col("area") > 0, F.col("raw") / F.col("area")).otherwise(F.col("raw")).alias("density"))
