"""Exact quantiles of groups of any size, by selection over histograms of the bits of doubles.

A double's bits, turned so that they ascend with the value, are read 16 at a time. A
histogram of the first 16 tells in which bucket each wanted rank lies, the next
one looks at these buckets alone, and after four the value is known to the last bit.
All groups, columns and quantiles go through the same four passes; what is shuffled
are counts, 65,536 a group and bucket at most, and no group's values meet in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lrforge.session import Scratch

DIGIT, PASSES = 16, 4
#: Up to this many rows in all, Spark's own exact percentile holds no more than these in a task.
FEW = 1 << 20
LOW_63 = np.int64(0x7FFFFFFFFFFFFFFF)


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A long that ascends with the double; 0.0 and -0.0 are one."""
    bits = (x.to_numpy(float) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ LOW_63, bits))


@F.pandas_udf(T.DoubleType())
def from_ordered_bits(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ LOW_63, b).view(float))


def _digit(bits: str, level: int) -> str:
    """The level-th 16 bits; the first are signed, as the bits are."""
    shift = 64 - DIGIT * (level + 1)
    return f"shiftright({bits}, {shift})" if level == 0 else f"shiftright({bits}, {shift}) & 65535L"


def select_quantiles(df: DataFrame, by: list[str], columns: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(by, name_column): quantiles with linear interpolation of each column's values, nulls and NaN left out; null where there are none.

    Groups with nulls in by are groups like others. The result is written, and what the
    passes wrote before it is removed again.
    """
    spark = df.sparkSession
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))
    group = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")) if by else F.struct(F.lit(0).alias("_"))
    with Scratch(spark, "quantiles") as scratch:
        flat = df.select(group.alias("g"), cells.alias("c")).select("g", "c.i", "c.x")
        groups = scratch.table(flat.select("g").distinct())
        values = scratch.table(flat.where("x is not null and not isnan(x)").select("g", "i", ordered_bits("x").alias("bits")))
        wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()])
        targets = None
        for level in range(PASSES):
            shift = 64 - DIGIT * level
            prefix = F.expr(f"shiftright(bits, {shift})") if level else F.lit(0)
            rows = values.select("g", "i", prefix.cast("long").alias("prefix"), F.expr(_digit("bits", level)).alias("digit"))
            if level:
                rows = rows.join(targets.select("g", "i", "prefix").distinct(), ["g", "i", "prefix"], "left_semi")
            order = W.partitionBy("g", "i", "prefix").orderBy("digit")
            hist = rows.groupBy("g", "i", "prefix", "digit").agg(F.count("*").alias("n"))
            hist = hist.withColumn("below", F.sum("n").over(order) - F.col("n"))
            if level == 0:
                hist = hist.withColumn("total", F.sum("n").over(W.partitionBy("g", "i")))
                at = hist.withColumn("w", F.explode(wanted)).withColumn("position", F.expr("w.q * (total - 1)"))
                sides = F.explode(F.array(F.struct(F.lit("low").alias("side"), F.floor("position").alias("rank")), F.struct(F.lit("high").alias("side"), F.ceil("position").alias("rank"))))
                at = at.withColumn("s", sides).select("g", "i", F.col("w.name").alias("name"), "position", "s.side", "s.rank", "prefix", "digit", "n", "below")
            else:
                at = hist.join(targets, ["g", "i", "prefix"])
            found = at.where("rank >= below and rank < below + n")
            step = F.col("digit") if level == 0 else F.col("prefix") * (1 << DIGIT) + F.col("digit")
            targets = scratch.table(found.select("g", "i", "name", "position", "side", (F.col("rank") - F.col("below")).alias("rank"), step.alias("prefix")))
        value = targets.select("g", "i", "name", "position", "side", from_ordered_bits("prefix").alias("value"))
        side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
        each = value.groupBy("g", "i", "name", "position").agg(side("low").alias("low"), side("high").alias("high"))
        # As Spark's percentile interpolates, to the last bit.
        between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("position") - F.col("position")) * F.col("low") + (F.col("position") - F.floor("position")) * F.col("high"))
        each = each.select("g", "i", "name", between.alias("value"))
        named = [F.max(F.when((F.col("i") == i) & (F.col("name") == name), F.col("value"))).alias(f"{name}_{c}") for i, c in enumerate(columns) for name in quantiles]
        wide = groups.join(each, "g", "left").groupBy("g").agg(*named)
        return scratch.kept(wide.select(*[F.col(f"g.{c}").alias(c) for c in by], *[f"{name}_{c}" for c in columns for name in quantiles]))


def summarized(rows: DataFrame, by: list[str], counts: list[Column], quantiles: dict[str, tuple[Column, float]]) -> DataFrame:
    """groupBy(by) with counts, and quantiles by their names: name -> (values, null where a row has none; quantile).

    rows are computed once. Few of them are left to Spark's percentile, which holds a
    group's distinct values in a task; many go through select_quantiles.
    """
    with Scratch(rows.sparkSession, "summarized") as scratch:
        wide = scratch.table(rows.select("*", *[F.when(~F.isnan(x), x).alias(f"_q{i}") for i, (x, _) in enumerate(quantiles.values())]))
        if wide.count() <= FEW:
            return scratch.kept(wide.groupBy(*by).agg(*counts, *[F.percentile(f"_q{i}", F.lit(q)).alias(name) for i, (name, (_, q)) in enumerate(quantiles.items())]))
        found = wide.groupBy(*by).agg(*counts)
        for q in sorted({q for _, q in quantiles.values()}):
            mine = {f"_q{i}": name for i, (name, (_, at)) in enumerate(quantiles.items()) if at == q}
            part = select_quantiles(wide, by, list(mine), {"at": q})
            same = F.lit(True)
            for c in by:
                same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            found = found.alias("a").join(part.alias("b"), same, "left").select("a.*", *[F.col(f"b.at_{c}").alias(name) for c, name in mine.items()])
        return scratch.kept(found)
