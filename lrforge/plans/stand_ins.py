"""The driver's tables as the concepts of this engine: cubes of counts, sheets, dirty cells, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lrforge.functions.numeric import rounded
from lrforge.operators import estimate

FLAGS = ("A", "N", "R")
FIRST_YEAR = 1992


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, finding, category, n): how often findings come with categories, in four scenarios."""
    t = lambda name: table(spark, sf_dir, name)
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = t("orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    joined = orders.join(customers.select("c_custkey", "c_mktsegment", "n_name", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    # One pass over the join: counts by all columns first, then each scenario's view of them.
    counted = joined.groupBy("o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "r_name").agg(F.count("*").alias("n"))
    view = lambda name, finding, category: F.struct(F.lit(name).alias("scenario_id"), F.col(finding).alias("finding"), F.col(category).alias("category"))
    views = F.array(view("segment", "o_orderpriority", "c_mktsegment"), view("region", "o_orderstatus", "r_name"), view("nation", "o_orderpriority", "n_name"))
    by_order = counted.select(F.explode(views).alias("v"), "n").select("v.*", "n")
    # Items are counted by part before they meet their parts.
    items = t("lineitem").groupBy("l_partkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    by_item = items.groupBy(F.lit("shipping").alias("scenario_id"), F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("finding"), F.col("p_brand").alias("category")).agg(F.sum("n").alias("n"))
    return by_order.unionByName(by_item).groupBy("scenario_id", "finding", "category").agg(F.sum("n").alias("n"))


def ratios(spark: SparkSession, sf_dir: str, smoothing: float = 0.5) -> DataFrame:
    """The cube with priors, smoothed ratios lr, and raw: what an estimator that rounds to tenths would say."""
    rows = estimate.empirical(cube(spark, sf_dir), ["scenario_id"], smoothing)
    return rows.withColumn("raw", F.greatest(rounded(F.col("lr"), 1), F.lit(0.1)))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells of a headerless sheet for every supplier: tiers, flags (twice), priors with a total, key row, a finding a year."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("y"))
    counted = items.groupBy("l_suppkey", "y", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    flag = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")).cast("int") - 1
    cell = lambda row, col, value: F.struct(F.lit(row).cast("int").alias("row_idx"), F.lit(col).cast("int").alias("col_idx"), (value if hasattr(value, "alias") else F.lit(value)).alias("value"))
    name = lambda f: f"Flag {f} (e.g. {f}1, {f}2)"
    fixed = [cell(0, 1, "Tier 1"), cell(0, 3, "Tier 2"), *[cell(r, 1 + 2 * i, name(f)) for r in (1, 2) for i, f in enumerate(FLAGS)], cell(4, 0, "Key feature")]
    by_supplier = counted.groupBy("l_suppkey").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("n")).otherwise(0)).alias(f) for f in FLAGS], F.sum("n").alias("total"), F.collect_set("y").alias("years"))
    priors = [*[cell(3, 1 + 2 * i, F.col(f).cast("string")) for i, f in enumerate(FLAGS)], cell(3, 7, F.col("total").cast("string"))]
    named = F.transform("years", lambda y: F.struct((y - FIRST_YEAR + 5).cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), F.concat(F.lit("Shipped in "), y.cast("string")).alias("value")))
    heads = by_supplier.select("l_suppkey", F.explode(F.concat(F.array(*fixed, *priors), named)).alias("c")).select("l_suppkey", "c.*")
    body = counted.select("l_suppkey", (F.col("y") - FIRST_YEAR + 5).cast("int").alias("row_idx"), (1 + 2 * flag + (F.col("l_linestatus") == "O").cast("int")).alias("col_idx"), F.col("n").cast("string").alias("value"))
    return heads.unionByName(body).select(F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("scenario_id"), F.lit("counts").alias("sheet"), "row_idx", "col_idx", "value")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output cells (model_id, scenario_id, row_index, value) of every kind, from events."""
    k = F.col("event_id") % 7
    value = F.when(k == 0, "").when(k == 1, "abc").when(k == 2, "0").when(k == 3, "-0.1").when(k == 4, "nan").otherwise(F.floor(F.abs("value") * 100 + 1).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("model_id"), F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("scenario_id"), F.col("event_id").alias("row_index"), value.alias("value"))


CUBE_SQL = """
j AS (SELECT o_orderstatus, o_orderpriority, c_mktsegment, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cube AS (
  SELECT 'segment' AS scenario_id, o_orderpriority AS finding, c_mktsegment AS category, count(*)::BIGINT AS n FROM j GROUP BY ALL
  UNION ALL SELECT 'region', o_orderstatus, r_name, count(*)::BIGINT FROM j GROUP BY ALL
  UNION ALL SELECT 'nation', o_orderpriority, n_name, count(*)::BIGINT FROM j GROUP BY ALL
  UNION ALL SELECT 'shipping', l_returnflag || '/' || l_linestatus, p_brand, count(*)::BIGINT FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
"""


def lr_sql(smoothing: float = 0.5) -> str:
    return f"""{CUBE_SQL},
tot AS (SELECT *, sum(n) OVER (PARTITION BY scenario_id, category)::DOUBLE AS nc, sum(n) OVER (PARTITION BY scenario_id, finding)::DOUBLE AS nf,
               sum(n) OVER (PARTITION BY scenario_id)::DOUBLE AS na, dense_rank() OVER (PARTITION BY scenario_id ORDER BY category)::INT AS category_order FROM cube),
lrs AS (SELECT *, nc / na AS prior, CASE WHEN na > nc AND nf - n + {smoothing} > 0
          THEN ((n + {smoothing}::DOUBLE) / (nc + {2 * smoothing}::DOUBLE)) / ((nf - n + {smoothing}::DOUBLE) / (na - nc + {2 * smoothing}::DOUBLE)) END AS lr FROM tot),
ratios AS (SELECT *, greatest(floor(lr * 10 + 0.5) / 10, 0.1::DOUBLE) AS raw FROM lrs)
"""


SHEETS_SQL = """
counted AS (SELECT l_suppkey, year(l_shipdate) AS y, l_returnflag AS f, l_linestatus AS s, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL),
supp AS (SELECT DISTINCT l_suppkey FROM counted),
flags(f, i) AS (VALUES ('A', 0), ('N', 1), ('R', 2)),
cells AS (
  SELECT 'supp_' || l_suppkey AS scenario_id, 'counts' AS sheet, row_idx::INT AS row_idx, col_idx::INT AS col_idx, value FROM (
    SELECT l_suppkey, 0 AS row_idx, 1 AS col_idx, 'Tier 1' AS value FROM supp
    UNION ALL SELECT l_suppkey, 0, 3, 'Tier 2' FROM supp
    UNION ALL SELECT l_suppkey, r, 1 + 2 * i, 'Flag ' || f || ' (e.g. ' || f || '1, ' || f || '2)' FROM supp, flags, (VALUES (1), (2)) x(r)
    UNION ALL SELECT l_suppkey, 4, 0, 'Key feature' FROM supp
    UNION ALL SELECT l_suppkey, 3, 1 + 2 * i, coalesce((SELECT sum(n) FROM counted c WHERE c.l_suppkey = supp.l_suppkey AND c.f = flags.f), 0)::BIGINT::VARCHAR FROM supp, flags
    UNION ALL SELECT l_suppkey, 3, 7, sum(n)::BIGINT::VARCHAR FROM counted GROUP BY l_suppkey
    UNION ALL SELECT DISTINCT l_suppkey, y - 1992 + 5, 0, 'Shipped in ' || y FROM counted
    UNION ALL SELECT l_suppkey, y - 1992 + 5, 1 + 2 * i + (s = 'O')::INT, n::VARCHAR FROM counted JOIN flags USING (f)))
"""

DIRTY_SQL = """
dirty AS (
  SELECT event_type AS model_id, 's' || (user_id % 50) AS scenario_id, event_id AS row_index,
         CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '0' WHEN 3 THEN '-0.1' WHEN 4 THEN 'nan' ELSE floor(abs(value) * 100 + 1)::BIGINT::VARCHAR END AS value
  FROM events),
graded AS (
  SELECT *, CASE WHEN value = '' THEN 'missing' WHEN value IN ('abc', 'nan') THEN 'non_numeric' WHEN value::DOUBLE <= 0 THEN 'non_positive' ELSE 'valid' END AS status FROM dirty)
"""
