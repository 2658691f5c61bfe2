"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. The keys' range is dealt into slices
within each source (as many as its share of the rows), so slices in order are a
range-sort of the source. Slice totals give distributed prefix sums; the slice in
which a source's budget ends is sliced again, until it has CUT_ROWS rows at most,
and only these are sorted row by row. That yields one cut (key, id, size) a source,
and every document then finds its share by comparing itself with its source's cut:
no document is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lrforge.llm.common import KEY_DIGITS, as_table, join_small, named, packed, random_key, read, word_count

SLICES = 256  # of a source's part of the keys, at most, each time
CUT_ROWS = 10_000  # rows of a source that are sorted together; rows that are equal in key, id and size count once


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Adds rank and target to rows (src_null, src, source_size), one a source.

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes; no target exceeds cap times its source's size, and what
    is above that is shared by weight among the rest. With sources in order of
    cap * size / weight, those that reach the cap come first, so one running sum
    finds the level of the rest. The table has a row a source, not a document.
    """
    by_name, by_ratio = W.orderBy("src_null", "src"), W.orderBy("ratio", "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    levels = ranked.withColumn("level", (F.sum("source_size").over(W.partitionBy()) - before) / rest)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.partitionBy())
    return levels.withColumn("target", F.least(cap * F.col("source_size").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).drop("weight", "ratio", "level")


def source_cuts(rows: DataFrame, seed: str, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row a source: size, target, whole epochs and the cut of the last one.

    rows: (src_null, src, key, id, size). A document before the cut belongs to the
    last epoch wholly, that at the cut with `part` words (rows that are equal in
    all of these columns share them evenly, rounded down), none after it.
    """
    by = ["src_null", "src"]
    sources = as_table(source_targets(rows.groupBy(*by).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, cap), "mix-sources")
    budget = F.floor(F.col("target") + 0.5)
    sized = F.greatest(F.col("source_size"), F.lit(1))
    sources = sources.withColumn("epochs", F.floor(budget / sized)).withColumn("rest", budget - F.col("epochs") * sized)
    # The part of each source's keys in which its cut lies, and the words before it.
    parts = sources.where("rest > 0").select(*by, "rest", F.lit(0).cast("long").alias("low"), F.lit(16**KEY_DIGITS).cast("long").alias("width"), F.lit(0).cast("long").alias("before"), "n")
    while not parts.where((F.col("n") > CUT_ROWS) & (F.col("width") > 1)).isEmpty():
        slices = F.least(F.lit(SLICES), F.ceil(4 * F.col("n") / CUT_ROWS)).cast("long")
        finer = parts.withColumn("slices", slices).withColumn("step", F.expr("(width + slices - 1) div slices"))
        dealt = join_small(rows, finer.select(*by, "rest", "low", "width", "before", "step"), by, "inner").where("key >= low and key < low + width").withColumn("slice", F.expr("(key - low) div step"))
        totals = dealt.groupBy(*by, "rest", "low", "before", "step", "slice").agg(F.sum("size").alias("slice_size"), F.count("*").alias("n"))
        run = F.col("before") + F.sum("slice_size").over(W.partitionBy(*by).orderBy("slice"))
        cut = totals.withColumn("run", run).withColumn("start", F.col("run") - F.col("slice_size")).where("start < rest and rest <= run")
        parts = as_table(cut.select(*by, "rest", F.expr("low + slice * step").alias("low"), F.col("step").alias("width"), F.col("start").alias("before"), "n"), "mix-slices")
    within = join_small(rows, parts.drop("n"), by, "inner").where("key >= low and key < low + width")
    tied = within.groupBy(*by, "before", "rest", "key", "id", "size").agg(F.count("*").alias("copies"))
    run = F.col("before") + F.sum(F.col("size") * F.col("copies")).over(W.partitionBy(*by).orderBy("key", "id", "size"))
    ends = tied.withColumn("run", run).withColumn("start", F.col("run") - F.col("size") * F.col("copies")).where("start < rest and rest <= run")
    ends = ends.select(*by, F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("start")) / F.col("copies")).alias("part"))
    return as_table(sources.join(ends, by, "left"), "mix-cuts").select(*by, "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "part")


def _keyed(docs: DataFrame, id_col: str, source_col: str, seed: str, size: Column) -> list[Column]:
    return [
        named(source_col).isNull().alias("src_null"),
        F.coalesce(named(source_col).cast("string"), F.lit("")).alias("src"),
        random_key(named(id_col), seed).alias("key"),
        F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"),
        size.alias("size"),
    ]


BEFORE = "key < cut_key or (key = cut_key and (id < cut_id or (id = cut_id and size < cut_size)))"
AT = "key = cut_key and id = cut_id and size = cut_size"


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix"
) -> DataFrame:
    """Decides how many words of every document the mix takes.

    Returns id_col, size, source_size, target, taken: a source's taken words are
    its rounded target (short by less than the number of equal rows at its cut),
    a document is taken at most cap times. Sizes are words; null and blank texts
    have none and give none. A null source is a source of its own, null ids are
    ordered as empty strings, rows that are equal in id, source and size get equal
    shares. Rows only depend on their own values and the seed, so reruns agree.
    An empty table gives no rows; other columns are not looked at.
    """
    rows = as_table(docs.select(named(id_col).alias("_id"), *_keyed(docs, id_col, source_col, seed, word_count(named(text_col)))), "mix-rows")
    cuts = source_cuts(rows.drop("_id"), seed, weights, cap)
    last = F.when(F.expr(BEFORE), F.col("size")).when(F.expr(AT), F.col("part")).otherwise(0)
    joined = join_small(rows, cuts, ["src_null", "src"])
    return joined.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix"
) -> DataFrame:
    """The mix itself: whole documents, each as often as it is taken, columns unchanged.

    As mix_sources, but the document at the cut goes in whole if at least half of
    it lies within the budget, so texts are never cut; documents without words
    belong to every whole epoch, or to the last one if they precede its cut. Rows that
    are equal in id, source and size are taken alike; a null source is a source of its
    own; an empty table gives none. Columns may have any names.
    """
    keyed = _keyed(docs, id_col, source_col, seed, word_count(named(text_col)))
    cuts = source_cuts(as_table(docs.select(*keyed), "mix-rows"), seed, weights, cap)
    last = F.when(F.expr(BEFORE), 1).when(F.expr(AT) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    taken = join_small(docs.select(packed(docs), *keyed), cuts, ["src_null", "src"]).withColumn("copies", (F.col("epochs") + last).cast("int"))
    return taken.where("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)")).alias("epoch")).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || left(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 13))::BIGINT AS key,
         coalesce(doc_id::VARCHAR, '') AS id
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w,
         row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM rows GROUP BY source),
levels AS (
  SELECT *, 3 * source_size / w::DOUBLE AS ratio,
         ((sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked),
targets AS (
  SELECT *, least(3.0::DOUBLE * source_size, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 0.0::DOUBLE) * w) AS target FROM levels),
budgets AS (
  SELECT *, floor(target + 0.5)::BIGINT // greatest(source_size, 1) AS epochs, floor(target + 0.5)::BIGINT % greatest(source_size, 1) AS rest FROM targets),
runs AS (
  SELECT r.doc_id, r.size, b.source_size, b.target, b.epochs, b.rest,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS before
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM runs
"""
