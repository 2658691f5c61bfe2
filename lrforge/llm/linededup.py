"""Line dedup by overlapping windows of three lines.

Windows are hashed (two 64-bit hashes), repeated hashes and their first places are
found by one aggregation, and every later occurrence marks the lines that it
covers. Only documents with such lines have their texts joined with the marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lrforge.llm.common import as_table, named, packed, read

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(_id, _tag, at, h1, h2) of every window of WINDOW lines that holds a word; lines count from 0."""
    lines = docs.withColumn("_lines", F.split("_text", "\n"))
    n = F.greatest(F.size("_lines") - (WINDOW - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("_lines", i + 1, n).alias(f"l{i}") for i in range(WINDOW)])
    each = lines.where(F.size("_lines") >= WINDOW).select("_id", "_tag", F.posexplode(zipped).alias("at", "w"))
    columns = [F.col(f"w.l{i}") for i in range(WINDOW)]
    worded = F.concat(*columns).rlike(r"[^\x20\x09-\x0D]")
    return each.where(worded).select("_id", "_tag", "at", F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *reversed(columns)).alias("h2"))


def _marks(docs: DataFrame) -> DataFrame:
    """(_id, _tag, starts) of documents with later occurrences: starts holds the first lines of their windows, in order."""
    windows = as_table(_windows(docs), "line-windows")
    place = F.struct(F.col("_id"), F.col("_tag"), F.col("at"))
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    # A passage in a third of all documents is a hot key on the left only, which adaptive execution splits.
    # Repeated windows grow with the input, so they aren't broadcast at any size.
    later = windows.join(first.select("h1", "h2", "first").hint("merge"), ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("_id", "_tag").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def _uncovered(lines: Column, starts: Column) -> Column:
    """Lines outside the windows, which are in order: what lies between the end of each and the start of the next, in linear time."""
    ends = F.concat(F.array(F.lit(0)), F.transform(starts, lambda p: p + WINDOW))
    return F.flatten(F.zip_with(ends, F.concat(starts, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))


def _named(id_col: str, text_col: str) -> list[Column]:
    return [named(id_col).alias("_id"), F.xxhash64(named(text_col)).alias("_tag")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes later occurrences of three consecutive lines; adds n_lines and n_removed.

    Lines end at \\n and are compared as they are; a window without any word never
    counts. Of all equal windows the first in order of (id, text hash, line) stays, in
    other documents and in its own; every line that a later one covers goes, and the
    rest is joined by \\n again, so each removed line still stands at an earlier place.
    Texts of fewer than three lines stay whole. A text of which every line goes
    becomes empty. Null texts stay null (n_lines 0), null ids come first; rows that are
    equal in id and text count as one document and lose the same lines. Other columns
    pass through, but for those named n_lines or n_removed (in any case), which the
    results replace; an empty table gives an empty one. Time and memory are linear in
    a document's lines.
    """
    names = _named(id_col, text_col)
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rows = docs.select(packed(docs), *names)
    # Spread evenly by (id, hash): texts meet their marks there, and hot passages play no part.
    marks = as_table(_marks(docs.select(*names, named(text_col).alias("_text"))), "line-marks").select(F.col("_id").alias("m_id"), F.col("_tag").alias("m_tag"), "starts")
    marked = rows.join(marks.hint("merge"), F.col("_id").eqNullSafe(F.col("m_id")) & (F.col("_tag") == F.col("m_tag")), "left")
    field = lambda c: F.col("row").getField(c)

    def work(lines: Column) -> Column:
        kept = F.when(F.col("starts").isNotNull(), _uncovered(lines, F.col("starts")))
        return F.struct(F.array_join(kept, "\n").alias("text"), F.size(lines).cast("long").alias("lines"), (F.size(lines) - F.size(kept)).cast("long").alias("removed"))

    # The lines are bound to a variable, so that a text is split once.
    split = marked.withColumn("_work", F.element_at(F.transform(F.array(F.split(field(text_col), "\n")), work), 1))
    text = F.when(F.col("starts").isNull(), field(text_col)).otherwise(F.col("_work.text"))
    counts = [F.when(field(text_col).isNull(), 0).otherwise(F.col("_work.lines")).cast("long").alias("n_lines"), F.when(F.col("starts").isNull(), 0).otherwise(F.col("_work.removed")).cast("long").alias("n_removed")]
    return split.select(*[text.alias(c) if c == text_col else field(c).alias(c) for c in columns], *counts)


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs after dedup_lines, columns unchanged; a document of which no word is left goes, if lines of it were removed.

    chars_col, if there, follows a text that has changed. As in dedup_lines for nulls,
    ties and empty tables; columns may have any names.
    """
    done = dedup_lines(docs.select(packed(docs), named(id_col).alias("_doc"), named(text_col).alias("_text")), "_doc", "_text")
    kept = done.where(F.expr(r"n_removed = 0 or rlike(_text, r'[^\x20\x09-\x0D]')"))
    old = lambda c: F.col("row").getField(c)
    new = {text_col: F.col("_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("n_removed") > 0, F.length("_text").cast(docs.schema[chars_col].dataType)).otherwise(old(chars_col))
    return kept.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS win
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3)),
later AS (
  SELECT doc_id, pos FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
covered AS (SELECT doc_id, list(DISTINCT pos + k) AS gone FROM later, range(0, 3) x(k) GROUP BY doc_id),
k AS (
  SELECT doc_id, text, lines, gone,
         CASE WHEN gone IS NULL THEN text
              ELSE array_to_string(list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)) END AS kept
  FROM d LEFT JOIN covered USING (doc_id))
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, length(kept)::BIGINT AS kept_chars, md5(kept) AS kept_md5 FROM k
"""
