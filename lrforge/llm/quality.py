"""A ledger of quality rules as bit masks, with DataFrame functions only.

Every rule is evaluated once. The ledger keeps its measurements and one bit a
failed rule; policies are versioned masks over these bits, so that a new policy,
or the question what a rule costs, needs no second look at the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lrforge.llm.common import SPACE, named, packed, read

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Bit, name and SQL test of failure over the measurements; integers only, so every engine agrees.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeats", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "n_symbols > 2 * n_words"),
    ("dup_lines", "n_lines >= 10 and 100 * n_dup_lines > 60 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Version: the bits that reject a document.
POLICIES = {
    1: BIT["few_words"] | BIT["repeats"],
    2: BIT["few_words"] | BIT["repeats"] | BIT["symbols"] | BIT["dup_lines"] | BIT["long_words"],
}
CURRENT = 2


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more: sorts (hash, position), keeps
    positions with an equal neighbour, and adds up what each covers before the next begins."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        twice = F.filter(
            F.arrays_zip(
                sorted_pairs.alias("p"),
                F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(sorted_pairs, 1, n)).alias("before"),
                F.slice(sorted_pairs, 2, n).alias("after"),
            ),
            lambda z: (z["p"]["h"] == z["before"]["h"]) | (z["p"]["h"] == z["after"]["h"]),
        )
        at = F.sort_array(F.transform(twice, lambda z: z["p"]["i"]))
        seen = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, seen, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")))["n"]

    return F.element_at(F.transform(F.array(pairs), covered), 1)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to whole texts.

    Null and blank texts have zeros. Lines count if they hold a word; a duplicate
    line equals an earlier one of its text. Rows are measured each by itself, equal ones
    alike; an empty table gives no rows. Input columns of these names (in any case) are
    replaced, others pass through. Windows hold numbers, not words, so a very long
    text takes a small multiple of its own size.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(packed(docs), text.alias("_text"))
    text = F.col("_text")
    words = rows.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    n = F.size("_words")
    hashed = words.withColumn("_each", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.arrays_zip(*[F.slice("_each", i + 1, F.greatest(n - (WINDOW - 1), F.lit(0))).alias(f"w{i}") for i in range(WINDOW)])
    hashed = hashed.withColumn("_hashes", F.transform(windows, lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(WINDOW)])))
    hashed = hashed.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    measured = hashed.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in MEASURES],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(some, _repeat_words(F.col("_hashes"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    return measured


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the measurements and failed, the mask of failed rules, for every row.

    Rows are judged each by itself: repeated ids and null ids are kept as they are,
    an empty table gives no rows, other columns are not looked at.
    """
    measured = measure(docs.select(F.col(id_col), F.col(text_col)), text_col).drop(text_col)
    mask = F.lit(0)
    for name, test in RULES:
        mask = mask.bitwiseOR(F.when(F.expr(test), BIT[name]).otherwise(0))
    return measured.withColumn("failed", mask.cast("int"))


def apply_policy(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds base_failed (the bits of policy 1) and kept (no bit of the policy and of policy 1)."""
    base = F.col("failed").bitwiseAND(F.lit(POLICIES[1])) != 0
    return ledger.withColumn("base_failed", base).withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version] | POLICIES[1])) == 0)


def ablations(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """A row a rule: documents it fails, those that it alone rejects under the policy, and those that share it.

    The ledger is first counted by mask, at most one row for each of the 2^rules masks.
    """
    policy = POLICIES[version]
    masks = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items()]))
    each = masks.select("failed", "n", rules.alias("r")).select("n", "r.*", F.col("failed").bitwiseAND(F.col("r.bit")).alias("hit"), F.col("failed").bitwiseAND(F.lit(policy)).alias("under"))
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("hit") != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when((F.col("hit") != 0) & (F.col("under") == F.col("bit")), F.col("n")).otherwise(0)).alias("rejects_alone"),
        F.bit_or(F.when(F.col("hit") != 0, F.col("under")).otherwise(0)).alias("seen_with"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(rule_ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rule_ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return apply_policy(ledger).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
grams AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS g FROM win),
rep AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM rep, range(0, 5) x(k) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
f AS (
  SELECT *, ((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    | (CASE WHEN n_symbols > 2 * n_words THEN 4 ELSE 0 END) | (CASE WHEN n_lines >= 10 AND 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END)
    | (CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END))::INT AS failed FROM m)
"""
OP10_SQL = f"{_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f"
ABLATIONS_SQL = f"""{_SQL}, rules(rule, bit) AS (VALUES {", ".join(f"('{name}', {bit})" for name, bit in BIT.items())})
SELECT rule, bit, count(*) FILTER (WHERE failed & bit <> 0)::BIGINT AS fails, count(*) FILTER (WHERE failed & {POLICIES[CURRENT]} = bit)::BIGINT AS rejects_alone,
  coalesce(bit_or(failed & {POLICIES[CURRENT]}) FILTER (WHERE failed & bit <> 0), 0)::INT AS seen_with
FROM f, rules GROUP BY rule, bit"""
