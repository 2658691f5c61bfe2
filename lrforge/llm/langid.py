"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed by Spark; the matrix of log probabilities
(languages x BUCKETS) is broadcast in blocks of at most BLOCK_LANGS languages, one
block (16 MB) for all but very many languages; tasks score batches of texts as sparse
rows of bucket numbers in numpy. Further blocks take another pass over the texts, and
the best language is carried along, so results don't depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lrforge.llm.common import KEY_DIGITS, as_table, bounded_batches, held_out, join_small, map_texts, named, random_key, read

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
BLOCK_LANGS = 128  # languages whose part of the matrix is broadcast at once: 16 MB
MAX_TRAIN_DOCS = 20_000  # documents that the model is fitted on, chosen by hash of their id within each language
LEAST_DOCS = 100  # of each language, if it has so many
SMOOTHING = 0.5
SPREAD = 40.0  # the score is taken after this many letters' worth of evidence, so that it doesn't always round to 1
BLOCK_CHARS = 1 << 20  # numpy works on this many characters at a time
PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
OVERLAP = max(ORDERS) - 1


def buckets_of(text: str, n_buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a whole text, block by block.

    Lower-cased; what isn't a letter becomes one space, and blanks stand at both
    ends, so n-grams know the ends of words.
    """
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " " if not text.isascii() else " " + " ".join(text.lower().translate(ASCII_LETTERS).split()) + " "
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for start in range(0, len(codes), BLOCK_CHARS):
        block = codes[max(0, start - OVERLAP) : start + BLOCK_CHARS]
        fresh = min(start, OVERLAP)
        parts = []
        for order in ORDERS:
            n = len(block) - order + 1
            if n <= 0:
                continue
            mixed = np.full(n, order, np.uint64)
            for k in range(order):
                mixed = (mixed ^ block[k : k + n]) * np.uint64(PRIMES[k])
                mixed ^= mixed >> np.uint64(29)
            parts.append((mixed[max(0, fresh - order + 1) :] % np.uint64(n_buckets)).astype(np.int64))
        yield np.concatenate(parts)


ASCII_LETTERS = {i: " " for i in range(128) if not chr(i).isalpha()}


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _counts(n_buckets: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                total = found.setdefault(lang, np.zeros(n_buckets, np.int64))
                for ids in buckets_of(text, n_buckets):
                    total += np.bincount(ids, minlength=n_buckets)
        for lang, total in found.items():
            at = np.nonzero(total)[0]
            if len(at):
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    return count


@dataclass
class Model:
    """What is learned: languages and their priors, and a table of counts, which only comes to the driver by blocks of languages."""

    langs: list[str] = field(default_factory=list)  # in order
    log_prior: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of languages: their share of all usable rows
    counts: DataFrame | None = None  # (lang, bucket, n)

    def log_probs(self, begin: int) -> np.ndarray:
        """(languages x BUCKETS) of the block of BLOCK_LANGS languages that begins here."""
        langs = self.langs[begin : begin + BLOCK_LANGS]
        table = np.full((len(langs), BUCKETS), SMOOTHING)
        if langs:
            at = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")
            rows = self.counts.where(F.col("lang").isin(langs)).select(at.alias("at"), "bucket", "n").toPandas()
            np.add.at(table, (rows["at"].to_numpy(int) - 1, rows["bucket"].to_numpy(int)), rows["n"].to_numpy(int))
        return np.log(table) - np.log(table.sum(axis=1, keepdims=True))


def sample_by_lang(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """All rows (id, lang, ...), or of each language about its part of `most` (LEAST_DOCS at least), whose hash-random keys are lowest; smaller languages whole."""
    total, n_langs = counts.agg(F.sum("_n"), F.count("*")).first()
    if not n_langs or total <= most:
        return rows
    quota = max(LEAST_DOCS, most // n_langs)
    return join_small(rows, counts, ["lang"], "inner").where((F.col("_n") <= quota) | (random_key(F.col("id"), "fit") < F.lit(float(16**KEY_DIGITS)) * quota / F.col("_n")))


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Priors and log probabilities of languages, from rows for which usable holds.

    n-grams are counted on all such rows, or on about max_docs of them, chosen by hash
    of their ids within each language, so that no language is left out; priors are
    shares of all such rows. Rows with a null text or language teach nothing, repeated
    rows count each. Without rows: no language. The names and shares of languages come to
    the driver; counts stay a table.
    """
    rows = docs.where(usable & named(lang_col).isNotNull() & named(text_col).isNotNull()).select(named(id_col).alias("id"), named(lang_col).alias("lang"), named(text_col).alias("text"))
    shares = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    sample = sample_by_lang(rows, shares, max_docs).select("lang", "text")
    share = {r["lang"]: r["_n"] for r in shares.collect()}
    langs = sorted(share)
    if not langs:
        return Model()
    counts = bounded_batches(sample).mapInPandas(_counts(BUCKETS), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    total = np.array([share[x] for x in langs], float)
    return Model(langs, np.log(total) - np.log(total.sum()), as_table(counts, "language-counts"))


def _scorer(docs: DataFrame, langs: list[str], log_prior: np.ndarray, log_probs: np.ndarray):
    """For a batch of texts the best of these languages, its log probability, and the sum of all odds against it."""
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(log_probs.T, np.float32), log_prior))
    n_langs = len(langs)

    def score(texts: list[str | None]) -> list[pa.Array]:
        table, prior = shared.value
        sums, sizes = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        rows: list[int] = []

        def flush() -> None:
            if held:
                lengths = np.array([len(x) for x in held])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                np.add.at(sums, np.array(rows), np.add.reduceat(table[np.concatenate(held)].astype(np.float64), starts, axis=0))
                np.add.at(sizes, np.array(rows), lengths)
                held.clear()
                rows.clear()

        waiting = 0
        for i, text in enumerate(texts):
            if n_langs and has_letter(text):
                for ids in buckets_of(text, BUCKETS):
                    held.append(ids)
                    rows.append(i)
                    waiting += len(ids)
                    if waiting >= BLOCK_CHARS:
                        flush()
                        waiting = 0
        flush()
        known = sizes > 0
        pred, top, odds, scale = np.full(len(texts), None, object), np.full(len(texts), -np.inf), np.zeros(len(texts)), np.ones(len(texts))
        if known.any():
            total = sums[known] + prior
            scale[known] = np.minimum(1.0, SPREAD * len(ORDERS) / sizes[known])
            pred[known], top[known] = np.array(langs, object)[total.argmax(axis=1)], total.max(axis=1)
            odds[known] = np.exp((total - total.max(axis=1, keepdims=True)) * scale[known][:, None]).sum(axis=1)
        return [pa.array(pred, pa.string()), pa.array(top), pa.array(odds), pa.array(scale)]

    return score


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to the columns other than the text.

    und, with score 0, for null texts, texts without a letter, and if no language
    was learned; ties go to the first language in order. Very long texts are scored
    whole, block by block. Input columns named lang_pred or score (in any case) are
    replaced; rows are judged each by itself, repeated ones too; an empty table gives
    no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score") and c != text_col]
    rows = docs.select(F.struct(*[named(c) for c in kept]).alias("row") if kept else F.lit(None).cast("struct<>").alias("row"), named(text_col).alias("text"))
    starts = range(0, max(1, len(model.langs)), BLOCK_LANGS)
    for b in starts:
        part = slice(b, b + BLOCK_LANGS)
        added = [T.StructField(f"pred{b}", T.StringType()), *[T.StructField(f"{n}{b}", T.DoubleType()) for n in ("top", "odds", "scale")]]
        rows = map_texts(rows, "text", _scorer(docs, model.langs[part], model.log_prior[part], model.log_probs(b)), added, drop_text=b == starts[-1])
    best = F.greatest(*[F.col(f"top{b}") for b in starts]) if len(starts) > 1 else F.col("top0")
    pred, odds = F.coalesce(*[F.when(F.col(f"top{b}") == best, F.col(f"pred{b}")) for b in starts]), F.lit(0.0)
    for b in starts:
        odds = odds + F.when(F.col(f"odds{b}") > 0, F.col(f"odds{b}") * F.exp((F.col(f"top{b}") - best) * F.col(f"scale{b}"))).otherwise(0.0)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], F.coalesce(pred, F.lit("und")).alias("lang_pred"), F.when(pred.isNotNull(), 1 / odds).otherwise(0.0).alias("score"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.select("doc_id", "text", "lang"), ~out)
    return predict(docs.select("doc_id", "text", out.alias("held_out")), model)
