"""Toxic passages as maximum-scoring segments over token log-odds.

Fit, on a bounded sample of labelled rows: document counts of words and of word
beginnings by label, summed by Spark; log-odds under Dirichlet priors, shrunk by
their standard deviation, become a lexicon, which the bound on the sample bounds. Scoring: a word takes
the surest of its entries, less a drift that makes clean text score below zero; a
linear scan finds all maximal segments; extreme-value statistics (lambda from the
scores of clean tokens, K from the best segments of clean documents) turn a
segment's score and the text's length into an expected number of chance segments.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lrforge.llm.common import bounded_batches, bounded_sample, held_out, map_texts, named, packed, read

TOKEN = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5, 6, 7)  # lengths of word beginnings that are features beside the word itself
MAX_TRAIN_DOCS = 12_000  # labelled documents that the model is fitted on, chosen by hash of their id
PRIOR = 0.5  # symmetric part of the Dirichlet prior
BACKGROUND = 10.0  # weight of the part in proportion to a feature's share of both classes
SURE, SHRINK = 3.0, 2.0  # least |z| of an entry; standard deviations taken off its log-odds
DRIFT = 0.5
SIGNIFICANT = 0.01  # expected chance segments in the text, at most
TOLERANCE = 0.002
BLOCK_CHARS = 1 << 20
CACHE = 200_000

SEGMENTS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


def features(word: str) -> list[str]:
    """The word, and its beginnings, which a dash marks."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def tokens(text: str) -> Iterator[list[str]]:
    """All words of a text, lower-cased, a block at a time; blocks end between words."""
    at = 0
    while at < len(text):
        end = at + BLOCK_CHARS
        if end < len(text):
            gap = re.compile(r"\W").search(text, end)
            end = gap.start() if gap else len(text)
        yield TOKEN.findall(text[at:end].lower())
        at = end


@dataclass
class Model:
    lexicon: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature: (|z|, score)
    decay: float = 1.0  # lambda
    k: float = 1.0
    threshold: float = 1.0


class Scores(dict):
    """Score of a word, worked out once."""

    def __init__(self, lexicon: dict[str, tuple[float, float]]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        known = [e for f in features(word) if (e := self.lexicon.get(f))]
        score = self[word] = (max(known)[1] if known else 0.0) - DRIFT
        return score


def token_scores(text: str, scores: Scores) -> np.ndarray:
    if len(scores) > CACHE:
        scores.clear()
    parts = [np.zeros(0)]
    for words in tokens(text):
        each = np.fromiter(map(scores.__getitem__, words), float, len(words))
        for i in np.nonzero(each > 0)[0].tolist():
            if i and words[i] == words[i - 1]:  # a stutter is no further evidence
                each[i] = -DRIFT
        parts.append(each)
    return np.concatenate(parts)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, in linear time.

    Works on runs of positive tokens alone. A candidate holds the sums before its
    first and after its last token; a new one joins back to the nearest candidate
    that starts lower, as long as that raises its score.
    """
    at = np.nonzero(scores > 0)[0]
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest candidate that starts lower
    for i in at.tolist():
        first, low, high = i, sums[i], sums[i + 1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append((first, i, low, high, j))
                break
            first, low = held[j][0], held[j][2]
            del held[j:]
    return [(first, last, float(high - low)) for first, last, low, high, _ in held]


def weigh(text: str | None, model: Model, scores: Scores) -> tuple[float, int, list[dict]]:
    """Evidence of a text (the sum of -ln E over significant segments), its tokens and these segments."""
    if not text:
        return 0.0, 0, []
    each = token_scores(text, scores)
    found = []
    for first, last, score in segments(each):
        log_expected = math.log(model.k * len(each)) - model.decay * score
        if log_expected < math.log(SIGNIFICANT):
            found.append({"first": first, "last": last, "score": score, "expected": math.exp(max(log_expected, -700.0))})
    return -sum(math.log(s["expected"]) for s in found), len(each), found


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = set().union(*tokens(text))
            found[int(toxic)].update(set().union(*map(features, words)) if words else ())
    names = list(found[0] | found[1])
    if names:
        yield pd.DataFrame({"feature": names, "toxic": [found[1][x] for x in names], "clean": [found[0][x] for x in names]})


def _decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p e^(lambda s) = 1, by bisection; values have both signs."""
    p = counts / counts.sum()
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 500))).sum() < 1 else (low, mid)
    return low


def train(docs: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fits on labelled rows for which usable holds; only their texts are looked at.

    labels: (id_col, label_col), null labels and ids are left out, repeated ones count
    each, and so do repeated documents; null texts teach nothing. On more than max_docs
    labels, about so many of them are taken, chosen by hash of their ids; that bounds
    the lexicon and all else that is broadcast or comes to the driver. Without rows of
    both classes, or of an empty table, the model finds nothing.
    """
    marked = bounded_sample(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable), id_col, max_docs).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
    ids = F.broadcast(marked)  # max_docs rows or so
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null").join(ids, "_id").select("text", "toxic")
    sample = bounded_batches(sample.repartition(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))))
    sample = sample.persist()
    try:
        counts = sample.mapInPandas(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        # The sums over all features, and the features that could be sure, come to the driver.
        rare = counts.groupBy("toxic", "clean").agg(F.count("*").alias("n")).toPandas()
        if not len(rare) or not rare["toxic"].sum() or not rare["clean"].sum():
            return Model()
        mass = float(((rare["toxic"] + rare["clean"]) * rare["n"]).sum())
        prior = PRIOR + BACKGROUND * (F.col("toxic") + F.col("clean")) / mass
        total_prior = PRIOR * float(rare["n"].sum()) + BACKGROUND
        nt, nc = float((rare["toxic"] * rare["n"]).sum()) + total_prior, float((rare["clean"] * rare["n"]).sum()) + total_prior
        odds = counts.select("feature", (F.col("toxic") + prior).alias("t"), (F.col("clean") + prior).alias("c"))
        odds = odds.select("feature", (F.ln(F.col("t") / (nt - F.col("t"))) - F.ln(F.col("c") / (nc - F.col("c")))).alias("d"), F.sqrt(1 / F.col("t") + 1 / F.col("c")).alias("sd"))
        sure = odds.withColumn("z", F.abs(F.col("d") / F.col("sd"))).where(F.col("z") >= SURE).toPandas()
        shrunk = np.sign(sure["d"]) * np.maximum(sure["d"].abs() - SHRINK * sure["sd"], 0)
        model = Model({f: (float(z), float(s)) for f, z, s in zip(sure["feature"], sure["z"], shrunk, strict=True) if s})

        _calibrate(sample, model)
        model.threshold = _best_threshold(*_evidence(sample, model))
    finally:
        sample.unpersist()
    return model


def _calibrate(sample: DataFrame, model: Model) -> None:
    """lambda from the scores of clean tokens, in steps of a tenth, and K from the best segments of clean documents; both sums are small."""
    shared = sample.sparkSession.sparkContext.broadcast(model.lexicon)

    def spectrum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, found = Scores(shared.value), Counter()
        for batch in batches:
            for text in batch["text"]:
                values, n = np.unique(np.round(token_scores(text, scores), 1), return_counts=True)
                found.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
        yield pd.DataFrame({"value": list(found), "n": list(found.values())}, dtype=float)

    clean = sample.where("toxic = 0").select("text")
    seen = clean.mapInPandas(spectrum, "value double, n double").groupBy("value").agg(F.sum("n").alias("n")).toPandas()
    counts: Counter = Counter(dict(zip(seen["value"], seen["n"], strict=True)))
    counts[max([1.0, *(s - DRIFT for _, s in model.lexicon.values())])] += 0.5  # half a clean token with the highest score
    values, n = np.array(list(counts)), np.array(list(counts.values()), float)
    decay = model.decay = _decay(values, n) if (values * n).sum() < 0 else 1e-6

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(shared.value)
        for batch in batches:
            each = [token_scores(text, scores) for text in batch["text"]]
            best = np.array([max((s for *_, s in segments(x)), default=0.0) for x in each])
            sizes = np.array([len(x) for x in each], float)
            yield pd.DataFrame({"docs": [float((sizes > 0).sum())], "mass": [float((sizes * np.exp(-decay * best)).sum())]})

    docs, mass = clean.mapInPandas(tops, "docs double, mass double").agg(F.sum("docs"), F.sum("mass")).first()
    model.k = (docs or 0.0) / max(1e-12, mass or 0.0)


def _evidence(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and label of each sampled document, over all of its segments; two numbers a document of the bounded sample."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(shared.value.lexicon)
        for batch in batches:
            yield pd.DataFrame({"evidence": [weigh(text, shared.value, scores)[0] for text in batch["text"]], "toxic": batch["toxic"].to_numpy()})

    found = sample.mapInPandas(weighed, "evidence double, toxic int").toPandas()
    return found["evidence"].to_numpy(float), found["toxic"].to_numpy(int)


def _best_threshold(evidence: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the gap below the lowest evidence at which F1 is within TOLERANCE of its highest.

    Evidence of documents that the lexicon was fitted on runs high, so of cuts that
    are nearly as good the lowest carries over best.
    """
    levels = np.unique(evidence[evidence > 0])
    if not len(levels):
        return 1.0
    f1 = [2 * (hit := int((toxic[evidence >= x] == 1).sum())) / max(1, hit + int((evidence >= x).sum()) + int(toxic.sum()) - hit) for x in levels]
    best = int(np.argmax(np.array(f1) >= max(f1) - TOLERANCE))
    below = levels[best - 1] if best else 0.0
    return float((levels[best] + below) / 2)


def judge(docs: DataFrame, model: Model, text_col: str = "text", drop_text: bool = True) -> DataFrame:
    """Adds score (0 to 1), predicted (1 from 0.5 on) and passages: the toxic segments as token positions.

    Null and empty texts, and those without a significant segment, score 0. Whole
    texts are scanned. Rows are judged each by itself, equal ones alike; ids may be
    null or repeated. Input columns named score, predicted or passages (in any case)
    are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[str, Scores] = {}

    def score(texts: list[str | None]) -> list[pa.Array]:
        model = shared.value
        scores = held.setdefault("scores", Scores(model.lexicon))
        found = [weigh(text, model, scores) for text in texts]
        evidence = np.array([e for e, _, _ in found], float)
        value = evidence / (evidence + model.threshold)
        passages = pa.array([s for _, _, s in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])))
        return [pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32), pa.int32()), passages]

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", SEGMENTS)]
    return map_texts(docs, text_col, score, added, drop_text)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, columns unchanged, whatever their names; null and empty texts stay, and repeated rows all."""
    rows = docs.select(packed(docs), named(text_col).alias("_text"))
    return judge(rows, model, "_text").where("predicted = 0").select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), ~out)
    return judge(docs.withColumn("held_out", out), model).select("doc_id", "held_out", "score", "predicted")
