"""Language ID and toxicity: held-out quality and edge cases."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lrforge.llm import langid, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@needs_data
def test_language_of_held_out_documents(spark):
    got = langid.op2_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the dog", None), (4, None, "en"), (None, "the hat and dog", "en")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(train, F.lit(True))
    assert model.langs == ["de", "en"]
    ask = spark.createDataFrame([(1, "the dog and cat", 1), (2, None, 2), (3, "123 !? ", 3), (4, "", 4), (5, "und die katze " * 200_000, 5), (5, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), 6), (5, "und die katze", 7), (5, "und die katze", 7)], "doc_id long, text string, nr int")
    got = langid.predict(ask, model).collect()
    assert [(r["lang_pred"], r["nr"]) for r in sorted(got, key=lambda r: r["nr"])] == [("en", 1), ("und", 2), ("und", 3), ("und", 4), ("de", 5), ("und", 6), ("de", 7), ("de", 7)]
    clash = ask.withColumnsRenamed({"nr": "Score"}).withColumn("lang_pred", F.lit("old")).withColumn("row", F.lit(1))
    assert langid.predict(clash, model).columns == ["doc_id", "row", "lang_pred", "score"]
    assert sorted(r["lang_pred"] for r in langid.predict(clash, model).collect()) == sorted(r["lang_pred"] for r in got)
    assert langid.predict(ask.select("text"), model).columns == ["lang_pred", "score"] and langid.predict(ask.select("text"), model).count() == 8
    none = langid.train(train.where("doc_id > 99"), F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(ask, none).collect()} == {("und", 0.0)}
    assert langid.predict(ask.where("doc_id > 99"), model).count() == 0


def bucket_by_hand(gram):
    """Same formula, on Python's integers."""
    x = len(gram)
    for c, prime in zip(gram, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=False):
        x = (x ^ ord(c)) * prime % 2**64
        x ^= x >> 29
    return x % langid.BUCKETS


def grams_by_hand(text):
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return [bucket_by_hand(clean[i : i + n]) for n in (1, 2, 3) for i in range(len(clean) - n + 1)]


def test_naive_bayes_by_hand(spark, monkeypatch):
    """Counts, smoothing, priors and the score against a plain version, with one block of languages and with several."""
    rng = random.Random(11)
    letters = {x: rng.sample("abcdefghijklmnopqrstuvwxyzéüßж", 9) for x in ("l1", "l2", "l3", "l4", "l5")}
    say = lambda x: " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12)))
    rows = [(i, say(x), x) for i, x in enumerate(rng.choices(sorted(letters), [5, 4, 3, 2, 1], k=150))]
    counts, share = {x: Counter() for x in letters}, Counter(x for *_, x in rows)
    for _, text, x in rows:
        counts[x].update(grams_by_hand(text))
    ask, want = [(i, say(rng.choice(sorted(letters)))) for i in range(60)], {}
    for i, text in ask:
        grams = grams_by_hand(text)
        log = {x: math.log(share[x] / 150) + sum(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS)) for g in grams) for x in letters}
        best, scale = max(log, key=log.get), min(1.0, 120 / len(grams))
        want[i] = (best, 1 / sum(math.exp((v - log[best]) * scale) for v in log.values()))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    for block in (128, 2):
        monkeypatch.setattr(langid, "BLOCK_LANGS", block)
        got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(ask, "doc_id long, text string"), model).collect()}
        assert {i: r["lang_pred"] for i, r in got.items()} == {i: x for i, (x, _) in want.items()}
        assert [got[i]["score"] for i in want] == pytest.approx([q for _, q in want.values()], rel=1e-3)


def test_blocks_count_what_the_whole_counts(monkeypatch):
    text = "Über alle Berge, and far away " * 30
    whole = np.sort(np.concatenate(list(langid.buckets_of(text, 997))))
    monkeypatch.setattr(langid, "BLOCK_CHARS", 50)
    assert np.array_equal(whole, np.sort(np.concatenate(list(langid.buckets_of(text, 997)))))


def maximal_segments(scores):
    """By definition: take the best segment (the shortest of equals), then the same on both sides of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    sums = np.concatenate([[0], np.cumsum(scores)])
    best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i = -best[2]
    j = i - best[1]
    return [*maximal_segments(scores[:i]), (i, j - 1, best[0]), *[(a + j, b + j, s) for a, b, s in maximal_segments(scores[j:])]]


def test_segments_are_all_maximal_ones():
    rng = random.Random(3)
    for _ in range(150):
        scores = np.array([rng.choice([-3, -2, -1, -0.5, 1, 2, 4.25]) + rng.random() / 100 for _ in range(rng.randint(0, 25))])
        got = sorted(toxicity.segments(scores))
        want = sorted(maximal_segments(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


@needs_data
def test_toxicity_of_held_out_documents(spark):
    got = toxicity.op3_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    hit = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert hit / max(1, (held["predicted"] == 1).sum()) > 0.9 and hit / (held["toxic"] == 1).sum() > 0.5


def test_toxicity_edge_cases(spark):
    good, bad = "a fine day for all of us here", "you are a vile wretch and"
    rows = [(i, (bad if i % 3 == 0 else good) + f" word{i % 7}") for i in range(120)] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(500, 1), (501, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    ask = spark.createDataFrame([(1, bad, 9), (2, good, 9), (3, None, 9), (4, "", 9), (4, good + " " + bad + " " + good, 9), (None, bad * 3, 9), (6, (good + " ") * 50_000 + bad, 9)], "doc_id long, text string, score0 int")
    got = toxicity.judge(ask, model).collect()
    assert [r["predicted"] for r in got] == [1, 0, 0, 0, 1, 1, 1]
    assert got[4]["passages"][0]["first"] >= 8 and got[2]["score"] == 0
    clash = ask.withColumnRenamed("score0", "predicted").withColumns({"Score": F.lit(1), "passages": F.lit("x"), "row": F.lit(2)})
    kept = toxicity.keep_clean(clash, model)
    assert kept.columns == ["doc_id", "text", "predicted", "Score", "passages", "row"] and kept.count() == 3
    again = toxicity.judge(clash, model)
    assert again.columns == ["doc_id", "row", "score", "predicted", "passages"] and [r["predicted"] for r in again.collect()] == [r["predicted"] for r in got]
    assert toxicity.judge(ask.where("doc_id > 99"), model).count() == 0
    blind = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r["predicted"] for r in toxicity.judge(ask, blind).collect()} == {0}


def test_rare_languages_are_learned_from_a_bounded_sample(spark):
    rows = [(i, f"plain words number {i}", "en") for i in range(800)] + [(1000 + i, f"seltene worte {i}", f"x{i}") for i in range(8)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), max_docs=50)
    assert model.langs == ["en", *(f"x{i}" for i in range(8))]


def test_fit_by_hand(spark):
    """Lexicon, lambda, K and threshold against plain versions of their definitions."""
    rng = random.Random(8)
    mild, foul = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)], ["vile", "vilely", "scum", "scummy"]
    rows = []
    for i in range(240):
        words = rng.choices(mild, k=rng.randint(3, 40))
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(foul, k=rng.randint(1, 4))
        elif i % 17 == 0:
            words.append("scum")
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))

    counts = {0: Counter(), 1: Counter()}
    for _, text, label in rows:
        counts[label].update({f for w in text.split() for f in (w, *(w[:n] + "-" for n in (3, 4, 5, 6, 7) if len(w) > n))})
    names = sorted(counts[0] | counts[1])
    t, c = (np.array([counts[label][x] for x in names], float) for label in (1, 0))
    prior = toxicity.PRIOR + toxicity.BACKGROUND * (t + c) / (t + c).sum()
    t, c = t + prior, c + prior
    d, sd = np.log(t / (t.sum() - t)) - np.log(c / (c.sum() - c)), np.sqrt(1 / t + 1 / c)
    want = {x: (abs(a / s), np.sign(a) * max(abs(a) - toxicity.SHRINK * s, 0)) for x, a, s in zip(names, d, sd, strict=True) if abs(a / s) >= toxicity.SURE}
    want = {x: v for x, v in want.items() if v[1]}
    assert set(model.lexicon) == set(want) and "vile" in want
    assert all(model.lexicon[x] == pytest.approx(v) for x, v in want.items())

    def token_score(word):
        known = [want[f] for f in (word, *(word[:n] + "-" for n in (3, 4, 5, 6, 7) if len(word) > n)) if f in want]
        return (max(known)[1] if known else 0.0) - toxicity.DRIFT

    def scores(text):
        words = text.split()
        each = [token_score(w) for w in words]
        return np.array([-toxicity.DRIFT if i and x > 0 and words[i] == words[i - 1] else x for i, x in enumerate(each)])

    clean = [scores(text) for _, text, label in rows if not label]
    spectrum = Counter(np.round(np.concatenate(clean), 1).tolist())
    spectrum[max(1.0, *(s - toxicity.DRIFT for _, s in want.values()))] += 0.5
    assert sum(n * math.exp(model.decay * x) for x, n in spectrum.items()) / sum(spectrum.values()) == pytest.approx(1, abs=1e-6) and model.decay > 1e-3
    best = [max((s for *_, s in maximal_segments(x)), default=0.0) for x in clean]
    assert model.k == pytest.approx(len(clean) / sum(len(x) * math.exp(-model.decay * b) for x, b in zip(clean, best, strict=True)))

    def evidence(text):
        x = scores(text)
        logs = [math.log(model.k * len(x)) - model.decay * s for *_, s in maximal_segments(x)]
        return -sum(e for e in logs if e < math.log(toxicity.SIGNIFICANT))

    weights = [(evidence(text), label) for _, text, label in rows]
    levels = sorted({e for e, _ in weights if e > 0})
    f1 = {x: 2 * (hit := sum(y for e, y in weights if e >= x)) / (sum(e >= x for e, _ in weights) + sum(y for _, y in weights)) for x in levels}
    cut = min(x for x in levels if f1[x] >= max(f1.values()) - toxicity.TOLERANCE)
    below = max([0.0, *(x for x in levels if x < cut)])
    assert model.threshold == pytest.approx((cut + below) / 2)
    got = {r["doc_id"]: r["score"] for r in toxicity.judge(docs, model).collect()}
    assert all(got[i] == pytest.approx(e / (e + model.threshold)) for (i, *_), (e, _) in zip(rows, weights, strict=True))


def test_evidence_of_a_long_document_counts_all_its_segments(spark):
    """Of 200 separate passages, each adds to the evidence of a training document."""
    model = toxicity.Model({"vile": (9.0, 6.0)}, 1.0, 1e-4, 1.0)
    text = " ".join(["vile", *["fine"] * 60] * 200)
    docs = spark.createDataFrame([(text, 1), ("vile", 0)], "text string, toxic int")
    found = dict(zip(*reversed(toxicity._evidence(docs, model)), strict=True))
    scores = toxicity.Scores(model.lexicon)
    assert found[1] == toxicity.weigh(text, model, scores)[0] and len(toxicity.weigh(text, model, scores)[2]) == 200
