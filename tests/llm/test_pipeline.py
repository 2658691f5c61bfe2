"""The pipeline's stages, each against a plain version of it on its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lrforge.llm import toxicity
from lrforge.llm.common import as_table
from tests.llm.test_dedup import components_by_hand, dedup_by_hand

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    at = {"input": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = as_table(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == at["input"].columns
        at[name] = docs
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    before, after = rows(at["input"]), rows(at["toxicity"])
    model = toxicity.train(at["input"], spark.read.parquet(f"{DATA}/labels.parquet"), F.lit(True))
    scores = toxicity.Scores(model.lexicon)
    assert after == {i: t for i, t in before.items() if toxicity.weigh(t, model, scores)[0] < model.threshold}

    want = {i: t for i, t, _, gone in dedup_by_hand(after.items()) if not gone or t.strip()}
    lined = rows(at["line_dedup"])
    assert lined == want

    _, comp = components_by_hand(list(lined.items()))
    near = rows(at["near_dedup"])
    assert near == {i: t for i, t in lined.items() if comp[i] == i}

    mixed = at["mixing"].groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("text")).collect()
    assert all(near[r["doc_id"]] == r["text"] and r["n"] <= 3 for r in mixed)

    last = corpus_pipeline.STAGES[-1][1](spark, at["mixing"], DATA).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in mixed}
    assert all(r["text"] == near[r["doc_id"]].replace("▁", " ") for r in last)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, an empty table and clashing names, through every stage."""
    text = "one two three four five six\nseven eight\nnine ten"
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, n_removed int, score double, _gone int, size int"
    row = lambda i, t, s: (i, t, None, s, None if t is None else len(t), "r", 1, 2.0, 3, 4)
    rows = [row(1, text, "a"), row(1, text, "a"), row(2, text, "b"), row(3, None, None), row(4, "", "a"), row(None, "own words here", "b"), row(5, "long " * 20_000, "a"), row(6, text + "\nmore", None)]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = as_table(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            assert after.columns == docs.columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
            kept = [r.asDict() for r in after.collect()]
            assert all((r["row"], r["n_removed"], r["score"], r["_gone"], r["size"]) == ("r", 1, 2.0, 3, 4) for r in kept)
            ids = sorted(str(r["doc_id"]) for r in kept)
            if not given:
                assert not kept
            elif name == "toxicity":
                assert ids == sorted(str(r[0]) for r in rows)
            elif name == "line_dedup":  # copies lose all three lines, and go; a longer one keeps its own
                assert ids == ["1", "1", "3", "4", "5", "6", "None"] and next(r["text"] for r in kept if r["doc_id"] == 6) == "more"
                assert next(r["n_chars"] for r in kept if r["doc_id"] == 6) == 4
            elif name == "near_dedup":
                assert ids == ["1", "1", "3", "4", "5", "6", "None"]
            docs = after
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.collect() if r["text"] is not None}
