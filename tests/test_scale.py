"""Quantiles, numbers, fills, tokens, repairs and requests by ways that no single task or group bounds."""

import base64
import datetime
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lrforge.functions import tokens
from lrforge.operators import agreement, audit, estimate, numbering, plan, quantiles, runtime, scan
from lrforge.streaming import incremental

LEVELS = {"least": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "most": 1.0}


# --- quantiles


def test_quantiles_are_exact_to_the_bit(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400), [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324], np.repeat(1.5, 300), rng.integers(-3, 3, 200)])
    rows = [(["a", "b", None, "all the same", "nothing"][i % 3], float(x), None if i % 4 == 0 else int(i % 11)) for i, x in enumerate(values)]
    rows += [("all the same", 2.5, 1)] * 50 + [("nothing", math.nan, None), ("nothing", None, None), ("one", -7.25, 3)]
    df = spark.createDataFrame(rows, "g string, x double, k int").repartition(5)
    got = {r["g"]: r.asDict() for r in quantiles.select_quantiles(df, ["g"], ["x", "k"], LEVELS).collect()}
    clean = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = clean.groupBy("g").agg(*[F.percentile(c, F.lit(q)).alias(f"{n}_{c}") for c in "xk" for n, q in LEVELS.items()]).collect()
    same = lambda a, b: a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))  # noqa: E731 - between infinities
    assert len(got) == len(want) == 6
    for r in want:
        for c, x in r.asDict().items():
            assert same(got[r["g"]][c], x), (r["g"], c)
    whole = quantiles.select_quantiles(df, [], ["k"], {"median": 0.5}).collect()
    assert [tuple(r) for r in whole] == [(clean.agg(F.percentile("k", F.lit(0.5))).first()[0],)]
    assert quantiles.select_quantiles(df.where("false"), ["g"], ["x"], LEVELS).collect() == []


def test_summaries_are_the_same_either_way(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["s", "t", None]), rng.random(), rng.choice([math.nan, 1.0, 2.0, 5.0])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, gap double, y double")
    few = sorted(map(repr, audit.quantiles(df, ["g"], ["gap", "y"]).collect()))
    monkeypatch.setattr(quantiles, "FEW", 10)
    assert sorted(map(repr, audit.quantiles(df, ["g"], ["gap", "y"]).collect())) == few
    assert {(r["g"], r["median_y"]) for r in audit.quantiles(df, ["g"], ["gap", "y"], poisoned=True).collect()} == {("s", None), ("t", None), (None, None)}


def test_scratch_goes(spark):
    from lrforge.session import Scratch

    with Scratch(spark, "try") as scratch:
        kept = scratch.kept(scratch.table(spark.range(5)).where("id > 2"))
        root = scratch.root.removeprefix("file:")
        assert os.path.isdir(root)
    assert not os.path.isdir(root) and kept.count() == 2


# --- numbers and fills


def test_numbers_without_one_window(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 10**6) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    numbered = numbering.numbered(df, "n", order=["v"], start=1)
    assert [(r["n"], r["v"]) for r in numbered.orderBy("n").collect()] == list(enumerate(sorted(values), 1))
    assert "SinglePartition" not in numbered._jdf.queryExecution().toString()
    assert numbering.numbered(df.where("false"), "n", order=["v"]).collect() == []
    work = plan.work_list(spark.createDataFrame([(f"in{i:03d}", "out") for i in range(50)], "input_workbook string, output_workbook string").repartition(5), most=3)
    assert [(r["pair_index"], r["input_workbook"]) for r in work.collect()] == [(1, "in000"), (2, "in001"), (3, "in002")]


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_fill_forward(spark, partitions):
    rng = random.Random(partitions)
    rows = [(k, i, rng.choice([None] * 9 + [f"v{i}"]), i % 3) for k in ("hot", None, "b", "c") for i in range(400 if k == "hot" else 30)]
    want, last = [], {}
    for k, i, v, extra in rows:
        last[k] = v if v is not None else last.get(k)
        want.append((k, i, last[k], extra))
    df = spark.createDataFrame(rows, "k string, i int, v string, extra int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in scan.fill_forward(df, ["k"], ["i"], "v").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("range_rows", [7, 50])
def test_ranges_grow_in_number_not_in_size(spark, range_rows):
    rng = random.Random(range_rows)
    rows = [(k, i, rng.choice([None] * 9 + [float(i)])) for k in ("hot", None, "b") for i in range(400 if k == "hot" else 3)]
    want, last = [], {}
    for k, i, v in rows:
        last[k] = v if v is not None else last.get(k)
        want.append((k, i, last[k]))
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(3)
    assert sorted(map(tuple, scan.fill_forward(df, ["k"], ["i"], "v", range_rows).collect()), key=repr) == sorted(want, key=repr)
    ranges, n = numbering.dealt(df, ["k", "i"], range_rows)
    sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
    assert n == -(-len(rows) // range_rows) and max(sizes) <= 3 * range_rows


def test_ends_of_ranges_are_found_without_a_sort(spark, monkeypatch):
    """Tasks that look for ends read many ranges at once; sorted by range they would hold all of them."""
    plans, frame = [], type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: (plans.append(df._jdf.queryExecution().toString()), collect(df))[1])
    scan.fill_forward(spark.range(100).select(F.lit("a").alias("k"), "id", F.lit("x").alias("v")), ["k"], ["id"], "v")
    assert plans and not any("SortAggregate" in p for p in plans)


# --- tokens


def merged_by_hand(piece, ranks):
    """Joins the two neighbours of least rank, the leftmost first, and looks again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def drawn_ranks(rng, letters=b"abc "):
    known = [bytes([b]) for b in range(256)]
    for _ in range(60):
        a, b = rng.choice(known[97:100] + known[32:33] + known[256:]), rng.choice(known[97:100] + known[256:])
        if a + b not in known and len(a + b) < 9:
            known.append(a + b)
    return {t: i for i, t in enumerate(known)}


def test_merging_by_ranks():
    rng = random.Random(11)
    for _ in range(40):
        ranks = drawn_ranks(rng)
        for _ in range(60):
            piece = bytes(rng.choice(b"aaabc ") for _ in range(rng.randint(0, 40)))
            assert tokens.merged(piece, ranks) == (merged_by_hand(piece, ranks) if piece else []), piece
    assert len(tokens.merged(b"ab" * 100_000, {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257})) == 50_000


def test_token_counts(spark, tmp_path):
    ranks = drawn_ranks(random.Random(5))
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in ranks.items()))
    assert tokens.read_ranks(spark, str(tmp_path / "ranks")) == ranks
    cut = {"abc  abc": ["abc", " ", " abc"], "a\n\n b": ["a", "\n\n", " b"], "it's a1b2!? ": ["it", "'s", " a", "1", "b", "2", "!?", " "], "\u00a0x\u0085": ["\u00a0", "x", "\u0085"], "日本 ½²": ["日本", " ½²"], "": []}
    rows = [(i, t) for i, t in enumerate(cut)] + [(90, None), (None, "a"), (91, "abc"), (91, "abc abc")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert {r["text"]: r["p"] for r in df.where("id < 90").select("text", tokens.pieces(F.col("text")).alias("p")).collect()} == cut
    want = {i: sum(len(merged_by_hand(p.encode(), ranks)) for p in ps) for i, ps in enumerate(cut.values())}
    want |= {90: 0, None: 1, 91: 2 * len(merged_by_hand(b"abc", ranks)) + len(merged_by_hand(b" abc", ranks))}
    assert {r["id"]: r["tokens"] for r in tokens.token_counts(df, ["id"], "text", ranks).collect()} == want


# --- repairs and requests


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "outputs")
    rows = [(m, s, i, f"{i}") for m in ("1", "m/2") for s in ("07", "b") for i in range(20)]
    spark.createDataFrame(rows, "model_id string, scenario_id string, row_index int, value string").repartition(2).write.partitionBy("model_id", "scenario_id").parquet(path)
    files = lambda: {str(p.relative_to(path)) for p in (tmp_path / "outputs").rglob("*.parquet")}
    before = files()
    key = ["model_id", "scenario_id", "row_index"]
    patches = spark.createDataFrame([("1", "07", 3, "fixed"), ("1", "07", 3, None), ("1", "07", 999, "nobody"), ("9", "b", 1, "no model")], "model_id string, scenario_id string, row_index int, value string")
    after = runtime.repair_table(spark, path, patches, key)
    want = [(m, s, i, "fixed" if (m, s, i) == ("1", "07", 3) else v) for m, s, i, v in rows]
    assert sorted(tuple(r) for r in after.select(*key, "value").collect()) == sorted(want)
    touched = {f for f in before if f.startswith("model_id=1/scenario_id=07")}
    assert before - touched == {f for f in files() if not f.startswith("model_id=1/scenario_id=07")} and not touched & files()


def test_repair_mode(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert [r["k"] for r in runtime.to_run(work, work, ["k"], "repair_invalid", work.where("k = 'b'")).collect()] == ["b"]
    with pytest.raises(ValueError, match="no invalid rows"):
        runtime.to_run(work, work, ["k"], "repair_invalid", work.where("false"))


class Counting:
    """Writes a line for every question into a file of its own; fails hard, as a lost executor does, after some of them."""

    def __init__(self, folder, dies_after=None):
        self.folder, self.dies_after, self.n = folder, dies_after, 0

    def __call__(self, request, attempt):
        if self.dies_after is not None and self.n == self.dies_after and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        self.n += 1
        with open(f"{self.folder}/asked-{os.getpid()}", "a") as f:
            f.write(json.dumps(request["finding"]) + "\n")
        if request["finding"].startswith("bad"):
            raise ValueError("no such finding")
        return float(len(request["finding"]))


def asked(folder):
    return sorted(json.loads(x) for p in folder.glob("asked-*") for x in p.read_text().splitlines())


def test_requests_are_asked_once(spark, tmp_path):
    folder, ledger = tmp_path / "log", f"file://{tmp_path}/ledger"
    folder.mkdir()
    where = str(folder)
    rows = [(f"f{i}" + "x" * i, i % 2) for i in range(12)] + [("twice", 1), ("twice", 1), ("bad", 0)]
    df = spark.createDataFrame(rows, "finding string, side int")
    ask = lambda more, dies=None: {r["finding"]: (r["value"], r["error"]) for r in estimate.estimate_once(more, lambda: Counting(where, dies), ledger, retries=0, sentinel="ERROR").collect()}
    first = ask(df.where("side = 1"))
    assert first["twice"] == ("5.0", None) and asked(folder) == sorted({f for f, s in rows if s == 1})
    second = ask(df)
    assert asked(folder) == sorted({f for f, _ in rows}) and second["bad"] == ("ERROR", "ValueError: no such finding") and second["f1x"] == ("3.0", None)
    third = ask(df)
    assert third == second and asked(folder) == sorted([*{f for f, _ in rows}, "bad"])  # what failed is asked again
    assert estimate.estimate_once(df, lambda: None, ledger, retries=0).count() == len(rows)


def test_a_run_that_dies_half_way_asks_nothing_twice(spark, tmp_path):
    folder, ledger = tmp_path / "log", f"file://{tmp_path}/ledger"
    folder.mkdir()
    where = str(folder)
    df = spark.createDataFrame([(f"f{i}",) for i in range(20)], "finding string").coalesce(1)
    ask = lambda: estimate.estimate_once(df, lambda: Counting(where, 1), ledger, retries=0)
    try:
        ask()
    except Exception:  # noqa: BLE001 - without task retries the run fails with its worker
        pass
    assert (folder / "died").exists() and 0 < len(asked(folder)) < 20
    assert len(ask().where("value is not null").collect()) == 20
    assert asked(folder) == sorted(f"f{i}" for i in range(20))


# --- streams and densities


def latest_by_hand(rows):
    best = {}
    for *cell, v, t in rows:
        if t is not None and (tuple(cell) not in best or (t, v is not None, v or "") > best[tuple(cell)][0]):
            best[tuple(cell)] = ((t, v is not None, v or ""), v)
    return {k: v for k, (_, v) in best.items()}


def test_latest_status_over_restarts(spark, tmp_path):
    """Three runs of a stream, with late, equal and repeated rows: the state at the end is that of all rows at once."""
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rng, start = random.Random(2), datetime.datetime(2031, 1, 1)
    seen = []
    for run in range(3):
        rows = [("m", f"s{rng.randint(0, 2)}", rng.randint(0, 9), rng.choice(["1.5", "2", "x", "", None, "-1"]), rng.choice([None, *(start + datetime.timedelta(hours=rng.randint(0, 30)) for _ in range(9))])) for _ in range(60)]
        seen += rows
        spark.createDataFrame(rows, incremental.OUTPUTS).repartition(2).write.mode("append").parquet(source)
        incremental.track_once(spark, source, target, check)
        changes = spark.read.parquet(target)
        want = latest_by_hand(seen)
        assert {(r["model_id"], r["scenario_id"], r["row_index"]): r["value"] for r in incremental.current(changes).collect()} == want
        left = {(r["model_id"], r["scenario_id"], r["row_index"]) for r in incremental.open_work(changes).collect()}
        assert left == {k for k, v in want.items() if v not in ("1.5", "2")}
    before = changes.count()
    incremental.track_once(spark, source, target, check)  # nothing new
    assert spark.read.parquet(target).count() == before


@pytest.mark.parametrize("method", ["scott", "silverman", 0.01, 30.0])
def test_densities_are_those_of_all_values(spark, method):
    rng = np.random.default_rng(1)
    groups = {"a": 10 ** rng.normal(0, 0.4, 300), "b": 10 ** rng.uniform(-3, 3, 50), "c": np.array([1.0, 1.0, 1.0, 1.0, 1.5, 1e-9, 1e9]), "few": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in [*xs, -1.0, math.nan]], "g string, lr double")
    got = agreement.kde(df, ["g"], method, points=200).toPandas()
    assert set(got["g"]) == {"a", "b", "c"} and len(got) == 600
    for g, part in got.groupby("g"):
        v, x = np.log10(groups[g]), np.linspace(math.log10(1 / 32), math.log10(32), 200)
        h = v.std(ddof=1) * {"scott": len(v) ** -0.2, "silverman": (len(v) * 0.75) ** -0.2}.get(method, method)
        raw = np.exp(-(((x[:, None] - v[None, :]) / h) ** 2) / 2).sum(axis=1)
        area = ((raw[1:] + raw[:-1]) / 2 * np.diff(x)).sum()
        assert part.sort_values("i")["density"].to_numpy() == pytest.approx(raw / area, abs=1e-9, rel=1e-9)
