"""Line dedup and near-dedup against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lrforge.llm import linededup, neardup
from lrforge.llm.shingles import shingle_set, word_hashes

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def dedup_by_hand(rows):
    seen, out = set(), []
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(map(WORD.search, w)):
                gone |= {p, p + 1, p + 2} if w in seen else set()
                seen.add(w)
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d e"]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(100 + i, f"own {i}\npassage one\npassage two\npassage three\nend {i}") for i in range(20)] + [(200, "\n\n\n\n"), (201, "\n\n\n\n"), (202, "x")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == sorted(dedup_by_hand(rows))


def test_line_dedup_edge_cases(spark):
    three = "l1\nl2\nl3"
    rows = [(None, three, 1), (1, three, 2), (1, three, 2), (2, None, 3), (3, "", 4), (4, "y\n" * 50_000, 5)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, DOCS + ", _lines int"))
    assert got.columns == ["doc_id", "text", "_lines", "n_lines", "n_removed"]
    by = {r["_lines"]: r for r in got.collect()}
    assert by[1]["text"] == three and by[2]["text"] == "" and by[2]["n_removed"] == 3
    assert by[3]["text"] is None and by[3]["n_lines"] == 0 and by[4]["text"] == ""
    # 50,001 lines, the last one empty: the first window stays, and the last, "y y" and the empty line, stands here alone.
    assert (by[5]["n_lines"], by[5]["n_removed"], by[5]["text"]) == (50_001, 49_999, "y\n")
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_is_linear(spark):
    """Two documents of a million lines: a passage of three lines of the first comes again in the second."""
    lines = [f"line {i}" for i in range(1_000_000)]
    other = [f"row {i}" for i in range(1_000_000)]
    other[500_000:500_003] = lines[7:10]
    rows = [(1, "\n".join(lines)), (2, "\n".join(other))]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["n_removed"] == 3 and got[2]["text"] == "\n".join(other[:500_000] + other[500_003:])


def test_line_dedup_with_clashing_names(spark):
    three = "l1\nl2\nl3"
    df = spark.createDataFrame([(1, three, 7, 8, "a", 9), (2, three + "\nx", 7, 8, "b", 9), (3, three, 7, 8, "c", 9)], DOCS + ", n_lines long, N_Removed long, starts string, row int")
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "starts", "row", "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["starts"], r["n_lines"], r["n_removed"]) for r in got.collect()) == [(1, three, "a", 3, 0), (2, "x", "b", 4, 3), (3, "", "c", 3, 3)]
    kept = linededup.keep_lines(df.withColumnRenamed("row", "n_chars"))
    assert kept.columns == df.columns[:-1] + ["n_chars"]
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_chars"]) for r in kept.collect()) == [(1, three, 7, 9), (2, "x", 7, 1)]
    assert linededup.keep_lines(df.where("doc_id > 9")).count() == 0


def shingles_by_hand(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components_by_hand(rows):
    sets = {i: shingles_by_hand(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
                    changed = True
    return sets, comp


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, ("\n" if group % 2 else " ").join(w.upper() if rng.random() < 0.1 else w for w in words)))
            n += 1
    return [*rows, (n, ""), (n + 1, None), (n + 2, "  \t"), (n + 3, "one two"), (n + 4, "ONE\ntwo"), (n + 5, "two one")]


def test_near_duplicates(spark):
    rows = corpus()
    sets, comp = components_by_hand(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"v{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(200)] = f"new{i}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join(base)) for i in range(300)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["component_id"] for r in got} == {1000} and sum(r["kept"] for r in got) == 1


def test_near_duplicate_edge_cases(spark):
    text = "a b c d e f g"
    rows = [(1, text, 5), (1, text, 5), (2, text, 5), (None, text, 5), (7, None, 5)]
    df = spark.createDataFrame(rows, DOCS + ", n int")
    got = neardup.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("7", 7, True), ("None", None, True)]
    clash = df.withColumns({"_gone": F.lit(1), "row": F.lit("x"), "component_id": F.lit(2)})
    for each in (df, clash):
        kept = neardup.keep_one_each(each)
        assert kept.columns == each.columns and kept.count() == 4
    with pytest.raises(TypeError, match="whole numbers"):
        neardup.near_duplicates(df.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_shingles_of_whole_long_texts(monkeypatch):
    from lrforge.llm import shingles

    text = " ".join(f"Word{i % 5000}" for i in range(60_000))
    whole = shingle_set(text)
    assert len(whole) == 5000
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 1000)
    assert (shingle_set(text) == whole).all()
    assert len(set(word_hashes("a A b é É").tolist())) == 4


@pytest.mark.parametrize(("x", "levels"), [((0, 0), 12), ((1, 0), 3), ((1 << 15, 0), 2), ((1 << 45, 9), 0), ((0, 1), 11), ((0, 1 << 49), 4)])
def test_prefix_levels(x, levels):
    import numpy as np

    assert neardup.prefix_levels(np.array([x[0]]), np.array([x[1]]))[0] == levels


def test_links_in_a_dense_region_of_dissimilar_documents(spark):
    """A passage of 144 words in 1,600 documents of 180; 400 pairs share 11 words more, which makes 151 of 201 shingles: a little over 75 %."""
    rng = random.Random(12)
    words = lambda k: " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))
    passage, rows = words(144), []
    for i in range(0, 800, 2):
        both = words(11)
        rows += [(i, f"{passage} {both} {words(25)}"), (i + 1, f"{passage} {both} {words(25)}")]
    rows += [(i, f"{passage} {words(36)}") for i in range(800, 1600)]
    a, b, c = (shingles_by_hand(rows[i][1]) for i in (0, 1, 2))
    assert 0.75 <= len(a & b) / len(a | b) < 0.76 and len(a & c) / len(a | c) < 0.7
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    want = {i: i - i % 2 if i < 800 else i for i, _ in rows}
    assert len(got) == len(want) and [r for r in got if r["component_id"] != want[r["doc_id"]]] == []


def test_pairs_left_open_are_tried_in_the_last_round(spark, monkeypatch):
    """One spanning round and empty windows: the links are among the pairs that the round left open."""
    candidates = neardup.candidates
    monkeypatch.setattr(neardup, "SPANNING_ROUNDS", 1)
    monkeypatch.setattr(neardup, "candidates", lambda sets, window, *trees: tuple(x.limit(0) if window > 1 else x for x in candidates(sets, window, *trees)))
    rng = random.Random(3)
    places = rng.sample(range(60), 60)
    rows = [(i, " ".join(f"w{w}" for w in range(12 * p, 12 * p + 200))) for i, p in enumerate(places)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_ends_of_many_small_partitions_meet(spark, monkeypatch):
    """Rows at partitions' ends are matched in partitions again if they are many, with the same pairs found."""
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS)
    want = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    monkeypatch.setattr(neardup, "MOST_ENDS", 100)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == want


def test_components_by_tasks(spark):
    from lrforge.llm.graph import components_by_tasks, connected_components

    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (7777, 7777)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {r["node"]: r["component"] for r in connected_components(df).collect()}
    for per_task in (1000, 50):
        got = {r["node"]: r["component"] for r in components_by_tasks(df, per_task=per_task).collect()}
        assert {n: c for n, c in got.items()} == want
    assert components_by_tasks(df.where("a < 0")).count() == 0


def test_a_shared_passage_is_no_meeting_place(spark):
    """2,000 dissimilar documents with one passage among their own words, and a pair that is linked: only this one meets."""
    rng = random.Random(9)
    passage = " ".join(f"common{i}" for i in range(80))
    own = lambda k: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(k))
    rows = [(i, i, f"{own(60)} {passage} {own(60)}") for i in range(2000)]
    rows.append((5000, 5000, rows[7][2] + " and more"))
    region = spark.createDataFrame(rows, "id long, comp long, text string").repartition(4)
    assert neardup.prefixes(region).groupBy("s").count().agg(F.max("count")).first()[0] <= 40  # chance meetings in a slot of a common shingle
    assert [tuple(r) for r in neardup.exact_candidates(region).collect()] == [(7, 5000)]
    assert neardup.exact_candidates(region.where("false")).collect() == []
