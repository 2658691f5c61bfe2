"""WARC round trips, exact top-k and SentencePiece sampling."""

import base64
import gzip
import hashlib
import math
import os
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lrforge.llm import pieces, topk, warc
from lrforge.llm.common import shared_path

PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = 2**53
    rows = [(1, "http://a/", "same"), (2, "http://b/ü x%20", "same"), (3, None, None), (4, "http://d/", ""), (5, "http://e/\r\nX: 1", "é" * 70_000), (6, "u", "other\r\n\r\nx"), (6, "u", "other\r\n\r\nx"), (None, "n", "same")]
    rows += [(big + 1, "http://big/", "twin"), (big + 3, "http://big/ ", "twin")]
    folder = shared_path(spark, "warc-test")
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", refers_to string, id int")
    for parts in (1, 3):
        files = warc.write_warc(df.repartition(parts), folder)
        got = warc.read_warc(files, folder).collect()
        assert len(got) == len(rows) and files.agg(F.sum("records")).first()[0] == len(rows)
        by = {r["page_id"]: r for r in got}
        assert (by[2]["record_type"], by[2]["payload"]) == ("response", b"same") and (by[1]["record_type"], by[1]["refers_to"], by[1]["payload"]) == ("revisit", 2, None)
        assert by[None]["refers_to"] == 2 and by[3]["refers_to"] == 4 and by[6]["refers_to"] is None
        assert by[big + 1]["refers_to"] == big + 3 and by[big + 3]["record_type"] == "response"
        for page_id, url, html in rows:
            data = (html or "").encode()
            assert by[page_id]["url"] == url and by[page_id]["payload_bytes"] == len(data) and by[page_id]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGES), folder), folder).count() == 0
    few = warc.read_warc(warc.write_warc(df, folder, least_bytes=5), folder).collect()
    assert {r["page_id"] for r in few if r["record_type"] == "revisit"} == set()


def test_warc_reader_is_strict(monkeypatch):
    good = warc.record(1, "http://a/", b"payload", warc._digest(b"payload"), None)
    again = warc.record(2, None, b"x", warc._digest(b"x"), 1)
    long = bytes(range(256)) * 4000
    stream = good + again + warc.record(3, "u", long, warc._digest(long), None)
    for step in (1, 7, 1 << 20):
        got = list(warc.records(stream[i : i + step] for i in range(0, len(stream), step)))
        assert [(r["page_id"], r["record_type"], r["payload_bytes"], r["payload"]) for r in got] == [(1, "response", 7, b"payload"), (2, "revisit", 1, None), (3, "response", len(long), long)]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records([stream[:-5]]))
    plain = gzip.decompress(good)
    with pytest.raises(ValueError, match="digest"):
        list(warc.records([gzip.compress(plain.replace(b"payload\r\n\r\n", b"qayload\r\n\r\n"))]))
    with pytest.raises(ValueError, match="framing"):
        list(warc.records([gzip.compress(plain[:-3])]))
    with pytest.raises(ValueError, match="framing"):
        list(warc.records([gzip.compress(plain + b"more")]))
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    assert max(len(x) for x, _ in warc.pieces_of([stream])) <= 100 and len(list(warc.records([stream], payload=False))) == 3


VECTORS = "vec_id long, embedding array<double>"


def top_by_hand(rows, k):
    valid = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in valid:
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0) for j, w in valid if j != i)
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(6)]) for i in range(0, 900, 3)]
    big = 2**53
    rows += [(None, rows[0][1]), (None, [1.0] * 6), (big + 1, rows[4][1]), (big + 3, rows[4][1]), (20 * (big // 20 + 1), rows[5][1])]
    rows += [(1, None), (2, [1.0, None]), (4, [float("nan")] * 6), (5, [1.0, 2.0]), (7, [float("inf")] * 6), (20, []), (3, rows[1][1])]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    for k, least in ((20, 64), (20, 7), (500, 7)):
        monkeypatch.setattr(topk, "LEAST_CHUNK", least)
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=k).collect()
        assert sorted(tuple(r) for r in got) == top_by_hand(rows, k)
    assert topk.top_k(df.withColumn("id", F.lit(1)).withColumn("rank", F.lit("x")), F.col("vec_id") % 20 == 0).count() == topk.top_k(df, F.col("vec_id") % 20 == 0).count()
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id % 20 <> 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_scored_rows_do_not_grow_with_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 4)))], VECTORS)
    seen, whole = [], topk._search

    def counted(k):
        work = whole(k)
        n = spark.sparkContext.accumulator(0)
        seen.append(n)

        def go(batches):
            for batch in work(batches):
                n.add(batch.num_rows)
                yield batch

        return go

    monkeypatch.setattr(topk, "_search", counted)
    for rows in (2000, 100):
        monkeypatch.setattr(topk, "SHARD_ROWS", rows)
        topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert seen[0].value == 100 * 20 and seen[1].value <= 100 * 20 * topk.GROUPS


def test_large_values_stay_exact():
    q, d = np.array([[2**31, 5]]), np.array([[2**30, 3], [2**40, 2**40]])
    assert topk._dots(q, d).tolist() == [[2**61 + 15, min(2**71 + 5 * 2**40, 2**63 - 1)]]


MODEL = pieces.DEFAULT_MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the public vocabulary")
TEXTS = ["", " ", "Hello world", "two  spaces\n\nand\tlines ", "naïve ﬁ 亜\U0001f600 ​", "x" * 3000, "der die das " * 2000, "a\r\nb"]


@needs_model
def test_pieces_round_trip(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(50, None, "k"), (None, "null key", "k"), (2, TEXTS[2], "k"), (51, "mark ▁ x", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sample string")
    encoded = pieces.encode(df, k=3).cache()
    texts = {r["doc_id"]: set() for r in encoded.collect()}
    for r in pieces.decode(encoded).collect():
        texts[r["doc_id"]].add(r["text"])
    assert texts == {i: {t} for i, t in enumerate(TEXTS)} | {None: {"null key"}, 51: {"mark   x"}}
    for r in encoded.collect():
        if r["doc_id"] not in (51, None):
            assert model.decode(r["ids"]) == TEXTS[r["doc_id"]]
    by = encoded.toPandas().groupby("doc_id")
    assert len(by.get_group(0)) == 1 and len(by.get_group(6)) == 3
    assert len({tuple(x) for x in by.get_group(6)["ids"]}) == 3
    assert sorted(tuple(x) for x in pieces.encode(df.repartition(5), k=3).where("doc_id = 6").toPandas()["ids"]) == sorted(tuple(x) for x in by.get_group(6)["ids"])
    assert pieces.encode(df.where("doc_id > 99")).count() == 0
    assert pieces.decode(encoded.select("doc_id", F.lit(None).cast("array<int>").alias("ids"), F.lit("old").alias("text"))).first()["text"] is None
    odd = spark.createDataFrame([([-1, 99_999_999, None],), ([],), ([int(pieces.vocabulary(MODEL).byte_ids[0xE9])],)], "ids array<int>")
    assert [r["text"] for r in pieces.decode(odd).collect()] == ["", "", "\ufffd"]
    both = pieces.encode(df, k=3, decoded="back").where("doc_id <> 51 and doc_id is not null").collect()
    assert len(both) == encoded.where("doc_id <> 51 and doc_id is not null").count() and all(r["back"] == TEXTS[r["doc_id"]] for r in both)


def samples(texts, keys, v, k):
    """[(pieces, log probability, log inclusion probability)] of each text."""
    out = [[] for _ in texts]
    for rows, counts, ids, log_p, included in pieces.encode_batch(texts, [pieces.row_seed(j, "t") for j in keys], v, k):
        ends = np.cumsum(counts)
        for i, a, b, p, q in zip(rows.tolist(), ends - counts, ends, log_p, included, strict=True):
            out[i].append((tuple(ids[a:b].tolist()), p, q))
    return out


@needs_model
def test_all_segmentations_come_if_asked_for(monkeypatch):
    """More samples than there are: each comes once, the least likely ones too, and their probabilities add up to 1."""
    v = pieces.vocabulary(MODEL)
    texts = ["on xe", "", "a", "q\u4e9cz", "zzz on"]
    got = samples(texts, range(5), v, 400)
    for text, found in zip(texts, got, strict=True):
        lat = pieces.build(pieces.units(text), v) if text else None
        ways = int(np.prod([lat.ways[i] for i in lat.start])) if text else 1
        assert len(found) == len({x[0] for x in found}) == min(ways, 400)
        assert sum(np.exp(x[1]) for x in found) == pytest.approx(1, abs=1e-6)
    assert all(x[2] == pytest.approx(0) for x in got[0])
    # Neither the other texts of a batch nor the size of lattices matter.
    several = samples(["other words", *texts], [9, *range(5)], v, 7)[1:]
    monkeypatch.setattr(pieces, "LATTICE_CHARS", 3)
    assert samples(texts, range(5), v, 7) == several


def test_words_are_whole():
    assert [len(x) for x in pieces.units("x" * 600)] == [601]
    assert pieces.units("a  b\n c") == ["▁a", "▁▁b", "\n", "▁c"] and pieces.units("") == []
    assert pieces.units("x" + " " * 100 + "y") == ["▁x", "▁" * 100 + "y"]
    for text in ("a" * 1000 + " b", " " * 700 + "x", "\0 a", "▁▁", "a\n"):
        assert "".join(pieces.units(text)) == ("▁" + text).replace(" ", "▁")


def lattice_by_hand(word, v):
    """(log mass of all ways, {(place, width): (id, log probability given the place)}) straight from the weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    beta, edges = [0.0] * (len(word) + 1), {}
    for i in range(len(word) - 1, -1, -1):
        out = {w: (known[word[i : i + w]], v.log_weight[known[word[i : i + w]]]) for w in range(1, min(16, len(word) - i) + 1) if word[i : i + w] in known}
        if 1 not in out:
            raw = word[i].encode()
            out[1] = (int(v.byte_ids[raw[0]]) if len(raw) == 1 else -ord(word[i]) - 1, sum(v.log_weight[v.byte_ids[b]] for b in raw))
        beta[i] = float(np.logaddexp.reduce([x + beta[i + w] for w, (_, x) in out.items()]))
        edges |= {(i, w): (piece, x + beta[i + w] - beta[i]) for w, (piece, x) in out.items()}
    return beta[0], edges


@needs_model
def test_long_runs_have_their_whole_lattice():
    """Words of one batch, some of which go on far beyond the others: pieces that cross places 256 and 512 are edges, with the weights of the whole."""
    v = pieces.vocabulary(MODEL)
    rng = random.Random(2)
    run = "".join(rng.choice(["the", "ing", "日本", "über", "z", "😀", "\t", "ß"]) for _ in range(300))
    words = ["▁the", "▁" * 90 + "a", "▁" + run, "\n", run[:257], "日本語" * 100, *(f"▁w{i}" for i in range(20)), "▁" + "x" * 700]
    lat = pieces.build(words, v)
    assert int(v.longest) <= 16
    for word, start in zip(words, lat.start.tolist(), strict=True):
        _, want = lattice_by_hand(word, v)
        got, place, open_ = {}, {start: 0}, [start]
        while open_:
            node = open_.pop()
            if node < lat.ends:
                assert place[node] == len(word)
                continue
            here = []
            for e in range(lat.at[node], lat.at[node + 1]):
                to, piece = int(lat.to[e]), int(lat.piece[e])
                here.append((to, piece, float(lat.log_p[e])))
                assert lat.sums[e] == 2.0 or abs(lat.sums[e] - sum(math.exp(x) for *_, x in here)) < 1e-9
            assert lat.sums[lat.at[node + 1] - 1] == 2.0
            text = word[place[node] :]
            for to, piece, x in here:
                width = 1 if piece < 0 or piece in set(v.byte_ids.tolist()) else next(w for w in range(1, 17) if (place[node], w) in want and want[place[node], w][0] == piece)
                got[place[node], width] = (piece, pytest.approx(x, abs=1e-9))
                if to not in place:
                    place[to] = place[node] + width
                    open_.append(to)
                assert place[to] == place[node] + width and text
        assert set(got) == {k for k in want if k in got} and all(want[k] == got[k] for k in got)
        assert {k for k in want if k[0] in set(place.values())} == set(got)


@needs_model
def test_a_very_long_run_takes_linear_time(spark):
    """A text of 200,000 characters without a space comes back, sampled twice."""
    text = "".join(random.Random(4).choice(["the", "ing", "日本", "q"]) for _ in range(90_000))
    rows = pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), decoded="back").collect()
    assert len(rows) == 2 and all(r["back"] == text for r in rows) and rows[0]["ids"] != rows[1]["ids"]


@needs_model
def test_sampling_is_exact():
    """First and second segmentations against their probabilities under the lattice."""
    v = pieces.vocabulary(MODEL)

    def all_of(unit):
        lat, out = pieces.build([unit], v), {}

        def go(node, path, log_p):
            if node < lat.ends:
                out[tuple(path)] = log_p
            else:
                for e in range(lat.at[node], lat.at[node + 1]):
                    go(lat.to[e], [*path, int(lat.piece[e])], log_p + lat.log_p[e])

        go(lat.start[0], [], 0.0)
        assert len(out) == lat.ways[lat.start[0]]
        return out

    p = {a + b: float(np.exp(x + y)) for (a, x), (b, y) in product(all_of("▁on").items(), all_of("▁xe").items())}
    assert sum(p.values()) == pytest.approx(1)
    n, first, second, weighted = 3000, Counter(), Counter(), Counter()
    for j in range(n):
        got = samples(["on xe"], [j], v, 2)[0]
        keys = [g[0] for g in got]
        assert len(set(keys)) == len(keys)
        first[keys[0]] += 1
        second[keys[1]] += 1
        for key, g in zip(keys, got, strict=True):
            weighted[key] += 1 / np.exp(g[2]) / n
            assert g[1] == pytest.approx(np.log(p[key]))
    for key, q in sorted(p.items(), key=lambda x: -x[1])[:3]:
        after = sum(o * q / (1 - o) for other, o in p.items() if other != key)
        assert first[key] / n == pytest.approx(q, abs=0.03) and second[key] / n == pytest.approx(after, abs=0.03)
    assert sum(weighted[k] * q for k, q in p.items()) == pytest.approx(1, abs=0.05)
