"""Backoff automaton, filter audit and conversation trie against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lrforge.llm import filters, ngrams, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- language-model scores


def model_by_hand(rows, order, mu):
    """{row number: (tokens, known, base, score)} straight from the formula; rows are (id, text, trained)."""
    docs = [["<start>", *WORD.findall((t or "").translate(LOWER)), "<end>"] for _, t, _ in rows]
    counts = Counter()
    for d, (_, _, trained) in zip(docs, rows, strict=True):
        if trained:
            for n in range(1, order + 1):
                counts.update(tuple(d[i : i + n]) for i in range(len(d) - n + 1))
    singles = {k: c for k, c in counts.items() if len(k) == 1 and k != ("<start>",)}
    total, types = sum(singles.values()), len(singles)

    def p(context, w):
        if not context:
            return (counts[(w,)] + 0.1) / (total + 0.1 * (types + 1))
        return (counts[(*context, w)] + mu * p(context[1:], w)) / (counts[context] + mu)

    out = []
    for d in docs:
        score = base = 0.0
        for i in range(1, len(d)):
            base += math.log10(p((), d[i]))
            score += math.log10(p(tuple(d[max(0, i - order + 1) : i]), d[i]))
        out.append((len(d) - 1, sum(counts[(w,)] > 0 for w in d[1:]), total, pytest.approx(base, abs=1e-9), pytest.approx(score, abs=1e-9)))
    return out


def texts(rng, n):
    words = ["a", "B", "cc", "über", "Ü", "x1", "日本", "end", "."]
    return [" ".join(rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(spark, monkeypatch, order):
    monkeypatch.setattr(ngrams, "BUCKET_BYTES", 1 << 10)
    rng = random.Random(order)
    given = texts(rng, 120) + [None, "", " \n\t", "a a a\x0ba", "never seen", "a\xa0b", "one\x85two", "cc " * 5000]
    rows = [(i, t, i % 4 != 3) for i, t in enumerate(given)]
    df = spark.createDataFrame(rows, "doc_id long, text string, trained boolean").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in ngrams.scores(df, F.col("trained"), order=order, mu=3.0).collect()}
    assert len(got) == len(rows)
    for (i, _, _), want in zip(rows, model_by_hand(rows, order, 3.0), strict=True):
        assert got[i] == want, i


def test_scores_of_odd_tables(spark):
    rows = [(1, "x y", True), (1, "x y", True), (None, "X  y z", None), (None, "q", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words boolean").withColumns({"block": F.lit(1), "ids": F.lit("c"), "n": F.lit(2), "counts": F.lit(3)})
    got = sorted((tuple(r) for r in ngrams.scores(df, F.col("words")).collect()), key=repr)
    want = [(i, *w) for (i, _, _), w in zip(rows, model_by_hand(rows, 2, ngrams.MU), strict=True)]
    assert len(got) == 4 and all(any(g == w for w in want) for g in got)
    none = ngrams.scores(df.where("false"), F.col("words"))
    assert none.collect() == [] and none.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    untaught = ngrams.scores(df, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 == r["score"] for r in untaught)


def test_probabilities_of_a_context_sum_to_one():
    """Over all tokens of the model and one unknown word, after every context that a text can reach."""
    rng = random.Random(5)
    given = [t.encode() for t in texts(rng, 50)]
    words = sorted({w for t in given for w in t.lower().split()} | {b"unknown"})
    follow = [b" ".join([*context, w]) for context in ([b"a"], [b"unknown"], [b"cc", b"a"], []) for w in words]
    follow += [b"a", b"unknown", b"cc a", b""]  # each context, and the end
    taught = np.array([True] * len(given) + [False] * len(follow))
    block = ngrams.Block(given + follow, taught, 3)
    c = block.grams[0].counts
    model = ngrams.Automaton(block, int(c[ngrams.END :].sum()), int((c[ngrams.END :] > 0).sum()), 2.0)
    bounds = block.bounds[len(given) :]
    for k, context in enumerate(([b"a"], [b"unknown"], [b"cc", b"a"], [])):
        mine = bounds[k * len(words) : (k + 1) * len(words)]  # each with another last word
        head = model.score(mine[0][0], mine[0][0] + len(context))
        ended = next(model.score(a, b) - model.score(a, b - 1) for (a, b), t in zip(block.bounds, [*given, *follow], strict=True) if t == b" ".join(context)) + head
        assert sum(10**s for s in [*(model.score(a, b - 1) for a, b in mine), ended]) == pytest.approx(10**head, rel=1e-9)


def test_blocks_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 1000)
    given = [(i, "w" * (i * 37 % 700) + " ü") for i in range(50)] + [(99, "long " * 1000)]
    rows = ngrams.to_blocks(spark.createDataFrame(given, "doc_id long, text string"), "doc_id", "text", F.lit(True)).collect()
    assert len({r["block"] for r in rows}) == len(rows) > 10
    assert all(r["bytes"] <= 1000 or len(r["ids"]) == 1 for r in rows)
    back = {}
    for r in rows:
        body, at = ngrams._text(bytes(r["body"]), r["bytes"]), 0
        for i, n in zip(r["ids"], r["sizes"], strict=True):
            back[i], at = body[at : at + n].decode(), at + n
    assert back == dict(given)


# --- filter audit


def counts_by_hand(t):
    w = WORD.findall(t)
    return [len(w), len(set(w)), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t), len(t)]


def test_transducer(monkeypatch):
    rng = random.Random(3)
    alphabet = "aAbB  \n\t#$|é日😀\x85\xa0\x0b\x00"
    given = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", " ", "A", "#", "x" * 9000 + " " + "x" * 8999 + " " + "x" * 9000]
    raw = [t.encode() for t in given]
    assert filters.scan_all(raw).tolist() == [counts_by_hand(t) for t in given]
    monkeypatch.setattr(filters, "CHUNK_BYTES", 50)  # texts in pieces, and few to a buffer
    assert filters.scan_all(raw).tolist() == [counts_by_hand(t) for t in given]


def test_table_is_right_when_all_hashes_meet(monkeypatch):
    monkeypatch.setattr(filters.Spans, "_hashes", lambda self: np.zeros(len(self.begins), np.uint64))
    given = [b"a b a c b a", b"a", b"", b"b b bb b"]
    assert filters.scan(given)[0][:, 1].tolist() == [3, 1, 0, 2]


def audit_by_hand(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, s in docs:
        n, d, c, m, p = counts_by_hand(t or "")
        f = [n < 200, 100 * d < 50 * n, 100 * c > 2 * p, m > 0, any(i is not None and j is not None and j < i and (u or "") == (t or "") for j, u, _ in docs)]
        fails.append((s or "", {"ABCDE"[k] for k in range(5) if f[k]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, own in enumerate(order):
                before = set(order[:k])
                gone = [x for x in mine if own in x[1] and not x[1] & before]
                out[part, order, k + 1] = [
                    sum(not x[1] & (before | {own}) for x in mine), len(gone), sum(own in x[1] and bool(x[1] & before) for x in mine),
                    sum(x[1] == {own} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
                shapley[part, own] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(250))
    kinds = [long, long + " #", long.upper(), "a " * 300, "A# " * 250, "few", "", None, "FEW |"]
    docs = [(i, rng.choice(kinds) if rng.random() < 0.7 else f"{long} {i}", rng.choice(["s", "t", "", None])) for i in range(150)]
    docs += [(7, long, "s"), (7, long, "s"), (None, long, "t"), (None, "new text", "u"), (500, "new text", "u"), (500, "new text", "v"), (-3, "few", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(7, 0, 0), (7, 1, 1), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "part", "mask", "n", "digest", "n_words", "good")}).repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filters.interactions(filters.failing(d, lab)).collect()}
    assert got == audit_by_hand(docs, labels)
    assert filters.interactions(filters.failing(d.where("false"), lab)).collect() == []
    assert {r[7] for r in map(tuple, filters.interactions(filters.failing(d, lab.where("false"))).collect())} == {0}


# --- conversation trie


def rebuilt_by_hand(turns):
    convs = {}
    for c, t, r, x in turns:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    convs = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def trie_by_hand(seqs):
    """seqs: (id, sequence of (role, text)) pairs."""
    nodes = {}
    for i, s in seqs:
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append((i, len(s) == d))
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: sum(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes)
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        ends = ",".join(map(str, sorted(i for i, e in members if e)))
        up = min(i for i, _ in nodes[p[:-1]]) if p else None
        out.append((min(i for i, _ in members), len(p), up, len(members), kids(p), sum(kids(q) == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


TURNS = "conv_id long, turn long, role string, text string"


def conversations(rng, ids):
    said = [("user", "hi"), ("assistant", "hi"), ("user", "über 日本"), (None, None), ("", ""), ("user", "")]
    return [(c, t, *rng.choice(said)) for c in ids for t in range(rng.randint(1, 7))]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie(spark, monkeypatch, shards):
    monkeypatch.setattr(trie, "PIECE_BYTES", 60)  # lists of ends in pieces of three
    rng = random.Random(shards)
    rows = conversations(rng, [*range(60), *range(100, 130), 205, -7, -250, -200])
    rows += [(c, t, "user", x) for c in range(300, 380) for t, x in enumerate(["same", "first", "turns"])]  # copies, more than a shard's
    rows += [(500, None, "user", "null turn first"), (500, 0, "user", "then"), (500, 0, "assistant", "tie"), (500, 0, "user", "then"), (None, 1, "user", "nobody's")]
    turns = spark.createDataFrame(rows, TURNS).withColumns({"keys": F.lit(1), "points": F.lit("p")}).repartition(4)
    seqs = trie.with_shared_heads(trie.turn_sequences(turns))
    assert {r["conv_id"]: len(r["keys"]) for r in seqs.collect()} == {c: len(s) for c, s in rebuilt_by_hand(rows).items()}
    got = sorted(repr(tuple(r)) for r in trie.trie(seqs, shards).collect())
    assert got == trie_by_hand(rebuilt_by_hand(rows).items())


def test_trie_of_odd_tables(spark):
    none = trie.trie(trie.turn_sequences(spark.createDataFrame([(None, 1, "user", "x")], TURNS)))
    assert none.collect() == [] and none.columns[-1] == "ends_sha256"
    chain = [(7, t, "user", f"turn {t}") for t in range(3000)]  # deeper than a recursion may go
    got = trie.trie(trie.turn_sequences(spark.createDataFrame(chain, TURNS)))
    assert got.count() == 3001 and got.agg(F.max("n_leaves"), F.max("depth"), F.sum("n_children")).first() == (1, 3000, 3000)
    alone = spark.createDataFrame([(4, [], []), (4, [], []), (9, [], [])], "conv_id long, keys array<binary>, points array<int>")
    assert [tuple(r) for r in trie.trie(alone, 3).collect()] == [(4, 0, None, 3, 0, 1, 0, hashlib.sha256(b"4,4,9").hexdigest())]


def test_median_order_balances():
    order = list(trie.medians_first(1023))
    assert sorted(order) == list(range(1023))
    tree = trie.Tree()
    for i in order:
        tree.insert([i], [1])
    deepest, open_ = 0, [(tree.equal[0], 1)]
    while open_:
        x, d = open_.pop()
        deepest = max(deepest, d)
        open_ += [(y, d + 1) for y in (tree.low[x], tree.high[x]) if y >= 0]
    assert deepest == 10
