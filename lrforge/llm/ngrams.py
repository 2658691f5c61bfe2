"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

The model is all n-grams of all training documents; it grows with them, so that no
task holds it. Texts lie in blocks. A block sends each n-gram that it has, once, with
its training count, to the bucket of the n-gram's hash; the bucket adds up and sends
the corpus count back. From these counts a block builds the part of the automaton that
its texts can reach: contexts are states, seen n-grams are arcs, and a failure arc
leads to the next shorter context. One walk from left to right carries the state
through a text and adds up log-probabilities.

Smoothing, with c for training counts and context u, u' without its first token:
    P(w | u) = (c(u w) + MU * P(w | u')) / (c(u) + MU)
    P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))
so an arc has the weight log10 P(w | u), and a failure arc log10 (MU / (c(u) + MU)).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lrforge.llm.common import CRC32_SQL, as_table, bounded_batches, held_out, named, read, release_memory

ORDER = 2
MU = 30.0
FLOOR = 0.1
BLOCK_BYTES = 4 << 20  # text of a block; a longer text is a block by itself
BUCKET_BYTES = 8 << 20  # text whose n-grams go to one bucket, on the average
START, END = 0, 1  # token numbers that every block has
SLICE = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


@dataclass
class Grams:
    """Distinct n-grams of one order in a block, in the order of their hashes."""

    keys: np.ndarray
    counts: np.ndarray  # in training documents of the block, later of the corpus
    at: np.ndarray  # number of the n-gram that ends at each place of the stream, -1 where none does
    context: np.ndarray  # number of the (n-1)-gram before the last token
    suffix: np.ndarray  # number of the (n-1)-gram without the first token
    last: np.ndarray  # token number


class Block:
    """Tokens of some texts, and their n-grams up to an order."""

    def __init__(self, texts: list[bytes], training: np.ndarray, order: int):
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        numbers[b"\n"], numbers[b""]  # no words: start, then end
        parts = []
        for text in texts:
            words = text.lower().split()
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.words = list(numbers)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
        stop = np.cumsum(sizes)
        start = stop - sizes
        self.stream = np.full(int(stop[-1]), END, np.int32)
        for part, at in zip(parts, start.tolist(), strict=True):
            self.stream[at] = START
            self.stream[at + 1 : at + 1 + len(part)] = part
        self.bounds = list(zip((start + 1).tolist(), stop.tolist(), strict=True))
        place = np.arange(len(self.stream)) - np.repeat(start, sizes)
        taught = np.repeat(training, sizes)

        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        counts = np.bincount(self.stream[taught], minlength=len(self.words))
        self.grams = [Grams(hashes, counts, self.stream, np.zeros(0, int), np.zeros(0, int), np.arange(len(self.words)))]
        keys = hashes[self.stream]
        for n in range(2, order + 1):
            before = keys
            keys = np.zeros(len(self.stream), np.uint64)
            keys[1:] = _mixed(_mixed(before[:-1] + np.uint64(n)) + hashes[self.stream[1:]])
            there = np.flatnonzero(place >= n - 1)
            distinct, first, which = np.unique(keys[there], return_index=True, return_inverse=True)
            at = np.full(len(self.stream), -1, np.int64)
            at[there] = which
            shorter = self.grams[-1].at
            counts = np.bincount(which[taught[there]], minlength=len(distinct))
            end = there[first]
            self.grams.append(Grams(distinct, counts, at, shorter[end - 1], shorter[end], self.stream[end]))

    def dealt(self, bits: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Of each order its number, the bucket of each n-gram asked for, and its number; buckets ascend. START isn't asked for."""
        words = np.argsort(self.grams[0].keys, kind="stable")
        words = words[words != START]
        out = [(1, _bucket(self.grams[0].keys[words], bits), words)]
        for n, g in enumerate(self.grams[1:], 2):
            out.append((n, _bucket(g.keys, bits), np.arange(len(g.keys))))
        return out


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _cuts(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of equal buckets."""
    starts = np.flatnonzero(np.diff(buckets, prepend=-1)) if len(buckets) else np.zeros(0, int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True):
        yield int(buckets[a]), a, b


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    return pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).reshape(n)


def _text(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True)


def to_blocks(docs: DataFrame, id_col: str, text_col: str, trained: Column) -> DataFrame:
    """(block, ids, training, sizes, bytes, body): whole texts put together up to BLOCK_BYTES, compressed; null texts are empty.

    Written as a table, as a block's number is that of its task and place.
    """
    slim = docs.select(named(id_col).alias("id"), F.coalesce(trained, F.lit(False)).alias("training"), named(text_col).alias("text"))
    kind = slim.schema["id"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("training", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("bytes", T.LongType()), T.StructField("body", T.BinaryType()),
    ])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, training, texts, size, id_type = [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            body = b"".join(texts)
            columns = [[block], [ids], [training], [[len(t) for t in texts]], [len(body)], [pa.compress(body, codec="zstd", asbytes=True)]]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > BLOCK_BYTES:
                    yield flush()
                    block, ids, training, texts, size = block + 1, [], [], [], 0
                ids.append(i)
                training.append(t)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield flush()
        release_memory()

    return as_table(bounded_batches(slim).mapInArrow(go, schema), "ngram-blocks")


def _opened(row: dict, order: int) -> Block:
    body, at, texts = _text(row["body"], row["bytes"]), 0, []
    for size in row["sizes"]:
        texts.append(body[at : at + size])
        at += size
    return Block(texts, np.array(row["training"], bool), order)


REQUEST = "n int, bucket long, block long, size int, bytes long, grams binary, counts binary"
ANSWER = "block long, n int, bucket long, size int, counts binary, tokens long, types long"


def _ask(order: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in REQUEST.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, rows = _opened(row, order), []
                for n, buckets, numbers in block.dealt(bits):
                    grams = block.grams[n - 1]
                    for bucket, a, b in _cuts(buckets):
                        some = numbers[a:b]
                        if n == 1:
                            raw = b"\n".join(block.words[i] for i in some.tolist())
                            size, sent = len(raw), pa.compress(raw, codec="zstd", asbytes=True)
                        else:
                            size, sent = 0, _pack(np.diff(grams.keys[some], prepend=np.uint64(0)))
                        rows.append((n, bucket, row["block"], b - a, size, sent, _pack(grams.counts[some].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        release_memory()

    return go


def _answer(requests: pa.Table) -> pa.Table:
    """All requests of a bucket for one order: counts are added up and go back as they were asked for; of words, how many there are too."""
    asked = requests.to_pylist()
    counts = [_unpack(r["counts"], r["size"], np.uint32).astype(np.int64) for r in asked]
    tokens = types = None
    if asked[0]["n"] == 1:
        words = [_text(r["grams"], r["bytes"]).split(b"\n") for r in asked]
        total: dict[bytes, int] = defaultdict(int)
        for some, own in zip(words, counts, strict=True):
            for word, c in zip(some, own.tolist(), strict=True):
                total[word] += c
        sums = [np.fromiter(map(total.__getitem__, some), np.int64, len(some)) for some in words]
        tokens, types = sum(total.values()), sum(c > 0 for c in total.values())
    else:
        keys = np.concatenate([np.cumsum(_unpack(r["grams"], r["size"], np.uint64)) for r in asked])
        distinct, which = np.unique(keys, return_inverse=True)
        every = np.zeros(len(distinct), np.int64)
        np.add.at(every, which, np.concatenate(counts))
        sums = np.split(every[which], np.cumsum([r["size"] for r in asked])[:-1])
    rows = [(r["block"], r["n"], r["bucket"], r["size"], _pack(s), None, None) for r, s in zip(asked, sums, strict=True)]
    if tokens is not None:
        rows.append((None, 1, asked[0]["bucket"], 0, None, tokens, types))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in ANSWER.split(", ")])


class Automaton:
    """States, arcs and failure arcs of the contexts of a block; state 0 is the empty context, which has an arc for every token.

    A context of m tokens is a state where training follows it; so is then each of its
    suffixes, and failing drops the first token. Arcs out of contexts of m tokens are kept
    by the place of the text that they can be taken at: weights[m - 1] has NaN where
    there is none.
    """

    def __init__(self, block: Block, tokens: int, types: int, mu: float):
        words = block.grams[0]
        words.counts[START] = words.counts[END]  # a start for every end
        self.known = words.counts > 0
        probability = (np.where(np.arange(len(words.counts)) == START, 0, words.counts) + FLOOR) / (tokens + FLOOR * (types + 1))
        self.root = np.log10(probability)
        self.weights, self.targets = [], []
        self.depth, self.fail, self.fail_weight = [0], [0], [0.0]
        none = np.zeros(len(words.counts), np.int64)
        longest = none  # of each shorter context the state of its longest suffix that is one
        for n, grams in enumerate(block.grams, 1):
            before = longest
            if n > 1:
                rest = block.grams[n - 2].counts
                probability = (grams.counts + mu * probability[grams.suffix]) / (rest[grams.context] + mu)
            if n < len(block.grams):
                state = (grams.counts > 0) & (grams.last != END)
                shorter = before[grams.suffix] if n > 1 else none
                longest = np.where(state, len(self.fail) - 1 + np.cumsum(state), shorter)
                self.depth += [n] * int(state.sum())
                self.fail += shorter[state].tolist()
                self.fail_weight += np.log10(mu / (grams.counts[state] + mu)).tolist()
            if n == 1:
                self.after_root = longest
            else:
                there = np.flatnonzero(grams.at >= 0)
                weight, target = np.full(len(grams.at), np.nan), np.zeros(len(grams.at), np.int64)
                weight[there] = np.where(grams.counts > 0, np.log10(probability), np.nan)[grams.at[there]]
                target[there] = (longest if n < len(block.grams) else longest[grams.suffix])[grams.at[there]]
                self.weights.append(weight)
                self.targets.append(target)
        self.stream, self.start = block.stream, int(self.after_root[START])

    def score(self, begin: int, end: int) -> float:
        """Log-probability of the text at these places, its end included, in one walk."""
        depth, fail, fail_weight, state, sums = self.depth, self.fail, self.fail_weight, self.start, []
        for i in range(begin, end, SLICE):
            j = min(end, i + SLICE)
            some = self.stream[i:j]
            columns = [self.root[some].tolist(), self.after_root[some].tolist()]
            columns += [zip(*(x[i:j].tolist() for x in xs), strict=True) if xs else [()] * (j - i) for xs in (self.weights, self.targets)]
            parts: list[float] = []
            add = parts.append
            for alone, then, weights, targets in zip(*columns, strict=True):
                while state:
                    m = depth[state] - 1
                    weight = weights[m]
                    if weight == weight:
                        add(weight)
                        state = targets[m]
                        break
                    add(fail_weight[state])
                    state = fail[state]
                else:
                    add(alone)
                    state = then
            sums.append(math.fsum(parts))
        return math.fsum(sums)


def scores(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: float = MU) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of every row, from a model of the rows where trained is true.

    Tokens are words, A-Z lower-cased, and one end a text; null texts are empty. n_known
    counts tokens that occur in training; base_score is the score of single tokens alone.
    Rows of one id, and equal texts, count and are scored each by itself; without training
    rows all tokens are unknown; other columns of docs don't matter. n-grams above single
    words are known by 64 bits of a hash, so that two of them share a count by a chance of
    about 2^-64 a pair. A task holds one block or one bucket: a hot n-gram is a row a block.
    """
    blocks = to_blocks(docs, id_col, text_col, trained)
    kind = blocks.schema["ids"].dataType.elementType
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    requests = bounded_batches(blocks).mapInArrow(_ask(order, bits), REQUEST)
    answers = as_table(requests.groupBy("n", "bucket").applyInArrow(_answer, ANSWER), "ngram-answers")
    tokens, types = answers.where("block is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(f, t) for f, t in fields)])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({})
        row = left.to_pylist()[0]
        block = _opened(row, order)
        told = {(r["n"], r["bucket"]): r for r in right.to_pylist()}
        for n, buckets, numbers in block.dealt(bits):
            for bucket, a, b in _cuts(buckets):
                r = told[n, bucket]
                block.grams[n - 1].counts[numbers[a:b]] = _unpack(r["counts"], r["size"], np.int64)
        model = Automaton(block, tokens, types, mu)
        texts = [block.stream[a:b] for a, b in block.bounds]
        columns = [
            pa.array([len(t) for t in texts], pa.int64()), pa.array([int(model.known[t].sum()) for t in texts], pa.int64()), pa.array([tokens] * len(texts), pa.int64()),
            pa.array([math.fsum(model.root[t].tolist()) for t in texts], pa.float64()), pa.array([model.score(a, b) for a, b in block.bounds], pa.float64()),
        ]
        ids = left.column(left.schema.get_field_index("ids")).combine_chunks().flatten()
        release_memory()
        return pa.table([ids, *columns], names=schema.names)

    told = answers.where("block is not null").select("block", "n", "bucket", "size", "counts")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(work, schema)


FOLDS = 10


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of those outside the held-out tenth; scores to six decimals."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scores(docs, ~held_out(F.col("doc_id"), FOLDS, 0))
    six = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", six("base_score").alias("base_score"), six("score").alias("score"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({CRC32_SQL.format('doc_id::VARCHAR')} % {FOLDS} = 0, false) AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, held_out, unnest(list_append(w, '')) AS w, unnest(list_prepend(chr(10), w)) AS u FROM d),
c1 AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
cu AS (SELECT u, count(*) AS c FROM t WHERE NOT held_out GROUP BY u),
c2 AS (SELECT u, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, w),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c1),
p AS (SELECT t.r, coalesce(c1.c, 0) > 0 AS known, (coalesce(c1.c, 0) + {FLOOR}::DOUBLE) / (n.n + {FLOOR}::DOUBLE * (n.v + 1)) AS p1, coalesce(c2.c, 0) AS c2, coalesce(cu.c, 0) AS cu FROM t LEFT JOIN c1 USING (w) LEFT JOIN cu USING (u) LEFT JOIN c2 ON c2.u = t.u AND c2.w = t.w, n),
s AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, fsum(log10(p1)) AS base_score, fsum(log10((c2 + {MU}::DOUBLE * p1) / (cu + {MU}::DOUBLE))) AS score FROM p GROUP BY r)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, n.n AS train_tokens, floor(base_score * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS base_score, floor(score * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS score FROM d JOIN s USING (r), n
"""
