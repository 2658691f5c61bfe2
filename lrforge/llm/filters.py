"""How filters interact: which one removes what, in every order that they can take.

A document is read once. A finite-state transducer over its UTF-8 bytes, given as two
tables, says where words begin and end and which bytes are capitals, symbols and code
points; word spans go into an open-addressing hash table that compares bytes before
it calls two spans the same word. What remains of a document is a few numbers, a
digest of its text and a mask of the filters that it fails. Masks are counted by
part, and everything about all orders follows from these counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lrforge.llm.common import map_texts, named, read

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
CHUNK_BYTES = 1 << 20  # texts are scanned together up to this size; longer ones in pieces of about it

# Classes of bytes, states, and what a step puts out.
SPACE, PLAIN, CAPITAL, SYMBOL, TAIL = range(5)
GAP, WORD = range(2)
BEGINS, ENDS, IS_CAPITAL, IS_SYMBOL, IS_POINT = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; the state after each class; outputs by state and class."""
    classes = np.full(256, PLAIN, np.uint8)
    classes[[0x20, *range(0x09, 0x0E)]] = SPACE
    classes[ord("A") : ord("Z") + 1] = CAPITAL
    classes[list(SYMBOLS)] = SYMBOL
    classes[0x80:0xC0] = TAIL
    after = np.array([GAP, WORD, WORD, WORD, WORD], np.uint8)
    out = np.zeros((2, 5), np.uint8)
    out[:, [SPACE, PLAIN, CAPITAL, SYMBOL]] |= IS_POINT
    out[:, CAPITAL] |= IS_CAPITAL
    out[:, SYMBOL] |= IS_SYMBOL
    out[WORD, SPACE] |= ENDS
    out[GAP, 1:] |= BEGINS
    return classes, after, out


CLASSES, AFTER, OUTPUT = _tables()


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits well mixed (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One factor a byte and one a place in the word (repeating after 4096 places; spans are compared in the end).
BYTE_KEYS = _mixed(np.arange(1, 257, dtype=np.uint64))
PLACES = 4096
PLACE_KEYS = _mixed(np.arange(1001, 1001 + PLACES, dtype=np.uint64)) | np.uint64(1)


class Spans:
    """Word spans of a buffer by document, and a hash table over them."""

    def __init__(self, buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray, doc: np.ndarray):
        self.buffer, self.begins, self.doc, self.sizes = buffer, begins, doc, ends - begins
        self.hashes = self._hashes()

    def _places(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte positions of these spans one after the other, their place within their span, and where each span's begin."""
        sizes = self.sizes[spans]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        return np.repeat(self.begins[spans], sizes) + place, place, first

    def _hashes(self) -> np.ndarray:
        if not len(self.begins):
            return np.zeros(0, np.uint64)
        at, place, first = self._places(np.arange(len(self.begins)))
        sums = np.add.reduceat(BYTE_KEYS[self.buffer[at]] * PLACE_KEYS[place % PLACES], first)
        return _mixed(sums + _mixed(self.doc.astype(np.uint64)))

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans of equal sizes hold the same bytes."""
        at, place, first = self._places(a)
        other = np.repeat(self.begins[b], self.sizes[b]) + place
        return np.logical_and.reduceat(self.buffer[at] == self.buffer[other], first) if len(a) else np.zeros(0, bool)

    def distinct(self) -> np.ndarray:
        """Which spans stand for their word in their document: all are inserted at once, round by round.

        In a round every open span looks at its slot: it takes an empty one, ends at an
        equal word's, and goes on to the next slot otherwise.
        """
        n = len(self.begins)
        size = 1 << max(1, (2 * n).bit_length())
        slots, stands = np.full(size, -1, np.int64), np.zeros(n, bool)
        at, open_ = (self.hashes & np.uint64(size - 1)).astype(np.int64), np.arange(n)
        while len(open_):
            slot = at[open_]
            free = slots[slot] < 0
            slots[slot[free]] = open_[free]
            owner = slots[slot]
            stands[open_[owner == open_]] = True
            a, b = open_[owner != open_], owner[owner != open_]
            same = (self.hashes[a] == self.hashes[b]) & (self.doc[a] == self.doc[b]) & (self.sizes[a] == self.sizes[b])
            same[same] = self._equal(a[same], b[same])
            open_ = a[~same]
            at[open_] = (at[open_] + 1) & (size - 1)
        return stands


def scan(texts: list[bytes]) -> tuple[np.ndarray, Spans, np.ndarray]:
    """(words, distinct words in this buffer, capitals, symbols, code points) of each text, its spans, and which stand for a word.

    A space follows each text in the buffer, so that no word runs on; it counts for nobody.
    The state after a byte depends on its class alone, so that all states of the
    buffer are one lookup, shifted by a place.
    """
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(sizes + 1) - 1
    start = stop - sizes
    classes = CLASSES[buffer]
    state = np.empty(len(classes), np.uint8)
    state[0], state[1:] = GAP, AFTER[classes[:-1]]
    out = OUTPUT[state, classes]

    def within(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, stop) - np.searchsorted(at, start)

    begins, ends = np.flatnonzero(out & BEGINS), np.flatnonzero(out & ENDS)
    spans = Spans(buffer, begins, ends, np.searchsorted(stop, begins))
    stands = spans.distinct()
    distinct = np.bincount(spans.doc[stands], minlength=len(texts))
    tails = within(np.flatnonzero(out & IS_POINT == 0))
    counts = np.stack([within(begins), distinct, within(np.flatnonzero(out & IS_CAPITAL)), within(np.flatnonzero(out & IS_SYMBOL)), sizes - tails], axis=1)
    return counts, spans, stands


def _pieces(text: bytes) -> Iterable[bytes]:
    """A long text in pieces that end at white space."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        while end < len(text) and CLASSES[text[end]] != SPACE:
            end += 1
        yield text[at:end]
        at = end


def _scan_long(text: bytes) -> np.ndarray:
    """As scan, for one text a piece at a time; its words are kept in a set, which compares bytes too."""
    total, words = np.zeros(5, np.int64), set()
    for piece in _pieces(text):
        counts, spans, stands = scan([piece])
        total += counts[0]
        words.update(piece[b : b + n] for b, n in zip(spans.begins[stands].tolist(), spans.sizes[stands].tolist(), strict=True))
    total[1] = len(words)
    return total


def scan_all(texts: list[bytes]) -> np.ndarray:
    """Counts of all texts, whatever their sizes."""
    found = np.zeros((len(texts), 5), np.int64)
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > CHUNK_BYTES:
            found[i] = _scan_long(text)
            continue
        held.append(i)
        size += len(text) + 1
        if size >= CHUNK_BYTES:
            found[held] = scan([texts[j] for j in held])[0]
            held, size = [], 0
    if held:
        found[held] = scan([texts[j] for j in held])[0]
    return found


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_distinct, n_capitals, n_symbols, n_points (long) and digest (128 bits of the text); the text goes.

    A null text counts as an empty one. Columns of docs with these names are replaced.
    Memory: some 40 bytes a byte of CHUNK_BYTES, and the distinct words of a longer text.
    """

    def work(texts: list[str | None]) -> list[pa.Array]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        found = scan_all(raw)
        return [pa.array(found[:, i], pa.int64()) for i in range(5)] + [pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in raw], pa.binary())]

    added = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("digest", T.BinaryType())]
    return map_texts(docs, text_col, work, added)


def failures_alone(measured: DataFrame) -> Column:
    """Mask of the filters that look at one document: bit 0 is A (few words), 1 B (few distinct), 2 C (capitals), 3 D (symbols)."""
    tests = ("n_words < 200", "100 * n_distinct < 50 * n_words", "100 * n_capitals > 2 * n_points", "n_symbols > 0")
    return sum((F.when(F.expr(t), 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def failing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters that they fail, and how many of them are labelled so.

    Filter E fails where an equal text has a smaller id in the whole table: rows of one
    id aren't each other's copies, and a null id neither fails nor makes others fail. A
    null part is the empty string. A document is good or toxic if any of its labels
    says so. Texts cross no shuffle; equal texts are counted before they do, so a
    text that a third of all rows share is a row a task.
    """
    slim = docs.select(named(id_col).alias("id"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"), named(text_col).alias("text"))
    measured = measure(slim)
    rows = measured.select("id", "part", "digest", failures_alone(measured).alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    told = labels.where("quality = 1 or toxic = 1").groupBy(named("doc_id").alias("id")).agg(F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"), F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic"))
    rows = rows.join(told, "id", "left").fillna(0, ["good", "toxic"])
    # Within a row of the next table an id occurs once, so the least one brings its own number of rows.
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    )
    texts = texts.withColumn("first_id", F.min("least.id").over(Window.partitionBy("digest")))
    stays = F.col("unnamed") + F.when(F.col("least.id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    each = F.explode(F.array(F.struct(F.col("mask").alias("mask"), stays.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - stays).alias("n"))))
    flat = texts.select("part", "good", "toxic", each.alias("x")).where("x.n > 0")
    return flat.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.expr("x.n * good")).alias("good"), F.sum(F.expr("x.n * toxic")).alias("toxic"))


def interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order and step, from rows (part, mask, n, good, toxic), of which a part has 2^filters at most.

    A filter's Shapley sum needs no orders: of the k filters that a document fails, each
    is the first in 1/k of all orders.
    """
    k = len(filters)
    orders = ["".join(o) for o in permutations(filters)]
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    parts = masks.groupBy("part").agg(by_mask.alias("m"))
    parts = parts.select("part", *[F.expr(f"transform(sequence(0, {2**k - 1}), i -> coalesce(m[i].{c}, 0L))").alias(c) for c in ("n", "good", "toxic")])
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.array(*map(F.lit, range(1, k + 1)))))
    bits = f"aggregate(split(substring(filter_order, 1, step - {{0}}), ''), 0, (a, c) -> a | if(c = '', 0, shiftleft(1, instr('{filters}', c) - 1)))"
    steps = steps.withColumn("before", F.expr(bits.format(1))).withColumn("upto", F.expr(bits.format(0))).withColumn("own", F.expr("upto - before"))

    def total(which: str, where: str) -> Column:
        return F.expr(f"aggregate(sequence(0, {2**k - 1}), 0L, (a, i) -> a + if({where}, {which}[i], 0L))")

    removed = "(i & own) <> 0 and (i & before) = 0"
    share = F.expr(f"aggregate(sequence(0, {2**k - 1}), 0L, (a, i) -> a + if((i & own) <> 0, n[i] * {len(orders)} div bit_count(i), 0L))")
    return steps.select(
        "part", "filter_order", "step", total("n", "(i & upto) = 0").alias("kept"), total("n", removed).alias("removed"), total("n", "(i & own) <> 0 and (i & before) <> 0").alias("redundant"),
        total("n", "i = own").alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source, order and step of the five filters over whole documents. An empty table gives no row."""
    return interactions(failing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * length(t.text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN t.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM t JOIN firsts USING (text) LEFT JOIN lab USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(c) WHERE NOT contains(o, c)),
steps AS (SELECT o AS filter_order, s::INT AS step, o[s] AS own, left(o, s - 1) AS before FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
x AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS fail, fails = own AS alone,
    len(list_filter(string_split(before, ''), lambda c: c <> '' AND contains(fails, c))) > 0 AS gone FROM m, steps),
r AS (
  SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fail), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE gone AND fail), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND fail), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fail), 0)::BIGINT AS toxic_lost FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
