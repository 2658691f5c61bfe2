"""SentencePiece encoding by sampling, and decoding.

A text's segmentations into pieces form a lattice, on which pieces have the weights
of a Zipf law over their rank in the vocabulary. Sampling is Gumbel top-k without
replacement: of all segmentations, each perturbed by its own Gumbel noise, the k
best are emitted. They are found by a perturbed A* search: the frontier holds
disjoint sets of lattice paths (a fixed prefix, some continuations excluded) with the
largest perturbed value of each as its exact bound; the best set is taken, its best
path sampled, and what is left of it split where paths leave that one.

No piece joins two words, so the lattice is a chain of small ones, a lattice a
distinct word. These are built, weighed backwards and sampled in numpy for some
LATTICE_CHARS of text at once, whole documents or parts of one; of a lattice only the
samples are kept. Noise comes from a hash of row key, round, word and step, so
results depend on nothing else.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lrforge.llm.common import bounded_batches, read, release_memory
from lrforge.llm.shingles import mix

SPACE_MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
ZIPF = 1.0  # exponent of the weights
LEAST_MASS = 1e-300  # what rounding leaves of a set that has a segmentation yet
CODE_BITS = 21  # a code point's
COLUMNS = 128  # of the table of steps: the commonest code points of the vocabulary, column 0 for all others
FEW = 6  # words that go on at a distance from their ends; so few are weighed one by one, which is faster
LATTICE_CHARS = 1 << 20  # characters of text whose lattices are held at once

UNIT = re.compile(f"\n|{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+")


def units(text: str) -> list[str]:
    """Words of a text, each with all marks before it; line ends are words of their own. Runs without a space are one word, however long."""
    if not text:
        return []
    marked = (SPACE_MARK + text).replace(" ", SPACE_MARK)
    if "\0" not in text and SPACE_MARK * 2 not in marked:
        return [x for x in marked.replace(SPACE_MARK, "\0" + SPACE_MARK).replace("\n", "\0\n\0").split("\0") if x]
    return UNIT.findall(marked)


class Vocabulary:
    """Pieces of a model file as a trie in arrays, with log weights."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        ordinary = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        pieces = {i: model.id_to_piece(i) for i in ordinary}
        if any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces.values()):
            raise ValueError("a piece of this model joins two words")
        spelled = [b"" if i not in pieces else pieces[i].replace(SPACE_MARK, " ").encode() for i in range(self.size)]
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(self.size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], spelled[i] = i, bytes([value])
        self.text = np.frombuffer(b"".join(spelled), np.uint8)
        self.text_length = np.array([*map(len, spelled), 0], np.int64)  # the last is of all ids outside the vocabulary
        self.text_start = np.concatenate([[0], np.cumsum(self.text_length)[:-1]])
        rank = np.array([min(-model.get_score(i), self.size) if i in pieces else self.size for i in range(self.size)], float)
        weight = (1 + rank) ** -ZIPF
        self.log_weight = np.log(weight / weight.sum())

        steps: dict[tuple[int, str], int] = {}
        ends, inner = [-1], {0: 0}
        for i, piece in pieces.items():
            state = 0
            for n, c in enumerate(piece, 1):
                if (state, c) not in steps:
                    steps[state, c] = len(ends)
                    ends.append(-1)
                state = steps[state, c]
                if n < len(piece):
                    inner.setdefault(state, len(inner))
            ends[state] = i
        self.ends = np.array(ends, np.int32)
        self.n_rows = len(inner)
        self.row = np.full(len(ends), self.n_rows, np.int32)  # of the table; one row more for states that lead nowhere
        self.row[list(inner)] = list(inner.values())
        common: dict[str, int] = {}
        for _, c in steps:
            common[c] = common.get(c, 0) + 1
        chosen = sorted((c for c in common if ord(c) < 1 << 16), key=lambda c: (-common[c], c))[: COLUMNS - 1]
        self.column = np.zeros(1 << 16, np.uint8)
        self.column[[ord(c) for c in chosen]] = np.arange(1, len(chosen) + 1)
        table = np.zeros((len(inner) + 1, COLUMNS), np.int32)
        rare = {}
        for (state, c), to in steps.items():
            at = int(self.column[ord(c)]) if ord(c) < 1 << 16 else 0
            if at:
                table[inner[state], at] = to
            else:
                rare[state << CODE_BITS | ord(c)] = to
        self.table = table.ravel()
        self.rare, self.rare_steps = np.array(sorted(rare), np.int64), rare
        self.rare_to = np.array([rare[k] for k in self.rare.tolist()], np.int32)
        self.views = tuple(memoryview(x) for x in (self.table, self.row, self.ends, self.column))
        self.longest = max(map(len, pieces.values()), default=1)

    def along(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """(width, id) of the pieces that these code points begin with, the shortest first; the same steps as below, for one word."""
        table, row, ends, columns = self.views
        state = 0
        for width, code in enumerate(codes, 1):
            at = columns[code] if code < 1 << 16 else 0
            if at:
                state = table[row[state] * COLUMNS + at]
            else:
                state = self.rare_steps.get(state << CODE_BITS | code, 0)
            if not state:
                return
            if ends[state] >= 0:
                yield width, ends[state]

    def step(self, state: np.ndarray, column: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that follow, 0 for none."""
        to = self.table[self.row[state] * COLUMNS + column]
        odd = np.nonzero(column == 0)[0]
        if len(odd) and len(self.rare):
            key = state[odd].astype(np.int64) << CODE_BITS | code[odd]
            at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            to[odd] = np.where(self.rare[at] == key, self.rare_to[at], 0)
        return to


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@dataclass
class Lattice:
    """Edges of many words' lattices, ordered by the node they leave. Nodes are numbered through all words; the first ones are the words' ends."""

    start: np.ndarray  # of words: their first node
    ends: int  # number of words
    ways: np.ndarray  # of nodes: how many segmentations go on from it
    at: np.ndarray  # of nodes: the first edge that leaves it
    to: np.ndarray  # of edges
    piece: np.ndarray  # of edges: id, or minus code point minus 1 for a character that only several bytes spell
    log_p: np.ndarray  # of edges: log probability given the node
    sums: np.ndarray  # of edges: probabilities added up within the node, 2 at the last


def _bytes_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of code points from 128 on: (points x 4) bytes, of which the last `length` count."""
    length = 2 + (code >= 0x800) + (code >= 0x10000)
    out = np.stack([code >> 18, code >> 12, code >> 6, code], axis=1) & 0x3F | 0x80
    lead = np.arange(4)[None, :] == 4 - length[:, None]
    out[lead] = (code >> 6 * (length - 1)) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[length]
    return out, length


def build(words: list[str], v: Vocabulary) -> Lattice:
    """Words are ordered by length, the longest first, and nodes by their distance from the word's end, so that
    all nodes of a distance lie together, and what follows from them is known when they are reached."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    order = np.argsort(-lengths, kind="stable")
    end, lengths = np.cumsum(lengths)[order], lengths[order]
    longest = int(lengths[0])
    sizes = np.searchsorted(-lengths, -np.arange(longest + 1), "right")  # words of this length or more
    first = np.concatenate([[0], np.cumsum(sizes)])  # of distances: their first node; distance 0 are the ends
    n_nodes, ranks = int(first[-1]), np.arange(len(words), dtype=np.int32)
    code = np.zeros(n_nodes, np.int32)
    for d in range(1, longest + 1):
        code[first[d] : first[d + 1]] = flat[end[: sizes[d]] - d]
    column = v.column[np.minimum(code, (1 << 16) - 1)]
    column[code >= 1 << 16] = 0

    beta, ways = np.zeros(n_nodes), np.ones(n_nodes)  # log mass and number of all ways from a node to its word's end
    at, n_edges = [np.zeros(len(words), np.int64)], 0
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    alone = int(np.searchsorted(-sizes, -FEW, "left")) if sizes[-1] <= FEW else longest + 1  # the first distance that so few words reach
    for d in range(1, min(alone, longest + 1)):
        here, m = int(first[d]), int(sizes[d])
        live, state, count = ranks[:m], np.zeros(m, np.int32), np.zeros(m, np.int32)
        found = []  # by width; a node's edges are numbered from the shortest on
        for width in range(1, d + 1):
            node = live + first[d - width + 1]
            state = v.step(state, column[node], code[node])
            hit = np.nonzero(state)[0]
            live, state = live[hit], state[hit]
            ids = v.ends[state]
            ended = np.nonzero(ids >= 0)[0]
            start, ids = live[ended], ids[ended]
            weight = v.log_weight[ids]
            if width == 1 and len(start) < m:  # characters without a piece are spelled
                bare = np.ones(m, bool)
                bare[start] = False
                bare = ranks[:m][bare]
                point = code[here + bare]
                single = point < 128
                spelled = np.where(single, v.byte_ids[np.minimum(point, 127)], -point - 1).astype(np.int32)
                raw, length = _bytes_of(np.maximum(point, 128))
                own = np.where(np.arange(4)[None, :] >= 4 - length[:, None], v.log_weight[v.byte_ids[raw]], 0.0).sum(axis=1)
                start, ids, weight = np.concatenate([start, bare]), np.concatenate([ids, spelled]), np.concatenate([weight, np.where(single, v.log_weight[np.maximum(spelled, 0)], own)])
            found.append((start, ids, weight, count[start]))
            count[start] += 1
            more = np.nonzero(v.row[state] < v.n_rows)[0]
            live, state = live[more], state[more]
            if not len(live):
                break
        begin = np.concatenate([[0], np.cumsum(count)])
        to, piece, x = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.int32), np.empty(begin[-1])
        for width, (start, ids, weight, number) in enumerate(found, 1):
            place, target = begin[start + 1] - 1 - number, start + np.int32(first[d - width])  # longest first: they tend to be the likeliest
            to[place], piece[place], x[place] = target, ids, weight + beta[target]
        heads = begin[:-1]
        top = np.maximum.reduceat(x, heads)
        x -= np.repeat(top, count)
        p = np.exp(x)
        total = np.add.reduceat(p, heads)
        rest = np.log(total)
        beta[here : here + m] = top + rest
        ways[here : here + m] = np.add.reduceat(ways[to], heads)
        x -= np.repeat(rest, count)
        np.minimum(x, 0.0, out=x)
        p /= np.repeat(total, count)
        several, k = np.nonzero(count > 1)[0], 1
        while len(several):
            p[heads[several] + k] += p[heads[several] + k - 1]
            k += 1
            several = several[count[several] > k]
        p[begin[1:] - 1] = 2.0  # the last edge of a node takes what rounding leaves
        at.append(heads + n_edges)
        n_edges += int(begin[-1])
        out.append((to, piece, x, p))
    if alone <= longest:
        rest = _one_by_one(v, max(1, alone), first, sizes, code, beta, ways, n_edges)
        at.append(rest[0])
        out.append(rest[1:])
        n_edges += len(rest[1])
    begins = np.empty(len(words), np.int64)
    begins[order] = first[lengths] + ranks
    to, piece, log_p, sums = (np.concatenate([o[i] for o in out]) for i in range(4))
    return Lattice(begins, len(words), ways, np.concatenate([*at, [n_edges]]), to, piece, log_p, sums)


def _one_by_one(v: Vocabulary, since: int, first: np.ndarray, sizes: np.ndarray, code: np.ndarray, beta: np.ndarray, ways: np.ndarray, n_edges: int) -> tuple[np.ndarray, ...]:
    """Edges from distance `since` on, as the loop of build makes them: where nodes' edges begin, and to, piece, log_p and sums.

    Each word is walked by itself from here to its beginning, with the code points
    that follow a node at hand; only v.longest of these and of the weights behind it matter.
    """
    last = len(sizes) - 1
    by_node: list[list[tuple[int, int, float, float]]] = [[] for _ in range(int(first[last + 1] - first[since]))]
    log_weight, offset = v.log_weight, int(first[since])
    starts = first.tolist()
    for rank in range(int(sizes[since])):
        length = int(np.searchsorted(-sizes, -rank - 1, "right")) - 1  # the largest distance at which there are more than rank words
        nodes = [starts[d] + rank for d in range(max(0, since - v.longest), length + 1)]
        shift = max(0, since - v.longest)  # nodes[i] is at distance i + shift
        codes, betas, counts = code[nodes].tolist(), beta[nodes].tolist(), ways[nodes].tolist()
        for d in range(since, length + 1):
            i = d - shift
            edges = [(width, piece, float(log_weight[piece])) for width, piece in v.along(codes[i : max(i - v.longest, 0) : -1] if d > v.longest else codes[i:0:-1])]
            if not edges or edges[0][0] > 1:
                point = codes[i]
                if point < 128:
                    spelled = int(v.byte_ids[point])
                    edges.insert(0, (1, spelled, float(log_weight[spelled])))
                else:
                    raw, size = _bytes_of(np.array([point]))
                    edges.insert(0, (1, -point - 1, float(log_weight[v.byte_ids[raw[0, 4 - int(size[0]) :]]].sum())))
            edges.reverse()
            x = [w + betas[i - width] for width, _, w in edges]
            top = max(x)
            p = [math.exp(y - top) for y in x]
            total = sum(p)
            rest, run = math.log(total), 0.0
            betas[i], counts[i] = top + rest, sum(counts[i - width] for width, _, _ in edges)
            held = by_node[nodes[i] - offset]
            for (width, piece, _), y, q in zip(edges, x, p, strict=True):
                run += q / total
                held.append((nodes[i - width], piece, min(y - top - rest, 0.0), run))
            held[-1] = (*held[-1][:3], 2.0)
        beta[nodes[since - shift :]], ways[nodes[since - shift :]] = betas[since - shift :], counts[since - shift :]
    count = np.fromiter(map(len, by_node), np.int64, len(by_node))
    flat = [e for held in by_node for e in held]
    to, piece = np.array([e[0] for e in flat], np.int32), np.array([e[1] for e in flat], np.int32)
    return np.cumsum(count) - count + n_edges, to, piece, np.array([e[2] for e in flat]), np.array([e[3] for e in flat])


MASK, STEP_1, STEP_2 = 2**64 - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _unit(x):
    """Hash values as numbers within 0 and 1."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52 if isinstance(x, np.ndarray) else ((x >> 12) + 0.5) * 2.0**-52


def _one(seed: int, what: int, number: int) -> float:
    """A uniform number of a seed for one purpose."""
    x = (seed + what * STEP_2 + number * STEP_1) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    x = (x ^ x >> 31) + STEP_1 & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return _unit(x ^ x >> 31)


def _gumbel(u: float) -> float:
    return -math.log(-math.log(u))


def sample_all(lat: Lattice, unit: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One segmentation of each word, by its hash: log probabilities, numbers of pieces, and the pieces in order."""
    node = lat.start[unit]
    live = np.arange(len(unit))
    log_p, count = np.zeros(len(unit)), np.zeros(len(unit), np.int32)
    taken = []
    step = 0
    while len(live):
        edge = lat.at[node]
        many = np.nonzero(lat.sums[edge] < 2.0)[0]
        if len(many):
            u = _unit(mix(base[live[many]] + np.uint64(step * STEP_1 & MASK)))
            at = edge[many]
            up = np.nonzero(u > lat.sums[at])[0]
            while len(up):
                at[up] += 1
                up = up[u[up] > lat.sums[at[up]]]
            edge[many] = at
        log_p[live] += lat.log_p[edge]
        count[live] += 1
        taken.append((live, lat.piece[edge]))
        node = lat.to[edge]
        go = node >= lat.ends
        live, node = live[go], node[go]
        step += 1
    offset = np.concatenate([[0], np.cumsum(count)])
    pieces = np.empty(offset[-1], np.int32)
    for step, (live, piece) in enumerate(taken):
        pieces[offset[live] + step] = piece
    return log_p, count, pieces


def sample_other(lat: Lattice, unit: int, excluded: list[list[int]], seed: int, what: int) -> tuple[float, list[int]]:
    """Log probability and pieces of a segmentation of one word other than those excluded, each with its share of what is left.

    There must be one: lat.ways counts them.
    """
    node, pieces, log_p = int(lat.start[unit]), [], 0.0
    barred = excluded
    while node >= lat.ends:
        a, b = int(lat.at[node]), int(lat.at[node + 1])
        names, logs, ends = lat.piece[a:b].tolist(), lat.log_p[a:b].tolist(), lat.to[a:b].tolist()
        left = [math.exp(x) for x in logs]
        for e, name in enumerate(names):
            own = [x[1:] for x in barred if x[0] == name]
            if own:
                rest = sum(math.exp(_along(lat, ends[e], x)) for x in own)
                left[e] = max(left[e] * (1.0 - rest), LEAST_MASS) if lat.ways[ends[e]] > len(own) else 0.0
        draw = _one(seed, what, len(pieces)) * sum(left)
        open_ = [e for e, x in enumerate(left) if x > 0]
        edge, run = open_[0], left[open_[0]]
        for e in open_[1:]:
            if run >= draw:
                break
            edge, run = e, run + left[e]
        pieces.append(names[edge])
        log_p += logs[edge]
        barred = [x[1:] for x in barred if x[0] == names[edge]]
        node = ends[edge]
    return log_p, pieces


def _along(lat: Lattice, node: int, pieces: list[int]) -> float:
    """Log probability of these pieces from a node on."""
    log_p = 0.0
    for piece in pieces:
        edge = int(lat.at[node]) + lat.piece[lat.at[node] : lat.at[node + 1]].tolist().index(piece)
        log_p, node = log_p + float(lat.log_p[edge]), int(lat.to[edge])
    return log_p


def log_inclusion(log_p: float, bound: float) -> float:
    """Log probability that a segmentation is among the samples, given the bound of those that aren't."""
    x = log_p - bound
    if x > 3:
        return math.log1p(-math.exp(-math.exp(min(x, 50.0))))
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class _Pool:
    """Segmentations of words, by number: log probability, and pieces one after the other."""

    def __init__(self) -> None:
        self.log_p, self.count, self.pieces = [], [], []

    def add(self, log_p: np.ndarray, count: np.ndarray, pieces: np.ndarray) -> None:
        self.log_p.append(log_p)
        self.count.append(count)
        self.pieces.append(pieces)

    def close(self) -> None:
        self.log_p, self.count, self.pieces = np.concatenate(self.log_p), np.concatenate(self.count), np.concatenate(self.pieces)
        self.start = np.cumsum(self.count, dtype=np.int64) - self.count

    def of(self, number: int) -> list[int]:
        return self.pieces[self.start[number] : self.start[number] + self.count[number]].tolist()

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        each = self.count[numbers]
        shift = self.start[numbers] - (np.cumsum(each, dtype=np.int64) - each)
        return self.pieces[np.repeat(shift, each) + np.arange(int(each.sum()))]


@dataclass
class _Entry:
    """A set of segmentations of one text: those that go with the path of a round before a word, and there take none of some segmentations."""

    bound: float
    round: int
    word: int
    excluded: tuple[int, ...]  # numbers in the pool
    mass: float  # of the excluded ones


def _parts(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of some LATTICE_CHARS characters."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    a = 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LATTICE_CHARS, "right")))
        yield a, b
        a = b


def encode_batch(texts: list[str], seeds: list[int], v: Vocabulary, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each rank from 1: numbers of the texts that have so many segmentations, counts of pieces, pieces, log probabilities, log inclusion probabilities."""
    lists = [units(text) for text in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    words = [x for part in lists for x in part]
    del lists
    ends = np.cumsum(counts)
    begins = ends - counts
    full = np.nonzero(counts)[0]  # the others have one segmentation, without pieces
    doc = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(words)) - np.repeat(begins, counts)
    seed = np.repeat(np.array(seeds, np.uint64), counts)
    number = at.astype(np.uint64) * np.uint64(STEP_2)

    # Number n of the pool is the free sample of word n % len(words) in round n // len(words), then come those of the frontier.
    pool, parts, ways = _Pool(), [_Pool() for _ in range(k)], np.zeros(len(words))
    for a, b in _parts(words):
        numbers = _Numbers()
        unit = np.fromiter(map(numbers.__getitem__, words[a:b]), np.int64, b - a)
        lat = build(list(numbers), v)
        ways[a:b] = lat.ways[lat.start[unit]]
        for r in range(k):
            parts[r].add(*sample_all(lat, unit, mix(seed[a:b] + number[a:b] + np.uint64(r * 2 + 1))))
        del lat, unit, numbers
    for part in parts:
        for x in zip(part.log_p, part.count, part.pieces, strict=True):
            pool.add(*x)
    del parts
    if len(words):
        pool.close()
    noise_base = mix(seed ^ np.uint64(STEP_1)) + number
    first = begins[full]

    frontier: list[list[_Entry]] = [[] for _ in texts]
    paths: list[np.ndarray] = []
    values: list[np.ndarray] = []
    alive: list[np.ndarray] = []
    taken: list[_Entry | None] = [None] * len(texts)
    bounds = np.array([_gumbel(_one(s, 1, 0)) for s in seeds])
    for r in range(k):
        path = np.arange(r * len(words), (r + 1) * len(words))
        if r == 0:
            live = full
        else:
            live = np.array([i for i in full.tolist() if frontier[i]], np.int64)
            if not len(live):
                break
            distinct = _Numbers()
            for i in live.tolist():
                best = max(range(len(frontier[i])), key=lambda j: frontier[i][j].bound)  # noqa: B023
                entry = taken[i] = frontier[i].pop(best)
                bounds[i] = entry.bound
                a, w = int(begins[i]), entry.word
                path[a:w] = paths[entry.round][a:w]
                distinct[words[w]]  # noqa: B018
            lat = build(list(distinct), v)
            new = [sample_other(lat, distinct[words[taken[i].word]], [pool.of(x) for x in taken[i].excluded], seeds[i], 2 + 2 * r) for i in live.tolist()]
            path[[taken[i].word for i in live.tolist()]] = len(pool.count) + np.arange(len(live))
            more = _Pool()
            more.add(pool.log_p, pool.count, pool.pieces)
            more.add(np.array([x for x, _ in new]), np.array([len(x) for _, x in new], np.int32), np.array([p for _, x in new for p in x], np.int32))
            more.close()
            pool = more
        paths.append(path)
        alive.append(live)
        log_p = pool.log_p[path] if len(words) else np.zeros(0)
        values.append(np.add.reduceat(log_p, first) if len(full) else np.zeros(0))

        # What is left of each set: paths that leave this one at its word, or at a later one.
        value = np.full(len(words), -np.inf)
        gone, leave = np.zeros(len(words)), ways > 1
        for i in live.tolist():
            a, b, entry = int(begins[i]), int(ends[i]), taken[i]
            np.cumsum(log_p[a : b - 1], out=value[a + 1 : b])
            value[a] = 0.0
            if entry is not None:
                w = entry.word
                leave[a:w] = False
                leave[w] = ways[w] > len(entry.excluded) + 1
                gone[w] = entry.mass
        leave &= value > -np.inf
        left = np.maximum(-np.expm1(log_p[leave]) - gone[leave], LEAST_MASS)
        noise = -np.log(-np.log(_unit(mix(noise_base[leave] + np.uint64(r * STEP_1 & MASK)))))
        value[leave] += noise + np.log(left)
        value[~leave] = -np.inf
        for _ in range(k - r):  # no more of them can come up, the bound of the rest included
            top = np.maximum.reduceat(value, first) if len(full) else np.zeros(0)
            spread = np.full(len(texts), np.inf)
            spread[full] = np.where(top > -np.inf, top, np.inf)
            best = np.nonzero(value == spread[doc])[0]
            best = best[np.unique(doc[best], return_index=True)[1]]
            for w, x in zip(best.tolist(), value[best].tolist(), strict=True):
                i = int(doc[w])
                entry, own = taken[i], int(path[w])
                again = entry is not None and entry.word == w
                # Noise added to log mass, held below the bound of the set that is split.
                bound = -float(np.logaddexp(-bounds[i], -x))
                mass = math.exp(float(pool.log_p[own])) + (entry.mass if again else 0.0)
                frontier[i].append(_Entry(bound, r, w, (*entry.excluded, own) if again else (own,), mass))
            value[best] = -np.inf
        for i in live.tolist():
            frontier[i] = sorted(frontier[i], key=lambda e: -e.bound)[: k - r]

    left_bound = [max((e.bound for e in f), default=-math.inf) for f in frontier]
    place = np.zeros(len(texts), np.int64)
    place[full] = np.arange(len(full))
    for r, live in enumerate(alive):
        inside = np.zeros(len(texts), bool)
        inside[live] = True
        path = paths[r][inside[doc]]
        pieces, sizes = (_spelled(pool.joined(path), pool.count[path], v)) if len(words) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        each = counts[live]
        sums = np.add.reduceat(sizes, np.cumsum(each) - each) if len(live) else np.zeros(0, np.int64)
        log_p = values[r][place[live]]
        included = np.array([log_inclusion(float(x), left_bound[i]) for i, x in zip(live.tolist(), log_p, strict=True)])
        if r == 0 and len(full) < len(texts):
            rows, n, p, q = np.arange(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            n[full], p[full], q[full] = sums, log_p, included
            yield rows, n, pieces, p, q
        else:
            yield live, sums, pieces, log_p, included


def _spelled(pieces: np.ndarray, counts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with the byte ids of spelled characters in their places, and how many there are of each word now."""
    odd = np.nonzero(pieces < 0)[0]
    if not len(odd):
        return pieces, counts.astype(np.int64)
    raw, length = _bytes_of(-pieces[odd] - 1)
    each = np.ones(len(pieces), np.int64)
    each[odd] = length
    out = np.repeat(pieces, each)
    end = np.cumsum(each)
    for j in range(4):
        has = length >= j + 1
        out[end[odd[has]] - 1 - j] = v.byte_ids[raw[has, 3 - j]]
    sums = np.concatenate([[0], end])
    word_end = np.cumsum(counts)
    return out, sums[word_end] - sums[word_end - counts]


def texts_of(pieces: np.ndarray, counts: np.ndarray, v: Vocabulary) -> pa.Array:
    """The texts that lists of ids, one after the other, decode to; ids outside the vocabulary give nothing."""
    ids = np.where((pieces >= 0) & (pieces < v.size), pieces, v.size).astype(np.int64)
    start, length = v.text_start[ids], v.text_length[ids]
    ends = np.cumsum(counts)
    sums = np.concatenate([[0], np.cumsum(length)])
    data = v.text[np.repeat(start - sums[:-1], length) + np.arange(int(sums[-1]))] if sums[-1] else np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], sums[ends]])
    filled = np.nonzero(offsets[1:] > offsets[:-1])[0]
    marked = filled[data[offsets[filled]] == 0x20]  # the space that encoding put before the text
    keep = np.ones(len(data), bool)
    keep[offsets[marked]] = False
    data = data[keep]
    shift = np.zeros(len(counts) + 1, np.int64)
    shift[marked + 1] = 1
    offsets -= np.cumsum(shift)
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
        whole = not (data[offsets[:-1][offsets[:-1] < len(data)]] & 0xC0 == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if not whole:
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))


def row_seed(key, seed: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{'' if key is None else key}".encode(), digest_size=8).digest(), "little")


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", seed: str = "pieces", decoded: str | None = None) -> DataFrame:
    """Returns id_col, sample (rank from 1), ids, log_prob, log_inclusion: up to k distinct segmentations a row.

    With decoded, a column of that name holds what the ids decode to, worked out
    beside them, so that ids needn't go through another Python worker.

    Whole texts are encoded, as the model does: a space before them, spaces as marks,
    characters without a piece as bytes. Null texts give no row;
    an empty text, and any with fewer segmentations than k, gives all it has, and no text
    gives fewer than both k and these, however small their probability. Equal perturbed
    values go to the first word in order. Rows of equal key and text give equal
    samples; a null key counts as empty text. model is a file that every executor has.
    Other columns are not looked at, whatever their names; an empty table gives no rows.
    A worker's memory grows with LATTICE_CHARS and with the longest single text.
    """
    field = docs.schema[id_col]
    fields = [field, T.StructField("sample", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())]
    schema = T.StructType([*fields, T.StructField(decoded, T.StringType())] if decoded else fields)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            keys = ids.to_pylist()
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end]) <= LATTICE_CHARS):
                    chars += len(texts[end])
                    end += 1
                for rank, (rows, counts, pieces, log_p, included) in enumerate(encode_batch(texts[start:end], [row_seed(x, seed) for x in keys[start:end]], v, k), 1):
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns = [ids.take(pa.array(rows + start)), pa.array(np.full(len(rows), rank, np.int32)), pa.ListArray.from_arrays(offsets, pieces), pa.array(log_p), pa.array(included)]
                    yield pa.RecordBatch.from_arrays(columns + ([texts_of(pieces, counts, v)] if decoded else []), names=schema.names)
                    del columns, pieces
                release_memory()
                start = end

    return bounded_batches(docs.select(id_col, text_col).where(F.col(text_col).isNotNull())).mapInArrow(go, schema)


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Puts the text in place of the ids: marks become spaces, the first of them goes; null ids give null.

    Decoding a sample gives back the text that was encoded, but for marks that it
    held itself, which are spaces now. Ids outside the vocabulary, and null ones in a
    list, give nothing; bytes that aren't UTF-8 give the replacement character. A
    column that has the text's name already is replaced. Rows are decoded each by
    itself; an empty table gives no rows.
    """
    kept = [f for f in encoded.schema.fields if f.name not in (ids_col, text_col)]
    names = [f.name for f in kept]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            pieces = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            texts = texts_of(pieces, counts, v)
            texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [texts], names=[*names, text_col])

    return bounded_batches(encoded).mapInArrow(go, T.StructType([*kept, T.StructField(text_col, T.StringType())]))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), decoded="text")
    return encoded.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.hash("ids").alias("ids_hash"), "log_prob", "log_inclusion", F.md5("text").alias("decoded_md5"))
