"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end per document. The corpus is counted whole: a table of every training word.
The model has two levels. Each of the most frequent words is a class, other words fall into classes by their last
bytes. With r the context vectors, q the output vectors and c1, c2 the position weights, the score of class w behind
the classes u, v is (c1 r_u + c2 r_v) q_w + b_w. Within a class the words of the dictionary have vectors of their own:
the score of a word behind v is g_v p_w + d_w; the class's other words have one output together, which they share by
their counts, one share for all unknown words. So the word vectors grow with the counted vocabulary up to the
dictionary's size, and the counts behind the others without bound.

Each text is encoded once: a number per word, which training and scoring read, and the words outside the dictionary.

Training is by noise-contrastive estimation over all training documents: in each round every task runs minibatches over
its own documents from the same start, with noise classes and words drawn from the counts, and the results are averaged:
by token counts, and a word's vector by how often the word occurred. A task's state is the parameters, whose size is
bounded by the dictionary. What a task draws depends on its number, so results depend on how the table is partitioned.

As the score of a class is a sum over the two positions, the normalising sum of all contexts is one matrix product,
Z = exp(A1) diag(exp b) exp(A2)', with A1 = (c1 r) q' and A2 = (c2 r) q'; and as the score of a word depends on one
position, its sums are a product per class. So each token's log-probability is exactly normalised and costs a few
look-ups. Counts of words outside the broadcast dictionary come by a join on the word.

Cases: a null or empty text has its end token only; a null doc_id counts as training; repeated documents each count
and get a row; texts of any length are whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.common import bounded_batches, cut, table, text_bytes


@dataclass(frozen=True)
class Sizes:
    """top: words that are classes of their own; tails: classes of other words; dictionary: words with counts, and beyond top vectors, that are broadcast; word_rounds: of the last rounds, in which words are trained too."""

    top: int = 768
    tails: int = 254
    dictionary: int = 200_000
    dim: int = 24
    word_dim: int = 8
    noise: int = 32
    word_noise: int = 5
    batch: int = 4096
    rounds: int = 2
    word_rounds: int = 2
    rate: float = 0.08

    @property
    def end(self) -> int:
        return self.top + self.tails

    @property
    def start(self) -> int:
        return self.top + self.tails + 1

    @property
    def classes(self) -> int:
        return self.top + self.tails + 2


SIZES = Sizes()
FLUSH = 200_000
#: Draws of noise words kept for each class, and rows that are added up in one go.
POOL, FAN_IN = 64, 128
#: Bytes of batches that are looked up in the dictionary in one go, as each look-up costs a pass over the dictionary.
GATHER = 8 << 20
MARKS = b".,;:!?#%$&*\"')("
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)"


def tail_class(word: bytes, sizes: Sizes = SIZES) -> int:
    """The class of a word that isn't frequent, by its last two bytes that aren't punctuation."""
    end = word.rstrip(MARKS)[-2:] or word[-1:]
    return sizes.top + (end[0] * 31 + end[-1] * 7 + len(end)) % sizes.tails


def tail_classes(words: pa.Array, sizes: Sizes = SIZES) -> np.ndarray:
    """tail_class() of each word of an array."""
    if not len(words):
        return np.empty(0, np.int16)
    bare = pc.ascii_rtrim(words.view(pa.string()), characters=MARKS.decode()).view(pa.binary())
    used = pc.binary_length(bare).to_numpy()
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.where(used > 0, np.minimum(used, 2), 1)
    last = np.where(used > 0, starts[:-1] + used, starts[1:]) - 1
    data = np.frombuffer(words.buffers()[2], np.uint8)
    return (sizes.top + (data[last - size + 1].astype(np.int32) * 31 + data[last].astype(np.int32) * 7 + size) % sizes.tails).astype(np.int16)


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), text_bytes().alias("text"))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and the lower-cased words of all texts, one text behind the other."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words = lists.flatten().view(pa.binary())
    keep = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty word
    before = np.r_[0, np.cumsum(keep)]
    return np.diff(before[lists.offsets.to_numpy()]), words if keep.all() else words.filter(pa.array(keep))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Several batches as one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= GATHER:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def count_words(docs: DataFrame) -> DataFrame:
    """word and count over the training documents; the empty word is the end."""

    def run(batches):
        held, rows = [], 0
        for batch in _gathered(batches):
            counts = split_words(batch.column(0))[1].value_counts()
            held.append(pa.table({"word": counts.field(0), "count": counts.field(1)}))
            held.append(pa.table({"word": pa.array([b""], pa.binary()), "count": pa.array([batch.num_rows], pa.int64())}))
            rows += len(counts) + 1
            if rows >= 2 * FLUSH:
                merged = _merged(held)
                rows = merged.num_rows
                if rows >= FLUSH:
                    yield from merged.to_batches()
                    held, rows = [], 0
                else:
                    held = [merged]
        if held:
            yield from _merged(held).to_batches()

    counted = _texts(docs).where("not held_out").select("text").mapInArrow(run, "word binary, count long")
    return counted.groupBy("word").agg(F.sum("count").alias("count"))


def _merged(tables: list[pa.Table]) -> pa.Table:
    """One row per word."""
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("count", "sum")]).rename_columns({"count_sum": "count"}).select(["word", "count"])


class Lexicon:
    """The broadcast dictionary: word to number by frequency, class of each number, count of each number.

    Words that share a class stand one behind the other as tail words, in the order of their classes. A word outside the
    dictionary has the code -1 - class; classes and tail_of go on behind the last number, so that codes are places from the end.
    """

    def __init__(self, rows: list[tuple[bytes, int]], tails: dict[int, tuple[int, int]], total: int, distinct: int, sizes: Sizes = SIZES):
        """tails: count and number of distinct words of each class by last bytes, without those that are classes of their own."""
        words = [w for w, _ in rows if w]
        self.sizes, top = sizes, sizes.top
        self.listed = pa.array(words, pa.binary())
        self.counts = np.array([c for w, c in rows if w], np.int64)
        self.classes = np.concatenate([np.arange(min(top, len(words)), dtype=np.int16), tail_classes(self.listed[top:], sizes)])
        self.ends = next((c for w, c in rows if not w), 0)
        self.total, self.distinct = total, distinct
        # tail words by class
        rest = self.classes[top:].astype(np.int64)
        order = np.argsort(rest, kind="stable")
        self.tail_of = np.full(len(words) + sizes.classes, -1, np.int32)
        self.tail_of[top + order] = np.arange(len(order), dtype=np.int32)
        self.classes = np.concatenate([self.classes, np.arange(sizes.classes, dtype=np.int16)[::-1]])
        self.tail_class = rest[order] - top
        self.tail_counts = self.counts[top:][order]
        self.first = np.searchsorted(self.tail_class, np.arange(sizes.tails + 1))
        # shares: each word counts once more than it occurs, and so do all unknown ones together
        n = np.array([tails.get(top + k, (0, 0)) for k in range(sizes.tails)], np.float64)
        listed = np.bincount(self.tail_class, self.tail_counts + 1.0, sizes.tails) if len(order) else np.zeros(sizes.tails)
        self.tail_total = n.sum(axis=1) + 1
        self.others = self.tail_total - listed
        self.weight = np.zeros(sizes.classes)
        self.weight[: min(top, len(words))] = self.counts[:top]
        self.weight[top : top + sizes.tails] = n[:, 0]
        self.weight[sizes.end] = self.ends

    @cached_property
    def number(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.listed.to_pylist())}

    def encode(self, words: pa.Array) -> np.ndarray:
        """The code of each word: its number, or -1 - class outside the dictionary."""
        codes = pc.index_in(words, value_set=self.listed).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        missing = np.flatnonzero(codes < 0)
        codes[missing] = -1 - tail_classes(words.take(pa.array(missing)), self.sizes)
        return codes


def lexicon(counts: DataFrame, sizes: Sizes = SIZES) -> Lexicon:
    """counts: from count_words(), cut. At most sizes.dictionary of the most frequent words, the end's count and totals per class come to the driver."""
    words = counts.where("word <> X''")
    # the least frequency class (sixteenths of a power of two) that still leaves at most so many words
    level, room, least = F.floor(F.log2("count") * 16), sizes.dictionary, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    frequent = words.where(level >= least).collect() if least is not None else []
    top = sorted(((bytes(r[0]), r[1]) for r in frequent), key=lambda x: (-x[1], x[0]))
    ends = counts.where("word = X''").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    # totals of the classes by last bytes: pre-aggregated by what the class is made from
    tails: dict[int, tuple[int, int]] = {}

    def run(batches):
        for batch in batches:
            k = tail_classes(batch.column(0), sizes).astype(np.int64)
            n = np.bincount(k, batch.column(1).to_numpy(), sizes.classes) if len(k) else np.zeros(sizes.classes)
            v = np.bincount(k, minlength=sizes.classes)
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at].astype(np.int64)), pa.array(v[at].astype(np.int64))], names=["k", "n", "v"])

    for r in words.select("word", "count").mapInArrow(run, "k long, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():
        tails[r[0]] = (r[1], r[2])
    for w, c in top[: sizes.top]:  # these are classes of their own
        n, v = tails[k := tail_class(w, sizes)]
        tails[k] = (n - c, v - 1)
    return Lexicon([(b"", ends), *top], tails, total, distinct, sizes)


class Model:
    """Parameters, float32. Of classes: context vectors r, output vectors q, position weights c (2 rows), biases b; of words: context vectors g (by class), word vectors p, biases d."""

    SHARED = ("r", "q", "c", "b", "g")

    def __init__(self, **parts: np.ndarray):
        self.parts = parts
        self.r, self.q, self.c, self.b, self.g, self.p, self.d = (parts[k] for k in ("r", "q", "c", "b", "g", "p", "d"))

    @staticmethod
    def start(words: Lexicon) -> "Model":
        sizes, rng = words.sizes, np.random.default_rng(11)
        share = (words.weight + 0.5) / (words.weight + 0.5).sum()
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return Model(
            r=normal(0.1, sizes.classes, sizes.dim), q=normal(0.1, sizes.classes, sizes.dim), c=np.ones((2, sizes.dim), np.float32), b=np.log(share).astype(np.float32),
            g=normal(0.3, sizes.classes, sizes.word_dim), p=np.zeros((len(words.tail_class), sizes.word_dim), np.float32),
            d=np.log((words.tail_counts + 1.0) / words.tail_total[words.tail_class]).astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        """The parameters that aren't a word's."""
        return np.concatenate([self.parts[k].ravel() for k in self.SHARED])

    def with_shared(self, flat: np.ndarray) -> "Model":
        at, parts = 0, dict(self.parts)
        for k in self.SHARED:
            n = parts[k].size
            parts[k] = flat[at : at + n].astype(np.float32).reshape(parts[k].shape)
            at += n
        return Model(**parts)

    def class_tables(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A1 + b, A2 and log Z: the log-probability of w behind u, v is A1[u, w] + A2[v, w] - logZ[u, v]. The start is never an output."""
        a1, a2 = (self.r * self.c[0]) @ self.q.T + self.b, (self.r * self.c[1]) @ self.q.T
        a1[:, start] = -np.inf
        top1, top2 = a1.max(axis=1, keepdims=True), a2.max(axis=1, keepdims=True)
        z = np.exp(a1 - top1) @ np.exp(a2 - top2).T
        return a1, a2, np.log(z) + top1 + top2.T

    def word_sums(self, words: Lexicon) -> np.ndarray:
        """The log of the sum over a class's words and its others, by the class before (rows) and the tail class."""
        out = np.empty((len(self.g), words.sizes.tails), np.float32)
        for k in range(words.sizes.tails):
            mine = slice(words.first[k], words.first[k + 1])
            out[:, k] = np.log(np.exp(self.g @ self.p[mine].T + self.d[mine]).sum(axis=1) + words.others[k] / words.tail_total[k])
        return out


def _groups(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts numbers, where each distinct one begins in it, and the distinct numbers."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return order, first, at[first]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of x."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # an infinite exponential gives zero
        np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


class Trainer:
    """Noise-contrastive steps over streams of classes and of tail words."""

    def __init__(self, model: Model, words: Lexicon, seed: tuple[int, ...]):
        self.words, self.sizes, self.rng = words, words.sizes, np.random.default_rng(seed)
        # output vectors stand beside their biases, and the model's parts are views of them
        self.outputs, self.tails = np.column_stack([model.q, model.b]), np.column_stack([model.p, model.d])
        self.m = Model(r=model.r.copy(), c=model.c.copy(), g=model.g.copy(), q=self.outputs[:, :-1], b=self.outputs[:, -1], p=self.tails[:, :-1], d=self.tails[:, -1])
        share = (words.weight + 0.5) / (words.weight + 0.5).sum()
        share[self.sizes.start] = 0
        self.share = share / share.sum()
        self.log_noise = np.log(self.sizes.noise * np.maximum(self.share, 1e-12)).astype(np.float32)
        self.seen = {k: np.ones_like(x) for k, x in (("r", model.r), ("c", model.c), ("g", model.g), ("outputs", self.outputs), ("tails", self.tails))}
        self.pool = np.empty(0, np.uint16)
        # words are drawn within their class by counts
        self.times = np.zeros(len(words.tail_class))
        self.cumulative = np.cumsum(words.tail_counts + 1.0)
        listed = np.bincount(words.tail_class, words.tail_counts + 1.0, self.sizes.tails) if len(self.times) else np.zeros(self.sizes.tails)
        self.word_noise = np.log(self.sizes.word_noise * (words.tail_counts + 1.0) / listed[words.tail_class]).astype(np.float32) if len(self.times) else np.zeros(0, np.float32)

    def noise(self) -> np.ndarray:
        n = self.sizes.noise
        if len(self.pool) < n:
            self.pool = self.rng.choice(self.sizes.classes, n * 512, p=self.share).astype(np.uint16)
        out, self.pool = self.pool[:n], self.pool[n:]
        return out

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """One minibatch of classes, in the order of w."""
        m, n = self.m, self.noise()
        ones = np.ones((len(m.r), 1), np.float32)  # the bias's input
        h = np.hstack([m.r * m.c[0], ones]).take(u, axis=0)
        h += np.hstack([m.r * m.c[1], 0 * ones]).take(v, axis=0)
        qw, qn = self.outputs.take(w, axis=0), self.outputs[n]
        good = self.log_noise[w] - np.einsum("ij,ij->i", h, qw)
        qn[:, -1] -= self.log_noise[n]
        bad = h @ qn.T
        dg, db = -_sigmoid(good), _sigmoid(bad)  # of -log sigmoid(good) and of -log sigmoid(-bad)
        qw *= dg[:, None]
        qw += db @ qn
        dh = qw[:, :-1]  # of the sum of the two context vectors
        grad, dc, moves = np.zeros_like(m.r), np.empty_like(m.c), np.zeros_like(self.outputs)
        for i, at in enumerate((u, v)):
            order, first, which = _groups(at)
            total = np.add.reduceat(dh.take(order, axis=0), first, axis=0)
            dc[i] = np.einsum("ij,ij->j", total, m.r[which])
            grad[which] += total * m.c[i]
        noise_moves = db.T @ h
        h *= dg[:, None]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        moves[w[first]] = np.add.reduceat(h, first, axis=0)
        np.add.at(moves, n, noise_moves)
        for values, k, x in ((self.outputs, "outputs", moves), (m.r, "r", grad), (m.c, "c", dc)):
            self._move(values, self.seen[k], x)

    def _move(self, values: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> None:
        """An AdaGrad step of a parameter; rows without a gradient stay."""
        seen += grad * grad
        values -= self.sizes.rate * grad / np.sqrt(seen + 1e-6)

    def draw_words(self) -> np.ndarray:
        """New noise words for every class that has words."""
        first, last = self.words.first[:-1], self.words.first[1:]
        drawn = np.zeros((self.sizes.tails, POOL), np.int32)
        have = np.flatnonzero(last > first)
        high = self.cumulative[last[have] - 1]
        low = np.where(first[have] > 0, self.cumulative[first[have] - 1], 0.0)
        at = np.searchsorted(self.cumulative, low[:, None] + self.rng.random((len(have), POOL)) * (high - low)[:, None], "right")
        drawn[have] = np.clip(at, first[have][:, None], last[have][:, None] - 1)
        return drawn

    def word_steps(self, v: np.ndarray, j: np.ndarray) -> None:
        """Minibatches of tail words behind classes, on the rows of those that occur here or are drawn."""
        m, drawn = self.m, self.draw_words()
        mine, at = np.unique(np.concatenate([drawn.ravel(), j]), return_inverse=True)
        slots, own, pools = at[: drawn.size], at[drawn.size :], self.words.tail_class[j] * POOL
        values, seen, log_noise = self.tails[mine], self.seen["tails"][mine], self.word_noise[mine]
        ones = np.ones((len(m.g), 1), np.float32)  # the bias's input
        for i in range(0, len(j), self.sizes.batch):
            part = slice(i, i + self.sizes.batch)
            turn = self.rng.integers(0, POOL, len(j[part])) + np.arange(self.sizes.word_noise)[:, None]
            which = np.concatenate([own[None, part], slots[pools[part] + turn % POOL]])  # the words, then their noise
            h = np.hstack([m.g, ones]).take(v[part], axis=0)
            out = values.take(which, axis=0)
            s = np.einsum("nij,ij->ni", out, h)
            s -= log_noise[which]
            np.negative(s[0], out=s[0])
            _sigmoid(s)
            np.negative(s[0], out=s[0])  # the derivatives
            dh = np.einsum("ni,nij->ij", s, out)
            grad, which = np.empty_like(values), which.ravel()
            for k, x in enumerate(np.ascontiguousarray(h.T)):
                grad[:, k] = np.bincount(which, (s * x).ravel(), len(mine))
            self._move(values, seen, grad)
            order, first, which = _groups(v[part])
            grad = np.zeros_like(m.g)
            grad[which] = np.add.reduceat(dh.take(order, axis=0), first, axis=0)[:, :-1]
            self._move(m.g, self.seen["g"], grad)
        self.tails[mine], self.seen["tails"][mine] = values, seen
        self.times += np.bincount(j, minlength=len(self.times))

    def drain(self, held: list[tuple[np.ndarray, np.ndarray]], with_words: bool = True) -> int:
        """Steps over the held documents (classes, tail words with -1 for others) in random order of tokens; they are given up then."""
        if not held:
            return 0
        u, v, w, tails = _with_contexts(held, self.sizes)
        held.clear()
        size = self.sizes.batch
        order = self.rng.permutation(len(w))
        for i in range(0, len(w), size):
            at = order[i : i + size]
            at = at[np.argsort(w[at], kind="stable")]
            self.step(u[at], v[at], w[at])
        own = order[tails[order] >= 0] if with_words else order[:0]
        if len(own):
            self.word_steps(v[own], tails[own])
        return len(w)


def _with_contexts(documents: list[tuple[np.ndarray, np.ndarray]], sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two back, one back, class, tail word) for each word and the end of some documents."""
    lengths = np.array([len(c) for c, _ in documents])
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    w, tails = np.full(ends[-1] + 1, sizes.end, np.uint16), np.full(ends[-1] + 1, -1, np.int32)
    inside = np.ones(len(w), bool)
    inside[ends] = False
    w[inside] = np.concatenate([c for c, _ in documents])
    tails[inside] = np.concatenate([t for _, t in documents])
    v, u = np.full(len(w), sizes.start, np.uint16), np.full(len(w), sizes.start, np.uint16)
    v[1:], u[2:] = w[:-1], w[:-2]
    v[starts] = u[starts] = sizes.start
    u[starts[lengths > 0] + 1] = sizes.start
    return u, v, w, tails


def coded(docs: DataFrame, words: Lexicon) -> DataFrame:
    """doc_id, held_out, the words' codes, and those outside the dictionary with how often they stand in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        lex = shared.value
        for batch in _gathered(batches):
            lengths, every = split_words(batch.column(2))
            every = every.dictionary_encode()
            at, codes = every.indices.to_numpy(), lex.encode(every.dictionary)
            missing = np.flatnonzero(codes[at] < 0)
            pairs, times = np.unique(np.repeat(np.arange(len(lengths)), lengths)[missing] * max(len(codes), 1) + at[missing], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(lengths) + 1) * max(len(codes), 1)), pa.int32())
            others = pa.ListArray.from_arrays(ends, every.dictionary.take(pa.array(pairs % max(len(codes), 1), pa.int64())))
            bounds = pa.array(np.r_[0, np.cumsum(lengths)] * codes.itemsize, pa.int32())
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, bounds.buffers()[1], pa.py_buffer(codes[at])])
            columns = [batch.column(0), batch.column(1), packed, others, pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "codes", "others", "times"])

    return _texts(docs).mapInArrow(run, "doc_id long, held_out boolean, codes binary, others array<binary>, times array<int>")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and all codes."""
    texts = column.to_pylist()
    return np.array([len(x) // 4 for x in texts], np.int64), np.frombuffer(b"".join(texts), np.int32)


def train(streams: DataFrame, words: Lexicon) -> Model:
    """A model fitted to all training documents. streams: from coded(), cut."""
    spark, sizes = streams.sparkSession, words.sizes
    shared = spark.sparkContext.broadcast(words)
    streams = streams.where("not held_out").select("codes")
    model = Model.start(words)
    for turn in range(sizes.rounds):
        begin = spark.sparkContext.broadcast(model.parts)

        def fit(batches, begin=begin, turn=turn):
            task, with_words = TaskContext.get().partitionId(), turn >= sizes.rounds - sizes.word_rounds
            trainer, tokens, held, waiting = Trainer(Model(**begin.value), shared.value, (100, turn, task)), 0, [], 0
            for batch in batches:
                lengths, codes = _codes(batch.column(0))
                bounds = np.cumsum(lengths)[:-1]
                for c, t in zip(np.split(shared.value.classes[codes], bounds), np.split(shared.value.tail_of[codes], bounds), strict=True):
                    held.append((c, t))
                    waiting += len(c) + 1
                    if waiting >= 16 * sizes.batch:
                        tokens += trainer.drain(held, with_words)
                        waiting = 0
            tokens += trainer.drain(held, with_words)
            if tokens:
                yield from _sums(trainer, tokens, task)

        sums = streams.mapInArrow(fit, SUMS)
        for keys in (["kind", "part", "grp"], ["kind", "part"]):  # no task adds up what all tasks have made at once
            sums = sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added(keys), SUMS)
        model = _averaged(model, sums.collect())  # as many rows as the parameters have parts
    return model


#: Sums of parameters in parts: kind s (shared: weighted by tokens) or w (words: a weight each), grp the group of tasks.
SUMS = "kind string, part int, grp int, weights binary, sums binary"
SIZE = 4096


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["kind", "part", "grp", "weights", "sums"])


def _sums(trainer: Trainer, tokens: int, task: int) -> Iterator[pa.RecordBatch]:
    """A task's parameters times their weights; parts of words that it hasn't met are left out."""
    flat = trainer.m.flat()
    yield _batch([("s", i // SIZE, task // FAN_IN, np.float64(tokens).tobytes(), (flat[i : i + SIZE].astype(np.float64) * tokens).tobytes()) for i in range(0, len(flat), SIZE)])
    both = np.c_[trainer.m.p, trainer.m.d].astype(np.float64)
    for i in range(0, len(both), SIZE):
        times = trainer.times[i : i + SIZE]
        if times.any():
            yield _batch([("w", i // SIZE, task // FAN_IN, times.tobytes(), (both[i : i + SIZE] * times[:, None]).astype(np.float32).tobytes())])


def _added(keys: list[str]):
    """Adds up rows that come sorted by some of kind, part and grp, one after the other."""

    def run(batches):
        key, kept, weights, sums = None, None, None, None
        for batch in batches:
            for kind, part, grp, w, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                now = (kind, part, grp)[: len(keys)]
                w, s = np.frombuffer(w), np.frombuffer(s, np.float64 if kind == "s" else np.float32).astype(np.float64)
                if now == key:
                    weights, sums = weights + w, sums + s
                    continue
                if key:
                    yield _batch([(*kept, weights.tobytes(), sums.astype(np.float64 if kept[0] == "s" else np.float32).tobytes())])
                key, kept, weights, sums = now, (kind, part, grp // FAN_IN), w, s
        if key:
            yield _batch([(*kept, weights.tobytes(), sums.astype(np.float64 if kept[0] == "s" else np.float32).tobytes())])

    return run


def _averaged(model: Model, rows: list) -> Model:
    flat, parts = model.flat().astype(np.float64), dict(model.parts)
    both = np.c_[model.p, model.d]
    for r in rows:
        weights = np.frombuffer(r["weights"])
        if r["kind"] == "s":
            mine = np.frombuffer(r["sums"])
            flat[r["part"] * SIZE : r["part"] * SIZE + len(mine)] = mine / weights
        else:
            mine = np.frombuffer(r["sums"], np.float32).reshape(len(weights), -1)
            met = np.flatnonzero(weights)
            both[r["part"] * SIZE + met] = mine[met] / weights[met, None]
    parts["p"], parts["d"] = both[:, :-1].astype(np.float32), both[:, -1].astype(np.float32)
    return Model(**parts).with_shared(flat)


class Scorer:
    """Natural log-probabilities of the tokens of documents."""

    def __init__(self, words: Lexicon, model: Model, sums: np.ndarray):
        """sums: from word_sums()."""
        self.words, self.m, self.sums = words, model, sums
        self.a1, self.a2, self.log_z = model.class_tables(words.sizes.start)
        self.log_others = np.log(words.others / words.tail_total)

    def tokens(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The class's, and in a tail class the word's, log-probability of each word and end; a word outside the dictionary has that of all such words of its class.

        documents: classes and tail words (-1: none, or a word outside the dictionary).
        """
        u, v, w, j = _with_contexts(documents, self.words.sizes)
        out = (self.a1[u, w] + self.a2[v, w] - self.log_z[u, v]).astype(np.float64)
        top = self.words.sizes.top
        i = np.flatnonzero(j >= 0)
        out[i] += np.einsum("ij,ij->i", self.m.g[v[i]], self.m.p[j[i]]) + self.m.d[j[i]] - self.sums[v[i], w[i] - top]
        i = np.flatnonzero((j < 0) & (w >= top) & (w < self.words.sizes.end))
        out[i] += self.log_others[w[i] - top] - self.sums[v[i], w[i] - top]
        return out


def score(docs: DataFrame, counts: DataFrame, words: Lexicon, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), a row per document."""
    return score_coded(_numbered(docs, words), counts, words, model)


def _numbered(docs: DataFrame, words: Lexicon) -> DataFrame:
    """coded(), cut, with a number per row."""
    return cut(coded(docs, words).withColumn("row", F.monotonically_increasing_id()))


def score_coded(texts: DataFrame, counts: DataFrame, words: Lexicon, model: Model) -> DataFrame:
    """score() of what _numbered() gives."""
    shared = texts.sparkSession.sparkContext.broadcast((words, model.parts, model.word_sums(words)))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double"
    names, types = [x.split()[0] for x in schema.split(", ")], [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        lex, parts, sums = shared.value
        scorer = Scorer(lex, Model(**parts), sums)
        none = np.zeros(lex.sizes.classes)
        logs = np.r_[np.log10(lex.counts + 1.0), none]  # by code, as the next
        log_shares = np.r_[np.zeros(len(lex.counts)), none]  # a word outside the dictionary has its count and one of these
        log_shares[-1 - np.arange(lex.sizes.top, lex.sizes.end)] = np.log10(lex.others)
        end_log, to10 = math.log10(lex.ends + 1), 1 / math.log(10)
        for batch in batches:
            lengths, codes = _codes(batch.column(3))
            if not len(lengths):
                continue
            bounds = np.cumsum(lengths)[:-1]
            by_token = scorer.tokens(list(zip(np.split(lex.classes[codes], bounds), np.split(lex.tail_of[codes], bounds), strict=True)))
            total = np.add.reduceat(by_token, np.r_[0, np.cumsum(lengths + 1)[:-1]]) * to10
            of = np.repeat(np.arange(len(lengths)), lengths)
            total -= np.bincount(of, log_shares[codes], len(lengths))
            base = np.bincount(of, logs[codes], len(lengths)) + end_log
            known = np.bincount(of, codes >= 0, len(lengths)).astype(np.int64) + (lex.ends > 0)
            out = [*batch.columns[:3], lengths + 1, known, base, total]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    bounded_batches(texts.sparkSession)
    local = texts.select("row", "doc_id", "held_out", "codes").mapInArrow(run, schema)
    asked = texts.select("row", F.explode(F.arrays_zip(F.col("others").alias("word"), F.col("times").alias("times"))).alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.times").alias("times"))
    joined = asked.join(counts, "word")  # unknown words add nothing
    rare = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("rare_logs"), F.sum("times").alias("rare_known"))
    none = math.log10(words.total + words.distinct + 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return local.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("rare_logs") - none * F.col("n_tokens")).alias("base_score"), (F.col("model") + zero("rare_logs")).alias("score"),
    )


def scored(docs: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """Counts, trains on and scores docs."""
    counts = cut(count_words(docs))
    words = lexicon(counts, sizes)
    texts = _numbered(docs, words)
    return score_coded(texts, counts, words, train(texts, words))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op1_lm_score": op1_lm_score}
SQL: dict[str, str] = {}
