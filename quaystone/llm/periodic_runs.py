"""Periodic runs of words, by a suffix automaton whose suffix links are a link-cut tree.

Every node of the automaton's link tree knows where its strings ended last. A preferred path of the link-cut tree holds
nodes with one such end, so each appended word is one access: the path from the new node to the root falls into segments
of one former end t each, whose deepest node has some length. Where the distance d from t to the new end is within
that length, the stretch from t minus the length on has period d and holds a square; d is its smallest period and its
start can't move left. The same start and period come again with every further word, so the last end makes it a run.

A word of a run of 12 words or more lies in a window of six words that stands in the run twice. Words in no window that
stands twice are in no run, so a text is cut at them, and its parts again, before the automaton reads what is left.

Cases: null and empty texts have no words and no runs; documents are rows, so repeated rows and rows without a doc_id
each get a result; memory is in proportion to the longest text (some 600 bytes a word that the automaton reads); extra
columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.common import add_columns, table, text_bytes
from quaystone.llm.shingles import windows

#: A run has so many words at least; half of them stand in it twice in a row.
LEAST = 12
HALF = LEAST // 2


class LastEnds:
    """A suffix automaton of the words appended so far; append() gives the runs that the new word continues or closes."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        #: The link-cut tree: children and parent in the splay tree of a preferred path; the parent of its root is where the path hangs.
        self.left, self.right, self.up = [-1], [-1], [-1]
        #: Of the root of a splay tree: where the strings of the path's nodes ended last.
        self.ended = [-1]
        self.last = 0

    def _node(self, length: int, link: int, follow: dict) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        for field in (self.left, self.right, self.up, self.ended):
            field.append(-1)
        return len(self.length) - 1

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if z >= 0 and left[z] == y:
            left[z] = x
        elif z >= 0 and right[z] == y:
            right[z] = x
        else:
            self.ended[x] = self.ended[y]
        up[x] = z
        near, far = (left, right) if left[y] == x else (right, left)
        moved = far[x]
        near[y] = moved
        if moved >= 0:
            up[moved] = y
        far[x] = y
        up[y] = x

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        while (y := up[x]) >= 0 and (left[y] == x or right[y] == x):
            if (z := up[y]) >= 0 and (left[z] == y or right[z] == y):
                self._rotate(y if (left[y] == x) == (left[z] == y) else x)
            self._rotate(x)

    def _state(self, word: int) -> tuple[int, int]:
        """The new node of the whole text and its parent; a node that must be divided gets its upper part on the same preferred path."""
        follow, link, length = self.next, self.link, self.length
        p = self.last
        new = self.last = self._node(length[p] + 1, 0, {})
        while p >= 0 and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if p < 0:
            return new, 0
        q = follow[p][word]
        if length[p] + 1 == length[q]:
            link[new] = q
            return new, q
        upper = self._node(length[p] + 1, link[q], follow[q].copy())
        while p >= 0 and follow[p].get(word) == q:
            follow[p][word] = upper
            p = link[p]
        link[q] = link[new] = upper
        self._splay(q)
        above = self.left[q]
        self.left[upper], self.left[q], self.up[upper] = above, upper, q
        if above >= 0:
            self.up[above] = upper
        return new, upper

    def append(self, word: int) -> list[tuple[int, int]]:
        """(start, period) of the stretches with two periods and more that end with this word."""
        new, x = self._state(word)
        left, right, up, ended, length = self.left, self.right, self.up, self.ended, self.length
        end, below, found = length[new], new, []
        up[new] = x
        while x >= 0:
            if (y := up[x]) >= 0 and (left[y] == x or right[y] == x):
                self._splay(x)
            t = ended[x]
            if end - t <= length[x]:
                found.append((t - length[x], end - t))
            if (cut := right[x]) >= 0:
                ended[cut] = t
            right[x] = below
            below, x = x, up[x]
        ended[below] = end
        self._splay(new)
        return found


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    ends, text, ids = {}, LastEnds(), {}
    for i, word in enumerate(words):
        for run in text.append(ids.setdefault(word, len(ids))):
            ends[run] = i + 1
    return sorted((s, e - s, p) for (s, p), e in ends.items() if e - s >= max(LEAST, 2 * p))


def _repeating(h: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
    """The parts of the words from first to before last that may hold runs; h: hashes of the windows of HALF words."""
    if last - first < LEAST:
        return []
    own = h[first : last - HALF + 1]
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(own) + HALF, np.int32)
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, at, 1)
    np.add.at(twice, at + HALF, -1)
    covered = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(twice[:-1]) > 0, [0]]).astype(np.int8)))
    parts = [(first + int(a), first + int(b)) for a, b in zip(covered[::2], covered[1::2])]
    return parts if parts == [(first, last)] else [x for a, b in parts for x in _repeating(h, a, b)]


def document(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a document's words."""
    if len(words) < LEAST:
        return []
    parts = _repeating(windows(words, HALF), 0, len(words))
    return [(a + s, n, p) for a, b in sorted(parts) for s, n, p in runs_of(words[a:b])]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run the first period only."""
    if runs:
        keep = np.ones(len(words), bool)
        for s, n, p in runs:
            keep[s + p : s + n] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def _batch(texts: list[bytes]) -> list[list]:
    split = [t.split() for t in texts]
    runs = [document(w) for w in split]
    return [list(map(len, split)), [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], [collapsed(w, r) for w, r in zip(split, runs)]]


def scan(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns (doc_id, if none are named) with n_words, runs (an array of start, length and period, by start, then period) and the collapsed text."""
    made = add_columns(docs, text_bytes(), _batch, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary", *(kept or ("doc_id",)))
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tail() -> Column:
    """The text, of one document in ten with words from some place on that repeat with a period; both follow from crc32(doc_id)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    joined = F.array_join(F.concat(F.slice(words, 1, a.cast("int")), F.slice(tail, 1, (n - a).cast("int"))), " ")
    return F.when((h % 10 == 0) & (n > 0), joined).otherwise(F.col("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of the result of scan(): the number of runs, the longest (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    length, period = best["length"], -best["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(table(spark, sf_dir, "documents").withColumn("text", repeated_tail())))


#: SQL can't follow repeats of any period in reasonable time; tests hold it against a plain form.
SQL: dict[str, str] = {}
QUERIES = {"op11_periodic_runs": op11_periodic_runs}
