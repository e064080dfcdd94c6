"""A bidirectional FM-index of word numbers, whose intervals are extended by all words at once, in numpy.

The text is an array of word numbers from 1 on; 0 ends a piece. Suffixes are sorted by their first words only, as many as
the longest phrase that is asked for: intervals of phrases up to that length are the same as in the full order, whatever
the order of ties. The index holds the last column of that order (the word before each suffix) of the text and of the
reversed text. Backward search needs how often a word stands in the column before a place; the column's places, sorted by
word and place, give that by binary search for any number of intervals.
"""

from __future__ import annotations

import numpy as np


def _ranks(key: np.ndarray) -> np.ndarray:
    """Numbers from 0 on of equal order, as small as may be."""
    order = np.argsort(key)
    steps = np.zeros(len(key), np.int64)
    in_order = key[order]
    np.cumsum(in_order[1:] != in_order[:-1], out=steps[1:])
    out = np.empty(len(key), np.int64)
    out[order] = steps
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a text (what comes after its end is smaller than all words) in the order of their first depth words."""
    words = text.astype(np.int64) + 1
    base = int(words.max()) + 1
    key, most = words, base
    for at in range(1, depth):
        if most > (1 << 62) // base:  # as many words in a number as fit
            key, most = _ranks(key), len(words)
        key = key * base
        key[: max(0, len(words) - at)] += words[at:]
        most *= base
    return np.argsort(key)


class Side:
    """The last column of one direction."""

    def __init__(self, text: np.ndarray, depth: int, words: int):
        order = suffix_order(text, depth)
        self.column = text[order - 1].astype(np.int64)
        self.column[order == 0] = 0
        n = len(text)
        self.n = n
        self.keys = np.sort(self.column * n + np.arange(n))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=words + 1))])  # suffixes that begin with a smaller word
        self.before = np.searchsorted(self.keys, np.arange(words + 2) * n)

    def step(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the suffixes that begin with word and go on as those before place end."""
        return self.first[word] + np.searchsorted(self.keys, word * self.n + place) - self.before[word]


class Index:
    """Phrases as columns of words with an interval in each direction; extend() makes the longer ones."""

    def __init__(self, text: np.ndarray, words: int, depth: int):
        text, self.words = np.concatenate([[0], text, [0]]), words  # every word is followed and preceded by something
        self.sides = (Side(text, depth, words), Side(text[::-1], depth, words))

    def single(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(phrases, starts, counts) of the words that occur: a row of words each, the interval's start by direction, its size."""
        starts = self.sides[0].first
        counts = np.diff(starts)
        at = np.flatnonzero(counts[1:]) + 1
        return at[:, None], (starts[at], self.sides[1].first[at]), counts[at]

    def extend(self, phrases: np.ndarray, starts: tuple, counts: np.ndarray, right: bool) -> tuple:
        """All phrases that are one word longer on one side, each once, in the same form."""
        mine, other = (self.sides[1], 1), (self.sides[0], 0)
        (side, own), (_, far) = (mine, other) if right else (other, mine)
        total = int(counts.sum())
        group = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        word = side.column[np.repeat(starts[own], counts) + inside]
        key = np.sort(group * (self.words + 1) + word)  # the words next to each phrase, in order
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.empty(0, np.int64)
        size = np.diff(np.append(edge, total))
        group, word = np.divmod(key[edge], self.words + 1)
        real = word > 0
        group, word, size, edge = group[real], word[real], size[real], edge[real]
        lower = edge - (np.cumsum(counts) - counts)[group]  # occurrences with a smaller word on that side
        at = (side.step(word, starts[own][group]), starts[far][group] + lower)
        grown = np.column_stack([phrases[group], word] if right else [word, phrases[group]])
        return grown, at if own == 0 else at[::-1], size
