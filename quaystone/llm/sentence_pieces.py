"""SentencePiece encoding and decoding of merge-type models, exact, by backtracking.

A text is cut where no piece can span (before a run of space marks and around line ends), and each segment is encoded
on its own: an Aho-Corasick automaton gives the longest piece from every place; pieces are taken greedily; a piece may
follow its predecessor only if merging the two from characters again gives the same two pieces; otherwise the next
shorter piece is tried, and places from which all fail are marked in a bitfield and never tried again. Merging joins
the adjacent pair with the best score first, the leftmost of equals, so a sequence whose neighbours all pass is what
merging the whole segment gives. Characters outside the vocabulary become byte pieces.

Cases: null and empty texts have no tokens and decode to an empty text; repeated documents each get a row; texts of
any length are whole (memory grows with the text, time in proportion); columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import groupby

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from quaystone.llm.common import as_bytes, map_batches, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Segments kept with their ids in a worker.
MOST_KEPT = 250_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces and scores of a model file, with the encoder's tables."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("a merge-type model without normalisation rules is needed")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        # the rank of a piece: the lower, the earlier it is merged
        by_score = sorted((i for i, t in enumerate(self.types) if t == NORMAL), key=lambda i: -proto.pieces[i].score)
        self.rank = {self.pieces[i]: r for r, i in enumerate(by_score)}
        self.id = {self.pieces[i]: i for i in by_score}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank) or any(t == USER for t in self.types):
            raise ValueError("a piece spans a place where texts are cut")
        # pieces that merging doesn't reach are never part of a result
        self.whole = {p for p in self.rank if len(p) == 1 or self.merged(p) == [p]}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.whole), None) for p in self.whole}
        self.characters = {p for p in self.whole if len(p) == 1}
        self.surface = [None if t == BYTE else "" if t == CONTROL else p.replace(MARK, " ") for p, t in zip(self.pieces, self.types)]
        self.automaton = ahocorasick.Automaton()
        for p in self.whole:
            self.automaton.add_word(p, (p, len(p) - 1))
        self.automaton.make_automaton()
        self.parts: dict[str, tuple[str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def merged(self, s: str) -> list[str]:
        """The pieces of s by merging, the plain way."""
        parts = list(s)
        while True:
            best = min(((self.rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b again.

        Merges are undone latest first on the side whose piece ranks later. Each state is then a moment of merging a
        and b apart: if the two pieces at the border could have merged at a better rank than that of the merge that
        came next (or at the same rank further left), merging a + b would have joined them.
        """
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self._apart(a, b)
        return found

    def _apart(self, a: str, b: str) -> bool:
        rank, never = self.rank, 1 << 30
        limit = never
        while True:
            if rank.get(a + b, never) < limit:
                return False
            ra, rb = (rank[a] if len(a) > 1 else -1), (rank[b] if len(b) > 1 else -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves(a)[1]  # a tie would go to the merge in a, which is further left
            else:
                limit, b = rb + 1, self.halves(b)[0]  # a tie would go to the border

    def halves(self, p: str) -> tuple[str, str]:
        """The two pieces whose merge made p."""
        found = self.parts.get(p)
        if found is None:
            parts = list(p)
            while len(parts) > 2:
                _, i = min((self.rank.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self.parts[p] = tuple(parts)
        return found

    def split(self, s: str) -> list[str]:
        """The pieces of a segment of known characters, by backtracking."""
        n = len(s)
        longest: list = [None] * n
        for end, (p, back) in self.automaton.iter(s):  # by end, so the longest from a place comes last
            longest[end - back] = p
        fitting = self.pairs
        out: list[str] = []
        failed = bytearray((n >> 3) + 1)  # bit i: nothing fits from place i
        at, piece = 0, longest[0]
        while True:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or (fitting.get((out[-1], piece)) if (out[-1], piece) in fitting else self.fits(out[-1], piece))):
                    break
                piece = self.shorter[piece]
            if piece is not None:
                out.append(piece)
                at = end
                if at == n:
                    return out
                piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                piece = self.shorter[last]

    def ids(self, segment: str) -> list[int]:
        """Ids of a segment; characters that aren't in the vocabulary stand alone."""
        if self.characters.issuperset(segment):
            return [self.id[p] for p in self.split(segment)] if segment else []
        out = []
        for known, part in groupby(segment, self.characters.__contains__):
            if known:
                out += self.ids("".join(part))
            else:
                out += [self.bytes[b] for b in "".join(part).encode()] if self.bytes else [self.unknown for _ in part]
        return out

    def known(self, segment: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, and what they decode to, of a segment."""
        found = self.kept.get(segment)
        if found is None:
            found = self.older.get(segment)
            if found is None:
                ids = self.ids(segment)
                found = len(ids), ",".join(map(str, ids)), self.decode(ids)
            if len(segment) <= 64:
                if len(self.kept) >= MOST_KEPT:
                    self.kept, self.older = {}, self.kept
                self.kept[segment] = found
        return found

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        return _CUT.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def decode(self, ids: list[int], first: bool = False) -> str:
        """Pieces joined, byte pieces as UTF-8 (U+FFFD for each byte that isn't); first: of a text's beginning."""
        if None not in (parts := [self.surface[i] for i in ids]):
            text = "".join(parts)
        else:
            out, raw = [], bytearray()
            for i, part in zip(ids, parts, strict=True):
                if part is None:
                    raw.append(int(self.pieces[i][3:5], 16))
                else:
                    out += [raw.decode(errors="replace"), part]
                    raw.clear()
            text = "".join(out) + raw.decode(errors="replace")
        return text[1:] if first and self.prefix and text.startswith(" ") else text


#: A line end, or a run of marks with what follows up to the next mark or line end.
_CUT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


@cache
def model(path: str) -> Model:
    return Model(path)


def encode(text: str, m: Model) -> list[int]:
    return [i for s in m.segments(text) for i in m.ids(s)]


def encoder(path: str):
    def run(cols):
        m = model(path)
        out = [cols[0], [], [], []]
        for raw in cols[1]:
            parts = [m.known(s) for s in m.segments(raw.decode(errors="replace"))]
            out[1].append(sum(p[0] for p in parts))
            out[2].append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
            text = "".join([p[2] for p in parts])
            text = text[1:] if m.prefix and text.startswith(" ") else text
            out[3].append(hashlib.sha256(text.encode()).hexdigest())
        return out

    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, a row per document."""
    return map_batches(as_bytes(docs, "doc_id"), encoder(path or default_model()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids as an array, a row per document."""
    path = path or default_model()
    return map_batches(as_bytes(docs, "doc_id"), lambda cols: [cols[0], [encode(t.decode(errors="replace"), model(path)) for t in cols[1]]], "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of a frame of doc_id and ids; null ids as none."""
    path = path or default_model()
    return map_batches(ids.select("doc_id", "ids"), lambda cols: [cols[0], [model(path).decode(x or [], True) for x in cols[1]]], "doc_id long, text string")


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and decoded text."""
    return encoded(docs)


QUERIES = {"op7_sentence_pieces": op7_sentence_pieces}
SQL: dict[str, str] = {}
