"""Byte automata: regular expressions by subset construction and minimisation into transition arrays.

Syntax: literals, escapes (\\xHH, \\. and the like), classes, groups, alternation and ? * + {m} {m,} {m,n}.
"""

from __future__ import annotations

from dataclasses import dataclass, field

EMPTY = ("cat", [])


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def either(self):
        arms = [self.sequence()]
        while self.peek() == "|":
            self.take()
            arms.append(self.sequence())
        return arms[0] if len(arms) == 1 else ("alt", arms)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.single()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                low, _, high = (body := self.s[self.i : self.s.index("}", self.i)]).partition(",")
                self.i += len(body) + 1
                lo, hi = int(low), (int(high) if high else None if "," in body else int(low))
            else:
                lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("cat", [node] * lo + ([("star", node)] if hi is None else [("alt", [node, EMPTY])] * (hi - lo)))
        return node

    def single(self):
        c = self.take()
        if c == "(":
            node = self.either()
            self.take()
            return node
        if c == "[":
            return ("set", self.members())
        return ("set", self.folded({self.code(c)}))

    def code(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self) -> frozenset[int]:
        negated, out = self.peek() == "^", set()
        if negated:
            self.take()
        while (c := self.take()) != "]":
            low = self.code(c)
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                out |= set(range(low, self.code(self.take()) + 1))
            else:
                out.add(low)
        out = set(self.folded(out))
        return frozenset(set(range(256)) - out if negated else out)

    def folded(self, codes: set[int]) -> frozenset[int]:
        if self.fold:
            codes = codes | {c ^ 32 for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(codes)


def parse(pattern: str, fold: bool = False):
    """The syntax tree; fold: ASCII letters in either case."""
    return _Parser(pattern, fold).either()


def reverse(node):
    kind, x = node
    if kind == "set":
        return node
    if kind == "star":
        return (kind, reverse(x))
    parts = [reverse(p) for p in x]
    return (kind, parts[::-1] if kind == "cat" else parts)


@dataclass
class _Nfa:
    moves: list = field(default_factory=list)
    free: list = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Builds node from start on; the state in which it ends."""
        kind, x = node
        if kind == "set":
            end = self.state()
            self.moves[start].append((x, end))
            return end
        if kind == "cat":
            for part in x:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "star":
            inner = self.state()
            self.free[start] += [inner, end]
            self.free[self.add(x, inner)] += [inner, end]
        else:
            for part in x:
                inner = self.state()
                self.free[start].append(inner)
                self.free[self.add(part, inner)].append(end)
        return end


@dataclass
class Dfa:
    """rows[s][b]: the state after byte b; accepts[s]: a bit for each rule that ends in s. State 0 is the start."""

    rows: list[list[int]]
    accepts: list[int]


def compile_rules(trees: list, anywhere: bool = False) -> Dfa:
    """One minimal automaton of all trees; anywhere: a match may begin at any byte."""
    nfa = _Nfa()
    root, bits = nfa.state(), {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.free[root].append(first)
        end = nfa.add(tree, first)
        bits[end] = bits.get(end, 0) | 1 << k

    def closed(states) -> frozenset[int]:
        todo = list(states)
        seen = set(todo)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in bits)

    always = closed([root])
    sets = list({codes for moves in nfa.moves for codes, _ in moves})
    alike: dict = {}  # bytes that every set holds or lacks together
    kind = [alike.setdefault(tuple(b in codes for codes in sets), len(alike)) for b in range(256)]
    sample = [kind.index(k) for k in range(len(alike))]
    numbers, order, rows = {always: 0}, [always], []
    for now in order:
        moves, row = [m for s in now for m in nfa.moves[s]], []
        for b in sample:
            nxt = closed(t for codes, t in moves if b in codes)
            nxt = nxt | always if anywhere else nxt
            if nxt not in numbers:
                numbers[nxt] = len(order)
                order.append(nxt)
            row.append(numbers[nxt])
        rows.append(row)
    accepts = [0] * len(order)
    for i, now in enumerate(order):
        for s in now:
            accepts[i] |= bits.get(s, 0)
    dfa = minimise(Dfa(rows, accepts))
    return Dfa([[row[k] for k in kind] for row in dfa.rows], dfa.accepts)


def minimise(dfa: Dfa) -> Dfa:
    """Splits classes of states until their members have like successors."""
    part = {a: i for i, a in enumerate(dict.fromkeys(dfa.accepts))}
    of, count = [part[a] for a in dfa.accepts], len(part)
    while True:
        seen: dict = {}
        new = [seen.setdefault((of[s], tuple(of[t] for t in row)), len(seen)) for s, row in enumerate(dfa.rows)]
        of = new
        if len(seen) == count:
            break
        count = len(seen)
    rows, accepts = [None] * count, [0] * count
    for s, row in enumerate(dfa.rows):
        rows[of[s]], accepts[of[s]] = [of[t] for t in row], dfa.accepts[s]
    return Dfa(rows, accepts)  # classes are numbered as first met, so state 0 stays the start


def linked(dfa: Dfa) -> list:
    """The start row; row[b] is the next row, row[256] the rules that end there, row[257] whether nothing can follow."""
    rows = [[None] * 258 for _ in dfa.rows]
    for i, (row, numbers, accept) in enumerate(zip(rows, dfa.rows, dfa.accepts, strict=True)):
        row[:256] = [rows[t] for t in numbers]
        row[256:] = accept, not accept and all(t == i for t in numbers)
    return rows[0]
