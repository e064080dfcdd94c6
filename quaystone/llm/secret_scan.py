"""Secret scans by one automaton of all rules.

The rules' expressions become one minimal automaton over bytes that may start anywhere; a text is read once, byte by
byte, and where rules end is noted. For those few places an automaton of the reversed rule finds the leftmost start
behind the rule's former match, and the rule's own automaton the longest end. Spans shorter than their rule asks for
are dropped after matching, as they use up their bytes. That is leftmost matching as expressions have it for rules like
these, whose ends don't depend on where they start; a rule of one's own should be of that kind.

Cases: null and empty texts have no spans; bytes that aren't UTF-8 count as a code point each; repeated documents each get a row; offsets are code points, end exclusive;
columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.automata import compile_rules, linked, parse, reverse
from quaystone.llm.common import add_columns, as_bytes, map_batches, table


@dataclass(frozen=True)
class Rule:
    """value: an expression for the part of a match that must have at least shortest bytes; none: the whole match."""

    kind: str
    pattern: str
    shortest: int = 1
    fold: bool = False
    value: str | None = None


# The base rules of the contract, then published token formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, True, r"""^[^:=]*[:=]\x20*["']?(.*)$"""),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{8,}", 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("stripe", r"(sk|rk)_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", 20),
)
BASE = ("assign", "access", "hex")


@cache
def _machines(rules: tuple[Rule, ...]):
    """The start rows of the combined automaton, and of each rule's own and reversed one."""
    trees = [parse(r.pattern, r.fold) for r in rules]
    return linked(compile_rules(trees, anywhere=True)), [linked(compile_rules([t])) for t in trees], [linked(compile_rules([reverse(t)])) for t in trees]


def _runs(row: list, data: bytes) -> list[tuple[int, int]]:
    """(offset, rules) wherever the set of rules that end behind a byte changes."""
    out, last = [], 0
    for i, b in enumerate(data):
        row = row[b]
        if row[256] != last:
            last = row[256]
            out.append((i, last))
    if last:
        out.append((len(data), 0))
    return out


def _furthest(row: list, data: bytes, at: int, stop: int, step: int) -> int:
    """How many bytes from offset at on the longest accepted prefix has; 0: none. Ends early in the dead state."""
    best = 0
    for i in range(at, stop, step):
        row = row[data[i]]
        if row[256]:
            best = abs(i - at) + 1
        elif row[257]:
            break
    return best


def byte_spans(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, rule number) in bytes, by start and rule; long enough ones only."""
    combined, own, back = _machines(rules)
    runs, out = _runs(combined, data), []
    if not runs:
        return out
    for k, rule in enumerate(rules):
        free, on = 0, None
        for at, mask in runs:
            if mask >> k & 1:
                on = at if on is None else on
                continue
            if on is None:
                continue
            first, on = on + 1, None  # the rule ends behind the bytes first - 1 to at - 1
            while first <= at:
                n = _furthest(back[k], data, first - 1, free - 1, -1)
                if not n:
                    first += 1
                    continue
                start = first - n
                end = start + _furthest(own[k], data, start, len(data), 1)
                free, first = end, max(end, first) + 1
                out.append((start, end, k))
    return sorted(s for s in out if _value_length(data, s, rules[s[2]]) >= rules[s[2]].shortest)


def _value_length(data: bytes, span: tuple[int, int, int], rule: Rule) -> int:
    text = data[span[0] : span[1]].decode(errors="replace")
    return len(re.match(rule.value, text)[1] if rule.value else text)


def text_spans(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    spans = byte_spans(data, rules)
    if not spans or data.isascii():
        return [(rules[k].kind, a, b) for a, b, k in spans]
    at, points, out = 0, 0, []
    for a, b, k in spans:
        points += len(data[at:a].decode(errors="replace"))
        at = a
        out.append((rules[k].kind, points, points + len(data[a:b].decode(errors="replace"))))
    return out


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(cols):
    out = [cols[0], [], [], [], [], []]
    for data in cols[1]:
        spans = text_spans(data)
        for i, kind in enumerate(BASE, 1):
            out[i].append(sum(s[0] == kind for s in spans))
        out[4].append(hashlib.sha256(_join(s for s in spans if s[0] in BASE).encode()).hexdigest())
        out[5].append(_join(spans))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, a count per base kind, a digest of the base spans and all spans, a row per document."""
    return map_batches(as_bytes(docs, "doc_id"), _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(data: bytes) -> str:
    """The text with [kind] in place of each secret; overlapping spans are one, named by the first."""
    out, at = [], 0
    for a, b, k in byte_spans(data):
        if a >= at:
            out += [data[at:a], f"[{RULES[k].kind}]".encode()]
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode(errors="replace")


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text and n_chars to match; all else as it was, null texts too."""

    rest = [c for c in docs.columns if c != "text"]
    out = add_columns(docs, F.col("text").cast("binary"), lambda texts: [[None if t is None else redacted(t) for t in texts]], "text string", *rest)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return redact(docs)


QUERIES = {"op4_secret_scan": op4_secret_scan}
SQL: dict[str, str] = {}
