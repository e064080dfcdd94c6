"""Chat formatting with a compiled template, and reading it back.

Turns stand between control strings. A control string inside a text gets a backslash behind its first character, a
backslash is doubled, and reading takes one backslash away again, so that every text comes back as it was and none can
look like a turn. Generation markers give the spans of the output that a model learns from.

Conversations are dealt by id and sorted by turn on disk; a task renders its rows as a stream, one turn in memory at a
time, so that a conversation of any length needs no more memory than its longest turn.

Cases: null texts and roles are empty; turns of equal number go by role and text, a null number first; repeated rows
are turns of their own; rows without a conv_id make one conversation without id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.common import bounded_batches, table
from quaystone.llm.templates import compile_template

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for turn in turns %}<s>{{ turn.role | escape }}[INST]"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}[/INST]</s>{% endfor %}"
)
_UNSAFE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))


def escape(text: str | None) -> str:
    return _UNSAFE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS = {"escape": escape, "trim": lambda v: (v or "").strip(), "upper": lambda v: (v or "").upper(), "lower": lambda v: (v or "").lower()}


@cache
def renderer(source: str = TEMPLATE):
    return compile_template(source, FILTERS)


class Text:
    """A sink that keeps the whole output and the spans of its generation parts."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def begin(self) -> None:
        self.spans.append([self.length, self.length])

    def end(self) -> None:
        self.spans[-1][1] = self.length

    @property
    def text(self) -> str:
        return "".join(self.parts)


class Reader(Text):
    """A sink that reads turns and learnt texts back from the output as it comes, and drops what it has read.

    turn(role, text) and learnt(text) are called in order.
    """

    def __init__(self, turn, learnt):
        super().__init__()
        self.turn, self.learnt, self.rest, self.at = turn, learnt, "", 0

    def write(self, text: str) -> None:
        self.length += len(text)
        self.rest += text
        while (cut := self.rest.find("</s>")) >= 0:
            start, mid, end = len("<s>"), self.rest.index("[INST]"), cut - len("[/INST]")
            self.turn(unescape(self.rest[start:mid]), unescape(self.rest[mid + len("[INST]") : end]))
            for a, b in self.spans:
                self.learnt(unescape(self.rest[a - self.at : b - self.at]))
            self.spans.clear()
            self.rest, self.at = self.rest[cut + len("</s>") :], self.at + cut + len("</s>")


def _digest(turns) -> list:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of an iterable of turns."""
    said, learnt, counts = hashlib.sha256(), hashlib.sha256(), [0, 0]

    def turn(role: str, text: str) -> None:
        counts[0] += 1
        said.update(f"{role}\n{text}\n".encode())

    def learn(text: str) -> None:
        counts[1] += len(text)
        learnt.update(text.encode())

    sink = Reader(turn, learn)
    renderer()({"turns": turns}, sink)
    return [counts[0], said.hexdigest(), counts[1], learnt.hexdigest(), sink.length]


def _rows(batches):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _in_order(conversations: DataFrame) -> DataFrame:
    bounded_batches(conversations.sparkSession)
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches):
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        yield conv, ({"role": r[2], "text": r[3]} for r in rows)


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, the formatted text, and the code point spans that are learnt; for conversations that fit in memory."""

    def run(batches):
        for conv, turns in _conversations(batches):
            sink = Text()
            renderer()({"turns": turns}, sink)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sink.text]), pa.array([sink.spans], pa.list_(pa.list_(pa.int64())))], names=["conv_id", "text", "spans"])

    return _in_order(conversations).mapInArrow(run, "conv_id long, text string, spans array<array<long>>")


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted output, a row per conversation, as a stream."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        some: list = []
        for conv, turns in _conversations(batches):
            some.append([conv, *_digest(turns)])
            if len(some) == 1000:
                yield pack(some)
                some = []
        yield pack(some)

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return _in_order(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))


QUERIES = {"op3_chat_format": op3_chat_format}
SQL = {
    "op3_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text)
  + length(regexp_replace(role || text, '[^\\]', '', 'g'))
  + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]')) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]')) + 20 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""
}
