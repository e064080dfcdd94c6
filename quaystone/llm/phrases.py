"""Phrase collocations: counts of phrases from an FM-index per shard, summed over shards, scored by their weakest cut.

Texts are cut into pieces and words and packed into shards of one language, each with its own word numbers. A shard's
FM-index of both directions (fm_index.py) gives every phrase of its text once, with its count, by extending intervals of
shorter phrases to the left and to the right in turn. The sum over shards of a phrase is its count.

Few phrases reach the least count, and most others stand in one shard or two; they aren't sent as text. In a first pass each
shard sends the hashes (at most 64 bits) and counts of its phrases of two and three words, packed by ranges of the hash; a range that adds
them up returns the hashes that may reach the least count to the shards that have them. In a second pass a shard indexes
only the stretches of words whose pairs came back, extends a phrase only by words whose triple came back, and sends what
it finds as text with exact counts, again packed by ranges. Hashes that meet by chance only send a phrase for nothing:
sums are taken by text.

The (k+1)-word phrases are the left and right extensions of the k-word ones: a phrase all of whose occurrences have one
extension in common is dropped for it. As counts can't grow with length, the next longer phrases settle that for all.

Cases: null and empty texts have no words; a null lang is und; rows are counted as they come, repeated ones too, with or
without a doc_id; a text of any length is cut into shards at its pieces; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.llm.common import SALTS, bounded_batches, cut, drop_cut, salted_join, table, text_bytes
from quaystone.llm.fm_index import Index
from quaystone.llm.shingles import mix

MOST_WORDS, LEAST_COUNT, TOP = 5, 100, 2_000
#: Words of a shard; a task with many languages packs them all once it holds twice as many.
SHARD = 1 << 20
#: Hashes in a range that one task adds up at a time.
RANGE = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)
UPPER, LOWER, ENDS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(UPPER.encode() + ENDS, LOWER.encode() + b"." * len(ENDS))


class _Numbers(dict):
    """Numbers of words in the order in which they come; a piece's end is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: bytes) -> list[bytes]:
    """The words, A-Z lower-cased, with a full stop for each end of a piece."""
    return text.translate(_PLAIN).replace(b".", b" . ").split()


def planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, first the lowest byte of all, then the next: the upper ones are nearly all 0."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


SHARD_SCHEMA = "lang string, words array<binary>, counts array<long>, codes binary, n_words long"


class _Packer:
    """The texts of one language that a task has read so far."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers, self.parts, self.size = _Numbers({b".": 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(words) + 1

    def row(self, lang: str) -> pa.RecordBatch:
        """Words get numbers by falling count, so that most are small."""
        codes = np.concatenate(self.parts)
        counts = np.bincount(codes, minlength=len(self.numbers))
        order = np.argsort(-counts[1:], kind="stable") + 1
        new = np.zeros(len(counts), np.int64)
        new[order] = np.arange(1, len(counts))
        codes = new[codes]
        codes = codes[np.append((codes[1:] > 0) | (codes[:-1] > 0), False)] if len(codes) > 1 else codes  # one end between pieces
        words = np.array(list(self.numbers), object)[order].tolist()
        columns = [[lang], [words], [counts[order].tolist()], [planes(codes)], [int(counts[1:].sum())]]
        types = [pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "words", "counts", "codes", "n_words"])


def shards(docs: DataFrame) -> DataFrame:
    """shard and SHARD_SCHEMA: the texts of a task by language, as word numbers with their dictionary."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        open_ones: dict[str, _Packer] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words, at = tokens(text), 0
                packer = open_ones.setdefault(lang, _Packer())
                while len(words) - at > SHARD:  # a very long text: up to the last end of a piece within reach, if there is one
                    end = next((i for i in range(at + SHARD, at, -1) if words[i] == b"."), None)
                    end = end or next((i for i in range(at + SHARD, len(words)) if words[i] == b"."), len(words))
                    packer.add(words[at:end])
                    yield packer.row(lang)
                    at = end
                packer.add(words[at:] if at else words)
                if packer.size >= SHARD:
                    yield packer.row(lang)
            if sum(p.size for p in open_ones.values()) >= 2 * SHARD:
                yield from (p.row(k) for k, p in open_ones.items() if p.size)
                open_ones = {}
        yield from (p.row(k) for k, p in open_ones.items() if p.size)

    made = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_bytes().alias("text")).mapInArrow(run, SHARD_SCHEMA)
    return made.withColumn("shard", F.monotonically_increasing_id())


class _Hashes:
    """Hashes of the phrases of a shard, as the number of a range (upper half) and 32 bits within it."""

    def __init__(self, lang: str, words: pa.Array, ranges: int):
        self.start = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        self.of_word = np.concatenate([np.zeros(1, np.uint64), np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))])
        self.ranges = np.uint64(ranges)

    def __call__(self, *columns: np.ndarray) -> np.ndarray:
        h = np.full(len(columns[0]), self.start + np.uint64(len(columns)), np.uint64)
        for c in columns:
            h = h * _P + self.of_word[c]
        h = mix(h)
        return ((h >> np.uint64(32)) % self.ranges << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, their sums, and for each of the given keys the number of its own."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    first = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return in_order[first], np.add.reduceat(counts[order], first), of


def _pack(keys: np.ndarray) -> bytes:
    """Keys of one range, in order, by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(from_planes(b)).astype(np.uint64)


def short_phrases(found: DataFrame, ranges: int, least: int) -> DataFrame:
    """shard, part (of the hashes), keys and counts (up to least) of the phrases of two and three words of each shard."""
    names = ["shard", "part", "keys", "counts"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, lang, words = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].values
                hashes, index = _Hashes(lang, words, ranges), Index(from_planes(batch.column(3)[i].as_py()), len(words), 3)
                pairs = index.extend(*index.single(), True)
                triples = index.extend(*pairs, False)
                if not len(pairs[0]):
                    continue
                keys, counts, _ = _added(np.concatenate([hashes(*p[0].T) for p in (pairs, triples)]), np.concatenate([p[2] for p in (pairs, triples)]))
                part = keys >> np.uint64(32)
                edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(keys))
                low, counts = keys & np.uint64(0xFFFFFFFF), np.minimum(counts, least)
                cuts = list(zip(edges[:-1], edges[1:]))
                columns = [[shard] * len(cuts), [int(part[a]) for a, _ in cuts], [_pack(low[a:b]) for a, b in cuts], [planes(counts[a:b]) for a, b in cuts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return found.select("shard", "lang", "words", "codes").mapInArrow(run, "shard long, part int, keys binary, counts binary")


def frequent_hashes(short: DataFrame, least: int) -> DataFrame:
    """shard, part and keys: those of a shard's hashes whose sum over all shards reaches least. A range of hashes is a group, a shard's part of it a row."""

    def add(group: pa.Table) -> pa.Table:
        keys = [_unpack(b) for b in group.column("keys").to_pylist()]
        counts = np.concatenate([from_planes(b) for b in group.column("counts").to_pylist()])
        _, sums, of = _added(np.concatenate(keys), counts)
        enough = np.split((sums >= least)[of], np.cumsum([len(k) for k in keys])[:-1])
        packed = [_pack(k[e]) for k, e in zip(keys, enough)]
        return pa.table({"shard": group.column("shard"), "part": group.column("part"), "keys": pa.chunked_array([pa.array(packed, pa.binary())])})

    return short.groupBy("part").applyInArrow(add, "shard long, part int, keys binary").where(F.length("keys") > 0)


def long_phrases(found: DataFrame, ranges: int, most_words: int) -> DataFrame:
    """lang, part (of the hashes), phrases, sizes (words) and counts of each shard, for phrases whose pairs and triples came back; found: shard, lang, words, codes and kept (part, keys)."""
    names = ["lang", "part", "phrases", "sizes", "counts"]

    def packed(lang: str, part: np.ndarray, phrases: pa.Array, sizes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        part = part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = pa.array(np.append(edges, len(part)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (phrases.take(pa.array(order)), pa.array(sizes[order], pa.int32()), pa.array(counts[order], pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(edges), pa.string()), pa.array(part[edges].astype(np.int32)), *lists], names=names)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch.column(0)[i].as_py(), batch.column(1)[i].values
                hashes, text = _Hashes(lang, words, ranges), from_planes(batch.column(2)[i].as_py())
                known = np.sort(np.concatenate([_unpack(x["keys"]) | np.uint64(x["part"]) << np.uint64(32) for x in batch.column(3)[i].as_py()]))

                def back(*columns, known=known, hashes=hashes):
                    h = hashes(*columns)
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    return known[at] == h

                linked = np.append((text[:-1] > 0) & (text[1:] > 0) & back(text[:-1], text[1:]), False)
                used = linked | np.append(False, linked[:-1])
                both = np.column_stack([text, np.zeros(len(text), np.int64)]).ravel()
                text = both[np.column_stack([used, used & ~linked]).ravel()]  # an end after each word that isn't linked to the next
                if not len(text):
                    continue
                index, found = Index(text, len(words), most_words), []
                grown = index.single()
                for size in range(2, most_words + 1):
                    right = size % 2 == 0
                    phrases, starts, counts = index.extend(*grown, right)
                    if size > 2:
                        keep = back(*(phrases[:, -3:] if right else phrases[:, :3]).T)
                        phrases, starts, counts = phrases[keep], tuple(s[keep] for s in starts), counts[keep]
                    grown = phrases, starts, counts
                    if not len(phrases):
                        break
                    text_of = pc.binary_join_element_wise(*[words.take(pa.array(c - 1)) for c in phrases.T], b" ")
                    found.append((hashes(*phrases.T) >> np.uint64(32), text_of, np.full(len(counts), size), counts))
                yield packed(lang, np.concatenate([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found]))

    return found.select("lang", "words", "codes", "kept").mapInArrow(run, "lang string, part int, phrases array<binary>, sizes array<int>, counts array<long>")


def summed_phrases(longer: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size and n of the phrases whose sum over all shards reaches least, by text. A range of hashes is a group, a shard's part of it a row."""

    def add(group: pa.Table) -> pa.Table:
        lists = group.column("phrases").combine_chunks()
        lang = group.column("lang").combine_chunks().take(pc.list_parent_indices(lists))
        flat = pa.table({"lang": lang, "phrase": pc.list_flatten(lists), "size": pc.list_flatten(group.column("sizes").combine_chunks()), "n": pc.list_flatten(group.column("counts").combine_chunks())})
        sums = flat.group_by(["lang", "phrase", "size"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        return sums.filter(pc.greater_equal(sums.column("n"), least)).select(["lang", "phrase", "size", "n"])

    return longer.groupBy("part").applyInArrow(add, "lang string, phrase binary, size int, n long").withColumn("phrase", F.col("phrase").cast("string"))


def counted(packed: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, phrase, size and n of all words and phrases of up to most_words words that occur least times and more; packed: a table as of shards()."""
    words = packed.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").cast("string").alias("phrase"), F.lit(1).alias("size"), F.col("w.counts").alias("n"))
    ranges = max(1, math.ceil((packed.agg(F.sum("n_words")).first()[0] or 0) / RANGE))
    back = frequent_hashes(short_phrases(packed, ranges, least), least).groupBy("shard").agg(F.collect_list(F.struct("part", "keys")).alias("kept"))
    longer = long_phrases(packed.drop("counts").join(back.hint("shuffle_hash"), "shard"), ranges, most_words)
    often = words.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return often.union(summed_phrases(longer, least))


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n and score of the phrases of two words and more that no extension stands for; counts: a table as of counted(); totals: lang and n."""
    phrases = counts.where("size > 1").withColumnRenamed("n", "a")
    of_longer = F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")))
    longer = phrases.where("size > 2").select("lang", of_longer.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("extended"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where("extended IS NULL OR extended < a").drop("extended")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    parts = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    met = salted_join(cuts.join(parts[0], ["lang", "first"]).join(parts[1], ["lang", "rest"]), totals, ["lang"], "phrase")
    wide = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "alrn"}
    score = F.expr(f"(1000 * ({wide['a']} * {wide['n']})) div ({wide['l']} * {wide['r']})")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return met.groupBy("lang", "phrase", "size", "a", "n").agg(least).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def mine(docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first phrases by score, count and text."""
    packed = cut(shards(docs))
    counts = cut(counted(packed, least, most_words))
    totals = cut(packed.groupBy("lang").agg(F.sum("n_words").alias("n")))
    drop_cut(packed)
    ranked = scored(counts, totals).withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "dealt"], ["lang"]):  # no language's phrases meet in one task but the first of each part
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


SQL = {
    "op13_phrases": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, m AS size, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase FROM w, range(1, {MOST_WORDS} + 1) q(m) WHERE len(ws) >= m),
f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= {LEAST_COUNT}),
c AS (SELECT * FROM f WHERE size > 1 AND NOT EXISTS (FROM f g WHERE g.lang = f.lang AND g.size > f.size AND g.a >= f.a AND contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))),
k AS (SELECT c.*, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rest FROM c, range(1, {MOST_WORDS}) q(k) WHERE k < size),
s AS (SELECT k.lang, k.phrase, k.a, l.a AS l, r.a AS r, n, k, ((1000::HUGEINT * k.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = head JOIN f r ON r.lang = k.lang AND r.phrase = rest JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {TOP}
"""
}
QUERIES = {"op13_phrases": op13_phrases}
