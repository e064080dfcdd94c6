"""Removal of bytes covered by repeated 200-byte strings, by deep-shallow sorting of suffixes at shared places.

Every 200-byte string chooses one of the 151 places within it where a 50-byte string begins: the one of least hash, the
leftmost of equals. Equal strings choose alike, so places whose 50 bytes stand nowhere else can be dropped. A place's
context reaches as far as the strings that may choose it, 150 bytes left and 200 right. Contexts that stand twice cover
themselves whole; texts that stand twice are removed whole. What is left are the ends of repeats: for the contexts of
one 50-byte string the suffixes to the right and the reversed prefixes to the left are sorted, and their common
prefixes in that order say for every length which of them agree so far. A 200-byte string that begins o bytes left of
the place is repeated if another context agrees with it o bytes to the left and 200 - o to the right; mostly the
neighbours in the two orders settle how far that goes, else the agreeing pairs of every o are counted.

A 50-byte string with over 4,000 contexts is split by what its strings must share besides: the first 125 bytes to the
right (o up to 75) or the first 75 to the left (o from 75 on); parts that are still larger are settled by counting the
hashes of their windows, in a grouped aggregate. Texts go through two exchanges, by a hash of the text.

Texts are told apart by 96 bits of their hashes, windows by 64 bits and the place's 64. Cases: null and empty texts
have no bytes, and texts under 200 bytes lose none; repeated rows are documents of their own, and so are different texts
under one doc_id; a null doc_id keeps its row; texts are read in parts of 256 KiB, so length doesn't matter; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.llm.common import bounded_batches, cut, drop_cut, map_batches, salted_join, table, text_bytes
from quaystone.llm.deep_shallow import common, sort
from quaystone.llm.shingles import mix

SPAN, GRAM = 200, 50
PLACES = SPAN - GRAM + 1
LEFT, RIGHT = PLACES - 1, SPAN
MIDDLE = LEFT // 2
PART = 1 << 18
#: Contexts that are sorted together at most, and rows after which a task sorts what it holds.
MOST_SORTED, HELD = 4_000, 8_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_RNG = np.random.Generator(np.random.PCG64(6))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


_UP = _powers(PART + SPAN + LEFT + RIGHT + 1, _BASE)
_DOWN = _powers(PART + SPAN + LEFT + RIGHT + 1, np.uint64(pow(int(_BASE), -1, 2**64)))


def _prefix(b: np.ndarray) -> np.ndarray:
    """Prefix sums from which hashes() gives the hash of any stretch."""
    return np.r_[np.uint64(0), np.cumsum(_BYTE[b] * _UP[: len(b)])]


def _hashes(prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix((prefix[high] - prefix[low]) * _DOWN[low])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values in a row."""
    n = len(v) - width + 1
    blocks = np.full(-(-len(v) // width) * width, 2**64 - 1, np.uint64)
    blocks[: len(v)] = v
    grid = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen places, the hashes of their 50 bytes and those of their contexts."""
    n, at, found = len(text), 0, []
    everything = np.frombuffer(text, np.uint8)
    while n - at >= SPAN:
        low = max(0, at - LEFT)
        b = everything[low : at + PART + SPAN + RIGHT]  # strings that begin in [at, at + PART)
        prefix, head = _prefix(b), at - low
        tail = min(len(b), head + PART + SPAN - 1)
        starts = np.arange(head, tail - GRAM + 1)
        grams = _hashes(prefix, starts, starts + GRAM)
        keyed = (grams & ~np.uint64((1 << 20) - 1)) | (starts - head).astype(np.uint64)
        chosen = np.unique(_least(keyed, PLACES) & np.uint64((1 << 20) - 1)).astype(np.int64)
        place = chosen + head
        lo, hi = np.maximum(0, place - LEFT), np.minimum(len(b), place + RIGHT)
        whole = _hashes(prefix, lo, hi) ^ mix((place - lo).astype(np.uint64) * np.uint64(1021) + (hi - place).astype(np.uint64) + np.uint64(7))
        found.append((place + low, grams[chosen], whole))
        at += PART
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    place, gram, whole = (np.concatenate(x) for x in zip(*found, strict=True))
    place, first = np.unique(place, return_index=True)
    return place, gram[first], whole[first]


def _anchor_batches(batches):
    """Places of every text; of equal texts within a task the first two, as more don't change what is repeated."""
    names, types = ["k", "j", "place", "gram", "whole"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for k, j, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            times = seen[k, j] = seen.get((k, j), 0) + 1
            if times <= 2:
                p, g, w = anchors(text)
                for c, x in zip(out, (np.full(len(p), k, np.int64), np.full(len(p), j, np.int32), p, g.view(np.int64), w.view(np.int64)), strict=True):
                    c.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, types, strict=True)], names=names)


def _common_in_order(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order, and how much each row of it has in common with the one before; -1 across groups."""
    order = sort(rows, lengths, group)
    shared = np.full(len(order), -1, np.int64)
    shared[1:] = common(rows, lengths, order[:-1], order[1:])
    shared[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, shared


def _best_mates(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each row has in common with the closer of its neighbours in the order, and that neighbour; -1: none."""
    n = len(order)
    best, mate = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        best[a], mate[a] = shared[1:], b
        closer = shared[1:] > best[b]
        best[b[closer]], mate[b[closer]] = shared[1:][closer], a[closer]
    return best, mate


def reaches(texts: list[bytes], left: np.ndarray, group: np.ndarray, times: np.ndarray, low: int = 0, high: int = LEFT) -> tuple[np.ndarray, np.ndarray]:
    """How far left of its place, and right of it, the repeated strings reach that begin low to high bytes left of it; 0, 0: none."""
    n = len(texts)
    right_rows, left_rows = np.zeros((n, RIGHT), np.uint8), np.zeros((n, LEFT), np.uint8)
    right_len = np.array([len(t) for t in texts], np.int64) - left
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        right_rows[i, : right_len[i]] = b[left[i] :]
        left_rows[i, : left[i]] = b[: left[i]][::-1]
    right_order, right_shared = _common_in_order(right_rows, right_len, group)
    left_order, left_shared = _common_in_order(left_rows, left, group)
    far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = low == 0 and high == LEFT
    unsettled = np.full(n, not whole)
    if whole:
        for order, shared, others, other_len, far in ((right_order, right_shared, left_rows, left, far_right), (left_order, left_shared, right_rows, right_len, far_left)):
            best, mate = _best_mates(order, shared)
            i = np.flatnonzero(best >= 0)
            match = common(others, other_len, i, mate[i]) + best[i] >= SPAN
            far[i[match]] = best[i[match]]
            unsettled[i[~match]] = True
    unsettled &= times < 2
    if unsettled.any():
        open_groups = np.isin(group, group[unsettled])
        first, last = _offsets(right_order, right_shared, left_order, left_shared, open_groups, low, high)
        i = np.flatnonzero(unsettled)
        found = first[i] >= 0
        far_left[i], far_right[i] = np.where(found, last[i], 0), np.where(found, SPAN - first[i], 0)
    none = far_left + far_right < SPAN
    far_left[none] = far_right[none] = 0
    return far_left, far_right


def _offsets(right_order, right_shared, left_order, left_shared, rows: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the least and the greatest o whose string is repeated among the rows asked for (-1: none).

    Rows are of one class to the right if they agree in 200 - o bytes, and to the left in o; in the sorted orders a class is a stretch.
    """
    n = len(rows)
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    chosen = np.flatnonzero(rows)
    by_right, by_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(low, high + 1):
        by_right[right_order] = np.cumsum(right_shared < SPAN - o)
        by_left[left_order] = np.cumsum(left_shared < o)
        key = by_right[chosen] * (n + 1) + by_left[chosen]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(chosen), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        i = chosen[again]
        first[i] = np.where(first[i] < 0, o, first[i])
        last[i] = o
    return first, last


#: What a task that sorts gets of each context, in order.
CONTEXT = ["k", "j", "place", "grp", "times", "context", "left", "low", "high"]


def _settle(batches):
    """Rows come sorted by low, grp, k, j and place; whole groups are sorted together, some thousand contexts at a time."""

    def flush(rows):
        k, j, place, grp, times, text, left, low, high = (list(c) for c in zip(*rows, strict=True))
        times = np.array(times)
        group = np.unique(np.array(grp), return_inverse=True)[1]
        far_left, far_right = reaches(text, np.array(left, np.int64), group, times, low[0], high[0])
        own = (far_right > 0) & (times < 2)
        p = np.array(place)
        columns = [np.array(k)[own], np.array(j, np.int32)[own], (p - far_left)[own], (p + far_right)[own]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "j", "low", "high"])

    held: list = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (row[7] != held[-1][7] or len(held) >= HELD and row[3] != held[-1][3]):
                yield from flush(held)
                held = []
            held.append(row)
    if held:
        yield from flush(held)


def _window_hashes(cols):
    """k, j, place, grp, times, offset left of the place and hash of every 200-byte window of a context that begins low to high bytes left of it."""
    out: list[list] = [[], [], [], [], [], [], []]
    for k, j, p, g, t, text, left, low, high in zip(*cols, strict=True):
        for start in range(max(0, left - high), min(left - low, len(text) - SPAN) + 1):
            for c, v in zip(out, (k, j, p, g, t, left - start, xxhash.xxh3_64_intdigest(text[start : start + SPAN]) - 2**63), strict=True):
                c.append(v)
    return out


def _remove(cols):
    out: list[list] = [*cols[:2], [], [], []]
    for text, runs in zip(*cols[2:], strict=True):
        kept, at, removed = hashlib.sha256(), 0, 0
        for run in sorted((r["low"], r["high"]) for r in runs):
            kept.update(text[at : run[0]])
            at = run[1]
            removed += run[1] - run[0]
        kept.update(text[at:])
        for c, v in zip(out[2:], (removed, len(runs), kept.hexdigest()), strict=True):
            c.append(v)
    return out


def contexts_around(texts: DataFrame, places: DataFrame, repeated: DataFrame) -> DataFrame:
    """The bytes around each place (k, j, id, place, grp, times, variants): texts meet their places by key, and only what is around them goes on."""
    left = F.least("place", F.lit(LEFT))
    around = F.substring("text", (F.col("place") - left + 1).cast("int"), (left + RIGHT).cast("int"))
    met = texts.join(places, ["k", "j", "id"]).select("k", "j", "place", "grp", "times", "variants", around.alias("context"), left.cast("int").alias("left"))
    return met if repeated.isEmpty() else met.dropDuplicates(["k", "j", "place"])


def ends_of_repeats(rows: DataFrame) -> list[DataFrame]:
    """Spans (k, j, low, high) of repeats that end within a context; rows: from contexts_around(), cut."""
    bounds = lambda df, a, b: df.withColumns({"low": F.lit(a), "high": F.lit(b)})
    settled = lambda df: df.select(*CONTEXT).repartition("grp").sortWithinPartitions("low", "grp", "k", "j", "place").mapInArrow(_settle, "k long, j int, low long, high long")
    usual = bounds(rows.where(F.col("variants") <= MOST_SORTED), 0, LEFT)
    crowded = rows.where(F.col("variants") > MOST_SORTED)
    right = F.substring("context", F.col("left") + 1, F.lit(SPAN - MIDDLE))
    to_left = F.substring("context", F.col("left") - MIDDLE + 1, F.lit(MIDDLE))
    one = bounds(crowded.where(F.octet_length("context") - F.col("left") >= SPAN - MIDDLE).withColumn("grp", F.xxhash64("grp", F.lit(0), right)), 0, MIDDLE)
    two = bounds(crowded.where(F.col("left") >= MIDDLE).withColumn("grp", F.xxhash64("grp", F.lit(1), to_left)), MIDDLE, LEFT)
    parts = cut(one.union(two).drop("variants"))
    sizes = cut(parts.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1"))
    parts = parts.join(sizes, "grp")
    windows = map_batches(parts.where(F.col("members") > MOST_SORTED).select(*CONTEXT), _window_hashes, "k long, j int, place long, grp long, times int, `offset` long, hash long")
    same = ["grp", "offset", "hash"]
    often = windows.groupBy(same).agg(F.sum("times").alias("n")).where("n > 1").select(same)
    again = windows.where("times = 1").join(often, same).groupBy("k", "j", "place").agg(F.max("offset").alias("most"), F.min("offset").alias("least"))
    counted = again.select("k", "j", (F.col("place") - F.col("most")).alias("low"), (F.col("place") - F.col("least") + SPAN).alias("high"))
    return [settled(usual), settled(parts.where(F.col("members") <= MOST_SORTED)), counted]


def merged(spans: DataFrame) -> DataFrame:
    """k, j, low and high of the maximal runs that the spans cover."""
    w = Window.partitionBy("k", "j").orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("starts", F.when(before.isNull() | (F.col("low") > before), 1).otherwise(0))
    runs = starts.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("k", "j", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, a row per document."""
    bounded_batches(docs.sparkSession)
    bytes_of = docs.select("doc_id", text_bytes().alias("text"))
    texts = bytes_of.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.xxhash64("text").alias("k"), F.hash("text").alias("j"), "text")
    described = cut(texts.select("doc_id", "id", "k", "j", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest")))
    long_texts = texts.where(F.octet_length("text") >= SPAN)
    found = cut(long_texts.select("k", "j", "text").mapInArrow(_anchor_batches, "k long, j int, place long, gram long, whole long"))
    classes = described.where(F.col("n_bytes") >= SPAN).groupBy("k", "j").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.max("n_bytes").alias("n_bytes"))
    classes = cut(classes)
    repeated = described.groupBy("k", "j", "id").count().where("count > 1")
    # contexts, their 50-byte strings, and what is known of each
    contexts = cut(found.groupBy("gram", "whole").agg(F.count("*").alias("times"), F.min(F.struct("k", "j", "place")).alias("at")))
    grams = contexts.groupBy("gram").agg(F.count("*").alias("variants"), F.min("times").alias("rarest"), F.sum("times").alias("all_times")).where("all_times > 1")
    shared = cut(contexts.join(grams, "gram"))
    drop_cut(contexts)
    twice = shared.where("times > 1").select("gram", "whole")
    covered = found.join(twice, ["gram", "whole"]).select("k", "j", F.greatest(F.col("place") - LEFT, F.lit(0)).alias("low"), (F.col("place") + RIGHT).alias("high"))
    # the ends of repeats: contexts of grams with several, one of them seen once
    ends = shared.where("variants > 1 and rarest = 1").select(F.col("gram").alias("grp"), "variants", F.least("times", F.lit(2)).cast("int").alias("times"), "at.*")
    places = ends.join(classes.select("k", "j", "id"), ["k", "j"])
    around = cut(contexts_around(long_texts.select("k", "j", "id", "text"), places, repeated))
    spans = covered
    for more in ends_of_repeats(around):
        spans = spans.union(more)
    once = classes.where("copies = 1").select("k", "j", "n_bytes")
    runs = merged(spans.join(once, ["k", "j"]).select("k", "j", "low", F.least("high", "n_bytes").alias("high")))
    # a run is 200 bytes long at least, so a text's runs take a fraction of the text
    runs = cut(runs.groupBy("k", "j").agg(F.collect_list(F.struct("low", "high")).alias("runs")))
    drop_cut(found)
    drop_cut(around)
    some = long_texts.select("k", "j", "text").join(runs.hint("shuffle_hash"), ["k", "j"])
    done = map_batches(some.select("k", "j", "text", "runs"), _remove, "k long, j int, removed long, spans long, kept string")
    several = classes.where("copies > 1").select("k", "j", F.lit(True).alias("gone"))
    out = salted_join(described, several, ["k", "j"], "id", "left").join(done, ["k", "j"], "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("gone"), 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("gone"), EMPTY_SHA).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL: dict[str, str] = {}
