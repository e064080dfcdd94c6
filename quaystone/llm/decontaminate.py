"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are the lower-cased parts of a text between ASCII white space. A fixed mask looks at some words of a short
window and ignores the others, so that a substituted word under an ignored place doesn't hide a copy. Two masks are
enough: however the words that may differ lie in a compared window (a quarter of 10 to 20 words), one of the masks
stands somewhere in it on equal words only. The hashes of all masked windows of the documents first meet a blocked Bloom
filter of the benchmark's, which is bounded and sent to every executor; what passes is joined with the benchmark's
exactly, so no seed of a document travels unless the benchmark may have it. A hit places an item on a document (an
alignment). Around each alignment words are compared in place: an item is found in a document if some window of 20
words (the whole item if that is shorter) agrees in at least 75 % of its words. Items of fewer than ten words are looked
for as exact runs of their words. Seeds and items that many documents share are dealt into parts in the joins.

Cases: null and empty texts and items without words match nothing; null ids are left out; rows of one doc_id count as
one document, and rows of one item_id as one item; repeated alignments count once; an empty benchmark finds nothing;
extra columns are ignored. The pipeline's stage decides per row, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import bloom
from quaystone.llm.common import cut, row_key, salted_join, table, without

#: Lossless for every item of SPAN words or more: together they hit all placements of n // 4 substitutions in n = 10 to 20 words.
SEED_MASKS = ("11101", "110000101")
SPAN = 10
WINDOW, AGREE_PCT = 20, 75
SPACES = r"[\x20\x09-\x0D]+"


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACES), "")


def _masked(hashes: Column, mask: str, number: int) -> Column:
    """A hash for each window of the mask's length, by first word."""
    at = lambda i: [hashes[i + F.lit(o)] for o, bit in enumerate(mask) if bit == "1"]
    return F.when(F.size(hashes) >= len(mask), F.transform(F.sequence(F.lit(0), F.size(hashes) - len(mask)), lambda i: F.xxhash64(F.lit(number), *at(i)))).otherwise(F.array().cast("array<bigint>"))


def seeds(texts: DataFrame, key: str, masks: list[tuple[int, str]]) -> DataFrame:
    """key, seed and the place of the window's first word, for all masks."""
    hashed = texts.select(key, F.transform(words("text"), lambda w: F.xxhash64(w)).alias("h"))
    arrays = hashed.select(key, F.size("h").alias("n"), *[_masked(F.col("h"), m, k).alias(f"m{k}") for k, m in masks])
    # one explode of the joined arrays; the place within them tells mask and window
    out = arrays.select(key, "n", F.posexplode(F.concat(*[f"m{k}" for k, _ in masks])).alias("i", "seed"))
    place, before = F.col("i"), F.lit(0)
    for _, m in masks:
        length = F.greatest(F.col("n") - len(m) + 1, F.lit(0))
        place = F.when(F.col("i") >= before, F.col("i") - before).otherwise(place)
        before = before + length
    return out.select(key, "seed", place.alias("place"))


def sought_seeds(items: DataFrame, item_words: DataFrame) -> tuple[DataFrame, list[tuple[int, str]]]:
    """item_id, seed and place of all items (cut), and the masks in use."""
    lengths = [r[0] for r in item_words.where(F.size("iw") < SPAN).select(F.size("iw")).distinct().collect()]  # at most SPAN - 1
    long_masks = list(enumerate(SEED_MASKS))
    short_masks = [(100 + n, "1" * n) for n in sorted(lengths)]
    long_items = items.join(item_words.where(F.size("iw") >= SPAN).select("item_id").distinct(), "item_id", "left_semi")
    sought = seeds(long_items, "item_id", long_masks)
    for k, m in short_masks:
        own = item_words.where(F.size("iw") == len(m)).select("item_id").distinct()
        sought = sought.union(seeds(items.join(own, "item_id", "left_semi"), "item_id", [(k, m)]))
    return cut(sought.select("item_id", "seed", F.col("place").alias("item_place")).distinct()), long_masks + short_masks


def alignments(docs: DataFrame, items: DataFrame, *carried: str) -> DataFrame:
    """row (the key of a document's row), item_id, shift, span of the compared windows, the most agreeing words in one and columns of docs; verified alignments only."""
    docs = docs.where(F.col("text").isNotNull()).select(row_key().alias("row"), "text", *carried)
    items = items.where(F.col("item_id").isNotNull()).select("item_id", "text")
    item_words = cut(items.select("item_id", words("text").alias("iw")).where(F.size("iw") > 0))
    sought, masks = sought_seeds(items, item_words)
    listed = cut(sought.select("seed").distinct())
    filters, blocks = bloom.build(listed, "seed")
    possible = bloom.probed(seeds(docs, "row", masks), "seed", filters, blocks)
    hits = salted_join(possible, sought, ["seed"], "row")
    hits = cut(hits.select("row", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct())
    # texts go once through an exchange by their row's key; of a document only the part under the item goes on
    placed = salted_join(hits, item_words, ["item_id"], "row")
    texts = docs.join(hits.select("row").distinct().hint("shuffle_hash"), "row", "left_semi").select("row", words("text").alias("dw"), *carried)
    placed = placed.join(texts, "row")
    under = F.transform("iw", lambda w, i: F.coalesce(F.get("dw", i + F.col("shift")) == w, F.lit(False)).cast("int"))
    placed = placed.select("row", "item_id", "shift", *carried, under.alias("same"), F.least(F.size("iw"), F.lit(WINDOW)).alias("span"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("span") + 1), lambda j: F.aggregate(F.slice("same", j, F.col("span")), F.lit(0), lambda a, x: a + x))
    best = placed.select("row", "item_id", "shift", *carried, "span", F.array_max(sums).alias("agree"))
    need = F.when(F.col("span") < SPAN, F.col("agree") == F.col("span")).otherwise(100 * F.col("agree") >= AGREE_PCT * F.col("span"))
    return best.where(need)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, length of the compared window, most agreeing words in one, and number of verified alignments."""
    found = alignments(docs.where(F.col("doc_id").isNotNull()), items, "doc_id")
    each = found.groupBy("doc_id", "item_id", "shift").agg(F.max("span").alias("span"), F.max("agree").alias("agree"))
    return each.groupBy("doc_id", "item_id").agg(
        F.max("span").cast("long").alias("span"), F.max("agree").cast("long").alias("agree"), F.count("*").alias("alignments")
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no item is found."""
    return without(docs, cut(alignments(docs, table(spark, sf_dir, "benchmark")).select("row").distinct()))


SQL = {
    # Every alignment that shares a word is compared: no seeds, so nothing that they could miss is missed here.
    "op2_decontaminate": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS MATERIALIZED (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS q FROM b WHERE len(w) > 0),
dw AS MATERIALIZED (SELECT doc_id, x, p FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d) SEMI JOIN bw USING (x)),
h AS MATERIALIZED (SELECT doc_id, item_id, n, p - q AS shift, list(q ORDER BY q) AS qs FROM dw JOIN bw USING (x) GROUP BY ALL
  HAVING CASE WHEN n < {SPAN} THEN count(*) = n ELSE 100 * count(*) >= {AGREE_PCT} * least(n, {WINDOW}) END),
a AS (SELECT doc_id, item_id, least(n, {WINDOW}) AS span, shift,
  list_max(list_transform(qs, lambda s: len(list_filter(qs, lambda q: q >= least(s, n - least(n, {WINDOW})) AND q < least(s, n - least(n, {WINDOW})) + {WINDOW})))) AS agree FROM h)
SELECT doc_id, item_id, max(span)::BIGINT AS span, max(agree)::BIGINT AS agree, count(*) AS alignments
FROM a WHERE CASE WHEN span < {SPAN} THEN agree = span ELSE 100 * agree >= {AGREE_PCT} * span END GROUP BY ALL
"""
}
QUERIES = {"op2_decontaminate": op2_decontaminate}
