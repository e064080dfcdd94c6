"""Removal of lines that many documents share, by sorted ranges of line hashes and keep bitmaps, in DataFrame functions only.

A line's key is the line without white space at both ends, A-Z lower-cased; keys of 40 code points and more that stand in
5 documents and more lose all their lines except in the largest doc_id that holds them. Places of such lines (128 bits of
the key's hash, document, line number) are range-partitioned by hash and sorted by hash, document (largest first) and
line number, so one pass sees the first document of each key and how many follow. What it returns isn't text but bitmaps:
of each document the 64-line words in which a line goes, others being left out. A join by 128 bits of the row's hashes
then brings a document and its bitmap together.

A key that may hold a large share of all places never meets in one range: the 1,000 most frequent hashes, as a sketch of
bounded size finds them, are counted by partial aggregates, and their places are judged beside a broadcast table of
those at most. Which keys are among them changes no result.

Cases: null and empty texts are one empty line; documents are told apart by doc_id, so rows that share an id count as one
document, each row losing its own lines, and rows without an id count as one that comes last and keeps a key's lines only
if the key stays anyway; a text may be of any length; an empty table gives an empty one; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.llm.common import cut, table

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Hashes that are judged beside a broadcast table, and items of the sketch that finds them.
HOT, SKETCH = 1_000, 16_384
WHITE, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def with_row(docs: DataFrame) -> DataFrame:
    """docs with 128 bits of hashes of doc_id and text (r1, r2)."""
    return docs.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(1), "text", "doc_id")})


def places(docs: DataFrame) -> DataFrame:
    """h1 and h2 of the key, doc_id, r1, r2 and pos of each line whose key is long enough."""
    each = with_row(docs.select("doc_id", "text")).select("doc_id", "r1", "r2", F.posexplode(lines()).alias("pos", "line"))
    stripped = each.select("doc_id", "r1", "r2", "pos", F.btrim("line", F.lit(WHITE)).alias("line")).where(F.char_length("line") >= LEAST_CHARS)
    keyed = stripped.withColumn("key", F.translate("line", UPPER, LOWER))
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "r1", "r2", "pos")


def dropped_places(found: DataFrame) -> DataFrame:
    """r1, r2 and pos of the lines that go; found: a table as of places(), read three times."""
    top = found.agg(F.expr(f"approx_top_k(h1, {HOT}, {SKETCH})").alias("top"))
    hot = F.broadcast(top.select(F.explode("top.item").alias("h1")))  # HOT rows at most
    new = F.row_number().over(order := Window.partitionBy("h1", "h2").orderBy(F.desc_nulls_last("doc_id"), "r1", "r2", "pos"))
    before = F.lag("doc_id").over(order)
    streamed = found.join(hot, "h1", "left_anti").repartitionByRange("h1", "h2").select(
        "h1", "h2", "doc_id", "r1", "r2", "pos", F.first("doc_id").over(order).alias("keeper"), ((new == 1) | ~before.eqNullSafe(F.col("doc_id"))).cast("long").alias("new")
    )
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cold = streamed.withColumn("n_docs", F.sum("new").over(whole))
    counted = found.join(hot, "h1", "left_semi")
    n_docs = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    shared = counted.groupBy("h1", "h2").agg(n_docs.alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= LEAST_DOCS)
    crowded = found.join(F.broadcast(shared), ["h1", "h2"])  # a row for each hot hash
    goes = (F.col("n_docs") >= LEAST_DOCS) & ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    return cold.where(goes).select("r1", "r2", "pos").union(crowded.where(goes).select("r1", "r2", "pos"))


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """r1, r2, n_dropped and gone (word: line numbers from 64 * word on; bits: those that go) of the documents that lose a line."""
    bits = dropped_places(cut(places(docs))).groupBy("r1", "r2", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("r1", "r2").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("gone"))


def dedup(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns (doc_id, if none are named) with n_lines, n_dropped and the text of the lines that stay (of a null text, an empty one)."""
    kept = kept or ("doc_id",)
    # the words that were left out come back, so that a line finds its word by number
    dense = F.flatten(F.transform("gone", lambda w, k: F.concat(F.array_repeat(F.lit(0).cast("long"), w["word"] - F.when(k > 0, F.get("gone", k - 1)["word"]).otherwise(F.lit(-1)) - 1), F.array(w["bits"]))))
    maps = keep_bitmaps(docs).select("r1", "r2", "n_dropped", dense.alias("gone"))
    own = docs.select("doc_id", "text", *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(kept)])
    met = with_row(own).join(maps.hint("shuffle_hash"), ["r1", "r2"], "left")
    stays = F.expr("array_join(filter(split(coalesce(text, ''), '\\n', -1), (x, i) -> (shiftrightunsigned(coalesce(get(gone, i div 64), 0L), i % 64) & 1) = 0), '\\n')")
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(stays)
    return met.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)], F.size(lines()).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WHITE = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13)"
SQL = {
    "op12_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_WHITE}), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {LEAST_DOCS}),
j AS (SELECT r, pos, line, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN c USING (key)),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM j GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (r)
"""
}
QUERIES = {"op12_line_dedup": op12_line_dedup}
