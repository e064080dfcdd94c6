"""MinHash near-dedup: universal hash minima, banding, verification, connected components.

Texts with the same lower-cased words are one class, represented by its least doc_id, and linked at once. The shingle
hashes of each class give 128 minima under multiply-shift universal hashes; 32 bands of 4 minima put classes into
buckets. A link at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 < 1e-5.

Within a bucket no pairs of all members are made. Members are dealt into blocks and linked to the least of their block,
and those to the least of the bucket, so no class has more than a block of partners there. Buckets that then still hold
several components are looked at once more: each member outside the largest component is compared, by signature and
inside its task, with members of other components whose set sizes allow the similarity; a pair is compared in the first
band that it shares, and only pairs that agree well enough come out. Large groups are dealt out as pairs of blocks.
Where more pairs than a few per member agree, the group's tasks get the sets themselves and give only links that join
components. Candidate pairs pass an estimate from the signatures (0.60, about four standard errors below 0.75) and are
confirmed on the full sets of shingles. Joins of texts are by hash partitioning at every size.

Cases: a null or empty text, or one of white space, has an empty set, stands for itself and is kept; fewer than five
words form one shingle; repeated doc_ids each get their row and are one node; a null doc_id is its own (null) component and not kept;
columns beyond those named are ignored. In the pipeline's stage texts without an id or under another text's id count as
documents of their own, after all others; rows that agree in id and text stay or go together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.llm.common import bounded_batches, cut, drop_cut, map_batches, row_key, salted_join, table, text_bytes, without
from quaystone.llm.components import components
from quaystone.llm.shingles import lower_words, mix, shingle_set

BANDS, ROWS = 32, 4
SIMILARITY_PCT = 75
#: Pairs whose signatures agree in fewer positions than this share are not looked at further.
ESTIMATE = 0.60
#: Members of a bucket that are compared in one task; larger buckets are cut into blocks of as many.
BLOCK = 4096
#: More agreeing pairs per row than this make a group dense: it is confirmed in its tasks, in blocks of so many bytes.
CROWD, DENSE_BYTES = 4, 16_000_000
#: Set sizes of a pair at the similarity differ by one such step of the logarithm at most.
SIZE_STEP = math.log(100 / SIMILARITY_PCT) + 1e-5
_RNG = np.random.Generator(np.random.PCG64(20240117))
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value under each universal hash; shingles isn't empty."""
    out = np.full(len(_A), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(out, (_A[:, None] * shingles[i : i + 512] + _B[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sign(cols):
    n, digest, sigs = [], [], []
    for text in cols[2]:
        words = lower_words(text)
        s = shingle_set(words)
        n.append(len(s))
        digest.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
        sigs.append(signature(s).astype(np.int32) if words else None)
    return [*cols[:2], n, digest, sigs]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, digest of the words (null without words) and signature, a row per document."""
    return map_batches(docs.select("doc_id", row_key().alias("row"), text_bytes().alias("text")), _sign, "doc_id long, row binary, n_shingles long, digest binary, sig array<int>")


def _band_keys(cols):
    nodes, out = cols[0], [[], [], [], []]
    if nodes:
        sig = np.array(cols[2], np.int32).astype(np.uint64).reshape(len(nodes), BANDS, ROWS)
        h = np.zeros((len(nodes), BANDS), np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(31) + sig[:, :, r] + np.uint64(1))
        h = mix(h + np.arange(BANDS, dtype=np.uint64))
        many = [np.repeat(np.array(c, np.int64), BANDS) for c in cols[:2]]
        out = [*many, np.tile(np.arange(BANDS, dtype=np.int32), len(nodes)), h.view(np.int64).ravel()]
    return out


def _sets(cols):
    return [cols[0], [shingle_set(lower_words(t)).tobytes() for t in cols[1]]]


def _similar(s: np.ndarray, t: np.ndarray) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= SIMILARITY_PCT * (len(s) + len(t) - both)


def _confirm(cols):
    good = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(cols[2], cols[3], strict=True)]
    return [[v for v, g in zip(c, good, strict=True) if g] for c in cols[:2]]


def shingle_sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame) -> DataFrame:
    """node and the bytes of the sorted shingle hashes; wanted: node and row, the key of the row that stands for it; repeated: keys of several rows. Texts go through one exchange."""
    texts = docs.select(row_key().alias("row"), text_bytes().alias("text"))
    found = texts.join(wanted.hint("shuffle_hash"), "row").select("node", "row", "text")
    if not repeated.isEmpty():
        found = found.dropDuplicates(["node", "row"])
    return map_batches(found.select("node", "text"), _sets, "node long, shingles binary")


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    near = agreeing_pairs(pairs, reps)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xs"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("ys"))
    joined = near.join(right, "b").join(left, "a").select("a", "b", "xs", "ys")
    return cut(map_batches(joined, _confirm, "a long, b long").distinct())


def agreeing_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose sizes and signatures let them be similar enough."""
    size = F.col("n_shingles")
    x = reps.select(F.col("node").alias("a"), size.alias("na"), F.col("sig").alias("sa"))
    y = reps.select(F.col("node").alias("b"), size.alias("nb"), F.col("sig").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, z: s + z)
    near = pairs.join(x, "a").join(y, "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY_PCT) & (agree >= int(ESTIMATE * BANDS * ROWS)))
    return cut(near.select("a", "b"))


#: What a task that compares gets of each row, in order.
UNIT = ["unit", "grp", "node", "component", "side", "own", "band", "sig"]


def _units(batches):
    """The rows of each unit; they come sorted by it."""
    held: list = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _agreeing(rows, sigs: np.ndarray):
    """(i, js) of a unit (a group, or two of its blocks): pairs of different components whose signatures agree and whose first common band this is."""
    comp, side, own = (np.array([r[i] for r in rows]) for i in (3, 4, 5))
    kinds, sizes = np.unique(comp, return_counts=True)
    two, band, least = bool((side == 1).any()), rows[0][6], int(ESTIMATE * BANDS * ROWS)
    for i in np.flatnonzero(comp != kinds[sizes.argmax()]):
        other = comp != comp[i]
        if not own[i]:  # two guests meet in their own group
            other &= own
        if two:  # pairs within a block are made where the block meets itself
            other &= side != side[i]
        j = np.flatnonzero(other)
        if len(j):
            same = sigs[j] == sigs[i]
            good = np.flatnonzero(same.sum(axis=1) >= least)
            if len(good):
                first = same[good].reshape(len(good), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                yield i, j[good[first]]


def _pack(pairs, dense=()) -> pa.RecordBatch:
    pairs = sorted(set(pairs))
    columns = [[int(p[i]) for p in pairs] + [None] * len(dense) for i in (0, 1)] + [[None] * len(pairs) + list(dense)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "grp"])


def _compare(batches):
    """Pairs (a, b) of each unit; of one with more than CROWD pairs per row its group only."""
    for rows in _units(batches):
        ids, sigs, found = [r[2] for r in rows], np.array([r[7] for r in rows], np.int32), []
        for i, js in _agreeing(rows, sigs):
            found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in js]
            if len(found) > CROWD * len(rows):
                yield _pack([], [rows[0][1]])
                break
        else:
            yield _pack(found)


def _compare_sets(batches):
    """As _compare, but confirmed at once on the sets; links that join what is joined already within the unit are left out."""
    for rows in _units(batches):
        ids, sigs = [r[2] for r in rows], np.array([r[7] for r in rows], np.int32)
        top, links = {r[3]: r[3] for r in rows}, []

        def root(c, top=top):
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        for i, js in _agreeing(rows, sigs):
            mine = np.frombuffer(rows[i][8], np.uint64)
            for j in js:
                a, b = root(rows[i][3]), root(rows[j][3])
                if a != b and _similar(mine, np.frombuffer(rows[j][8], np.uint64)):
                    top[max(a, b)] = min(a, b)
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        yield _pack(links)


def _deal(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows: grp, node, component, own, band and what blocks, a group's number of blocks, is made from. Each row once per unit of its group that it is part of."""
    met = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("met", F.explode(F.sequence(F.lit(0), blocks - 1)))
    unit = F.struct("grp", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"))
    return met.select(F.xxhash64(unit).alias("unit"), "grp", "node", "component", (F.col("block") > F.col("met")).cast("int").alias("side"), "own", "band")


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """The keys whose rows are of several components, and how many rows they have."""
    ends = rows.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many"))
    return ends.where("lo < hi").select(key, "many")


def links_across(members: DataFrame, comp: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components."""
    bounded_batches(members.sparkSession)
    rows = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = cut(rows.select("bucket", "band", "node", "component", "n_shingles"))
    rows = rows.join(_mixed(rows, "bucket").select("bucket"), "bucket", "left_semi")
    # sizes that let two be similar are at most one step apart: a group holds a step, and the step below as guests
    rows = rows.withColumn("step", F.floor(F.log("n_shingles") / SIZE_STEP)).withColumn("at", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    rows = cut(rows.select(F.xxhash64("bucket", "at").alias("grp"), "band", "node", "component", (F.col("at") == F.col("step")).alias("own")))
    rows = cut(rows.join(_mixed(rows, "grp"), "grp"))
    sigs = reps.select("node", "sig")
    ordered = _deal(rows, F.ceil(F.col("many") / BLOCK)).join(sigs, "node").select(*UNIT).repartition("unit").sortWithinPartitions("unit", "node", "side")
    found = cut(ordered.mapInArrow(_compare, "a long, b long, grp long"))
    usual = confirmed(found.where("grp IS NULL").select("a", "b").distinct(), reps, sets)
    dense = rows.join(cut(found.where("grp IS NOT NULL").select("grp").distinct()), "grp", "left_semi")
    dense = cut(dense.join(reps.select("node", (8 * F.col("n_shingles") + 8 * BANDS * ROWS).alias("bytes")), "node"))
    dense = dense.join(dense.groupBy("grp").agg(F.sum("bytes").alias("all_bytes")), "grp")
    dealt = _deal(dense, F.ceil(F.col("all_bytes") / DENSE_BYTES)).join(sigs, "node").join(sets, "node").select(*UNIT, "shingles")
    ordered = dealt.repartition("unit").sortWithinPartitions("unit", "node", "side")
    return usual.union(cut(ordered.mapInArrow(_compare_sets, "a long, b long, grp long").select("a", "b").distinct()))


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member with the least of its block, and the leasts of blocks with the bucket's."""
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = members.select("bucket", "node", F.pmod(F.xxhash64("node"), blocks).alias("block"))
    headed = dealt.withColumn("a", F.min("node").over(Window.partitionBy("bucket", "block")))
    heads = headed.where("node = a").select("bucket", F.col("node").alias("b"))
    tops = heads.withColumn("a", F.min("b").over(Window.partitionBy("bucket")))
    return headed.select("a", F.col("node").alias("b")).union(tops.select("a", "b")).where("a <> b").distinct()


def classes_of(signed: DataFrame, apart: bool) -> DataFrame:
    """digest, node, n_shingles, sig, row and n_rows of each class of equal words.

    The node is the class's least doc_id. With apart, a class without one or under an id that stands for another class gets a number above all ids, and null ids take part.
    """
    usable = F.col("digest").isNotNull() if apart else F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = signed.where(usable).groupBy("digest").agg(first, F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"), F.count("*").alias("n_rows"))
    classes = classes.select("digest", F.col("first.doc_id").alias("node"), F.col("first.row").alias("row"), "n_shingles", "sig", "n_rows")
    if not apart:
        return cut(classes)
    classes = cut(classes.withColumn("number", F.monotonically_increasing_id()))
    owners = classes.where("node IS NOT NULL").groupBy("node").agg(F.min("digest").alias("owner"))
    owned = classes.join(owners, "node", "left")
    most, high = classes.agg(F.max("number")).first()[0], signed.agg(F.max("doc_id")).first()[0]
    start = 0 if high is None else high + 1
    if start + (most or 0) >= 2**63:
        raise ValueError("the ids leave no room for numbers")
    node = F.when(F.col("owner").eqNullSafe(F.col("digest")), F.col("node")).otherwise(F.col("number") + F.lit(start))
    return cut(owned.select("digest", node.alias("node"), "row", "n_shingles", "sig", "n_rows"))


def linked(docs: DataFrame, apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, n_shingles, digest) and, for classes of several rows or with links: digest, component, row and is_first, if the class is its component's least."""
    signed = cut(signatures(docs))
    classes = classes_of(signed, apart)
    rows = cut(signed.select("doc_id", "row", "n_shingles", "digest"))
    drop_cut(signed)
    repeated = cut(rows.groupBy("row").count().where("count > 1").select("row"))
    reps = classes.select("node", "n_shingles", "sig")  # several rows for a node only where classes share an id
    buckets = map_batches(reps, _band_keys, "node long, n_shingles long, band int, bucket long")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(buckets.join(shared, "bucket"))
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "row")
    sets = cut(shingle_sets(docs, wanted, repeated))
    links = confirmed(cut(star_pairs(members)), reps, sets)
    comp = components(links.union(links_across(members, components(links), reps, sets)))
    drop_cut(sets)
    info = classes.join(comp, "node", "left").where("n_rows > 1 OR component IS NOT NULL")
    return rows, info.select("digest", F.coalesce("component", "node").alias("component"), F.col("row").alias("first_row"), F.col("component").isNull().alias("is_first"))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, a row per document."""
    rows, info = linked(docs)
    out = salted_join(rows, info.select("digest", "component"), ["digest"], "row", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the least id."""
    rows, info = linked(docs, apart=True)
    gone = salted_join(rows, info, ["digest"], "row").where(~F.col("is_first") | (F.col("row") != F.col("first_row")))
    return without(docs, cut(gone.select("row").distinct()))


QUERIES = {"op10_near_dedup": op10_near_dedup}
SQL = {
    "op10_near_dedup": r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
}
