"""The pipeline on awkward documents, on empty tables, and with the joins of large tables."""

import pytest

import corpus_pipeline
from quaystone.llm import near_dedup
from tests.llm import edge

ITEM = edge.sentence(77, 30)


def folder(spark, path, docs, items=((1, ITEM),), labels=((5, 1),)):
    edge.as_table(spark, path, "documents", docs)
    edge.as_table(spark, path, "benchmark", spark.createDataFrame(list(items), "item_id long, text string"))
    return edge.as_table(spark, path, "labels", spark.createDataFrame(list(labels), "doc_id long, quality int"))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    words = [edge.sentence(40 + k, 120) for k in range(6)]
    upper = "".join(c.upper() if c.isascii() else c for c in words[0])
    rows = [
        (1, words[0]), (2, words[0]), (3, upper), (4, words[1] + " " + ITEM), (5, words[2] + " token = abcdefgh12345678"), (6, words[3]), (6, words[4]), (None, words[5]), (None, words[5]), (None, None),
        (7, ""), (8, "few words"), (9, "la " * 200), (10, words[1]), (10, words[1]), (None, words[3]),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, [1.5]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `row` string, `n_words` int, `__salt` array<double>")
    return folder(spark, tmp_path_factory.mktemp("awkward"), frame.repartition(3)), [*words, upper]


def after(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:stages]:
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    return docs


def test_stages_decide_by_row(spark, awkward):
    sf_dir, w = awkward
    rows = lambda n: sorted(((r["doc_id"], r["text"]) for r in after(spark, sf_dir, n).select("doc_id", "text").collect()), key=repr)
    good = [(1, w[0]), (2, w[0]), (3, w[6]), (4, w[1] + " " + ITEM), (5, w[2] + " token = abcdefgh12345678"), (6, w[3]), (6, w[4]), (None, w[5]), (None, w[5]), (10, w[1]), (10, w[1]), (None, w[3])]
    assert rows(1) == sorted(good, key=repr)
    # document 4 is near 10 (its words and 30 more), so one of them goes; without an id comes behind with one
    kept = [(1, w[0]), (4, w[1] + " " + ITEM), (5, good[4][1]), (6, w[3]), (6, w[4]), (None, w[5]), (None, w[5])]
    assert rows(2) == sorted(kept, key=repr)
    assert rows(3) == sorted([r for r in kept if r[0] != 4], key=repr)
    out = after(spark, sf_dir, 4).where("doc_id = 5").first()
    assert out["text"] == w[2] + " [assign]" and out["n_chars"] == len(out["text"]) and out["__salt"] == [1.5] and out["row"] == "x"


def test_large_table_joins_change_nothing(spark, awkward):
    sf_dir, _ = awkward
    want = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=repr) == want and len(want) == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_empty_tables(spark, tmp_path, awkward):
    docs = spark.read.parquet(f"{awkward[0]}/documents.parquet")
    empty = folder(spark, tmp_path / "a", docs.limit(0))
    assert corpus_pipeline.run(spark, empty).count() == 0
    bare = folder(spark, tmp_path / "b", docs, [(1, "")], [(99, 0)])
    assert corpus_pipeline.run(spark, bare).where("doc_id = 4").count() == 1


def test_components_of_equal_ids(spark):
    """Classes under one id are one node in the operator, and documents of their own in the stage."""
    a, b = edge.sentence(1, 80), edge.sentence(2, 80)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.link(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    kept = {r["text"] for r in near_dedup.stage(spark, docs, "").collect()}
    # one of the two texts under the id counts as its; the other comes behind all ids
    assert kept in ({a, b + " y", ""}, {b, a + " x", ""})
