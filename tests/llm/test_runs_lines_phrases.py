"""Periodic runs, line dedup and phrases against plain forms, on the smallest tables and on awkward ones."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.llm import fm_index, line_dedup, periodic_runs, phrases
from tests.conftest import SF
from tests.llm import edge

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module", params=["tables", "awkward"])
def corpus(request, spark, tmp_path_factory):
    """The folder of documents and its (doc_id, text, lang) rows."""
    folder = SF
    if request.param == "awkward":
        docs = edge.documents(spark)
        more = spark.createDataFrame([(i, t, None, "h1", 1, "pos", "r1", 2, "line", 3, ["gone"], 0.5) for i, t in awkward()], edge.SCHEMA)
        folder = edge.as_table(spark, tmp_path_factory.mktemp("edge"), "documents", docs.union(more))
    return folder, [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]


def awkward():
    line, other = "A line of more than forty characters, told apart by nothing", "Another line that stands in many documents; also long enough"
    rows = [(i, f"{i}\n {line.upper()}\x0b\n{other}" if i % 2 else f"{line} \nshort\n\n{line}") for i in range(30, 42)]
    rows += [(None, line), (None, f"x\n{line}\r\ny"), (41, other), (41, other), (50, "\n".join([line] * 200)), (51, ("wörd " * 7 + "end. ") * 30), (52, ("a b a b c " * 40).strip())]
    # every tenth id's text repeats from some place on
    return rows + [(i, edge.sentence(i, 60 + i % 50)) for i in range(100, 160)]


def plain_runs(w):
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12 and not any(w[i : j + q - d] == w[i + d : j + q] for d in range(1, q)):
                found.add((i, j - i + q, q))
            i = j + 1
    return sorted(found)


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(1500):
        n, k = rng.randint(0, 60), rng.randint(1, 4)
        w = [b"%d" % rng.randint(0, k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(n + 1), rng.randint(1, max(1, n // 4))
            for i in range(a + p, min(n, a + p * rng.randint(2, 5))):
                w[i] = w[i - p]
        assert periodic_runs.document(w) == periodic_runs.runs_of(w) == plain_runs(w)


def test_the_automaton_stays_linear_on_repetitive_text():
    first, second = [0], [0, 1]
    while len(second) < 20_000:
        first, second = second, second + first
    for words, runs in (([0] * 20_000, 1), ([i % 37 for i in range(20_000)], 1), (list(range(20_000)), 0)):
        assert len(periodic_runs.runs_of(words)) == runs
    assert max(n for _, n, _ in periodic_runs.runs_of(second)) > 10_000


def test_op11(spark, corpus):
    folder, docs = corpus
    want = []
    for i, t, _ in docs:
        w, h = re.findall(SPACE, t or ""), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if i is not None and h % 10 == 0 and n:
            a, o = g % n, list(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [o[a + (j - a) % p] if j >= a else o[j] for j in range(n)]
        runs = plain_runs(w) if n < 3000 else periodic_runs.runs_of(w)
        gone = {j for s, m, p in runs for j in range(s + p, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    out = periodic_runs.op11_periodic_runs(spark, folder)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr) and any(r[1] for r in want)


def plain_lines(docs):
    held = collections.defaultdict(set)
    cut = [(i, [(x, x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))) for x in (t or "").split("\n")]) for i, t, _ in docs]
    for i, lines in cut:
        for _, key in lines:
            if len(key) >= 40:
                held[key].add(i)
    top = {key: max((x for x in ids if x is not None), default=None) for key, ids in held.items() if len(ids) >= 5}
    out = []
    for i, lines in cut:
        kept = [x for x, key in lines if key not in top or top[key] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 1_000])
def test_op12(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    folder, docs = corpus
    want = plain_lines(docs)
    assert sorted(map(tuple, line_dedup.op12_line_dedup(spark, folder).collect()), key=repr) == sorted(want, key=repr)
    assert any(r[2] for r in want)


def test_lines_are_streamed_from_sorted_ranges(spark):
    """Places are exchanged by ranges of their hash, and no second exchange comes between that and the window."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = line_dedup.dropped_places(line_dedup.places(docs))._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window [sum(new")
    assert "hashpartitioning" not in plan[window : plan.index("rangepartitioning")] and "Python" not in plan and "Arrow" not in plan


def test_bitmaps_hold_the_lines_that_go(spark):
    docs = spark.createDataFrame([(i, "\n".join(["own %d" % i] * 130 + ["a line that all of these documents share, every one"])) for i in range(6)], "doc_id long, text string")
    maps = line_dedup.keep_bitmaps(docs).collect()
    assert [r["n_dropped"] for r in maps] == [1] * 5 and all([tuple(w) for w in r["gone"]] == [(2, 1 << 2)] for r in maps)


def test_columns_that_stay_keep_their_values(spark):
    docs = edge.documents(spark).withColumns({"r1": F.lit("x"), "gone": F.lit(7), "pos": F.lit("p")})
    out = line_dedup.dedup(docs, "doc_id", "r1", "gone", "pos", "words")
    assert out.columns == ["doc_id", "r1", "gone", "pos", "words", "n_lines", "n_dropped", "text"] and {tuple(r) for r in out.select("r1", "gone", "pos").collect()} == {("x", 7, "p")} and out.count() == docs.count()
    runs = periodic_runs.scan(docs.withColumn("runs_", F.lit(1)), "doc_id", "k", "r1", "words")
    assert runs.count() == docs.count() and {r[0] for r in runs.select("r1").collect()} == {"x"}


def test_empty_documents(spark, tmp_path):
    folder = edge.as_table(spark, tmp_path, "documents", edge.documents(spark).limit(0))
    for query in (periodic_runs.op11_periodic_runs, line_dedup.op12_line_dedup, phrases.op13_phrases):
        assert query(spark, folder).count() == 0


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_index_counts_every_phrase_once(depth):
    rng = np.random.default_rng(depth)
    for _ in range(60):
        n, v = int(rng.integers(1, 80)), int(rng.integers(1, 6))
        text = rng.integers(0, v + 1, n)
        index = fm_index.Index(text, v, depth)
        grown = index.single()
        for m in range(1, depth + 1):
            want = collections.Counter(tuple(map(int, text[i : i + m])) for i in range(n - m + 1) if (text[i : i + m] > 0).all())
            assert {tuple(map(int, p)): int(c) for p, c in zip(grown[0], grown[2])} == dict(want) and len(grown[0]) == len(want)
            grown = index.extend(*grown, bool(rng.integers(2))) if m < depth else grown


def test_numbers_with_many_bits_are_ranked():
    """More words than fit in a number of 62 bits."""
    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, 500) * (1 << 20) + rng.integers(0, 3, 500)
    pad = [*text.tolist(), *[-1] * 5]
    keys = [tuple(pad[i : i + 5]) for i in fm_index.suffix_order(text, 5)]
    assert keys == sorted(keys)


def plain_phrases(docs, least, top):
    n, f = collections.Counter(), collections.Counter()
    for _, t, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(str.maketrans(phrases.UPPER, phrases.LOWER))):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    often = {k: c for k, c in f.items() if c >= least}
    dropped = {(lang, part) for (lang, p), c in often.items() for part in (p[1:], p[:-1], p[2:], p[:-2], p[1:-1]) if often.get((lang, part)) == c}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in dropped:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, lc, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, lc, r) in enumerate(sorted(rows)[:top])]


@pytest.mark.parametrize("shard, ranges", [(1 << 21, 500_000), (300, 200)])
def test_phrases(spark, corpus, monkeypatch, shard, ranges):
    monkeypatch.setattr(phrases, "RANGE", ranges)
    monkeypatch.setattr(phrases, "SHARD", shard)
    folder, docs = corpus
    least = 5 if folder != SF else 20
    got = [tuple(r) for r in phrases.mine(spark.read.parquet(f"{folder}/documents.parquet"), least=least, top=500).collect()]
    assert got and sorted(got) == sorted(plain_phrases(docs, least, 500))


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        a = rng.randrange(1, 10 ** rng.randint(1, 13))
        rows.append((f"x{i} y{i}", a, a + rng.randrange(10 ** rng.randint(1, 13)), a + rng.randrange(10 ** rng.randint(1, 13))))
    counts = spark.createDataFrame([("en", p, 2, a) for p, a, _, _ in rows] + [("en", p.split()[k], 1, (b, c)[k]) for p, _, b, c in rows for k in (0, 1)], "lang string, phrase string, size int, n long")
    n = 10**15 + 7
    got = {r["phrase"]: r["score"] for r in phrases.scored(counts, spark.createDataFrame([("en", n)], "lang string, n long")).collect()}
    assert got == {p: 1000 * a * n // (b * c) for p, a, b, c in rows if 1000 * a * n // (b * c) < 1 << 63}
