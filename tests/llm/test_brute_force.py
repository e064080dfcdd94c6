"""The queries without SQL (and some with) against plain Python on the smallest tables and on the awkward ones."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from quaystone.llm import license_scan, lm_score, near_dedup, quality_rules, secret_scan, sentence_pieces, suffix_dedup
from tests.conftest import SF
from tests.llm import edge


@pytest.fixture(scope="module", params=["tables", "awkward"])
def corpus(request, spark, tmp_path_factory):
    """The folder of documents and labels, and its (doc_id, text) rows."""
    if request.param == "tables":
        folder = SF
    else:
        path = tmp_path_factory.mktemp("edge")
        edge.as_table(spark, path, "documents", edge.documents(spark))
        folder = edge.as_table(spark, path, "labels", spark.createDataFrame([(5, 1, 0, "x"), (5, 0, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, lang string"))
    return folder, [(r[0], r[1] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def same(frame, want):
    got = [tuple(r) for r in frame.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def words(text):
    return text.encode().split()


def test_quality_counts(spark, corpus):
    folder, docs = corpus
    want = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j + o for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    out = quality_rules.op8_quality_rules(spark, folder).cache()
    same(out.drop("kept"), want)
    assert out.where("base_failed and kept").count() == 0


def test_secrets(spark, corpus):
    folder, docs = corpus
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for i, t in docs:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{secret_scan.BASE[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want.append((i, *[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(text.encode()).hexdigest()))
    same(secret_scan.op4_secret_scan(spark, folder).drop("spans"), want)


def test_pieces_equal_the_library(spark, corpus):
    import sentencepiece

    folder, docs = corpus
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    want = []
    for i, t in docs:
        ids = lib.encode(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    same(sentence_pieces.op7_sentence_pieces(spark, folder), want)


def test_repeats_are_removed(spark, corpus):
    folder, docs = corpus
    seen = collections.Counter(b[p : p + 200] for _, t in docs for b in [t.encode()] for p in range(len(b) - 199))
    want = []
    for i, t in docs:
        b, spans = t.encode(), []
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + 200
                else:
                    spans.append([p, p + 200])
        kept, at = b"", 0
        for a, z in spans:
            kept, at = kept + b[at:a], z
        want.append((i, len(b), sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    same(suffix_dedup.op6_suffix_dedup(spark, folder), want)


def test_repeats_in_different_texts_of_one_id(spark, tmp_path):
    rows = edge.shared_ids()
    folder = edge.as_table(spark, tmp_path, "documents", spark.createDataFrame(rows, "doc_id long, text string"))
    seen = collections.Counter(b[p : p + 200] for _, t in rows for b in [t.encode()] for p in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = t.encode()
        gone = {q for p in range(len(b) - 199) if seen[b[p : p + 200]] > 1 for q in range(p, p + 200)}
        kept = bytes(x for q, x in enumerate(b) if q not in gone)
        want.append((i, len(b), len(gone), sum(q - 1 not in gone for q in gone), hashlib.sha256(kept).hexdigest()))
    same(suffix_dedup.op6_suffix_dedup(spark, folder), want)


@pytest.mark.parametrize("crowd", [near_dedup.CROWD, -1])
def test_near_duplicates(spark, corpus, crowd, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    if crowd < 0:  # many blocks to a bucket
        monkeypatch.setattr(near_dedup, "DENSE_BYTES", 3000)
    folder, docs = corpus
    sets = []
    for _, t in docs:
        w = t.encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    top = {i: i for i, _ in docs if i is not None}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    by = collections.defaultdict(list)
    for n, (i, _) in enumerate(docs):
        for g in sets[n]:
            by[g].append(n)
    for a, b in {(a, b) for group in by.values() for a in group for b in group if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]) and docs[a][0] is not None and docs[b][0] is not None:
            x, y = root(docs[a][0]), root(docs[b][0])
            top[max(x, y)] = min(x, y)
    want = [(i, len(s), None if i is None else root(i), i is not None and root(i) == i) for (i, _), s in zip(docs, sets, strict=True)]
    same(near_dedup.op10_near_dedup(spark, folder), want)


def test_scores(spark, corpus):
    folder, docs = corpus
    counts = collections.Counter()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    for i, t in docs:
        if not held[i]:
            counts.update(t.encode().lower().split())
            counts[b""] += 1
    total, distinct, want = sum(counts.values()), len(counts), []
    for i, t in docs:
        w = [*t.encode().lower().split(), b""]
        want.append((i, held[i], len(w), sum(x in counts for x in w), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)))
    got = lm_score.op1_lm_score(spark, folder).collect()
    key = lambda r: (repr(r[0]), r[2], round(r[5], 3))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5] and abs(a["base_score"] - b[5]) <= 1e-6 * abs(b[5]) and a["score"] < 0
    if folder == SF:  # the model does better than the base on what it hasn't seen
        assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_licenses(spark, corpus):
    folder, docs = corpus
    got = {(r["doc_id"], r["license"], r["first_word"]) for r in license_scan.op9_license_scan(spark, folder).collect()}
    want = set()
    for i, t in docs:
        w = license_scan.license_words(t.encode())
        for name, text in license_scan.TEMPLATES.items():
            own = license_scan.license_words(text.encode())
            want |= {(i, name, p) for p in range(len(w) - len(own) + 1) if w[p : p + len(own)] == own}
    assert want <= got and len(got) <= len(want) + 3  # near matches may be among them
