"""The operators' parts, contracts and edge cases."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaystone.llm import automata, bloom, chat_format, components, decontaminate, deep_shallow, license_scan, lm_score, near_dedup, quality_rules, registry, secret_scan, sentence_pieces, suffix_dedup, templates, url_filter
from tests.conftest import SF, rows
from tests.llm import edge


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = rows(registry.queries()[name](spark, SF))
    cursor = duck.execute(registry.oracle_sql()[name])
    assert got == rows(cursor.fetchall(), [d[0] for d in cursor.description])


def test_every_operator_is_registered():
    found = registry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in found) for n in range(1, 14)] == [1] * 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "secret_scan", "sentence_pieces"]


EMPTY = [
    ("documents", lambda s, d: quality_rules.judge(d, s.createDataFrame([], "doc_id long, quality int"))), ("documents", lambda s, d: near_dedup.link(d)), ("documents", lambda s, d: suffix_dedup.dedup(d)), ("documents", lambda s, d: secret_scan.scan(d)),
    ("documents", lambda s, d: secret_scan.redact(d)), ("documents", lambda s, d: sentence_pieces.encoded(d)), ("documents", lambda s, d: license_scan.scan(d)), ("documents", lambda s, d: decontaminate.overlaps(d, s.read.parquet(f"{SF}/benchmark.parquet"))),
]


@pytest.mark.parametrize("case", range(len(EMPTY)))
def test_empty_tables(spark, case):
    assert EMPTY[case][1](spark, edge.documents(spark).limit(0)).count() == 0


def test_empty_scores(spark, tmp_path):
    folder = edge.as_table(spark, tmp_path, "documents", edge.documents(spark).limit(0))
    assert lm_score.op1_lm_score(spark, folder).count() == 0


def test_stages_on_awkward_documents(spark, tmp_path):
    docs = edge.documents(spark)
    edge.as_table(spark, tmp_path, "benchmark", spark.createDataFrame([(1, edge.sentence(4, 60), "x"), (None, "a b c", "x"), (2, None, "x"), (3, "one two", "x")], "item_id long, text string, doc_id string"))
    folder = edge.as_table(spark, tmp_path, "labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    kept = [r[0] for r in quality_rules.stage(spark, docs, folder).select("doc_id").collect()]
    assert {5, 6, 7, 8, 10, 15, 9} <= set(kept) and not {0, 1, 2, 3, 11, 14} & set(kept)
    kept = [r[0] for r in near_dedup.stage(spark, docs, folder).select("doc_id").collect()]
    assert 5 in kept and not {4, 6, 7, 9, 12} & set(kept) and kept.count(None) == 2 and {0, 1, 2} <= set(kept)
    kept = [r[0] for r in decontaminate.stage(spark, docs, folder).select("doc_id").collect()]
    assert not {3, 4, 15} & set(kept) and {0, 1, 2, 5, 8} <= set(kept) and kept.count(12) == 2
    out = secret_scan.stage(spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == docs.count()
    text = {r["doc_id"]: r for r in out.collect()}
    assert "[assign]" in text[15]["text"] and "AKIA" not in text[15]["text"] and text[15]["n_chars"] == len(text[15]["text"]) and text[0]["text"] is None


def test_stages_decide_per_row(spark, tmp_path):
    """Clean texts stay where another text under their id, or without an id, goes."""
    clean, other, third, item = (edge.sentence(n, 80) for n in (31, 32, 33, 34))
    texts = [(1, clean), (2, clean + " end"), (2, other), (None, third), (None, "short"), (None, None), (3, "short"), (3, item), (4, item + " more"), (4, edge.sentence(35, 80)), (None, item + " x")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    edge.as_table(spark, tmp_path, "benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))
    folder = edge.as_table(spark, tmp_path, "labels", spark.createDataFrame([], "doc_id long, quality int"))
    got = lambda stage: sorted(((r[0], r[1]) for r in stage(spark, docs, folder).select("doc_id", "text").collect()), key=repr)
    assert got(quality_rules.stage) == sorted((x for x in texts if x[1] not in ("short", None)), key=repr)
    assert got(decontaminate.stage) == sorted((x for x in texts if not x[1] or item not in x[1]), key=repr)
    near = got(near_dedup.stage)
    assert {(1, clean), (2, other), (None, third), (None, None), texts[9]} <= set(near) and texts[1] not in near
    assert sum(item in (t or "") for _, t in near) == 1 and near_dedup.stage(spark, docs, folder).columns == docs.columns


def test_pipeline_equals_its_stages_and_plain_forms(spark):
    """Rows of the whole pipeline against one worked out by hand from the operators' own queries."""
    import hashlib

    import sentencepiece

    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r["doc_id"] for r in quality_rules.op8_quality_rules(spark, SF).where("kept").collect()}
    linked = {}
    for r in near_dedup.link(spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(sorted(good)))).collect():
        linked[r["doc_id"]] = r["component_id"]
    leaked = {r["doc_id"] for r in decontaminate.op2_decontaminate(spark, SF).collect()}
    want = {d for d in good if linked[d] == d and d not in leaked}
    assert set(out) == want
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    for d in want:
        ids = lib.encode(secret_scan.redacted(docs[d].encode()))
        assert out[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# the parts


def test_automaton_equals_re():
    import re

    rng = random.Random(2)
    patterns = ["ab*c", "(a|bc)+d?", "[a-c]{2,3}x", "a[abcdx]?", "(ab|a)(c|bcd)"]
    for p in patterns:
        dfa = automata.compile_rules([automata.parse(p)])
        for _ in range(300):
            t = "".join(rng.choice("abcdx") for _ in range(rng.randint(0, 7)))
            s = 0
            for b in t.encode():
                s = dfa.rows[s][b]
            assert bool(dfa.accepts[s]) == bool(re.fullmatch(p, t)), (p, t)


def test_spans_of_extra_rules():
    text = b"ghp_" + b"zQ" * 18 + b" x -----BEGIN RSA PRIVATE KEY----- "
    assert [s[0] for s in secret_scan.text_spans(text)] == ["github", "pem"]


def test_templates_fold_and_stay_in_the_sandbox():
    tree = templates.parse_template("a{{ 'b' ~ (1 + 1) }}{% if true %}c{% else %}d{% endif %}", {})
    assert tree == [("text", "ab2c")]
    sink = chat_format.Text()
    templates.compile_template("{{ x.__class__ }}{{ x['k'] }}{% for y in x.l %}{{ loop.index }}{{ y }}{% endfor %}", {})({"x": {"k": "v", "l": [7, 8]}}, sink)
    assert sink.text == "v1728"
    for bad in ("{{ f() }}", "{% import os %}", "{{ x | nothing }}", "{% for x in y %}", "{{ 'a }}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(bad, {})


@pytest.mark.parametrize("text", ["", "\\", "<s>", "</s>[INST] ok [/INST]", "<\\s>", "\\\\</s>\\", "[INST][INST]", "<", "[/INST]</s>"])
def test_escapes_are_reversible(text):
    safe = chat_format.escape(text)
    assert chat_format.unescape(safe) == text and not any(c in safe for c in chat_format.CONTROLS)


def test_conversations_with_nulls_and_ties(spark):
    rows_ = [(1, 0, "user", None, "x"), (1, 1, None, "a</s>b", "x"), (1, 1, "assistant", "a", "x"), (1, 1, "assistant", "a", "x"), (None, None, "assistant", "z\\", "x"), (2, 0, "assistant", "", "x")]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, spans string")
    got = {r["conv_id"]: r for r in chat_format.digests(df).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 2 and got[None]["loss_chars"] == 2 and got[2]["loss_chars"] == 0
    assert chat_format.digests(df.limit(0)).count() == 0
    whole = {r["conv_id"]: r for r in chat_format.formatted(df).collect()}
    assert [chat_format.unescape(whole[None]["text"][a:b]) for a, b in whole[None]["spans"]] == ["z\\"] and len(whole[1]["text"]) == got[1]["formatted_chars"]


def test_urls(spark):
    urls = ["http://a.net/x", "https://A.EXAMPLE.net/en/1", "http://example.com/de/", "http://xexample.com/de/", "http://a.org/fr/1", None, "nothing", "http://net", "http://w.x.org/p/?utm_source=1", "https://www.w.x.org/p#top", ""]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    listed = spark.createDataFrame([("w.x.org/p",), (None,), ("w.x.org/p",)], "canonical string")
    got = {}
    for r in url_filter.judge(pages, listed).collect():
        got.setdefault(r["page_id"], []).append((r["rule"], r["verdict"]))
    assert got[0] == got[11] == [("net/", "block")] and got[1] == [("example.net/en/", "allow")] and got[2] == [("example.com/de/", "block")] and got[3] == [(None, "allow")]
    assert got[4] == [("org/fr/", "allow")] and got[5] == got[6] == got[7] == got[10] == [(None, "allow")] and got[8] == got[9] == [(None, "block")]
    assert url_filter.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 3 and url_filter.judge(pages.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    urls = spark.range(2000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    filters, blocks = bloom.build(urls, "canonical")
    assert bloom.probed(urls, "canonical", filters, blocks).count() == 2000
    others = spark.range(20000).select(F.concat(F.lit("other/"), "id").alias("canonical"))
    both = bloom.probed(others, "canonical", filters, blocks, keep_all=True)
    assert both.count() == 20000 and both.where("possible").count() < 400
    assert bloom.probed(others, "canonical", *bloom.build(urls.limit(0), "canonical")).count() == 0


def test_substituted_copies_are_found_and_others_left(spark):
    item = edge.sentence(9, 40)
    w = item.split(" ")
    changed = list(w)
    for i in range(3, 40, 9):
        changed[i] = "zzz"
    docs = spark.createDataFrame([(1, "before " + " ".join(changed) + " after"), (2, edge.sentence(10, 200)), (3, " ".join(w[10:35])), (4, " ".join(w[:9])), (5, None)], "doc_id long, text string")
    got = {r["doc_id"] for r in decontaminate.overlaps(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1, 3}


def test_seed_masks_hit_every_placement_of_substitutions():
    import itertools

    bits = [[i for i, b in enumerate(m) if b == "1"] for m in decontaminate.SEED_MASKS]
    assert all(b[0] == 0 and b[-1] == len(m) - 1 for b, m in zip(bits, decontaminate.SEED_MASKS, strict=True))
    for n in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        most = n - -(-decontaminate.AGREE_PCT * n // 100)
        placed = [sum(1 << (at + i) for i in b) for b in bits for at in range(n - b[-1])]
        for changed in itertools.combinations(range(n), most):
            bad = sum(1 << i for i in changed)
            assert any(not bad & p for p in placed), (n, changed)


def best_alignments(words, item):
    """Most agreeing words of each accepted alignment, by trying every shift."""
    span, out = min(len(item), decontaminate.WINDOW), {}
    for shift in range(-len(item) + 1, len(words)):
        same = [0 <= i + shift < len(words) and words[i + shift] == w for i, w in enumerate(item)]
        agree = max(sum(same[j : j + span]) for j in range(len(item) - span + 1))
        if 100 * agree >= decontaminate.AGREE_PCT * span if span >= decontaminate.SPAN else agree == span:
            out[shift] = agree
    return span, out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(21)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in [*range(8, 25), 40]}
    docs, d = {}, 0
    for n, item in items.items():
        for extra in (0, 0, 0, 0, 0, 0, 1):  # as many substitutions as are allowed, and one more
            copy = item[:20] if n >= 20 else list(item)
            for i in rng.sample(range(len(copy)), len(copy) // 4 + extra):
                copy[i] = "zzz"
            docs[d] = [f"a{d}"] * rng.randint(0, 3) + copy + [f"b{d}"] * rng.randint(0, 3)
            d += 1
    want = set()
    for d, words in docs.items():
        for n, item in items.items():
            span, found = best_alignments(words, item)
            if found:
                want.add((d, n, span, max(found.values()), len(found)))
    frame = lambda rows_, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows_.items()], f"{key} long, text string")
    assert {tuple(r) for r in decontaminate.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()} == want


def test_all_places_of_a_repeated_phrase_are_aligned(spark):
    phrase, between = [f"p{i}" for i in range(9)], [f"x{i}" for i in range(11)]
    item = phrase + between + phrase
    words = ["zzz" if i in (2, 4, 6, 8, 10) else w for i, w in enumerate(between)] + phrase  # only the phrase has whole seeds
    span, found = best_alignments(words, item)
    docs, items = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.overlaps(docs, items).collect()] == [(1, 7, span, max(found.values()), len(found))]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5), (200, 100)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 20)) and got[200] == 100 and 0 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deep_shallow_sort_and_common_prefixes():
    rng = random.Random(4)
    for _ in range(40):
        n, width = rng.randint(1, 50), rng.choice([8, 60, 150])
        strings = [rng.choice([b"a" * rng.randint(0, width), bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, width)))]) for _ in range(n)]
        m = np.zeros((n, width), np.uint8)
        for i, x in enumerate(strings):
            m[i, : len(x)] = np.frombuffer(x, np.uint8)
        group = np.array([rng.randint(0, 2) for _ in range(n)])
        order = deep_shallow.sort(m, np.array([len(x) for x in strings]), group)
        assert [(group[i], strings[i]) for i in order] == sorted((group[i], strings[i]) for i in range(n))


def test_crowded_groups_are_settled_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, suffix_dedup.dedup(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "MOST_SORTED", 1)
    assert sorted(map(tuple, suffix_dedup.dedup(docs).collect())) == want


SMALL = lm_score.Sizes(top=6, tails=5, dictionary=40, dim=4, word_dim=3, batch=64, noise=8)


def small_lexicon(sizes=SMALL, listed=40):
    """60 words, of which the more frequent are in the dictionary."""
    counts = {b"w%d%d" % (i % 7, i): 200 // (i + 1) + 1 for i in range(60)}
    rows = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    tails = {}
    for w, c in rows[sizes.top :]:
        n, v = tails.get(k := lm_score.tail_class(w, sizes), (0, 0))
        tails[k] = (n + c, v + 1)
    return lm_score.Lexicon([(b"", 50), *rows[:listed]], tails, sum(counts.values()) + 50, 61, sizes), counts


def plain_score(words, counts, lex, m):
    """log10 of a text's probability, token by token from the definition."""
    sizes, total = lex.sizes, 0.0
    kind = lambda w: lex.number[w] if w in lex.number and lex.number[w] < sizes.top else lm_score.tail_class(w, sizes)
    outputs = [w for w in range(sizes.classes) if w != sizes.start]
    before = [sizes.start, sizes.start]
    for w in [*words, None]:
        k = sizes.end if w is None else kind(w)
        u, v = before
        h = m.c[0] * m.r[u] + m.c[1] * m.r[v]
        s = {x: float(h @ m.q[x] + m.b[x]) for x in outputs}
        total += s[k] - math.log(sum(math.exp(x) for x in s.values()))
        if w is not None and k >= sizes.top:
            t = k - sizes.top
            inside = {j: math.exp(float(m.g[v] @ m.p[j] + m.d[j])) for j in range(lex.first[t], lex.first[t + 1])}
            rest = lex.others[t] / lex.tail_total[t]
            if w in lex.number:
                total += math.log(inside[lex.tail_of[lex.number[w]]] / (sum(inside.values()) + rest))
            else:
                total += math.log(rest / (sum(inside.values()) + rest)) + math.log((counts.get(w, 0) + 1) / lex.others[t])
        before = [v, k]
    return total / math.log(10)


def random_model(lex):
    rng, m = np.random.default_rng(0), lm_score.Model.start(lex)
    return lm_score.Model(**{k: (v + rng.normal(0, 0.4, v.shape)).astype(np.float32) for k, v in m.parts.items()})


def test_probabilities_sum_to_one():
    lex, counts = small_lexicon()
    m = random_model(lex)
    after = [b"w00", b"w550", b"nowhere"]
    for a in after:  # over all next tokens: every counted word, all unknown ones of each class together, and the end
        first = plain_score([a], counts, lex, m)
        steps = [10 ** (prefix_score([a, w], counts, lex, m) - prefix_score([a], counts, lex, m)) for w in counts]
        unknown = []
        for k in range(lex.sizes.tails):
            word = next(x for x in (b"%c%c" % (97 + i, 97 + j) for i in range(26) for j in range(26)) if lm_score.tail_class(x, lex.sizes) == lex.sizes.top + k)
            unknown.append(10 ** (prefix_score([a, word], counts, lex, m) - prefix_score([a], counts, lex, m)))
        end = 10 ** (first - prefix_score([a], counts, lex, m))
        assert abs(sum(steps) + sum(unknown) + end - 1) < 1e-4


def prefix_score(words, counts, lex, m):
    """As plain_score, but without the end."""
    with_end = plain_score(words, counts, lex, m)
    sizes = lex.sizes
    kind = lambda w: lex.number[w] if w in lex.number and lex.number[w] < sizes.top else lm_score.tail_class(w, sizes)
    u, v = ([sizes.start, sizes.start] + [kind(w) for w in words])[-2:]
    h = m.c[0] * m.r[u] + m.c[1] * m.r[v]
    s = {x: float(h @ m.q[x] + m.b[x]) for x in range(sizes.classes) if x != sizes.start}
    return with_end - (s[sizes.end] - math.log(sum(math.exp(x) for x in s.values()))) / math.log(10)


def test_scores_equal_the_definition(spark):
    lex, counts = small_lexicon()
    m = random_model(lex)
    rng = random.Random(4)
    texts = ["", "nowhere w00 w11", *(" ".join(rng.choice([*[w.decode() for w in counts], "zz", "q."]) for _ in range(rng.randint(1, 30))) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(bytearray(w), c) for w, c in counts.items()] + [(bytearray(b""), 50)], "word binary, count long")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, table, lex, m).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - plain_score(t.encode().split(), counts, lex, m)) < 1e-3, t


def test_training_learns_which_word_follows():
    """Within a class, and between classes."""
    lex, counts = small_lexicon()
    t = lm_score.Trainer(lm_score.Model.start(lex), lex, (1,))
    k = max(range(SMALL.tails), key=lambda k: lex.first[k + 1] - lex.first[k])
    one, two = lex.first[k], lex.first[k] + 1
    documents = []
    for i in range(400):  # class 0 is followed by one of the class's words, class 1 by another
        documents.append((np.array([i % 2, SMALL.top + k], np.int16), np.array([-1, (one, two)[i % 2]], np.int32)))
    for _ in range(40):
        t.drain(list(documents))
    scorer = lm_score.Scorer(lex, t.m, t.m.word_sums(lex))
    for v, good, bad in ((0, one, two), (1, two, one)):
        p = [scorer.tokens([(np.array([v, SMALL.top + k], np.int16), np.array([-1, j], np.int32))])[1] for j in (good, bad)]
        assert p[0] > p[1] + 1


AWKWARD = [b"", b" ", b" a  B.\t\x0b\x0c\r\n c ", b"\x1c x\x00y \xff\xfeZ. .. \xff", b"\xc3\x89 \xc2\xa0 q\xe2\x80\x83r"]


def test_words_of_arrays_equal_those_of_single_texts():
    texts = pa.array([b"before", *AWKWARD, b"w00 w11, zz W00 (zz) zz"], pa.binary())[1:]
    n, words = lm_score.split_words(texts)
    want = [t.lower().split() for t in texts.to_pylist()]
    assert n.tolist() == [len(x) for x in want] and words.to_pylist() == [w for x in want for w in x]
    assert lm_score.tail_classes(words[1:]).tolist() == [lm_score.tail_class(w) for w in words[1:].to_pylist()]


def test_texts_are_encoded_once(spark, monkeypatch):
    """Training and scoring read the same codes; words outside the dictionary stand beside them."""
    calls, own = [], lm_score.coded
    monkeypatch.setattr(lm_score, "coded", lambda *x: calls.append(x) or own(*x))
    texts = [x.decode("utf-8", "ignore") for x in AWKWARD] + ["w00 w11 zz w00 zz", "w00 w22", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lm_score.scored(docs, SMALL).count() == len(texts) and len(calls) == 1
    lex, _ = small_lexicon()
    for r in own(docs, lex).collect():
        words = (texts[r["doc_id"]] or "").encode().lower().split()
        codes = np.frombuffer(r["codes"], np.int32).tolist()
        assert codes == [lex.number.get(w, -1 - lm_score.tail_class(w, SMALL)) for w in words]
        missing = collections.Counter(w for w in words if w not in lex.number)
        assert dict(zip(map(bytes, r["others"]), r["times"], strict=True)) == missing


def plain_steps(m, words, batches, draws):
    """Noise-contrastive AdaGrad steps token by token, from the definition, in double precision. batches: (u, v, w, noise classes); draws: (v, word, noise words)."""
    sizes = words.sizes
    at = {k: np.array(x, np.float64) for k, x in m.parts.items()}
    seen = {k: np.ones_like(x) for k, x in at.items()}
    share = words.weight + 0.5
    share[sizes.start] = 0
    share = np.maximum(share / share.sum(), 1e-12)
    listed = np.bincount(words.tail_class, words.tail_counts + 1.0, sizes.tails)
    word_share = (words.tail_counts + 1.0) / listed[words.tail_class]

    def move(grads):
        for k, g in grads.items():
            seen[k] += g * g
            at[k] -= sizes.rate * g / np.sqrt(seen[k] + 1e-6)

    for batch in batches:
        grads = {k: np.zeros_like(at[k]) for k in "rqcb"}
        for u, v, w in zip(*batch[:3], strict=True):
            h = at["c"][0] * at["r"][u] + at["c"][1] * at["r"][v]
            for k, good in [(w, True), *((n, False) for n in batch[3])]:
                odds = h @ at["q"][k] + at["b"][k] - math.log(sizes.noise * share[k])
                d = 1 / (1 + math.exp(-odds)) - good
                grads["q"][k] += d * h
                grads["b"][k] += d
                for i, x in enumerate((u, v)):
                    grads["r"][x] += d * at["q"][k] * at["c"][i]
                    grads["c"][i] += d * at["q"][k] * at["r"][x]
        move(grads)
    for batch in draws:
        grads = {k: np.zeros_like(at[k]) for k in "gpd"}
        for v, j, noise in zip(*batch, strict=True):
            for k, good in [(j, True), *((n, False) for n in noise)]:
                d = 1 / (1 + math.exp(-(at["g"][v] @ at["p"][k] + at["d"][k] - math.log(sizes.word_noise * word_share[k])))) - good
                grads["p"][k] += d * at["g"][v]
                grads["d"][k] += d
                grads["g"][v] += d * at["p"][k]
        move(grads)
    return at


def test_steps_equal_the_definition():
    lex, _ = small_lexicon()
    m, rng = random_model(lex), np.random.default_rng(5)
    batches = [[rng.integers(0, SMALL.classes - 1, 64).astype(np.uint16) for _ in range(3)] for _ in range(3)]
    for b in batches:
        b[2].sort()
    v, j = rng.integers(0, SMALL.classes, 150).astype(np.uint16), rng.integers(0, len(lex.tail_class), 150).astype(np.int32)
    t, same = lm_score.Trainer(m, lex, (3,)), lm_score.Trainer(m, lex, (3,))
    for b in batches:
        t.step(*b)
        b.append(same.noise())
    t.word_steps(v, j)
    drawn, draws = same.draw_words(), []
    for i in range(0, len(j), SMALL.batch):
        part = slice(i, i + SMALL.batch)
        turn = same.rng.integers(0, lm_score.POOL, len(j[part]))[:, None] + np.arange(SMALL.word_noise)
        draws.append((v[part], j[part], drawn[lex.tail_class[j[part]][:, None], turn % lm_score.POOL]))
    want = plain_steps(m, lex, batches, draws)
    for k, x in t.m.parts.items():
        assert np.allclose(x, want[k], atol=1e-4), k
    assert t.times.tolist() == np.bincount(j, minlength=len(lex.tail_class)).tolist()


def test_sums_of_tasks_are_averages():
    lex, _ = small_lexicon()
    trainers = [lm_score.Trainer(random_model(lex), lex, (k,)) for k in (1, 2)]
    trainers[1].m = lm_score.Model(**{k: v + 1 for k, v in trainers[1].m.parts.items()})
    for t, times in zip(trainers, (1, 3), strict=True):
        t.times[:] = times
        t.times[0] = 0
    batches = [b for n, t in ((10, trainers[0]), (30, trainers[1])) for b in lm_score._sums(t, n, 0)]
    rows = sorted((tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows)), key=lambda r: r[:3])
    added = [r for b in lm_score._added(["kind", "part"])([lm_score._batch(rows)]) for r in b.to_pylist()]
    out = lm_score._averaged(lm_score.Model.start(lex), added)
    want = trainers[0].m
    assert np.allclose(out.q, want.q + 0.75, atol=1e-5) and np.allclose(out.p[1:], want.p[1:] + 0.75, atol=1e-5)
    assert np.allclose(out.p[0], 0)  # a word that no task met keeps its start


def test_binomial_bound():
    assert abs(quality_rules.binomial_cdf(2, 5, 0.3) - 0.83692) < 1e-4 and quality_rules.binomial_cdf(5, 5, 0.3) == 1.0
    assert quality_rules.choose(1000, [200, 30, 2, 0], [1, 2, 3, 4], 0.01, 0.01) == 3 and quality_rules.choose(10, [0], [1], 0.01, 0.01) is None


def test_cutoffs_keep_good_documents(spark):
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.repeat(F.lit("ab### cd "), 60)).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i)), " ")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"))
    counted = quality_rules.count_documents(docs.withColumn("text", F.concat("text", F.lit(" x "), F.col("doc_id").cast("string"))))
    cut = quality_rules.cutoffs(counted, labels).collect()
    assert cut[0]["__symbol_ratio_cutoff"] == 0.01


def test_license_bands_guarantee():
    assert license_scan.chance(0.15) > 1 - 1e-4
    text = edge.sentence(1, 100) + " " + license_scan.TEMPLATES["MIT-text"].replace("merge", "join") + " " + edge.sentence(2, 50)
    assert [x[0] for x in license_scan.find(license_scan.license_words(text.encode()))] == ["MIT-text"]


@pytest.mark.parametrize("name, inserted", [("Apache-2.0-header", 12), ("MPL-2.0-header", 4), ("MIT-text", 24)])
def test_licenses_with_inserted_words_are_found(name, inserted):
    own = license_scan.license_words(license_scan.TEMPLATES[name].encode())
    extra = [b"x%d" % i for i in range(inserted)]
    copy = own[: len(own) // 2] + extra + own[len(own) // 2 :]
    for copies in (1, 2):  # two copies stay apart
        got = [x[:3] for x in license_scan.find([b"before"] * 9 + copy * copies + [b"after"] * 9) if x[0] == name]
        assert got == [(name, 9 + i * len(copy), 9 + (i + 1) * len(copy)) for i in range(copies)]


def test_decoding_round_trip(spark):
    docs = edge.documents(spark)
    out = sentence_pieces.decoded(sentence_pieces.token_ids(docs))
    got = sorted((repr(r["doc_id"]), r["text"]) for r in out.collect())
    assert got == sorted((repr(i), t or "") for i, t in edge.texts())


@pytest.mark.parametrize("most", [0, 40])
def test_scores_with_a_small_dictionary(spark, most):
    """Words outside the dictionary get their counts by the join; nothing exact changes."""
    docs = spark.createDataFrame([(i, edge.sentence(i % 7, 40) if i else None) for i in range(30)], "doc_id long, text string")
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)]
    want = sorted(map(tuple, lm_score.scored(docs).select(*columns).collect()))
    assert sorted(map(tuple, lm_score.scored(docs, lm_score.Sizes(dictionary=most)).select(*columns).collect())) == want


def plain_overlap(doc, item):
    """Whether some window of the item agrees with the document in enough words, tried at every shift."""
    d, w = doc.lower().split(), item.lower().split()
    span = min(len(w), decontaminate.WINDOW)
    for shift in range(-len(w), len(d)):
        same = [0 <= i + shift < len(d) and d[i + shift] == x for i, x in enumerate(w)]
        best = max(sum(same[s : s + span]) for s in range(len(w) - span + 1))
        if best == span if span < decontaminate.SPAN else 100 * best >= decontaminate.AGREE_PCT * span:
            return True
    return False


def test_every_copy_with_substitutions_is_found(spark):
    """Random substitutions at the limit of what counts as a copy, against alignment by brute force."""
    rng, items, docs = random.Random(12), [], []
    for k in range(40):
        n = rng.choice([5, 9, 10, 12, 14, 16, 19, 20, 20, 27, 60])
        items.append((k, " ".join(f"i{k}w{rng.randint(0, 99)}" for _ in range(n))))
        for copy in range(6):
            w = items[-1][1].split(" ")
            if n > 20 and copy % 2:
                w = w[(at := rng.randint(0, n - 20)) : at + 20]
            most = len(w) // 4 if n >= 10 else 1
            for i in rng.sample(range(len(w)), rng.choice([most, most, max(0, most - 1), most + 1])):
                w[i] = f"new{rng.randint(0, 999)}"
            docs.append((len(docs), k, " ".join(["a b c d e f g"] * rng.randint(0, 3) + w + ["h i j k"])))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(spark.createDataFrame([d[::2] for d in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i, k, text in docs if plain_overlap(text, items[k][1])}
    assert got == want and len(want) > 150


def test_decontamination_without_a_benchmark(spark):
    docs, items = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string"), spark.createDataFrame([(1, "")], "item_id long, text string")
    assert decontaminate.overlaps(docs, items).count() == decontaminate.overlaps(docs, items.limit(0)).count() == decontaminate.overlaps(docs.limit(0), items).count() == 0


def test_added_secret_rules_match_as_expressions_do():
    rng = random.Random(3)
    parts = ["ghp_", "gho_", "xoxb-", "sk_live_", "rk_live_", "eyJ", ".eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "a1B2", "Zz9", "0" * 40, " ", "\n", "é", "AKIA", "_", "-"]
    added = [r for r in secret_scan.RULES if r.kind not in secret_scan.BASE]
    for _ in range(3000):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 1, 6]) for _ in range(rng.randint(1, 25)))
        want = sorted((m.start(), r.kind, m.end()) for r in added for m in re.finditer(r.pattern, text, re.A) if len(m[0]) >= r.shortest)
        assert sorted((a, k, b) for k, a, b in secret_scan.text_spans(text.encode()) if k not in secret_scan.BASE) == want, text


def test_invalid_bytes_do_no_harm(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('ff746f6b656e3a206162636465666768ff') AS string) AS text")
    assert secret_scan.scan(docs).first()["n_assign"] == 1 and sentence_pieces.encoded(docs).count() == 1 and secret_scan.redact(docs).count() == 1


def plain_cutoffs(rows, good):
    """Cutoffs of each stratum from the definition; rows: (doc_id, stratum, metrics, base_failed)."""
    out, strata = {}, sorted({s for i, s, _, failed in rows if i in good and not failed})
    each = quality_rules.LEVEL / (len(strata) * sum(map(len, quality_rules.GRID.values())))
    for s in strata:
        held = [m for i, x, m, failed in rows if x == s and i in good and not failed]
        for name, grid in quality_rules.GRID.items():
            for c in grid:
                k, n, p = sum(m[name] > c for m in held), len(held), quality_rules.ALLOWED / len(quality_rules.GRID)
                if k / n <= p and sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) <= each:
                    out[s, name] = c
                    break
    return out


def test_kept_follows_the_certified_cutoffs(spark):
    rng, docs, labels = random.Random(8), [], []
    for i in range(3000):
        bad = i % 8 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 400)) for _ in range(60 + i % 50)]
        if bad:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), ("en", "de", None)[i % 3]))
        labels.append((i, 0 if bad else 1))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = quality_rules.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    names = list(quality_rules.GRID)
    cut = plain_cutoffs([(r["doc_id"], r["__stratum"], {m: r[f"__{m}"] for m in names}, r["__base_failed"]) for r in out if r["__stratum"]], {i for i, q in labels if q})
    assert any(k[1] == "symbol_ratio" for k in cut)
    for r in out:
        over = any(r[f"__{m}"] > cut.get((r["__stratum"], m), math.inf) for m in names)
        assert r["__kept"] == (not r["__base_failed"] and not over)


def test_contained_licenses_by_brute_force():
    """Templates with words dropped: found if and only if three quarters of their shingles are left in some stretch."""
    rng = random.Random(6)
    for name, text in license_scan.TEMPLATES.items():
        own = license_scan.license_words(text.encode())
        size = len(set(license_scan.windows(own).tolist()))
        for _ in range(12):
            w = list(own)
            for i in sorted(rng.sample(range(len(w)), rng.randint(0, max(1, len(w) // 8))), reverse=True):
                w[i : i + 1] = [] if rng.random() < 0.5 else [b"other"]
            padded = [b"before%d" % i for i in range(12)] + w + [b"after%d" % i for i in range(12)]
            left = len(set(license_scan.windows(padded).tolist()) & set(license_scan.windows(own).tolist())) if len(padded) > 4 else 0
            found = [x for x in license_scan.find(padded) if x[0] == name]
            assert bool(found) == (100 * left >= license_scan.CONTAINED_PCT * size), (name, left, size)


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    """Blocks of a few members and dense groups give the same components."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, near_dedup.link(docs).collect()), key=repr)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    assert sorted(map(tuple, near_dedup.link(docs).collect()), key=repr) == want
    monkeypatch.setattr(near_dedup, "CROWD", 0)
    assert sorted(map(tuple, near_dedup.link(docs).collect()), key=repr) == want


@pytest.mark.parametrize("name", ["op2_decontaminate", "op5_url_filter", "op6_suffix_dedup", "op8_quality_rules", "op10_near_dedup"])
def test_plans_of_large_tables_give_the_same_rows(spark, name):
    """Without automatic broadcasts every join is the shuffled one that large tables get."""
    query = registry.queries()[name]
    want = sorted(map(tuple, query(spark, SF).collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, query(spark, SF).collect()), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
