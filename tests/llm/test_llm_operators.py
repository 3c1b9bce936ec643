"""Each operator against a plain implementation, with nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequoria.llm import bpe, components, fingerprint, hnsw, hyperminhash, langid, licenses, mixing, ppm, quality, urlfilter

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text(1, 120).split()
    near = " ".join(base[:-1] + ["other"])
    rows = [(1, " ".join(base)), (2, near), (3, " ".join(base).upper()), (4, text(2, 80)), (5, None), (6, ""), (7, " \n\t"), (8, "two words"), (9, "Two  words"), (10, text(3, 30_000)), (4, text(2, 80))]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i != 5 else None, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs):
    got = {r.doc_id: r for r in hyperminhash.near_duplicates(docs).collect()}
    assert {k: r.component_id for k, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10}
    assert all(got[r.doc_id].n_shingles == len(shingles(r.text)) for r in docs.collect())
    assert hyperminhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (5, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100}


def test_bpe_matches_the_library_and_round_trips(spark, docs):
    import tiktoken

    path, pattern = bpe.tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = sorted((r.doc_id, len(ids := own.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted(map(tuple, bpe.encode(docs, path, pattern).collect())) == want


def test_stitching(spark):
    import regex

    form = regex.compile(bpe.tokenizer()[1])
    r = random.Random(5)
    for _ in range(200):
        t = "".join(r.choice(" \n\tab'sdlv12!?é漢") for _ in range(r.randrange(400)))
        assert bpe.pretokens(t, form, chunk=r.choice([5, 17, 40]), overlap=r.choice([6, 12, 30])) == form.findall(t)


def test_fingerprints(spark, docs):
    got = fingerprint.fingerprints(docs.filter("doc_id <> 4").drop("lang")).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.filter("doc_id <> 4").collect()), reverse=True)
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        assert abs(by[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    assert by[5].fingerprint == by[6].fingerprint == ""


def test_language(spark):
    model = {"a": "abc abd acb abc bca " * 50, "b": "xyz xzy yxz zyx " * 50}
    df = spark.createDataFrame([(1, "abc acb abd"), (2, "ZYX xyz"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["a", "b", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_ppm(train, texts, order=ppm.ORDER):
    from collections import Counter, defaultdict

    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        s = b"\n" * order + t + b"\n"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k : i]][s[i]] += 1
    for t in texts:
        s, total = b"\n" * order + t + b"\n", 0.0
        for i in range(order, len(s)):
            out = set()
            for k in range(order, -1, -1):
                c = {a: n for a, n in counts[k].get(s[i - k : i], {}).items() if a not in out}
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                total += np.log10((c.get(s[i]) or d) / (n + d))
                if s[i] in c:
                    break
                out |= set(c)
            else:
                total -= np.log10(256 - len(out))
        yield total


def test_ppm(spark, docs):
    rows = docs.filter("doc_id < 10").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in ppm.score(rows, F.col("doc_id") % 4 != 1).collect()}
    texts = {r.doc_id: ppm.canonical((r.text or "").encode()) for r in rows.collect()}
    ids = sorted(texts)
    for i, want in zip(ids, plain_ppm([texts[i] for i in ids if i % 4 != 1], [texts[i] for i in ids]), strict=True):
        assert abs(got[i].score - want) < 1e-8
        assert got[i].n_tokens == len(texts[i].split()) + 1


def test_licenses(spark):
    wrapped = "Some words.\n\n# Licensed under the\n# Apache Licence, Version 2.0.\n\nmore words"
    rows = [(1, "RELEASED under the MIT licence!"), (2, "x\nReleased under the MIT License.\nCopyright 2020 A"), (3, None), (4, ""), (5, wrapped), (5, wrapped), (6, "word " * 300_000 + "\nLicensed under CC BY 4.0.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in licenses.scan(df, licenses.known_licenses(spark)).collect()}
    assert (got[1].text_license, got[2].text_license, got[2].line_licenses, got[2].n_license_lines) == ("MIT", None, "MIT", 1)
    assert (got[3].text_license, got[4].line_licenses, got[5].paragraph_licenses, got[6].line_licenses) == (None, "", "Apache-2.0", "CC-BY-4.0")
    assert licenses.scan(df, licenses.known_licenses(spark)).count() == 7 and licenses.scan(df.limit(0), licenses.known_licenses(spark)).count() == 0


def test_licenses_as_they_are_published(spark):
    """The package that is under test brings whole licences of others along."""
    from pathlib import Path

    import pyspark

    folder = Path(pyspark.__file__).parent / "licenses"
    want = {"AnchorJS": "MIT", "bootstrap": "MIT", "d3.min.js": "ISC", "xz": "0BSD", "CC0": "CC0-1.0", "json-formatter": "Apache-2.0", "graphlib-dot": "MIT", "cloudpickle": None}
    texts = [(k, (folder / f"LICENSE-{name}.txt").read_text()) for k, name in enumerate(want)]
    titled = [(100 + k, f"{titles[0] if titles else ''}\n\nCopyright (c) 2024 Jane Doe\nAll rights reserved.\n\n{body}") for k, (_, titles, body) in enumerate(licenses.WHOLE)]
    got = {r.doc_id: r.text_license for r in licenses.scan(spark.createDataFrame(texts + titled, "doc_id long, text string"), licenses.known_licenses(spark)).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())
    assert [got[100 + k] for k in range(len(licenses.WHOLE))] == [name for name, *_ in licenses.WHOLE]


def test_spellings_next_to_each_other(spark):
    df = spark.createDataFrame([("Licence, licence LICENCE",), ("GPLv3 v2.0",), ("non-commercial\nnon commercial",), ("1. one\n * two\n(c) me\nCopyright holders say",)], "t string")
    assert [r[0] for r in df.select(licenses.canonical(F.col("t"))).collect()] == ["license license license", "gpl version 3 version 2 0", "noncommercial noncommercial", "one two copyright owners say"]


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 3 * r.size for r in got)
    goal = mixing.targets([("a", 100), ("b", 1000), (None, 10)])
    assert abs(sum(goal.values()) - 1110) < 1e-9 and goal["a"] == 300 and goal[None] == 30
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_quality():
    rows = [(*quality.features(t.encode()), g) for k in range(60) for t, g in ((text(k, 40), 2), ("SHOUT!! " * 30, 0), (text(k, 20) + " bad bad words words", 1))]
    model = quality.fit(rows, 3)
    assert (np.diff(model.thresholds) > 0).all()
    right = sum(round(model.tails(float(model.weights[f] @ v)).sum()) == g for f, v, g in rows)
    assert right > 0.95 * len(rows)


def test_urls(spark):
    urls = ["https://www.a.example.com/en/1?x=2#y", "HTTP://WWW.Example.COM/en/", "no scheme", None, "http://b.net/fr/2", "http://x.org?q"]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(6)] == [("www.a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("", "", None), ("", "", None), ("b.net", "/fr/2", "net/fr/"), ("x.org", "", None)]


def test_vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    x = np.vstack([base, base[:10] + 0.02 * r.normal(size=(10, 16)), np.repeat(base[:1], 5, axis=0)])
    rows = [(i, [float(a) for a in v], i % 2) for i, v in enumerate(x)] + [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 1)]
    got = {g.vec_id: g for g in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(links, False)
    assert [got[i].n_links for i in range(len(x))] == links.sum(1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102))


def test_pipeline_keeps_every_text(spark):
    import corpus_pipeline

    rows = [(1, "alpha beta c"), (1, "d e f g"), (1, "d e f g"), (2, "alpha beta c"), (None, "x y"), (None, "z"), (3, None), (-5, ""), (4, "x y")]
    frame = spark.createDataFrame([(i, t, "en", "s", 9, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key int")
    got = corpus_pipeline.once(spark, frame, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(r.text or "" for r in got.collect()) == ["", "", "alpha beta c", "d e f g", "x y", "z"]
    assert corpus_pipeline.once(spark, frame.limit(0), "").count() == 0


def test_pipeline_drops_near_copies_from_080_on(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(104)]  # 100 shingles; other last words leave 100 - k of 100 + k
    ends = {1: 0, 2: 9, 3: 11, 4: 13}  # Jaccard with 1: 91/109 = 0.83, 89/111 = 0.802, 87/113 = 0.77
    rows = [(i, " ".join(base[: 104 - k] + [f"{i}x{j}" for j in range(k)]), "en", "s", 9) for i, k in ends.items()]
    sets = {i: shingles(t) for i, t, *_ in rows}
    near = [i for i in sets if i > 1 and 5 * len(sets[1] & sets[i]) >= 4 * len(sets[1] | sets[i])]
    assert near == [2, 3]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.once(spark, frame, "").collect()) == [1, 4]


@pytest.mark.parametrize("bound", [1, 16, 300])
def test_ppm_scores_by_the_whole_trie_past_its_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(ppm, "MODEL_GRAMS", bound)
    monkeypatch.setattr(ppm, "FREQUENT_WORDS", 5)
    texts = {i: text(i, 30) + " żółw 漢字" * (i % 3) for i in range(8)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm.score(rows, F.col("doc_id") % 4 != 1).collect()}
    plain = {i: ppm.canonical(t.encode()) for i, t in texts.items()}
    for i, want in zip(plain, plain_ppm([plain[j] for j in plain if j % 4 != 1], plain.values()), strict=True):
        assert abs(got[i] - want) < 1e-8


def test_samples_lose_no_language_of_many_copies(spark):
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 10).alias("lang"), F.concat(F.lit("- 1 "), F.col("id") % 10, F.lit(" word "), F.translate((F.col("id") % 10).cast("string"), "0123456789", "abcdefghij")).alias("text"))
    df = df.union(spark.createDataFrame([(20_000, "m", " 12 " * 3000 + "late")], "doc_id long, lang string, text string"))
    assert langid.samples(df, F.lit(True)) == {f"l{i}": f"word {'abcdefghij'[i]} " for i in range(10)} | {"m": "late "}


@pytest.mark.parametrize("wide", [40, 70, 900])
def test_phrases_over_the_whole_alphabet(monkeypatch, wide):
    r = random.Random(wide)
    signs = [chr(0x4E00 + i) for i in range(wide - 10)] + [chr(0x1E922 + i) for i in range(10)]
    sample = "".join(signs + r.choices(signs, weights=[1 / (i + 1) for i in range(wide)], k=3000))
    texts = ["".join(sample[(k := r.randrange(2900)) : k + r.randrange(1, 9)] for _ in range(20)) for _ in range(30)]
    texts += ["?" + t[:9] + "??" + t[9:] + "?" for t in texts[:9]] + ["?"]

    def plain(t):
        at = count = 0
        while at < len(t):
            to = at + 1
            while to < len(t) and t[at : to + 1] in sample:
                to += 1
            at, count = to, count + 1
        return count

    parser = langid.Parser(sample)
    for part in (512, 7, 3):  # phrases go on over the borders of stretches
        monkeypatch.setattr(langid, "STRETCH", part)
        points, owner = langid.stretches(texts)
        follows, end, got = np.diff(owner, prepend=-1) == 0, 0, np.zeros(len(texts))
        for i in range(0, len(owner), 50):
            count, end = parser.phrases(np.ascontiguousarray(points[:, i : i + 50]), follows[i : i + 50], end)
            got += np.bincount(owner[i : i + 50], count, len(texts))
        assert got.tolist() == [plain(t) for t in texts]


def test_language_keeps_marks_of_every_script(spark):
    hindi, thai, chinese, english = "हिन्दी में यह एक वाक्य है ", "ภาษาไทยเป็นภาษาที่มีวรรณยุกต์ ", "我们今天去学校读书写字然后回家吃饭 ", "this is a plain sentence of words "
    assert langid.letters("हिन्दी, में!") == "हिन्दी में"
    model = {"en": english * 20, "hi": hindi * 20, "th": thai * 20, "zh": chinese * 20}
    df = spark.createDataFrame([(1, "यह हिन्दी है"), (2, "ภาษาไทย"), (3, "今天去学校"), (4, "plain words"), (5, chinese * 2000)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(df, model).orderBy("doc_id").collect()] == ["hi", "th", "zh", "en", "zh"]


def test_vectors_over_many_shards(spark, monkeypatch):
    """Planted near copies across shards of one label, and a label without any."""
    monkeypatch.setattr(hnsw, "SHARD", 64)
    r = np.random.default_rng(8)
    base = r.normal(size=(200, 16))
    x = np.vstack([base, base[:60] + 0.02 * r.normal(size=(60, 16)), np.repeat(base[:1], 40, axis=0)])
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)] + [(1000 + i, [float(a) for a in v], 1) for i, v in enumerate(r.normal(size=(150, 16)))]
    rows += [(5, rows[5][1], 0), (2000, [float("inf")] + [1.0] * 15, 0), (2001, [1.0] * 16, None), (None, [1.0] * 16, 0)]
    got = hnsw.near_duplicates(spark.createDataFrame([(*q, 7) for q in rows], "vec_id long, embedding array<float>, label int, kept int")).collect()
    by = {g.vec_id: g for g in got}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = u @ u.T >= 0.98
    np.fill_diagonal(links, False)
    assert len(got) == len(rows) and [by[i].n_links for i in range(len(x))] == links.sum(1).tolist()
    assert all(by[i].n_links == 0 and by[i].kept for i in (1003, 2000, 2001)) and not by[None].kept
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_graph_links_against_all_pairs(same):
    """A large group, small ones and single vectors, within a shard and between two."""
    r = np.random.default_rng(11)
    base = r.normal(size=(1500, 24))
    x = np.vstack([base, base[:1] + 0.05 * r.normal(size=(700, 24)), base[5:300] + 0.03 * r.normal(size=(295, 24))])
    x = r.permutation(x / np.linalg.norm(x, axis=1)[:, None])
    own, queries = (x, x) if same else (x[::2], x[1::2])
    got = np.zeros((len(queries), len(own)), int)
    for rows, cols, linked in hnsw.links_of(hnsw.Graph(own), own, queries, 0.98, same):
        got[np.ix_(rows, cols)] += linked
    want = queries @ own.T >= 0.98
    assert got.max() == 1 and got.sum() >= 0.999 * want.sum() and not got[~want].any()
    assert not same or (got == got.T).all()


def test_vectors_of_extreme_sizes_and_widths(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0), (3, [5.0], 0), (4, [7.0], 0), (5, [-2.0], 0), (6, [1.0, -1.0], 0), (7, [7.0], 0), (8, [], 0), (9, [7.0, None], 0)]
    got = {g.vec_id: (g.n_links, g.component_id) for g in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (0, 5), 6: (0, 6), 7: (2, 3), 8: (0, 8), 9: (0, 9)}


def test_near_duplicates_against_all_pairs(spark):
    """Pairs on both sides of 0.85, among short and long texts, against all pairs of full sets."""
    r = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(r.choice([12, 40, 104, 200]))]
        for k in range(4):
            n = r.randrange(0, max(2, len(base) // 10))
            rows.append((len(rows), " ".join(base[: len(base) - n] + [f"x{g}{k}{j}" for j in range(n)])))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {q.doc_id: q for q in hyperminhash.near_duplicates(spark.createDataFrame([(*q, "x") for q in rows], "doc_id long, text string, component_id string")).collect()}
    assert {i: got[i].component_id for i in sets} == {i: find(i) for i in sets}


def test_quality_of_a_table(spark):
    good, bad = [text(k, 40) for k in range(60)], ["SHOUT!! " * (20 + k) for k in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (3, good[3])]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.classify(docs, quality.train(docs, quality.graded(labels))).collect()
    assert len(out) == len(rows) and all(0 <= q.tail_probability <= 1 for q in out)
    held_out = [q for q in out if q.doc_id < 120 and q.doc_id % 2]
    assert sum(q.selected == (q.doc_id < 60) for q in held_out) > 0.95 * len(held_out)
    assert quality.classify(docs.limit(0), quality.train(docs, quality.graded(labels))).count() == 0


def test_urls_learn_from_other_rows_only(spark):
    urls = [f"http://h{i}.net/es/{i}" for i in range(40)] + [f"http://h{i}.com/{i}" for i in range(40)] + ["http://h.org/a"] * 2
    got = urlfilter.judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")).collect()
    assert len(got) == len(urls)
    by = {q.page_id: q for q in got}
    assert all(by[i].verdict == "block" for i in range(40)) and all(by[i].verdict == "allow" for i in range(40, 80))
    assert by[80].verdict == by[81].verdict and urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
