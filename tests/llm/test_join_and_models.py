"""Jaccard join, toxicity, language ID, URL filter, licences and the pipeline."""

import math
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casetrail.llm import langid, licenses, ngram_join, toxicity, url_filter
from tests.llm import helpers as H


def plain_components(rows, percent=80):
    sets = []
    for _, text in rows:
        found = H.words(H.low(text or ""))
        sets.append({tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[root(k)] = min(key, least.get(root(k), key))
    return Counter(
        (key, len(sets[k]), least.get(root(k)) if sets[k] else key) for k, (key, _) in enumerate(rows)
    )


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_join(spark, seed):
    rng = np.random.default_rng(seed)
    rows = H.documents(seed)
    base = [f"b{k}" for k in range(60)]
    for k in range(40):  # chains around the threshold
        near = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            near[at] = f"n{rng.integers(0, 5)}"
        rows.append((500 + k, " ".join(near)))
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(600 + k, passage + " " + " ".join(f"o{k}x{j}" for j in range(k))) for k in range(30)]
    rows += [(None, passage), (None, "nothing like the others here"), (2, "zz"), (1, "zz")]
    df = ngram_join.ngram_join(H.frame(spark, rows))
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in H.collected(df))
    assert found == plain_components(rows)


def test_ngram_join_small_blocks(spark, monkeypatch):
    """Blocks of two members and a counted share that seldom fills a prefix stay exact."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "COUNTED", int(0.02 * 2**64))
    rows = H.documents(9)
    found = Counter(tuple(r.values()) for r in H.collected(ngram_join.ngram_join(H.frame(spark, rows))))
    assert found == plain_components(rows)


def test_ngram_join_short_chains(spark):
    """Chains of growing short texts, whose counted shingles seldom fill a prefix."""
    rows = []
    for chain in range(60):
        for size in range(9, 26):
            rows.append((len(rows), " ".join(f"c{chain}w{j}" for j in range(size))))
    found = Counter(tuple(r.values()) for r in H.collected(ngram_join.ngram_join(H.frame(spark, rows))))
    assert found == plain_components(rows)


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_join(H.frame(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, " \n")]
    assert [(r["n_shingles"], r["component_id"]) for r in H.collected(ngram_join.ngram_join(H.frame(spark, rows)))] == [(0, 1), (0, 2), (0, 3)]


def toxic_case():
    rng = np.random.default_rng(5)
    bad = ["vile", "rotten", "nasty", "foul"]
    rows, labels = [], []
    for k in range(160):
        found = [f"{H.ALPHABET[rng.integers(0, 17)]}{rng.integers(0, 20)}" for _ in range(rng.integers(20, 80))]
        if k % 4 == 0:
            for at in rng.choice(len(found), 4, replace=False):
                found[at] = bad[rng.integers(0, 4)]
        rows.append((k, " ".join(found)))
        labels.append((k, int(k % 4 == 0)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_case()
    rows += [(900, None), (901, ""), (None, "vile rotten nasty foul"), (0, rows[0][1])]
    marks = [*labels, (900, 1), (5000, 1), (None, 1), (3, None), (5, 7), (9, 0), (9, 0)]
    df, lab = H.frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    teaches = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    judged = toxicity.score_toxicity(df, df, lab, teaches)
    found = H.collected(judged)
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    truth = dict(labels)
    held = [r for r in found if r["doc_id"] in truth and H.fold(r["doc_id"], 5) == 0]
    assert all(r["predicted"] == truth[r["doc_id"]] for r in held) and len(held) > 20
    clean = {r["doc_id"]: r for r in found}
    assert clean[900]["predicted"] == clean[901]["predicted"] == 0 and clean[901]["evidence"] == []
    assert clean[None]["predicted"] == 1 and all(e["toxic"] == 1 for e in clean[None]["evidence"][:3])


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    terms = [f"t{k}".encode() for k in range(30)]
    rows = [
        {"doc_id": k, "toxic": int(k % 3 == 0), "size": 40, "terms": {terms[j]: int(rng.integers(1, 4)) for j in rng.choice(30, rng.integers(0, 5), replace=False)}}
        for k in range(300)
    ]
    index = toxicity.Index(terms, rng.uniform(1, 4, 30), rows, neighbours=7, block=16)
    asks = [{terms[j]: int(rng.integers(1, 4)) for j in rng.choice(30, rng.integers(0, 6), replace=False)} for _ in range(50)]
    vectors = index.vectors(asks, [30] * 50)
    cosines, places = index.nearest(vectors)
    whole = np.zeros((300, 30), "f4")
    for start, held, postings in index.blocks:
        whole[np.ix_(range(start, start + postings.shape[1]), held)] = postings.T
    plain = np.sort(vectors @ whole.T, 1)[:, ::-1][:, :7]
    assert np.allclose(cosines, np.maximum(plain, 0), atol=1e-6)
    assert np.allclose(np.where(places >= 0, (vectors[:, None, :] * whole[places]).sum(-1), 0), cosines, atol=1e-6)


def test_toxicity_few_examples(spark):
    """Words of a handful of examples count, as do words that one example has."""
    rows = [(k, f"vile{k % 2} word{k} text" if k < 6 else f"kind{k % 3} word{k} text") for k in range(24)]
    rows += [(100, "vile0 text unseen"), (101, "kind1 text unseen")]
    df = H.frame(spark, rows)
    lab = spark.createDataFrame([(k, int(k < 6)) for k in range(24)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in H.collected(toxicity.score_toxicity(df, df, lab, F.col("doc_id") < 100, neighbours=3))}
    assert (found[100]["predicted"], found[101]["predicted"]) == (1, 0)
    assert {e["toxic"] for e in found[100]["evidence"]} == {1}


def test_rare_terms_are_exact(monkeypatch):
    """Columns and postings together give the plain cosine."""
    monkeypatch.setattr(toxicity, "COMMON", 16)
    rng = np.random.default_rng(2)
    terms = [f"t{k}".encode() for k in range(200)]
    pick = lambda: {terms[int(200 * x**3)]: int(rng.integers(1, 4)) for x in rng.random(rng.integers(0, 12))}
    rows = [{"doc_id": k, "toxic": int(k % 3 == 0), "size": 40, "terms": pick()} for k in range(300)]
    idf = rng.uniform(1, 4, 200)
    index = toxicity.Index(terms, idf, rows, neighbours=7, block=16)
    assert 0 < index.columns < 200
    asks = [pick() for _ in range(50)]

    def plain(counts, size):
        w = np.zeros(200)
        for t, n in counts.items():
            w[int(t[1:])] = (1 + np.log(n)) * idf[int(t[1:])]
        return w / np.sqrt((w**2).sum() + size - sum(counts.values()))

    whole = {r["doc_id"]: plain(r["terms"], 40) for r in rows}
    _, cosines, places = index.score(asks, [40] * 50)
    for ask, near, where in zip(asks, cosines, places):
        each = {k: float(plain(ask, 40) @ v) for k, v in whole.items()}
        assert np.allclose(near, sorted(each.values(), reverse=True)[:7], atol=1e-5)
        assert all(abs(each[index.ids[p]] - c) < 1e-5 for p, c in zip(where, near) if p >= 0)


def test_isotonic_curve():
    x, y = toxicity.rising(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0, 1, 0, 1, 1]))
    assert y.tolist() == [0, 0, 0.5, 0.5, 1, 1] and x.tolist() == [0.1, 0.1, 0.2, 0.3, 0.4, 0.4]


def test_toxicity_without_examples(spark):
    df = H.frame(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in H.collected(toxicity.score_toxicity(df, df, none, F.lit(True)))] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r["predicted"] for r in H.collected(toxicity.score_toxicity(df, df, one, F.lit(True)))] == [0, 0]
    empty = H.frame(spark, [])
    assert toxicity.score_toxicity(empty, empty, none, F.lit(True)).count() == 0


def test_gradients_are_right():
    """Backpropagation through time against differences."""
    network = langid.Network(["a", "b", "c"], 3)
    for w in network.weights():
        w *= 1.5
    data = np.random.default_rng(2).integers(97, 123, (4, 6)).astype("u1")
    data[0, 4:] = 0
    target = np.array([0, 1, 2, 1])

    def loss():
        found, _, _ = network.probabilities(data)
        mask = langid.LETTERS[data.T]
        return -float(np.log(found[:, target, np.arange(4)])[mask].sum() / mask.sum())

    for w, g in zip(network.weights(), network.step(data, target)):
        flat, slope = w.reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(slope))[:4]:
            old = flat[k]
            flat[k] = old + 0.01
            up = loss()
            flat[k] = old - 0.01
            down = loss()
            flat[k] = old
            assert (up - down) / 0.02 == pytest.approx(slope[k], rel=0.05, abs=2e-3)


def test_language(spark):
    rng = np.random.default_rng(6)
    parts = {"xx": ["lam", "pom", "tir", "sa"], "yy": ["zhé", "ök", "vü", "aß"]}
    rows = []
    for k in range(80):
        lang = "xx" if k % 2 else "yy"
        text = " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(rng.integers(5, 60)))
        rows.append((k, text, lang))
    rows += [(200, None, "xx"), (201, "", "yy"), (202, "12 %% 34", "xx"), (203, rows[1][1] * 300, None), (None, rows[0][1], "yy")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, score int, place int")
    training = df.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    found = {r["doc_id"]: r for r in H.collected(langid.identify(df, training, steps=60))}
    assert len(found) == len(rows)
    for key, text, lang in rows[:80]:
        assert found[key]["lang_pred"] == lang
        assert 0.5 < found[key]["score"] <= 1 and sum(found[key]["spread"].values()) == pytest.approx(1, abs=1e-4)
    assert all((found[k]["lang_pred"], found[k]["score"]) == ("und", 0.0) for k in (200, 201, 202))
    assert found[203]["lang_pred"] == "xx" and found[None]["lang_pred"] == "yy"
    nothing = langid.identify(df, df.filter("false"), steps=1).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.identify(df.filter("false"), df.filter("false"), steps=1).count() == 0


def test_language_sample_takes_copies_once(spark):
    rows = [("aa", f"copy {k}") for k in range(3) for _ in range(200)] + [("aa", f"other {k}") for k in range(30)]
    df = spark.createDataFrame(rows, "lang string, text string")
    found = langid.sample(df, 33, 1, 64).collect()
    assert {r["cut"] for r in found} == {t for _, t in rows} and len(found) == 33


RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for stop in "/?#":
        host = host.split(stop, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = H.low(host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_urls(spark):
    rng = np.random.default_rng(8)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x=/de/#f", "http://a.net", "http://net/", "https://x.example.com/de/", "https://notexample.com/de/", "http://b.org?x://y.net/", "x://y://z.net/", "http://h.net#/en/", "http://example.net/en", "http://k.org/fr/../é"]
    urls += [f"http://{rng.choice(['a', 'b-c', 'spam-1'])}.{rng.choice(['example.net', 'example.com', 'k.org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.integers(0, 999)}" for _ in range(120)]
    rows = list(enumerate(urls)) + [(3, urls[4]), (None, urls[5])]
    df = spark.createDataFrame([(*r, "x", 1.0, "s") for r in rows], "page_id long, url string, host string, score double, suffix string")
    judged = url_filter.judge_urls(df, RULES, trees=3)
    found = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in judged.collect())
    assert found == Counter((k, *plain_url(u)[:3]) for k, u in rows)
    for r in judged.collect():
        verdict = next(plain_url(u)[3] for k, u in rows if k == r["page_id"] and plain_url(u)[0] == r["host"])
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow")) and 0 <= r["score"] <= 1
    # One verdict only, or no page: nothing is trained.
    few = url_filter.judge_urls(df.filter("page_id IN (6, 8)"), RULES).collect()
    assert {r["page_id"]: (r["score"], r["verdict"]) for r in few} == {6: (None, "block"), 8: (None, "allow")}
    assert url_filter.judge_urls(df.filter("false"), RULES).count() == 0


def test_licenses(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", licenses.TEMPLATES[3][1]),
        (2, "a/b/x.txt", "plain text"),
        (3, "a/b/c/y.txt", f"first line\n{mit}\nlast"),
        (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/b/c/d/z.txt", None),
        (6, "q/x.txt", ""),
        (7, "q/r/LICENSE", "no licence at all here"),
        (8, None, "<p>Licensed under CC BY-NC 4.0.</p> text"),
        (9, "top.txt", "the licence of our club says nothing"),
        (2, "a/b/x.txt", "plain text"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, path string, text string, license string, folder string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(df, "page_id", "path", "text").collect()}
    got = {k: (r["license"], r["origin"], r["inherited_from"]) for k, r in found.items()}
    assert got == {
        1: ("MIT", "own", None),
        2: ("MIT", "inherited", "a"),
        3: ("MIT", "own", None),
        4: ("GPL-3.0", "own", None),
        5: ("GPL-3.0", "inherited", "a/b/c"),
        6: (None, "none", None),
        7: (None, "none", None),
        8: ("CC-BY-NC-4.0", "own", None),
        9: (None, "none", None),
    }
    assert found[3]["region"] == mit and found[3]["own_cosine"] == pytest.approx(1)
    # The cosine, plainly.
    total = len(rows)
    plain = lambda t: Counter(licenses.words_of(t.encode()))
    known = {w for _, t in licenses.TEMPLATES for w in plain(t)}
    df_of = {w: sum(w in plain(r[2] or "") for r in rows) for w in known}
    idf = lambda w: math.log((1 + total) / (1 + df_of[w])) + 1 if w in known else math.log((1 + total) / 2) + 1
    vec = lambda t: {w: (1 + math.log(n)) * idf(w) for w, n in plain(t).items()}
    a, b = vec(licenses.TEMPLATES[3][1]), vec(rows[0][2])
    dot = sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    assert found[1]["own_cosine"] == pytest.approx(dot)
    assert licenses.scan_licenses(df.filter("false"), "page_id", "path", "text").count() == 0


def test_licenses_are_scanned_once(spark):
    df = spark.createDataFrame([(1, "a/LICENSE", licenses.TEMPLATES[3][1]), (2, "a/x", "x")], "page_id long, path string, text string")
    found = licenses.scan_licenses(df, "page_id", "path", "text")
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["origin"] for r in found.collect()} == {1: "own", 2: "inherited"}


def test_wrapped_licenses(spark):
    """Notices over several lines, in comments and with inline tags."""
    wrap = lambda t, lead: "\n".join(lead + line for line in textwrap.wrap(t, 60))
    mit, gpl, bsd = (licenses.TEMPLATES[k][1] for k in (3, 5, 8))
    rows = [
        (1, "a/LICENSE", f"MIT License\n\nCopyright (c) 2020 A. Author\n\n{wrap(mit, '')}"),
        (2, "a/x.c", "plain"),
        (3, "b/y.py", f"#!/usr/bin/python\n#\n{wrap(gpl, '# ')}\n#\nimport os"),
        (4, "c/z.c", f"/*\n * Copyright\n *\n{wrap(bsd, ' * ')}:\n */"),
        (5, "d/i.html", "<p>All is <a href='x'>Licensed under</a> <em>the</em><br>Apache License, Version 2.0.</p>"),
        (6, "e/i.html", "<p>Released under</p><p>the club</p><p>License.</p>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, path string, text string")
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(df, "page_id", "path", "text").collect()}
    assert found == {1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: "BSD-3-Clause", 5: "Apache-2.0", 6: None}


def test_pipeline(spark, tmp_path):
    rows, marks = toxic_case()
    docs = [(k, t + " and more of the same", "en", "s0", len(t)) for k, t in rows]
    test = " ".join(f"q{k}" for k in range(15))
    docs += [(300, docs[1][1], "en", "s0", 1), (301, f"{docs[2][1]} {test}", "en", "s1", 1), (302, "123 %%%", "en", None, 1), (303, None, None, None, None), (304, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {k for k, mark in marks if mark}
    assert set(found) == {k for k, *_ in docs} - toxic - {300, 301, 302, 303, 304}
    assert all(r["lossless"] and r["n_tokens"] * 4 == len(r["ids"]) for r in found.values())
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
