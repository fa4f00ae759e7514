"""Contamination, byte BPE, token counts, language model and quality rules."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casetrail.llm import bpe, contamination, ppm, quality, token_counts
from casetrail.llm.common import fold as spark_fold
from tests.llm import helpers as H

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
DOCS = H.documents()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'stheing12 \x1c")), max_size=60))
def test_bpe_equals_library(text):
    vocabulary = bpe.Vocabulary.load(RANKS, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )
    ids = vocabulary.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
    assert vocabulary.decode(ids) == text.encode()


def test_bpe_long_pretoken(vocabulary, library):
    text = "thein" * 20_000
    assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_memo_turnover(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20)
    for text in [t or "" for _, t in DOCS]:
        assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_encode_and_decode(spark, library):
    encoded = bpe.encode(H.frame(spark, DOCS), RANKS, public_tokenizers.PATTERN)
    found = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["lossless"]) for r in H.collected(encoded))
    wanted = Counter()
    for key, text in DOCS:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        wanted[(key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True)] += 1
    assert found == wanted
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((k, t or "") for k, t in DOCS)


def test_token_counts(spark):
    rows = [*DOCS, (7, "a <|endoftext|> b<|endoftext|>"), (8, "  <|endoftext|>  x"), (9, "<|endoftext|")]
    model = Tokenizer.from_file(JSON)
    # A small broadcast part sends most terms through the join.
    for hot in (5, 300_000):
        df = token_counts.count_tokens(H.frame(spark, rows), JSON, public_tokenizers.PATTERN, hot=hot)
        found = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in H.collected(df))
        wanted = Counter()
        for key, text in rows:
            n = len(model.encode(text or "", add_special_tokens=False).ids)
            wanted[(key, len((text or "").encode()), n, n > 512)] += 1
        assert found == wanted


def plain_contamination(rows, items, width=13):
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for key, text in items:
        found = word.findall(H.low(text or ""))
        if found and key is not None:
            windows.setdefault(str(key), set()).update(
                tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))
            )
    out = Counter()
    for key, text in rows:
        found = word.findall(H.low(text or ""))
        hit, held = set(), []
        for item, all_windows in windows.items():
            some = False
            for window in all_windows:
                for k in range(len(found) - len(window) + 1):
                    if tuple(found[k : k + len(window)]) == window:
                        some = True
                        hit |= set(range(k, k + len(window)))
            if some:
                held.append(item)
        n = len(found)
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out[(key, n, len(hit), len(held), digest, len(hit) > 0 and 20 * len(hit) >= n)] += 1
    return out


def contamination_case(spark):
    test = " ".join(f"q{k}" for k in range(20))
    items = [(1, test), (1, test), (10, "Short ITEM-here"), (2, " ".join(f"q{k}" for k in range(5, 22))), (3, ""), (4, None), (None, "q1 q2"), (5, "é字 ü")]
    rows = [
        *DOCS,
        (1, "lead " + test.replace(" ", ", ") + " tail"),
        (2, test + " " + test),
        (3, " ".join(f"q{k}" for k in range(12))),
        (4, "a short, item HERE; short item here short item"),
        (5, " ".join(f"Q{k}" for k in range(22)) + " word" * 400),
        (6, "É字 é字 Ü ü x é字, ü"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    return rows, items, bench


@pytest.mark.parametrize("at_once", [200_000, 4])
def test_contamination(spark, at_once):
    rows, items, bench = contamination_case(spark)
    judged = contamination.decontaminate(H.frame(spark, rows), bench, patterns_at_once=at_once)
    found = Counter(tuple(r.values()) for r in H.collected(contamination.digest(judged)))
    assert found == plain_contamination(rows, items)
    # Spans lie on the hit words of the original text.
    by_id = {r["doc_id"]: r for r in H.collected(judged)}
    assert [by_id[4]["items"], len(by_id[4]["spans"])] == [["10"], 1]
    text = dict(rows)[4]
    assert text[by_id[4]["spans"][0]["start"] : by_id[4]["spans"][0]["stop"]] == "short, item HERE; short item here"
    text = dict(rows)[1]
    assert text[by_id[1]["spans"][0]["start"] : by_id[1]["spans"][0]["stop"]].startswith("q0, q1")


def plain_escape(counts, context, symbol):
    """Method C with exclusion, from the longest context down, one symbol at a time."""
    excluded, chance = set(), 1.0
    for depth in range(len(context), -1, -1):
        node = counts.get(context[len(context) - depth :], {})
        left = {s: n for s, n in node.items() if s not in excluded}
        if not left:
            continue
        total = sum(left.values()) + len(left)
        if symbol in left:
            return chance * left[symbol] / total
        chance *= len(left) / total
        excluded |= left.keys()
    return chance / (256 - len(excluded))


def test_language_model(spark):
    held = F.coalesce(spark_fold(F.col("doc_id"), 7) == 2, F.lit(False))
    df = ppm.score_texts(H.frame(spark, DOCS), held, hot=5)
    counts, contexts = Counter(), {}
    for key, text in DOCS:
        if H.fold(key, 7) == 2:
            continue
        counts.update([*H.words(H.low(text or "")), None])
        data = (text or "").encode()
        for at, symbol in enumerate(data):
            for depth in range(min(2, at) + 1):
                node = contexts.setdefault(data[at - depth : at], {})
                node[symbol] = node.get(symbol, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    wanted = []
    for key, text in DOCS:
        tokens = [*H.words(H.low(text or "")), None]
        data = (text or "").encode()
        base = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        cache = {}
        score = 0.0
        for at, symbol in enumerate(data):
            pair = (data[max(0, at - 2) : at], symbol)
            if pair not in cache:
                cache[pair] = math.log10(plain_escape(contexts, *pair))
            score += cache[pair]
        known = sum(counts[t] > 0 for t in tokens)
        wanted.append((key, H.fold(key, 7) == 2, len(tokens), known, total, base, score))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    found = sorted((tuple(r.values()) for r in H.collected(df)), key=order)
    for a, b in zip(found, sorted(wanted, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-4, abs=1e-6)


@pytest.mark.parametrize(("order", "hot_trie"), [(3, 0), (5, 40), (6, 10_000)])
def test_language_model_of_long_contexts(spark, order, hot_trie):
    rows = [*DOCS, (7001, "abc"), (7002, "abcd"), (7003, "zq" * 9 + "never seen before, held out?")]
    held = F.coalesce(spark_fold(F.col("doc_id"), 7) == 2, F.lit(False)) | F.col("doc_id").eqNullSafe(7003)
    df = ppm.score_texts(H.frame(spark, rows), held, hot=5, order=order, hot_trie=hot_trie)
    contexts = {}
    for key, text in rows:
        if H.fold(key, 7) == 2 or key == 7003:
            continue
        data = (text or "").encode()
        for at, symbol in enumerate(data):
            for depth in range(min(order, at) + 1):
                node = contexts.setdefault(data[at - depth : at], {})
                node[symbol] = node.get(symbol, 0) + 1
    cache, wanted = {}, []
    for key, text in rows:
        data, score = (text or "").encode(), 0.0
        for at, symbol in enumerate(data):
            pair = (data[max(0, at - order) : at], symbol)
            if pair not in cache:
                cache[pair] = math.log10(plain_escape(contexts, *pair))
            score += cache[pair]
        wanted.append((key, len(H.words(text)) + 1, score))
    order_of = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in H.collected(df)), key=order_of)
    for a, b in zip(found, sorted(wanted, key=order_of), strict=True):
        assert a[:2] == b[:2]
        assert a[2] == pytest.approx(b[2], rel=1e-4, abs=1e-6)


def test_language_model_without_training(spark):
    df = ppm.score_texts(H.frame(spark, [(1, "ab"), (2, None)]), F.lit(True))
    found = H.collected(df)
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found] == [(2, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert found[0]["score"] == pytest.approx(-2 * math.log10(256), rel=1e-6)


def plain_repeats(found):
    windows = Counter(tuple(found[k : k + 5]) for k in range(len(found) - 4))
    hit = {k + o for k in range(len(found) - 4) if windows[tuple(found[k : k + 5])] > 1 for o in range(5)}
    return len(hit)


def test_quality(spark):
    boiler = "Subscribe to our newsletter for more news every week"
    rows = [(k, t, "h0") for k, t in DOCS]
    rows += [(1000 + k, f"{boiler}\n" + " ".join(f"w{k}x{j}" for j in range(40)), "h1") for k in range(15)]
    rows += [(2000 + k, f"{boiler}  \n" + " ".join(f"v{k}x{j}" for j in range(3)), "h1") for k in range(3)]
    rows += [(3000, f"{boiler}\nthree more words", "h2"), (3001, boiler, None)]
    rows += [(4000 + k, "the very same copied text with a number of words in it", "h3") for k in range(30)]
    rows += [(5000, "again and again and again it is again and again and again it is said", "h3")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n_words int, host int")
    judged = quality.judge(df)
    found = H.collected(judged)
    for key, text, _ in rows:
        own = H.words(text)
        lines = [x for x in (text or "").split("\n") if H.words(x)]
        mine = [r for r in found if r["doc_id"] == key and r["n_words"] == len(own)]
        assert mine
        for r in mine:
            if text is None or key is not None:
                repeats = plain_repeats(own)
                assert r["word_chars"] == sum(map(len, own))
                assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
                assert r["n_dup_lines"] == len(lines) - len(set(lines))
                assert r["n_repeat_words"] == repeats
                assert r["base_failed"] == (len(own) < 10 or 100 * repeats > 20 * len(own))
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[1000 + k]["kept"] and by_id[1000 + k]["n_common_words"] == 9 for k in range(15))
    assert not any(by_id[2000 + k]["kept"] for k in range(3))  # three words are left
    assert by_id[3000]["kept"] and by_id[3000]["n_common_words"] == 0  # another host
    assert all(by_id[4000 + k]["kept"] for k in range(30))  # copies are one document
    assert by_id[5000]["base_failed"]
    cleaned = {r["doc_id"]: r["text"] for r in quality.without_common_lines(df, judged).collect()}
    assert cleaned[1000] == " ".join(f"w0x{j}" for j in range(40))
    assert 2000 not in cleaned


@pytest.mark.parametrize("many", [0])
def test_empty_tables(spark, many):
    empty = H.frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == many
    assert token_counts.count_tokens(empty, JSON, public_tokenizers.PATTERN).count() == many
    assert ppm.score_texts(empty, F.lit(False)).count() == many
    assert contamination.decontaminate(empty, bench).count() == many
    assert quality.judge(empty.withColumn("source", F.lit("s"))).count() == many
    judged = contamination.decontaminate(H.frame(spark, [(1, "a b c")]), bench).collect()
    assert [(r["n_words"], r["contaminated"]) for r in judged] == [(3, False)]
