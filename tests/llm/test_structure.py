"""Shards, fill-in-the-middle and conversation repair."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casetrail.llm import conversations as C
from casetrail.llm import fim, sharding
from tests.llm import helpers as H

DOCS = H.documents()
MORE = "size long, shard int, slot long, range int, place long, n long, form string, cut string, h1 int, output string"


# --- shards ---------------------------------------------------------------------------------------


def plain_shards(rows, shards):
    keyed = sorted(
        ((k is not None, k or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8, k) for k, t in rows),
    )
    total, before, slots, out = sum(r[3] for r in keyed), 0, Counter(), []
    for _, _, crc, size, key in keyed:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((key, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return Counter(out)


@pytest.mark.parametrize("shards", [1, 5, 24, 500])
def test_shards(spark, shards):
    rows = DOCS + [(None, "hot")] * 40 + [(7, None)] * 3
    df = sharding.assign_shards(H.frame(spark, rows, MORE), shards)
    assert df.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert Counter(map(tuple, df.collect())) == plain_shards(rows, shards)


def test_shards_are_nearly_equal(spark):
    rows = [(k, "x" * (k * 37 % 91)) for k in range(2000)]
    made = sharding.by_bytes(H.frame(spark, rows, MORE)).collect()
    sums = Counter()
    for r in made:
        sums[r["shard"]] += r["size"]
    assert set(sums) == set(range(24)) and max(sums.values()) - min(sums.values()) <= 2 * 99
    assert {r["law"] for r in made} == {"bytes"} and {r["grown_shard"] for r in made} == {None}


def test_shards_of_no_rows(spark):
    assert sharding.assign_shards(H.frame(spark, [], MORE)).collect() == []


def test_written_shards(spark, tmp_path):
    rows = DOCS + [(5, "again")] * 30
    df = H.frame(spark, rows, "note string, place long")
    sharding.write_shards(df, str(tmp_path / "shards"), 3, parts=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
    found = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in back.collect())
    assert found == plain_shards(rows, 3)


# --- fill-in-the-middle ---------------------------------------------------------------------------


def units_of(text, unit):
    return list(text) if unit == "character" else re.findall(r"[^\n]*\n|[^\n]+", text)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab\n")), max_size=40), max_size=8),
    st.integers(0, 2**32 - 1),
    st.integers(0, 2**32 - 1),
    st.sampled_from(["character", "line"]),
    st.integers(0, 3),
)
def test_cut_points(texts, one, two, unit, skip):
    raw = pa.array([t.encode() for t in texts], pa.binary()).slice(min(skip, len(texts)))
    texts = texts[min(skip, len(texts)) :]
    made = fim.cut_points(raw, pa.array([one] * len(texts), pa.int64()), pa.array([two] * len(texts), pa.int64()), unit)
    for text, cut in zip(texts, made.to_pylist(), strict=True):
        units = units_of(text, unit)
        first, second = sorted(x % (len(units) + 1) for x in (one, two))
        ends = [len("".join(units[:k]).encode()) for k in (first, second)]
        assert list(cut.values()) == [len(units), first, second, *ends]


def plain_fim(key, text, unit="character"):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = units_of(text, unit)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= 90:
        return key, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return key, len(units), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return key, len(units), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["character", "line"])
def test_fill_in_middle(spark, unit):
    odd = ["<P> inside", "a<", "<<P", "S><M", "\n\n", "é字\U0001f600" * 50, "x<S>", ">P<"]
    rows = DOCS + [(1000 + k, t) for k, t in enumerate(odd * 8)] + [(4, "long é\n" * 60_000)]
    made = fim.fill_in_middle(H.frame(spark, rows, MORE), unit)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert Counter(map(tuple, made.collect())) == Counter(plain_fim(k, t, unit) for k, t in rows)
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")))
    assert Counter(map(tuple, back.collect())) == Counter((k, t or "") for k, t in rows)


def test_fill_in_middle_digest_and_empty(spark):
    assert fim.digest(fim.fill_in_middle(H.frame(spark, [], MORE))).collect() == []
    row = fim.digest(fim.fill_in_middle(H.frame(spark, [(3, "some text")], MORE))).collect()[0]
    assert row["restored_sha256"] == hashlib.sha256(b"some text").hexdigest()
    with pytest.raises(ValueError):
        fim.fill_in_middle(H.frame(spark, [], MORE), "word")


# --- conversations --------------------------------------------------------------------------------


def faults(rows):
    """Initial, must go, cut off of each row."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        gone = not body or (role, text) in seen
        seen.add((role, text))
        out.append((role[:1] if role[:1] in tuple("sua") else "?", gone, not gone and body[-1] not in ".!?"))
    return out


def every_repair(rows):
    """Least (cost, audit) over all edits of a few rows."""
    told, best = faults(rows), None
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(["D", "K", "Ru", "Ra"], repeat=len(told)):
        if any(gone and e != "D" for e, (_, gone, _) in zip(edits, told)):
            continue
        for added in itertools.product(gaps, repeat=len(told) + 1):
            roles, audit, cost = added[0], "I" * len(added[0]), 2 * sum(map(len, added))
            for e, (initial, _, cut), more in zip(edits, told, added[1:]):
                roles += {"D": "", "K": initial, "Ru": "u", "Ra": "a"}[e] + more
                audit += e[0] + "I" * len(more)
                cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (cut and e != "D")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def talk(rows, key=1):
    """Result of the parser for rows ``(turn, role, text)`` in order."""
    one, seen = C.Conversation(key, C.Parser()), {}
    for turn, role, text in rows:
        repeated = (role, text) in seen and seen[role, text] != turn
        seen.setdefault((role, text), turn)
        one.row(turn, role.encode(), text.encode(), repeated)
    return one.result()


def test_repair_against_every_repair():
    rng = random.Random(5)
    for _ in range(60):
        texts = ["One.", "Two!", "three", " ", "Four?", "Five."]
        rows = [(k, rng.choice(["system", "user", "user", "assistant", "tool", ""]), rng.choice(texts)) for k in range(rng.randint(0, 3))]
        made = talk(rows)
        assert (made["cost"], made["audit"]) == every_repair(rows), rows


def slow_repair(rows):
    """Audits kept as whole strings, by plain states: nothing, opened, asked, answered."""
    go = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def filled(tops):
        tops = dict(tops)
        for _ in range(3):
            for state, (cost, audit) in list(tops.items()):
                for role in "ua":
                    to = go.get((state, role))
                    if to:
                        tops[to] = min(tops.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return tops

    tops = filled({"0": (0, "")})
    for initial, gone, cut in faults(rows):
        new = {}
        for state, (cost, audit) in tops.items():
            options = [(state, cost + 3, "D")]
            if not gone:
                options += [(go.get((state, initial)), cost + cut, "K")]
                options += [(go.get((state, r)), cost + 2 + cut, "R") for r in "ua"]
            for to, price, letter in options:
                if to:
                    new[to] = min(new.get(to, (10**9, "")), (price, audit + letter))
        tops = filled(new)
    return min(tops[s] for s in "0a" if s in tops)


@pytest.mark.parametrize("seed", range(6))
def test_repair_of_long_conversations(seed):
    rng = random.Random(seed)
    roles = [["user"], ["system"], ["user", "assistant"], ["system", "user", "assistant", "x"], ["assistant"], ["tool", "user"]][seed]
    rows = [(k, rng.choice(roles), rng.choice(["", f"Line {k}.", f"line {k}", "Same."])) for k in range(600)]
    made = talk(rows)
    assert (made["cost"], made["audit"]) == slow_repair(rows)


def test_parser_remembers_few_steps():
    one = C.Conversation(1, C.Parser())
    rng = random.Random(2)
    for k in range(20_000):
        one.row(k, rng.choice([b"user", b"assistant", b"system", b"x"]), rng.choice([b"a.", b"b", b""]), rng.random() < 0.1)
    assert len(one.parser.known) < 2_000
    letters = Counter(one.result()["audit"])
    assert letters["K"] + letters["R"] + letters["D"] == 20_000


def plain_repair(key, rows):
    """Everything the operator tells about one conversation, from whole strings."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    told = faults(rows)
    cost, audit = slow_repair(rows)
    out, rest, opened = [], list(rows), False
    for letter in audit:
        row = rest.pop(0) if letter != "I" else None
        if letter == "D":
            continue
        opened = opened or (not out and letter == "K" and row[1][:1] == "s")
        expected = "user" if (len(out) - opened) % 2 == 0 else "assistant"
        role = row[1] if letter == "K" else expected
        out.append((letter, row[0] if row else None, role, row[2] if row else ""))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    blank = sum(not re.search("[^\x20\x09-\x0d]", r[2]) for r in rows)
    cut = sum(t[2] for t in told)
    made = {
        "conv_id": key,
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": blank,
        "duplicate": sum(t[1] for t in told) - blank,
        "truncated": cut,
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{o[2]}:{o[3]}" for o in out).encode()).hexdigest(),
    }
    return made, [(key, k, *o) for k, o in enumerate(out)]


def test_repair(spark):
    rng = random.Random(11)
    texts = [None, "", " \n", "Same.", "Same.", "Cut off", "Good one!", "é字?", "x" * 50_000 + "."]
    roles = [None, "", "system", "user", "user", "assistant", "assistant", "tool", "User"]
    rows = []
    for key in [None, *range(40)]:
        for _ in range(rng.randint(1, 9)):
            turn = rng.choice([None, *range(6)])
            text = rng.choice(texts)
            rows.append((key, turn, rng.choice(roles), text and text + rng.choice(["", " ", "\n"])))
    rows += [(900, k, ("user", "assistant")[k % 2], f"Turn {k % 150}.") for k in range(700)]
    rows += [(901, 1, "user", "Dropped.")]
    frame = spark.createDataFrame(
        [(*r, r[0] != 901, 1, "c") for r in rows],
        "conv_id long, turn long, role string, text string, is_live boolean, cost int, mark string",
    )
    groups = {}
    for key, *row in rows:
        groups.setdefault(key, []).append(tuple(row))
    groups[901] = []
    wanted = {k: plain_repair(k, v) for k, v in groups.items()}
    made = C.repair(frame, F.col("is_live"))
    found = {r["conv_id"]: r.asDict() for r in made.collect()}
    assert found == {k: v[0] for k, v in wanted.items()}
    edits = C.repaired_rows(frame, made, F.col("is_live"))
    assert sorted(map(tuple, edits.collect()), key=str) == sorted((r for v in wanted.values() for r in v[1]), key=str)


def test_repair_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(C.damaged(none), F.col("live")).collect() == []
    assert C.repaired_rows(none, C.repair(none)).collect() == []


def test_repair_with_other_names(spark):
    df = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", 2, "assistant", "Ho.")], "id string, at int, who string, said string")
    made = C.repair(df, columns={"conv_id": "id", "turn": "at", "role": "who", "text": "said"}).collect()
    assert [(r["conv_id"], r["audit"], r["cost"]) for r in made] == [("c", "KK", 0)]


def test_damage(spark):
    rows = [(k, t, "assistant", "One. Two!") for k in range(40) for t in (None, 0, 1)] + [(None, 3, None, None)]
    made = Counter(tuple(r) for r in C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    wanted = Counter()
    for key, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        wanted[key, turn, "user" if harm == 4 else role, text, harm != 0] += 2 if harm == 3 else 1
    assert made == wanted


def test_word_tricks():
    data = np.frombuffer("aé字\U0001f600\nb".encode() * 9, "u1")
    units = fim.Units(data, np.array([0, len(data)]), "character")
    assert units.counts().tolist() == [54]
    assert [int(units.after(np.array([k]))[0]) for k in range(6)] == [0, 1, 3, 6, 10, 11]
