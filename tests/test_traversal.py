"""Walks over small graphs against plain versions."""

import random
from collections import deque
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casetrail.operators import traverse as W
from catalog import traversal


def graph(seed, nodes=14, edges=30):
    rng = random.Random(seed)
    names = [rng.choice([f"N{k}", f"n{k}"]) for k in range(nodes)]
    rows = [(rng.choice(names), rng.choice(names), k) for k in range(edges)]
    return rows + [(None, "n1", edges), ("n2", "", edges + 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, seq long")


def links(rows, direction):
    out = {}
    for s, t, seq in rows:
        if not s or not t:
            continue
        s, t = s.lower(), t.lower()
        for a, b, on in ((s, t, direction != "incoming"), (t, s, direction != "outgoing")):
            if on:
                out.setdefault(a, []).append((seq, b))
    return {k: [b for _, b in sorted(v)] for k, v in out.items()}


def plain_trace(seed, near, hops, cap, stops):
    seen, level, out, counts = {seed}, [seed], [(seed, 0, 1, None, None, seed in stops)], []
    for hop in range(1, hops + 1):
        new, fetched, going = [], 0, [(k, n) for k, n in enumerate(level, 1) if n not in stops]
        for place, node in going:
            fetched += 1
            for other in near.get(node, []):
                if other not in seen and len(new) < cap:
                    seen.add(other)
                    new.append((other, node, place))
            if len(new) >= cap:
                break
        if not new:
            break
        out += [(n, hop, k, p, pp, n in stops) for k, (n, p, pp) in enumerate(new, 1)]
        counts.append((hop, len(new), sum(n in stops for n, _, _ in new), fetched))
        level = [n for n, _, _ in new]
    return out, counts


@pytest.mark.parametrize("seed,direction,cap", [(1, "all", 3), (2, "outgoing", 100), (3, "incoming", 2)])
def test_trace(spark, seed, direction, cap):
    rows = graph(seed)
    stops = {"n3", "n7"}
    near = links(rows, direction)
    seeds = spark.createDataFrame([(f"N{k}",) for k in range(14)] + [("n1",), (None,), ("",)], "seed string")
    made = W.trace(seeds, frame(spark, rows), 4, cap, spark.createDataFrame([("N3",), ("n7",)], "node string"), direction)
    wanted = {f"n{k}": plain_trace(f"n{k}", near, 4, cap, stops) for k in range(14)}
    assert sorted(map(tuple, made.collect()), key=str) == sorted(((s, *r) for s, v in wanted.items() for r in v[0]), key=str)
    counts = W.hop_counts(made, cap).select("seed", "hop", "found", "stopped", "fetched")
    assert sorted(map(tuple, counts.collect())) == sorted((s, *r) for s, v in wanted.items() for r in v[1])


def test_trace_without_cap(spark):
    rows = graph(5)
    made = W.trace(spark.createDataFrame([("n0",)], "seed string"), frame(spark, rows), 5)
    plain, counts = plain_trace("n0", links(rows, "all"), 5, 10**6, set())
    assert sorted((r["node"], r["hop"]) for r in made.collect()) == sorted((r[0], r[1]) for r in plain)
    assert sorted((r["hop"], r["found"], r["fetched"]) for r in W.hop_counts(made).collect()) == sorted((h, f, n) for h, f, _, n in counts)


def test_direction_is_checked(spark):
    with pytest.raises(ValueError):
        W.neighbours(frame(spark, []), "up")


def distance(near, a, b, most):
    level, seen = deque([(a, 0)]), {a}
    while level:
        node, d = level.popleft()
        if node == b:
            return d
        if d < most:
            for other in near.get(node, []):
                if other not in seen:
                    seen.add(other)
                    level.append((other, d + 1))
    return None


@pytest.mark.parametrize("seed,most", [(1, 5), (2, 5), (3, 4), (4, 1), (5, 0)])
def test_shortest_paths(spark, seed, most):
    rows = graph(seed, edges=22)
    near = links(rows, "outgoing")
    real = {(s.lower(), t.lower(), q) for s, t, q in rows if s and t}
    pairs = [(a * 14 + b, f"N{a}", f"n{b}") for a in range(14) for b in range(14)] + [(900, None, "n1"), (901, "", ""), (902, "zz", "zz")]
    made = W.shortest_paths(spark.createDataFrame(pairs, "pair int, source string, target string"), frame(spark, rows), most).collect()
    assert len(made) == len(pairs)
    for r in made:
        a, b = r["source"], r["target"]
        length = distance(near, a, b, most) if a and b else None
        assert r["length"] == length, r
        steps = [tuple(s) for s in r["path"]]
        assert len(steps) == (length or 0) and set(steps) <= real
        at = a
        for s, t, _ in steps:
            assert s == at
            at = t
        assert not steps or at == b


@pytest.mark.parametrize("most", [6, 7])
def test_shortest_paths_with_one_wide_end(spark, most):
    chain = [(f"c{k}", f"c{k + 1}", k) for k in range(7)]
    wide = [("c0", f"x{k}", 100 + k) for k in range(30)] + [(f"x{k}", f"y{k % 5}", 200 + k) for k in range(30)] + [("y3", "c6", 300)]
    rows = chain + wide + [("c7", "c0", 400), ("z", "z", 401)]
    near = links(rows, "outgoing")
    real = set(rows)
    names = ["c0", "c1", "c6", "c7", "x3", "y4", "z"]
    pairs = [(7 * a + b, s, t) for a, s in enumerate(names) for b, t in enumerate(names)]
    made = W.shortest_paths(spark.createDataFrame(pairs, "pair int, source string, target string"), frame(spark, rows), most).collect()
    assert len(made) == len(pairs)
    for r in made:
        assert r["length"] == distance(near, r["source"], r["target"], most), r
        steps = [tuple(s) for s in r["path"]]
        assert len(steps) == (r["length"] or 0) and set(steps) <= real
        assert [s for s, _, _ in steps[1:]] == [t for _, t, _ in steps[:-1]]
        assert not steps or (steps[0][0], steps[-1][1]) == (r["source"], r["target"])


def test_an_end_is_searched_once_for_all_its_pairs(spark, monkeypatch):
    """50 pairs with one target that 100 nodes pay: no level holds the hundred for each of them."""
    rows = [(f"p{k}", "t", k) for k in range(100)] + [(f"s{k}", f"q{k}", 100 + k) for k in range(50)]
    pairs = spark.createDataFrame([(k, f"s{k}", "t") for k in range(50)], "pair int, source string, target string")
    save, saved = W.cut_lineage, []

    def counted(df):
        saved.append((made := save(df)).count())
        return made

    monkeypatch.setattr(W, "cut_lineage", counted)
    assert [r["length"] for r in W.shortest_paths(pairs, frame(spark, rows)).collect()] == [None] * 50
    assert max(saved) <= 150


def test_transfers_are_read_before_the_plan(spark):
    assert not any("lineitem" in f for f in traversal._shortest(spark, "/root/testdata/sf0.001").inputFiles())


def plain_typed(source, near, targets, most, limit):
    found, level = [], [(source,)]
    for _ in range(most):
        longer = [(*p, o) for p in level for o in set(near.get(p[-1], [])) if o not in p]
        found += sorted(p for p in longer if p[-1] in targets)
        level = [p for p in longer if p[-1] not in targets]
    return found[:limit]


@pytest.mark.parametrize("direction,limit", [("outgoing", 3), ("all", 10), ("incoming", 100)])
def test_typed_paths(spark, direction, limit):
    rows = graph(8, nodes=9, edges=20)
    near, targets = links(rows, direction), {"n2", "n5"}
    sources = spark.createDataFrame([(f"n{k}",) for k in range(9)] + [(None,)], "source string")
    made = W.typed_paths(sources, frame(spark, rows), spark.createDataFrame([("N2",), ("n5",)], "node string"), 4, limit, direction)
    found = {}
    for r in sorted(made.collect(), key=lambda r: (r["source"], r["place"])):
        found.setdefault(r["source"], []).append(tuple(r["path"]))
        assert r["length"] == len(r["path"]) - 1 and r["target"] == r["path"][-1]
    wanted = {s: p for s in (f"n{k}" for k in range(9)) if (p := plain_typed(s, near, targets, 4, limit))}
    assert found == wanted


def test_enriched_edges(spark):
    rows = [
        ("a", "b", 1, Decimal("10.00"), "X", "h1"), ("a", "b", 2, Decimal("10.00"), "USD", "h2"), ("a", "b", 3, None, None, "h3"),
        ("a", "b", 4, Decimal("0.00"), "", "h4"), ("b", "a", 5, Decimal("5.00"), "X", "h5"), ("b", "a", 6, Decimal("5.00"), "X", "h6"),
        ("b", "a", 7, Decimal("10.00"), "Y", "h7"),
    ]
    df = spark.createDataFrame(rows, "source string, target string, seq long, value decimal(18,2), token_symbol string, tx_hash string")
    made = {(r["source"], r["target"]): r for r in W.enriched_edges(df, ("USD",)).collect()}
    one = made["a", "b"]
    assert (one["token_symbol"], one["tx_hash"], one["total_value"], one["tx_count"]) == ("USD", "h2", Decimal("10.00"), 4)
    assert [tuple(t) for t in one["secondary_tokens"]] == [("X", Decimal("10.00"), 1), ("native", Decimal("0.00"), 2)]
    two = made["b", "a"]
    assert (two["token_symbol"], two["tx_hash"], two["tx_count"]) == ("X", "h5", 3)
    plain = {(r["source"], r["target"]): r for r in W.enriched_edges(df).collect()}
    assert plain["a", "b"]["token_symbol"] == "X"
    assert W.enriched_edges(df.limit(0)).collect() == []


def test_between_and_stops(spark):
    rows = [("A", "b", 1, True), ("a", "B", 2, None), ("b", "a", 3, False)]
    df = spark.createDataFrame(rows, "source string, target string, seq long, is_spam boolean")
    pairs = spark.createDataFrame([("a", "b"), ("A", "B")], "source string, target string")
    assert [r["seq"] for r in W.between(df, pairs).collect()] == [2]
    assert sorted(r["seq"] for r in W.between(df, pairs, False).collect()) == [1, 2]
    kinds = spark.createDataFrame([("Exchange", "x"), ("other", "Big Bank"), (None, ""), ("labeled", None)], "kind string, name string")
    stop = W.stops_at(F.col("kind"), F.col("name"), ["EXCHANGE"], F.col("name").contains("Bank"))
    assert [r[0] for r in kinds.select(stop).collect()] == [True, True, False, False]
