"""Language-model scores by prediction by partial matching over bytes, and a unigram base.

The model is a trie of byte contexts up to ``order`` bytes long, whose counts Spark gathers from all
training texts. A symbol not seen behind a context is reached by an escape to the next shorter
context (method C: as many escapes as distinct symbols), where all symbols of the longer context
are excluded. Below the empty context every remaining byte is equally likely.

Contexts of two bytes and less are broadcast whole. Longer ones are dealt over buckets by the three
bytes before the symbol, so that a bucket knows all longer contexts of its own; texts send what the
broadcast commonest grams do not answer to the buckets and get sums back.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.llm.common import dictionary_sums, hot_terms, map_rows, saved, texts

# Keys of counts: three bytes; then two bytes at the start of a text; then its first byte.
PAIRS, FIRSTS = 1 << 24, 1 << 25
FLUSH = 300_000  # distinct words that a task counts before it hands the counts on
PART = 1 << 22  # bytes looked at together, so that a long text needs no more memory

# Grams of longer contexts: the context's bytes and the symbol, below the number of context bytes.
TAG = 56
LONGEST = 6
BUCKET_BYTES = 4 << 20  # bytes of all texts to a bucket of the trie
FLUSH_GRAMS = 1 << 21  # distinct grams that a task holds before it hands them on

_models: dict[str, Model] = {}
_shallow: dict[str, list[Level]] = {}
_hot: dict[str, HotGrams] = {}


def context_keys(data: np.ndarray) -> np.ndarray:
    """Keys of all positions of one text."""
    wide = data.astype(np.uint32)
    out = [FIRSTS | wide[:1], PAIRS | (wide[:1] << 8) | wide[1:2]] if len(wide) > 1 else [FIRSTS | wide]
    return np.concatenate([*out, (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]])


class Model:
    """Log10 probabilities of each byte behind each context, from the counts of the trie."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        deep = keys < PAIRS
        order = np.argsort(keys[deep])
        k2, n2 = keys[deep][order].astype("i8"), counts[deep][order].astype("f8")
        pairs = (keys >= PAIRS) & (keys < FIRSTS)
        c1 = np.bincount(k2 & 0xFFFF, n2, 1 << 16)
        c1 += np.bincount(keys[pairs].astype("i8") - PAIRS, counts[pairs], 1 << 16)
        c1 = c1.reshape(256, 256)
        firsts = keys >= FIRSTS
        c0 = c1.sum(0) + np.bincount(keys[firsts].astype("i8") - FIRSTS, counts[firsts], 256)
        floor = np.full(256, 1 / max(1, 256 - np.count_nonzero(c0)))
        p0 = self._top(c0[None, :], floor[None, :])
        # Behind a context: the shorter context without the longer one's symbols.
        x0 = self._rest(np.broadcast_to(c0, (256, 256)), c1 > 0, floor[None, :])
        p1 = self._top(c1, x0, p0)
        self.first = np.log10(p0[0]).astype("f4")
        self.second = np.log10(p1).astype("f4")
        self.table = np.empty((256, 65536), "f4")
        edges = np.searchsorted(k2, np.arange(257) << 16)
        for a in range(256):
            c2 = np.zeros(65536)
            c2[k2[edges[a] : edges[a + 1]] & 0xFFFF] = n2[edges[a] : edges[a + 1]]
            c2 = c2.reshape(256, 256)
            x1 = self._rest(c1, c2 > 0, x0)
            self.table[a] = np.log10(self._top(c2, x1, p1)).astype("f4").reshape(-1)
        self.table = self.table.reshape(-1)

    @staticmethod
    def _top(counts, below, unseen=None):
        """Probabilities at the longest context; ``unseen`` replaces contexts without counts."""
        total = counts.sum(-1, keepdims=True)
        distinct = np.count_nonzero(counts, axis=-1)[..., None]
        mass = np.maximum(total + distinct, 1)
        out = np.where(counts > 0, counts / mass, distinct / mass * below)
        return np.where(total > 0, out, below if unseen is None else unseen)

    @staticmethod
    def _rest(counts, excluded, below):
        """Probabilities after an escape: excluded symbols take no part."""
        left = np.where(excluded, 0.0, counts)
        total = left.sum(-1, keepdims=True)
        distinct = np.count_nonzero(left, axis=-1)[..., None]
        mass = np.maximum(total + distinct, 1)
        return np.where(left > 0, left / mass, np.where(distinct > 0, distinct / mass, 1.0) * below)

    def log10(self, data: np.ndarray) -> float:
        if len(data) == 0:
            return 0.0
        score = float(self.first[data[0]])
        if len(data) > 1:
            score += float(self.second[data[0], data[1]])
        for start in range(0, len(data) - 2, PART):
            wide = data[start : start + PART + 2].astype(np.int32)
            keys = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
            score += float(self.table[keys].sum(dtype="f8"))
        return score


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the ordered known ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(wanted), "i8"), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _low(size: int) -> int:
    return (1 << 8 * size) - 1


class Level:
    """Contexts of ``depth`` bytes: counts of their symbols, and what an escape from them costs."""

    def __init__(self, depth: int, keys: np.ndarray, counts: np.ndarray, below: Level | None):
        self.keys, self.counts = keys, counts.astype("i8")
        self.contexts, starts = np.unique(keys >> 8, return_index=True)
        self.total = np.add.reduceat(self.counts, starts) if len(keys) else self.counts
        self.distinct = np.diff(np.append(starts, len(keys)))
        if below is None:
            left, more = np.zeros(len(self.contexts), "i8"), 256 - self.distinct
        elif not len(keys):
            left = more = self.counts
        else:
            place, _ = _find(below.keys, keys & _low(depth))
            shorter, _ = _find(below.contexts, self.contexts & _low(depth - 1))
            left = below.total[shorter] - np.add.reduceat(below.counts[place], starts)
            more = below.distinct[shorter] - self.distinct
        # Behind an escape: one over the mass of the shorter context without this one's symbols, and
        # the part of it that escapes again.
        self.share = 1 / np.maximum(left + more, 1)
        self.again = np.where(more > 0, more * self.share, 1.0)

    def top(self) -> np.ndarray:
        """Log10 probability of each key as the longest context."""
        at, _ = _find(self.contexts, self.keys >> 8)
        return np.log10(self.counts / (self.total + self.distinct)[at])


def shallow_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of no, one and two bytes of context, of the counts that ``train`` gives."""
    keys, counts = keys.astype("i8"), counts.astype("i8")
    pairs, firsts = (keys >= PAIRS) & (keys < FIRSTS), keys >= FIRSTS
    two = _summed(keys[keys < PAIRS], counts[keys < PAIRS])
    one = _summed(np.append(two[0] & 0xFFFF, keys[pairs] - PAIRS), np.append(two[1], counts[pairs]))
    none = _summed(np.append(one[0] & 0xFF, keys[firsts] - FIRSTS), np.append(one[1], counts[firsts]))
    levels: list[Level] = []
    for depth, (k, n) in enumerate((none, one, two)):
        levels.append(Level(depth, k, n, levels[-1] if levels else None))
    return levels


def by_depth(order: int, keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Grams of a bucket and their counts for each length of context from three bytes on."""
    tags, made = keys >> TAG, {}
    k, n = np.empty(0, "i8"), np.empty(0, "i8")
    for depth in range(order, 2, -1):
        own = tags == depth
        size = _low(depth + 1)
        k, n = _summed(np.append(k & size, keys[own] & size), np.append(n, counts[own]))
        made[depth] = k, n
    return made


def deep_levels(shallow: list[Level], order: int, keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """All levels up to ``order`` over the grams of a bucket."""
    levels, made = list(shallow), by_depth(order, keys, counts)
    for depth in range(3, order + 1):
        levels.append(Level(depth, *made[depth], levels[-1]))
    return levels


def resolve(levels: list[Level], grams: np.ndarray) -> np.ndarray:
    """Log10 probability of each gram, its symbol behind its context."""
    tags, out = grams >> TAG, np.zeros(len(grams))
    share, again = np.zeros(len(grams)), np.zeros(len(grams))  # no share: no context so far
    open_ = np.ones(len(grams), bool)
    for depth in range(len(levels) - 1, -1, -1):
        level, at = levels[depth], np.flatnonzero(open_ & (tags >= depth))
        if not len(at) or not len(level.keys):
            continue
        key = grams[at] & _low(depth + 1)
        place, seen = _find(level.keys, key)
        context, known = _find(level.contexts, key >> 8)
        first = share[at] == 0
        mass = (level.total + level.distinct)[context]
        count = level.counts[place]
        hit = np.where(first, count / mass, count * share[at])
        miss = np.where(first, level.distinct[context] / mass, again[at])
        out[at[seen]] += np.log10(hit[seen])
        open_[at[seen]] = False
        left = known & ~seen
        out[at[left]] += np.log10(miss[left])
        share[at[left]], again[at[left]] = level.share[context[left]], level.again[context[left]]
    kinds = len(levels[0].keys)
    out[open_] -= np.log10(max(1, 256 - kinds))
    return out


def start_grams(data: np.ndarray, order: int) -> np.ndarray:
    """Grams of the places from the fourth byte on that have less than ``order`` bytes before them."""
    made, key = [], 0
    for at, symbol in enumerate(data[:order].tolist()):
        key = key << 8 | symbol
        if at > 2:
            made.append(at << TAG | key)
    return np.array(made, "i8")


def full_grams(data: np.ndarray, order: int):
    """Grams of all places with ``order`` bytes before them, ``PART`` at a time."""
    for start in range(0, len(data) - order, PART):
        part = data[start : start + PART + order]
        many = len(part) - order
        key = np.full(many, order, "i8")
        for _ in range(7 - (order + 1)):
            key <<= 8
        for i in range(order + 1):
            key <<= 8
            key |= part[i : i + many]
        yield key


def _mixed(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
    return ((keys.view("u8") * np.uint64(factor)) >> np.uint64(64 - bits)).astype("i8")


def buckets_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a gram, by the three bytes before its symbol."""
    return _mixed((grams >> 8) & 0xFFFFFF, 0x9E3779B97F4A7C15, 31) % buckets


class HotGrams:
    """Log10 probabilities of the commonest grams; the few that share a slot twice are left out."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.parts = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            bits = max(4, int(4 * len(keys)).bit_length())
            at = _mixed(keys, factor, bits)
            known, value = np.full(1 << bits, -1, "i8"), np.zeros(1 << bits, "f4")
            known[at], value[at] = keys, values
            self.parts.append((factor, bits, known, value))
            left = known[at] != keys
            keys, values = keys[left], values[left]

    def split(self, grams: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum over the grams that are known, and the others."""
        total = 0.0
        for factor, bits, known, value in self.parts:
            at = _mixed(grams, factor, bits)
            hit = known[at] == grams
            total += float(value[at[hit]].sum(dtype="f8"))
            grams = grams[~hit]
        return total, grams


def _cached(cache: dict, name: str, make):
    if name not in cache:
        cache.clear()
        cache[name] = make()
    return cache[name]


def _by_bucket(buckets: int, grams: np.ndarray, *columns: np.ndarray):
    """The bucket, and grams and columns as bytes, of each bucket."""
    bucket = buckets_of(grams, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    parts = [c[order] for c in (grams, *columns)]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for start, stop in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
        yield int(bucket[start]), *[c[start:stop].tobytes() for c in parts]


def deep_counts(training: DataFrame, order: int, buckets: int) -> DataFrame:
    """``(bucket, grams, counts)``, a row for each bucket, of contexts from three bytes on."""

    def work(slices):
        held: list = []

        def handed():
            keys, counts = _summed(*map(np.concatenate, zip(*held, strict=True)))
            made = list(_by_bucket(buckets, keys, counts))
            held.clear()
            return {f.name: list(c) for f, c in zip(fields, zip(*made, strict=True), strict=True)}

        size = 0
        for s in slices:
            fresh = []
            for text in s["text"]:
                data = np.frombuffer(text or b"", "u1")
                fresh += [start_grams(data, order), *full_grams(data, order)]
            keys, counts = np.unique(np.concatenate(fresh or [np.empty(0, "i8")]), return_counts=True)
            if len(keys):
                held.append((keys, counts.astype("i8")))
                size += len(keys)
            if size > 2 * FLUSH_GRAMS:
                held[:] = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > FLUSH_GRAMS:
                    yield handed()
                    size = 0
        if held:
            yield handed()

    fields = [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("grams", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
    ]

    def merged(group):
        keys, counts = (np.concatenate([np.frombuffer(v.as_buffer(), "i8") for v in group[c]]) for c in ("grams", "counts"))
        keys, counts = _summed(keys, counts)
        return pa.table(
            {"bucket": group["bucket"].slice(0, 1), "grams": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())}
        )

    return map_rows(training.select("text"), fields, work).groupBy("bucket").applyInArrow(merged, T.StructType(fields))


def hot_grams(trie: DataFrame, order: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest grams, ``most`` at the utmost, and their log10 probabilities, rare ones first."""

    def buckets(s):
        for grams, counts in zip(s["grams"], s["counts"], strict=True):
            yield np.frombuffer(grams, "i8"), np.frombuffer(counts, "i8")

    def steps(slices):
        for s in slices:
            for _, counts in buckets(s):
                step, n = np.unique((np.log2(counts) * 16).astype("i8"), return_counts=True)
                yield {"step": step.tolist(), "grams": n.tolist()}

    number = [T.StructField("step", T.LongType()), T.StructField("grams", T.LongType())]
    found = map_rows(trie, number, steps).groupBy("step").agg(F.sum("grams").alias("grams")).collect()
    least, taken = None, 0
    for row in sorted(found, key=lambda r: -r["step"]):
        taken += row["grams"]
        if taken > most:
            break
        least = row["step"]
    if least is None:
        return np.empty(0, "i8"), np.empty(0, "f4")

    def chosen(slices):
        for s in slices:
            for grams, counts in buckets(s):
                common = (np.log2(counts) * 16).astype("i8") >= least
                for depth, (keys, numbers) in by_depth(order, grams, counts).items():
                    own = common & (grams >> TAG == depth)
                    at, _ = _find(keys, grams[own] & _low(depth + 1))
                    value = Level(depth, keys, numbers, None).top()[at]
                    yield {"gram": grams[own].tolist(), "n": counts[own].tolist(), "value": value.tolist()}

    fields = [T.StructField("gram", T.LongType()), T.StructField("n", T.LongType()), T.StructField("value", T.FloatType())]
    rows = map_rows(trie, fields, chosen).toArrow()
    rank = np.argsort(rows["n"].to_numpy(), kind="stable")  # of two in a slot the commoner one stays
    return rows["gram"].to_numpy()[rank], rows["value"].to_numpy()[rank]


def digest(text: bytes) -> int:
    return int.from_bytes(blake2b(text, digest_size=8).digest(), "little", signed=True)


def cold_sums(source: DataFrame, trie: DataFrame, order: int, buckets: int, shallow, hot) -> DataFrame:
    """``(digest, deep)``: for each distinct text the sum over the grams that are not broadcast.

    Equal texts ask the same; the first gram of each carries a mark that tells how often.
    """

    def work(slices):
        known = _cached(_hot, hot.value[0], lambda: HotGrams(*hot.value[1:]))
        held: list = []

        def handed():
            made = list(_by_bucket(buckets, *map(np.concatenate, zip(*held, strict=True))))
            held.clear()
            return {f.name: list(c) for f, c in zip(fields, zip(*made, strict=True), strict=True)}

        size = 0
        for s in slices:
            for text in s["text"]:
                data = np.frombuffer(text or b"", "u1")
                if len(data) < 4:
                    continue
                parts = [start_grams(data, order), *full_grams(data, order)]
                keys, counts = np.unique(np.concatenate([known.split(p)[1] for p in parts]), return_counts=True)
                if len(keys):
                    marks = np.arange(len(keys)) == 0
                    held.append((keys, counts.astype("i4"), np.full(len(keys), digest(text), "i8"), marks))
                    size += len(keys)
            if size > FLUSH_GRAMS // 2:
                yield handed()
                size = 0
        if held:
            yield handed()

    fields = [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("grams", T.BinaryType()),
        T.StructField("freqs", T.BinaryType()),
        T.StructField("digests", T.BinaryType()),
        T.StructField("marks", T.BinaryType()),
    ]

    def answered(trie, asked):
        name, keys, numbers = shallow.value
        below = _cached(_shallow, name, lambda: shallow_levels(keys, numbers))
        own = [np.concatenate([np.empty(0, "i8"), *[np.frombuffer(v.as_buffer(), "i8") for v in trie[c]]]) for c in ("grams", "counts")]
        if not asked.num_rows:
            return out.empty_table()
        levels = deep_levels(below, order, *own)
        of = lambda name, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in asked[name]])
        digests, marks = of("digests", "i8"), of("marks", "?").astype("i8")
        unique, place = np.unique(of("grams", "i8"), return_inverse=True)
        keys, sums = _summed(digests, resolve(levels, unique)[place] * of("freqs", "i4"))
        return pa.table([keys, sums, _summed(digests, marks)[1]], schema=out)

    out = pa.schema([("digest", pa.int64()), ("deep", pa.float64()), ("copies", pa.int64())])
    asked = map_rows(source.select("text"), fields, work)
    sums = trie.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answered, "digest long, deep double, copies long")
    return sums.groupBy("digest").agg((F.sum("deep") / F.sum("copies")).alias("deep"))


def train(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all contexts of ``(doc_id, text)`` rows: at most 256^3 + 256^2 + 256 numbers."""

    def work(slices):
        held: list = []

        def reduced():
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([n for _, n in held])
            unique, place = np.unique(keys, return_inverse=True)
            return unique, np.bincount(place, counts, len(unique)).astype("i8")

        for s in slices:
            for text in s["text"]:
                data = np.frombuffer(text or b"", "u1")
                if len(data):
                    held.append((context_keys(data), None))
            if held:
                fresh = np.concatenate([k for k, n in held if n is None] or [np.empty(0, "u4")])
                old = [h for h in held if h[1] is not None]
                held[:] = [*old, np.unique(fresh, return_counts=True)]
                if len(held) > 32:
                    held[:] = [reduced()]
        if held:
            keys, counts = reduced()
            for start in range(0, len(keys), 1 << 16):
                part = slice(start, start + (1 << 16))
                yield {"key": keys[part].astype("i4").tolist(), "n": counts[part].tolist()}

    fields = [T.StructField("key", T.IntegerType()), T.StructField("n", T.LongType())]
    counted = map_rows(source.select("text"), fields, work).groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    return rows["key"].to_numpy().astype("u4"), rows["n"].to_numpy()


def _words(text: bytes | None) -> list[bytes]:
    """``bytes.lower`` and ``bytes.split`` know ASCII only, as wanted."""
    return (text or b"").lower().split()


def _word_counts(source: DataFrame) -> DataFrame:
    """``(term, n)`` of all words, counted in each task first."""

    def emit(seen):
        return {"term": [w.decode("utf-8", "replace") for w in seen], "n": list(seen.values())}

    def work(slices):
        seen: Counter = Counter()
        for s in slices:
            for text in s["text"]:
                seen.update(_words(text))
                if len(seen) > FLUSH:
                    yield emit(seen)
                    seen.clear()
        yield emit(seen)

    fields = [T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
    per_task = map_rows(source.select("text"), fields, work)
    return per_task.groupBy("term").agg(F.sum("n").alias("n"))


def score_texts(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot: int = 300_000,
    longest: int = 64,
    order: int = 2,
    hot_trie: int = 1_000_000,
) -> DataFrame:
    """Score whole texts by a model learned from the rows that are not ``held_out``.

    One row per document row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``. ``score`` is the log10 probability of the text's bytes given their number; the base is
    an add-one unigram model over lower-cased words and one end per text.

    Contexts have up to ``order`` bytes, six at most. Those of two and less, at most 256^3 + 256^2 + 256
    counts, are sent to all tasks; the longer ones grow with the corpus and lie in buckets, of which the
    ``hot_trie`` commonest grams are sent. Texts ask the buckets for all others. Of the word counts the ``hot`` commonest words of at most ``longest`` characters are sent; the
    rest join the documents by a shuffle.

    Null texts count as empty: one end token, score 0. A null in ``held_out`` counts as false.
    Without training rows each byte has probability 1/256 and the base probability is 1. Repeated
    rows are counted and scored one by one. Only the named columns are read.
    """
    if not 2 <= order <= LONGEST:
        raise ValueError(f"order must be from 2 to {LONGEST}")
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    source = texts(docs, id_col, text_col, held)
    training = source.filter(~F.col("held_out"))
    shallow = spark.sparkContext.broadcast((uuid4().hex, *train(training)))
    common = spark.sparkContext.broadcast((uuid4().hex, np.empty(0, "i8"), np.empty(0, "f4")))
    deep = None
    if order > 2:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = 1 + size // BUCKET_BYTES
        trie = saved(deep_counts(training, order, buckets))
        common = spark.sparkContext.broadcast((uuid4().hex, *hot_grams(trie, order, hot_trie)))
        deep = cold_sums(source, trie, order, buckets, shallow, common)
    counts = saved(_word_counts(training))
    ends = training.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = words + ends, kinds + (ends > 0)
    mass = total + distinct + 1
    sent = spark.sparkContext.broadcast(
        {r["term"].encode(): r["n"] for r in hot_terms(counts, hot, longest)}
    )

    def work(slices):
        name, keys, numbers = shallow.value
        model, known = _cached(_models, name, lambda: Model(keys, numbers)), sent.value
        grams = _cached(_hot, common.value[0], lambda: HotGrams(*common.value[1:]))

        def log10(data):
            if order == 2:
                return model.log10(data)
            parts = [start_grams(data, order), *full_grams(data, order)]
            return model.log10(data[:3]) + sum(grams.split(p)[0] for p in parts)

        logs: dict[int, float] = {}
        for s in slices:
            out = {f.name: [] for f in fields}
            for doc, held, row, text in zip(s["doc_id"], s["held_out"], s["row"], s["text"]):
                words = _words(text)
                plus, seen, cold = float(np.log10((ends + 1) / mass)), int(ends > 0), []
                for w, n in Counter(words).items():
                    c = known.get(w)
                    if c is None:
                        cold.append((w, n))
                        continue
                    if c not in logs:
                        logs[c] = float(np.log10((c + 1) / mass))
                    plus += n * logs[c]
                    seen += n
                # A word holds no blank: this matches nothing.
                terms = [w.decode("utf-8", "replace") for w, _ in cold] or [f" {row}"]
                many, none = len(terms), [0] * (len(terms) - 1)
                out["doc_id"] += [doc] * many
                out["held_out"] += [held] * many
                out["row"] += [row] * many
                out["n_tokens"] += [len(words) + 1] * many
                out["score"] += [log10(np.frombuffer(text or b"", "u1"))] * many
                out["digest"] += [digest(text or b"") if order > 2 else None] * many
                out["plus"] += [plus, *none]
                out["seen"] += [seen, *none]
                out["term"] += terms
                out["freq"] += [n for _, n in cold] or [0]
            yield out

    fields = [
        T.StructField("doc_id", source.schema["doc_id"].dataType),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("row", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("digest", T.LongType()),
        T.StructField("plus", T.DoubleType()),
        T.StructField("seen", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("freq", T.LongType()),
    ]
    stream = map_rows(source.withColumn("row", F.monotonically_increasing_id()), fields, work)
    count = F.coalesce(F.col("n"), F.lit(0))
    sums = {
        "n_known": F.col("seen") + F.when(count > 0, F.col("freq")).otherwise(0),
        "base_score": F.col("plus") + F.col("freq") * F.log10((count + 1) / F.lit(float(mass))),
    }
    keys = ["row", "doc_id", "held_out", "n_tokens", "score", "digest"]
    told = dictionary_sums(stream, counts, keys, sums, "n")
    if deep is not None:
        told = told.join(deep, "digest", "left").withColumn("score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    return told.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
