"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every word of the examples is a term. Its weight is its IDF times its association with the label
(the phi coefficient), so words that say little about the label weigh little, and none is cut.

The examples lie in blocks of similar ones. An inverted index holds, for each block, the weights of
its examples by common term and the largest weight of each term; rare terms have sparse postings,
whose sums are taken whole. Both together bound the cosine of every example of a block, so a block
is opened only for texts whose nearest neighbours so far are not closer than its bound. What the
search returns is exact.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.llm.common import SLICE, document_frequencies, handed_through, map_rows, saved, texts

# Letters A-Z in lower case; other ASCII characters that are no letter become blanks.
FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32) for c in range(256)
)

COMMON = 64  # terms of at least one example in so many have columns of their own


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Index:
    """Labelled examples as block-max postings, and votes of the nearest ones."""

    def __init__(
        self,
        terms: list[bytes],
        idf: np.ndarray,
        rows: list[dict],
        neighbours: int,
        block: int = 64,
        other: float = 1.0,
    ):
        self.place = {t: k for k, t in enumerate(terms)}
        self.idf, self.neighbours, self.other = idf.astype("f4"), neighbours, other
        self.labels = np.array([r["toxic"] for r in rows], "f4")
        self.ids = np.array([r["doc_id"] for r in rows], object)
        counts = [r["terms"] for r in rows]
        numbers = np.zeros(len(terms), "i8")
        for found in counts:
            numbers[[self.place[t] for t in found]] += 1
        # Terms of one example in 64 and more have a column in the blocks, the others postings.
        common = COMMON * numbers >= len(rows)
        self.columns = int(common.sum())
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        vectors, (owners, held, weights) = self.split(counts, [r["size"] for r in rows])
        # Similar examples share a block: sort by label, leading term and its weight.
        lead = vectors.argmax(1) if self.columns else np.zeros(len(rows), "i8")
        weight = vectors.max(1) if self.columns else np.zeros(len(rows))
        order = np.lexsort((weight, lead, self.labels))
        self.labels, self.ids, vectors = self.labels[order], self.ids[order], vectors[order]
        owners = np.argsort(order)[owners]
        by_term = np.argsort(held, kind="stable")
        self.owners, self.weights = owners[by_term].astype("i4"), weights[by_term]
        self.starts = np.searchsorted(held[by_term], np.arange(len(terms) + 1))
        self.blocks = []
        for start in range(0, len(rows), block):
            part = vectors[start : start + block]
            some = np.flatnonzero(part.any(0))
            self.blocks.append((start, some, np.ascontiguousarray(part[:, some].T)))
        self.tops = np.zeros((self.columns, len(self.blocks)), "f4")
        for k, (_, some, postings) in enumerate(self.blocks):
            self.tops[some, k] = postings.max(1)
        # Base rate and, by leaving each example out, the map from votes to probabilities.
        self.rate = float(self.labels.mean()) if len(rows) else 0.0
        self.ridge, self.steps = 0.05, None
        if len(rows):
            of = np.argsort(owners, kind="stable")
            edges = np.searchsorted(owners[of], np.arange(len(rows) + 1))
            parts = []
            for start in range(0, len(rows), SLICE):
                own = np.arange(start, min(start + SLICE, len(rows)))
                mine = of[edges[own[0]] : edges[own[-1] + 1]]
                rare = owners[mine] - start, held[mine], weights[mine]
                parts.append(self.nearest(vectors[own], own, rare))
            near = [np.concatenate(x) for x in zip(*parts)]
            sums = (near[0].astype("f8") ** 2).sum(1)[(self.labels == 1) & (near[1][:, 0] >= 0)]
            if len(sums):
                self.ridge = max(1e-9, 0.1 * float(np.median(sums)))
            self.steps = rising(self.votes(*near), self.labels)

    def split(self, counts: list[dict], sizes: list[int]):
        """Vectors of ``(1 + log tf) * idf``, of unit length when each other word of the text counts
        as a term of weight ``other`` that no example shares. The common terms come as rows, the
        others as ``(row, term, weight)`` arrays."""
        many = [len(found) for found in counts]
        owners = np.repeat(np.arange(len(counts)), many)
        terms = np.fromiter((self.place[t] for found in counts for t in found), "i8", sum(many))
        freqs = np.fromiter((n for found in counts for n in found.values()), "f8", sum(many))
        weights = (1 + np.log(freqs)) * self.idf[terms]
        rest = np.array(sizes, "f8") - np.bincount(owners, freqs, len(counts))
        norms = np.sqrt(np.bincount(owners, weights**2, len(counts)) + rest * self.other**2)
        weights = (weights / np.maximum(norms, 1e-12)[owners]).astype("f4")
        column = self.column[terms]
        common, rare = column >= 0, column < 0
        out = np.zeros((len(counts), self.columns), "f4")
        out[owners[common], column[common]] = weights[common]
        return out, (owners[rare], terms[rare], weights[rare])

    def vectors(self, counts: list[dict], sizes: list[int]) -> np.ndarray:
        """The common terms' part of the vectors."""
        return self.split(counts, sizes)[0]

    def rare_sums(self, rows: int, rare) -> np.ndarray:
        """What the rare terms add to the cosine of each row and example."""
        owners, terms, weights = rare
        many = self.starts[terms + 1] - self.starts[terms]
        at = np.arange(many.sum()) + np.repeat(self.starts[terms] - (np.cumsum(many) - many), many)
        cells = np.repeat(owners, many) * len(self.labels) + self.owners[at]
        sums = np.bincount(cells, np.repeat(weights, many) * self.weights[at], rows * len(self.labels))
        return sums.reshape(rows, len(self.labels)).astype("f4")

    def nearest(self, vectors: np.ndarray, own: np.ndarray | None = None, rare=None):
        """Cosines and places of the nearest examples of each row, best first; -1 if none."""
        rows, k = len(vectors), self.neighbours
        cosines, places = np.zeros((rows, k), "f4"), np.full((rows, k), -1)
        bounds = vectors @ self.tops
        sums = None
        if rare is not None and len(rare[0]) and rows:
            sums = self.rare_sums(rows, rare)
            # Sums of parts and of the whole may differ in the last digits.
            bounds += np.maximum.reduceat(sums, [start for start, *_ in self.blocks], 1) + 1e-6
        for b in np.argsort(-bounds.max(0), kind="stable") if rows else []:
            need = np.flatnonzero(bounds[:, b] > cosines[:, -1])
            if not len(need):
                continue
            start, held, postings = self.blocks[b]
            found = vectors[np.ix_(need, held)] @ postings
            if sums is not None:
                found += sums[need, start : start + found.shape[1]]
            at = np.broadcast_to(np.arange(start, start + found.shape[1]), found.shape).copy()
            if own is not None:
                found[at == own[need][:, None]] = 0
            at[found <= 0] = -1
            both = np.concatenate([cosines[need], found], 1)
            them = np.concatenate([places[need], at], 1)
            # Of equal cosines the example with the lower place comes first.
            order = np.lexsort((np.where(them < 0, 1 << 30, them), -both))[:, :k]
            cosines[need] = np.take_along_axis(both, order, 1)
            places[need] = np.take_along_axis(them, order, 1)
        return cosines, places

    def votes(self, cosines: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Mean label of the nearest examples, weighted by closeness; the base rate has a small
        weight, so that far neighbours decide little."""
        weights = np.where(places >= 0, cosines.astype("f8") ** 2, 0)
        marks = np.where(places >= 0, self.labels[places], 0)
        return ((weights * marks).sum(1) + self.ridge * self.rate) / (weights.sum(1) + self.ridge)

    def score(self, counts: list[dict], sizes: list[int]):
        """Calibrated scores, and the cosines and places of the neighbours."""
        if not len(self.labels):
            return np.zeros(len(counts)), np.zeros((len(counts), 0)), np.zeros((len(counts), 0), int)
        vectors, rare = self.split(counts, sizes)
        cosines, places = self.nearest(vectors, None, rare)
        scores = np.clip(np.interp(self.votes(cosines, places), *self.steps), 0, 1)
        return np.where(places[:, 0] >= 0, scores, self.rate), cosines, places


def rising(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve from votes to label rates with least squared error, by pooling
    neighbours that fall (isotonic regression); ties are one point."""
    points, inverse = np.unique(votes, return_inverse=True)
    sums = np.bincount(inverse, labels)
    sizes = np.bincount(inverse).astype("f8")
    pools: list[list[float]] = []  # sum, size, first, last
    for k, (total, size) in enumerate(zip(sums, sizes)):
        pools.append([total, size, k, k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, size, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + size, pools[-1][2], last]
    x = np.concatenate([[points[int(p[2])], points[int(p[3])]] for p in pools])
    y = np.concatenate([[p[0] / p[1]] * 2 for p in pools])
    return x, y


def _term_rows(rows: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Per row its distinct words with their frequencies."""

    def work(slices):
        for s in slices:
            out = {f.name: s.get(f.name) for f in fields}
            found = [Counter(words_of(t)) for t in s["text"]]
            out["size"] = [c.total() for c in found]
            out["terms"] = [[w.decode("utf-8", "replace") for w in c] for c in found]
            out["freqs"] = [list(c.values()) for c in found]
            yield out

    return map_rows(rows, fields, work)


TERMS = [
    T.StructField("size", T.LongType()),
    T.StructField("terms", T.ArrayType(T.StringType())),
    T.StructField("freqs", T.ArrayType(T.LongType())),
]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    teaches: Column,
    per_label: int,
    neighbours: int,
) -> Index:
    """Choose examples, weigh their words and count document frequencies over all documents."""
    source = texts(docs, "doc_id", "text", F.coalesce(teaches, F.lit(False)).alias("teaches"))
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lessons = docs.select(docs["doc_id"].alias("doc_id"), teaches.alias("teaches"))
    lessons = lessons.filter("teaches").select("doc_id").distinct()
    marks = marks.join(lessons, "doc_id", "left_semi")
    # Bounded: at most per_label ids of each label are sent to all tasks. Every task gives its first
    # ones, so none sorts all ids of a label.
    first = lambda label: marks.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    chosen = saved(first(1).unionByName(first(0)).select("doc_id", "toxic"))
    kind = source.schema["doc_id"].dataType
    shown = [T.StructField("doc_id", kind), T.StructField("toxic", T.IntegerType())]
    examples = source.filter("teaches").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # An id teaches once: of several texts the one with the least hash.
    examples = examples.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sizes = {r[0]: r[1] for r in chosen.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        rows = [{"doc_id": None, "toxic": 1, "size": 0, "terms": {}}] * bool(bad)
        return Index([], np.zeros(0), rows, neighbours)
    known: dict[str, bytes] = {}
    rows = []
    for part in _term_rows(examples, [*shown, *TERMS]).toArrow().to_batches(max_chunksize=SLICE):
        for doc, toxic, size, words, freqs in zip(*(c.to_pylist() for c in part.columns)):
            words = [known.setdefault(w, w.encode()) for w in words]
            rows.append({"doc_id": doc, "toxic": toxic, "size": size, "terms": dict(zip(words, freqs))})
    rows.sort(key=lambda r: str(r["doc_id"]))
    terms = sorted(known.values())
    place = {t: k for k, t in enumerate(terms)}
    held = np.zeros((2, len(terms)))
    for r in rows:
        held[r["toxic"], [place[t] for t in r["terms"]]] += 1
    total, numbers = document_frequencies(source, terms, words_of)
    idf = np.log((1 + total) / (1 + numbers)) + 1
    marks = [r["toxic"] for r in rows]
    bad, good = sum(marks), len(marks) - sum(marks)
    tied = association(held[1], held[0], bad, good)
    most = float(tied.max()) if len(terms) and tied.max() > 0 else 1.0
    # A word that no example has is like one that a single example of the commoner label has.
    single = np.array([[0.0, 1.0], [1.0, 0.0]])
    other = float(association(*single, bad, good).min()) * (np.log(1 + total) + 1) / most
    return Index(terms, idf * tied / most, rows, neighbours, other=other)


def association(a: np.ndarray, b: np.ndarray, bad: int, good: int) -> np.ndarray:
    """Phi coefficient, without sign, of the label and words in ``a`` toxic and ``b`` other examples."""
    n, cross = bad + good, a * (good - b) - b * (bad - a)
    return np.abs(cross) / np.sqrt(np.maximum((a + b) * (n - a - b) * float(bad) * float(good), 1e-12))


def score_toxicity(
    docs: DataFrame,
    training: DataFrame,
    labels: DataFrame,
    teaches: Column,
    keep: dict[str, Column] | None = None,
    text_as: str | None = None,
    per_label: int = 2048,
    neighbours: int = 15,
) -> DataFrame:
    """Score whole texts by their nearest labelled examples.

    One row per row of ``docs``: ``doc_id``, the columns of ``keep``, the text as ``text_as`` if wanted, ``score`` (0 to 1),
    ``predicted`` (1 if the score is at least 0.5) and ``evidence`` (the neighbours, nearest first:
    their id, label and cosine).

    ``training`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``) give the examples; only rows
    of ``training`` where ``teaches`` holds are used, at most ``per_label`` of each label, chosen
    by a hash of the id. All their words make up the vectors, weighted by IDF, for which document
    frequencies count all rows of ``training``, and by association with the label. The index holds
    the words of the chosen examples and nothing else and is sent to all tasks.

    Null and empty texts, and texts without a known word, have no neighbours and get the score of
    the base rate. Labels other than 0 and 1, null ids and unknown ids teach nothing; an id with
    both labels counts as toxic, one with several texts teaches one. Without examples every score is 0. Equal cosines rank by index
    order. Repeated rows are scored one by one. Only the named columns are read.
    """
    spark = docs.sparkSession
    index = fit(training, labels, teaches, per_label, neighbours)
    sent = spark.sparkContext.broadcast(index)
    source = texts(docs, "doc_id", "text", *[c.alias(n) for n, c in (keep or {}).items()])
    kept, carry = handed_through(source, text_as)
    near = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("toxic", T.IntegerType()),
            T.StructField("cosine", T.DoubleType()),
        ]
    )
    fields = [
        *kept,
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(near)),
    ]

    def work(slices):
        index = sent.value
        known = index.place.keys()
        for s in slices:
            found = [words_of(t) for t in s["text"]]
            counts = [Counter([w for w in words if w in known]) for words in found]
            scores, cosines, places = index.score(counts, [len(words) for words in found])
            evidence = [
                [
                    {"doc_id": index.ids[p], "toxic": int(index.labels[p]), "cosine": float(c)}
                    for p, c in zip(where, near)
                    if p >= 0
                ]
                for where, near in zip(places, cosines)
            ]
            yield {
                "score": scores.tolist(),
                "predicted": [int(x >= 0.5) for x in scores],
                "evidence": evidence,
            }

    return map_rows(source, fields, work, carry)
