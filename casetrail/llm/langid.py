"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of windows. It
labels every byte of a text; the probabilities of all letters are averaged for the document. Gates
and states use ``x / (1 + |x|)`` instead of the exponential functions: it saturates alike and costs
a fraction, which counts where every byte of a corpus takes a step.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.llm.common import handed_through, map_rows, texts

UNDETERMINED = "und"
WINDOW = 128  # bytes that one pass of the network sees
BLOCK = 1024  # windows computed together
LETTERS = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
LETTER = regex.compile(r"\p{L}")

_networks: dict[str, Network] = {}


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Direction:
    """One direction: update and reset gates and a candidate, one below the other. Arrays hold a
    row per unit and a column per text, so that each part of them lies in one piece."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.table = rng.normal(0, 0.3, (3 * hidden, 256)).astype("f4")
        self.inner = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype("f4")

    def forward(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte, as (steps, hidden, texts)."""
        h, many = self.hidden, len(data)
        state = np.zeros((h, many), "f4")
        out = np.empty((data.shape[1], h, many), "f4")
        given, back, size = (np.empty((3 * h, many), "f4") for _ in range(3))
        gates, update, reset, new = given[: 2 * h], given[:h], given[h : 2 * h], given[2 * h :]
        room, little, inner = size[: 2 * h], size[2 * h :], back[2 * h :]
        for t, column in enumerate(np.ascontiguousarray(data.T)):
            np.take(self.table, column, axis=1, out=given, mode="clip")
            np.matmul(self.inner, state, out=back)
            gates += back[: 2 * h]
            np.abs(gates, out=room)
            room += 1
            gates /= room
            gates *= 0.5
            gates += 0.5
            np.multiply(reset, inner, out=little)
            new += little
            np.abs(new, out=little)
            little += 1
            new /= little
            if keep is not None:
                keep.append((state.copy(), gates.copy(), new.copy(), inner.copy()))
            state = np.subtract(state, new, out=out[t])
            state *= update
            state += new
        return out

    def backward(self, data: np.ndarray, kept: list, slopes: np.ndarray):
        """Gradients of the table and of the inner weights from those of all states."""
        h = self.hidden
        inner = np.zeros_like(self.inner)
        given = np.empty((3 * h, data.shape[1], len(data)), "f4")
        slope = np.zeros((h, len(data)), "f4")
        for t in range(data.shape[1] - 1, -1, -1):
            state, gates, new, back = kept[t]
            slope = slope + slopes[t]
            update, reset = gates[:h], gates[h:]
            d_new = slope * (1 - update) * (1 - np.abs(new)) ** 2
            d_gates = np.concatenate([slope * (state - new), d_new * back])
            d_gates *= 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
            given[:, t] = np.concatenate([d_gates, d_new])
            d_back = np.concatenate([d_gates, d_new * reset])
            inner += d_back @ state.T
            slope = slope * update + self.inner.T @ d_back
        one_hot = np.zeros((data.size, 256), "f4")
        one_hot[np.arange(data.size), data.T.reshape(-1)] = 1
        return given.reshape(3 * h, -1) @ one_hot, inner


class Network:
    """Two directions and an output layer over both states."""

    def __init__(self, labels: list[str], hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.behind = Direction(hidden, rng), Direction(hidden, rng)
        self.output = rng.normal(0, 0.3, (2 * hidden, len(labels))).astype("f4")
        self.shift = np.zeros(len(labels), "f4")

    def weights(self) -> list[np.ndarray]:
        a, b = self.ahead, self.behind
        return [a.table, a.inner, b.table, b.inner, self.output, self.shift]

    def probabilities(self, data: np.ndarray, keep: tuple | None = None):
        """Probabilities at each byte, as (steps, labels, texts), and the states behind them."""
        ahead = self.ahead.forward(data, keep and keep[0])
        behind = self.behind.forward(data[:, ::-1], keep and keep[1])[::-1]
        h = self.ahead.hidden
        scores = self.output[:h].T @ ahead
        scores += self.output[h:].T @ behind
        scores += self.shift[:, None]
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores, ahead, behind

    def step(self, data: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all letters."""
        keep: tuple[list, list] = ([], [])
        slopes, ahead, behind = self.probabilities(data, keep)
        mask = LETTERS[data.T].astype("f4")
        slopes[:, target, np.arange(len(target))] -= 1
        slopes *= (mask / max(1.0, mask.sum()))[:, None]
        h = self.ahead.hidden
        flat = lambda x: x.transpose(1, 0, 2).reshape(x.shape[1], -1)
        output = np.concatenate([flat(ahead) @ flat(slopes).T, flat(behind) @ flat(slopes).T])
        first = self.ahead.backward(data, keep[0], self.output[:h] @ slopes)
        second = self.behind.backward(data[:, ::-1], keep[1], (self.output[h:] @ slopes)[::-1])
        return [*first, *second, output, flat(slopes).sum(1)]

    def fit(self, windows: np.ndarray, targets: np.ndarray, steps: int, batch: int, rate: float):
        """Adam with a falling rate; batches hold as many windows of each label."""
        rng = np.random.default_rng(11)
        groups = [np.flatnonzero(targets == k) for k in range(len(self.labels))]
        first = [np.zeros_like(w) for w in self.weights()]
        second = [np.zeros_like(w) for w in self.weights()]
        for n in range(1, steps + 1):
            each = max(1, batch // len(groups))
            pick = np.concatenate([rng.choice(g, each) for g in groups])
            slopes = self.step(windows[pick], targets[pick])
            now = rate * (1 - (n - 1) / steps)
            for w, g, m, v in zip(self.weights(), slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= now * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
        return self

    def pooled(self, many: list[bytes]) -> np.ndarray:
        """Mean probabilities over all letters of each text; texts of any length, whole."""
        sums = np.zeros((len(many), len(self.labels)))
        if not self.labels:
            return sums
        numbers = np.zeros(len(many))
        held, owners, size = [], [], 0

        def flush():
            data, owner = np.concatenate(held), np.concatenate(owners)
            for start in range(0, len(data), BLOCK):
                part, to = data[start : start + BLOCK], owner[start : start + BLOCK]
                found, _, _ = self.probabilities(part)
                mask = LETTERS[part.T].astype("f4")
                np.add.at(sums, to, np.einsum("tkn,tn->nk", found, mask))
                np.add.at(numbers, to, mask.sum(0))

        for k, text in enumerate(many):
            flat = np.frombuffer(text, "u1")
            for start in range(0, len(flat), WINDOW * BLOCK):
                part = flat[start : start + WINDOW * BLOCK]
                full = np.zeros((-(-len(part) // WINDOW), WINDOW), "u1")
                full.reshape(-1)[: len(part)] = part
                held.append(full)
                owners.append(np.full(len(full), k))
                size += len(full)
                if size >= 4 * BLOCK:
                    flush()
                    held, owners, size = [], [], 0
        if held:
            flush()
        return sums / np.maximum(numbers, 1)[:, None]


def sample(rows: DataFrame, per_label: int, windows: int, width: int) -> DataFrame:
    """At most ``windows`` windows of ``width`` characters from each of ``per_label`` texts of a
    label. Texts and places are chosen by hash, so that runs repeat."""
    room = F.greatest(F.lit(1), F.length("text") - width + 1)
    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(windows)),
        lambda k: F.substring(
            F.col("text"), F.pmod(F.xxhash64("text", k), room).cast("int") + 1, F.lit(width)
        ),
    )
    # Cut first: whole texts are never sorted.
    short = rows.select("lang", F.xxhash64("text").alias("mark"), F.array_distinct(cuts).alias("cuts"))
    # Copies teach once: equal texts have equal marks and would fill the places that are left.
    distinct = short.dropDuplicates(["lang", "mark"])
    order = Window.partitionBy("lang").orderBy("mark", "cuts")
    picked = distinct.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_label)
    return picked.select("lang", F.explode("cuts").alias("cut"))


def train(
    rows: DataFrame, per_label: int, windows: int, hidden: int, steps: int, batch: int = 96
) -> Network:
    """Learn from ``(text, lang)`` rows; the driver gets the bounded sample only."""
    width = 64
    found = sample(rows, per_label, windows, width).collect()
    labels = sorted({r["lang"] for r in found})
    network = Network(labels, hidden)
    if len(labels) > 1:
        data = np.zeros((len(found), width), "u1")
        for k, r in enumerate(found):
            raw = np.frombuffer(r["cut"].encode()[:width], "u1")
            data[k, : len(raw)] = raw
        targets = np.array([labels.index(r["lang"]) for r in found])
        network.fit(data, targets, steps, batch, 0.02)
    return network


def identify(
    docs: DataFrame,
    training: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: dict[str, Column] | None = None,
    text_as: str | None = None,
    per_label: int = 400,
    windows: int = 4,
    hidden: int = 8,
    steps: int = 150,
) -> DataFrame:
    """Predict the language of whole texts.

    One row per document row: ``doc_id``, the columns of ``keep``, the text as ``text_as`` if wanted, ``lang_pred`` (a value of
    ``lang_col`` in ``training``), ``score`` (its mean probability over all letters, 0 to 1) and
    ``spread`` (a map of all labels to their mean probability).

    ``training`` gives texts and labels: of each label at most ``per_label`` texts with
    ``windows`` short windows each go to the driver, whatever the size of the table; rows without
    a label, a text or a letter teach nothing.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing
    was learned. Ties go to the first label in order. Repeated rows are judged one by one. Only
    the named columns are read.
    """
    spark = docs.sparkSession
    rows = training.select(training[text_col].alias("text"), training[lang_col].alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    network = train(rows, per_label, windows, hidden, steps)
    sent = spark.sparkContext.broadcast((uuid4().hex, network.labels, hidden, network.weights()))
    more = [c.alias(n) for n, c in (keep or {}).items()]
    source = texts(docs, id_col, text_col, *more)
    kept, carry = handed_through(source, text_as)
    fields = [
        *kept,
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spread", T.MapType(T.StringType(), T.DoubleType())),
    ]

    def work(slices):
        name, labels, size, weights = sent.value
        if name not in _networks:
            _networks.clear()
            fresh = Network(labels, size)
            for own, given in zip(fresh.weights(), weights):
                own[...] = given
            _networks[name] = fresh
        model = _networks[name]
        for s in slices:
            out = {"lang_pred": [], "score": [], "spread": []}
            found = model.pooled([t or b"" for t in s["text"]])
            for text, row in zip(s["text"], found):
                if not labels or not LETTER.search((text or b"").decode("utf-8", "replace")):
                    best, score, spread = UNDETERMINED, 0.0, []
                else:
                    row = np.clip(row, 0.0, 1.0)
                    k = int(row.argmax())
                    best, score = labels[k], float(row[k])
                    spread = list(zip(labels, row.tolist()))
                out["lang_pred"].append(best)
                out["score"].append(score)
                out["spread"].append(spread)
            yield out

    return map_rows(source, fields, work, carry)
