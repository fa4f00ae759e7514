"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.llm.common import handed_through, map_rows, saved, texts

# Lower-case A-Z; every other ASCII character that is no letter or digit becomes a blank. Bytes
# keep their places, so offsets hold for the original text.
FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32)
    for c in range(256)
)

# A run of hit words: character offsets in the original text, first word and number of words.
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "stop", "first", "words")])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows_of(text: bytes | None, width: int) -> set[bytes]:
    """All windows of ``width`` words; a shorter item is one window, an empty one has none."""
    words = words_of(text)
    if not words:
        return set()
    return {
        b" " + b" ".join(words[i : i + width]) + b" "
        for i in range(max(1, len(words) - width + 1))
    }


def _windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    def work(slices):
        for s in slices:
            rows = [(i, w) for i, t in zip(s["doc_id"], s["text"]) for w in windows_of(t, width)]
            yield {"item_id": [r[0] for r in rows], "window": [r[1] for r in rows]}

    fields = [T.StructField("item_id", T.StringType()), T.StructField("window", T.BinaryType())]
    items = texts(benchmark, item_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    return map_rows(items, fields, work).filter("item_id IS NOT NULL").distinct()


class Automaton:
    """Windows and the items that hold them; built once in each task."""

    def __init__(self, patterns: list[tuple[bytes, list[str]]]):
        import ahocorasick

        self.items = [items for _, items in patterns]
        self.lengths = np.array([len(p) for p, _ in patterns], "i8")
        self.words = np.array([p.count(b" ") - 1 for p, _ in patterns], "i8")
        self.machine = ahocorasick.Automaton()
        for k, (pattern, _) in enumerate(patterns):
            self.machine.add_word(pattern.decode("latin-1"), k)
        if patterns:
            self.machine.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, set[str], list[tuple]]:
        """Number of words, items found, and runs of hit words as spans of characters."""
        folded = (text or b"").translate(FOLD)
        words = folded.split()
        if not words or not len(self.words):
            return len(words), set(), []
        joined = b" " + b" ".join(words) + b" "
        found = list(self.machine.iter(joined.decode("latin-1")))
        if not found:
            return len(words), set(), []
        ends = np.array([e for e, _ in found], "i8")
        which = np.array([k for _, k in found], "i8")
        blanks = np.flatnonzero(np.frombuffer(joined, "u1") == 32)
        first = np.searchsorted(blanks, ends - self.lengths[which] + 1)
        edge = np.zeros(len(words) + 1, "i8")
        np.add.at(edge, first, 1)
        np.add.at(edge, first + self.words[which], -1)
        hit = np.concatenate(([0], np.cumsum(edge[:-1]) > 0, [0])).astype("i1")
        starts, stops = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        items = {i for k in set(which.tolist()) for i in self.items[k]}
        return len(words), items, self._spans(text, folded, starts, stops)

    @staticmethod
    def _spans(text, folded, starts, stops):
        solid = np.concatenate(([0], np.frombuffer(folded, "u1") != 32, [0])).astype("i1")
        begin, end = np.flatnonzero(np.diff(solid) == 1), np.flatnonzero(np.diff(solid) == -1)
        # Bytes to characters: continuation bytes do not start a character.
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80)))
        return [
            (int(chars[begin[a]]), int(chars[end[b - 1]]), int(a), int(b - a))
            for a, b in zip(starts, stops)
        ]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: dict[str, Column] | None = None,
    text_as: str | None = None,
    width: int = 13,
    least_percent: int = 5,
    patterns_at_once: int = 200_000,
) -> DataFrame:
    """Occurrences of test items in documents.

    One row per document row: ``doc_id``, the columns of ``keep``, the text as ``text_as`` if wanted, ``n_words, n_hit, items`` (sorted
    as text), ``spans`` (runs of hit words: character offsets of the original text, first word and
    number of words) and ``contaminated`` (hit words, and at least ``least_percent`` of all words).

    The windows of the benchmark are sent to every task. Up to ``patterns_at_once`` windows make
    one automaton; a larger benchmark is cut into several, each of which scans the documents, so
    that memory stays bounded.

    Null and empty texts have no words and are clean. Items without words or without an id are
    left out; repeated items count once. Repeated document rows are judged one by one. Only the
    named columns are read.
    """
    spark = docs.sparkSession
    windows = _windows(benchmark, item_col, item_text_col, width)
    by_window = windows.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    total = by_window.count()
    slices = max(1, -(-total // patterns_at_once))
    sliced = by_window.withColumn("slice", F.pmod(F.xxhash64("window"), F.lit(slices)))
    source = texts(docs, id_col, text_col, *[c.alias(n) for n, c in (keep or {}).items()])
    kept, carry = handed_through(source, text_as)
    if slices > 1:
        # Saved, so that a row has the same number in every scan.
        source = saved(source.withColumn("row", F.monotonically_increasing_id()))
    fields = [
        *kept,
        T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]

    def scan(part: int, extra: bool) -> DataFrame:
        held = sliced.filter(F.col("slice") == part).select("window", "items").toLocalIterator()
        sent = spark.sparkContext.broadcast([(bytes(r[0]), list(r[1])) for r in held])

        def work(slices_):
            machine = Automaton(sent.value)
            for s in slices_:
                found = [machine.scan(t) for t in s["text"]]
                yield {
                    "n_words": [n for n, _, _ in found],
                    "items": [sorted(i) for _, i, _ in found],
                    "spans": [[dict(zip(SPAN.names, x)) for x in spans] for _, _, spans in found],
                }

        row = [T.StructField("row", T.LongType())] if extra else []
        return map_rows(source, fields + row, work, carry | ({"row": "row"} if extra else {}))

    if slices == 1:
        found = scan(0, False).withColumn(
            "n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
        )
    else:
        found = _merged([scan(part, True) for part in range(slices)], [f.name for f in kept])
    hit = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= least_percent * F.col("n_words"))
    return found.select(
        *[f.name for f in kept], "n_words", "n_hit", "items", "spans", hit.alias("contaminated")
    )


def _merged(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Join the finds of several automata over the same rows: spans are united by offsets.

    A run's words are counted again from the united runs, so overlapping finds count once.
    """
    frame = parts[0]
    for other in parts[1:]:
        frame = frame.unionByName(other)
    rows = frame.groupBy("row").agg(
        *[F.first(n).alias(n) for n in names],
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    )

    def work(slices):
        for s in slices:
            united = [unite([tuple(x[n] for n in SPAN.names) for x in spans]) for spans in s["spans"]]
            yield {k: s[k] for k in (*names, "n_words", "items")} | {
                "spans": [[dict(zip(SPAN.names, x)) for x in spans] for spans in united],
                "n_hit": [sum(x[3] for x in spans) for spans in united],
            }

    fields = [rows.schema[n] for n in (*names, "n_words", "items", "spans")]
    return map_rows(rows.drop("row"), [*fields, T.StructField("n_hit", T.LongType())], work)


def unite(spans: list[tuple]) -> list[tuple]:
    """Join runs that overlap or touch."""
    out: list[tuple] = []
    for start, stop, first, words in sorted(spans, key=lambda x: x[2]):
        if out and first <= out[-1][2] + out[-1][3]:
            old = out[-1]
            out[-1] = (old[0], max(old[1], stop), old[2], max(old[3], first + words - old[2]))
        else:
            out.append((start, stop, first, words))
    return out


def digest(found: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS k FROM b WHERE len(words) > 0),
p AS (SELECT DISTINCT item, least(13, len(words)) AS l, array_to_string(words[k:k+12], ' ') AS win FROM i),
s AS (SELECT DISTINCT l FROM p),
d AS (SELECT doc_id, words, l, unnest(range(1, len(words) - l + 2)) AS k FROM w, s WHERE len(words) >= l),
g AS (SELECT doc_id, k, l, array_to_string(words[k:k+l-1], ' ') AS win FROM d),
h AS (SELECT doc_id, k, g.l, item FROM g JOIN p ON p.l = g.l AND p.win = g.win),
o AS (SELECT doc_id, k, unnest(range(0, l)) AS o FROM h),
n AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM o GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS held FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(held, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""
