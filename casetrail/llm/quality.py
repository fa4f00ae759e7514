"""Quality rules with cross-document line frequency.

Lines that many documents of one host share are boilerplate. They are removed, and a document of
which too little is left is rejected, as is one that fails the base rules on its own text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.llm.common import map_rows, saved

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"


def _number(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def normal_lines(text: bytes) -> list[tuple[bytes, int]]:
    """Lower-cased lines with single blanks and their numbers of words; empty lines are left out."""
    found = [line.lower().split() for line in text.split(b"\n")]
    return [(b" ".join(words), len(words)) for words in found if words]


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    if len(words) <= width:
        return 0
    ids: dict[bytes, int] = {}
    first = np.fromiter((ids.setdefault(w, len(ids)) for w in words), "i8", len(words))
    # Number the windows exactly: join the numbers of shorter ones and renumber.
    window, size = first, len(ids)
    for n in range(1, width):
        joined = window[:-1] * len(ids) + first[n:]
        unique, window = np.unique(joined, return_inverse=True)
        size = len(unique)
        if size == len(window):
            return 0
    again = np.flatnonzero(np.bincount(window, minlength=size)[window] > 1)
    edge = np.zeros(len(words) + 1, "i8")
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def measures(text: bytes) -> dict:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    flat = np.frombuffer(text, "u1")
    chars = int(np.count_nonzero((flat & 0xC0) != 0x80)) - sum(map(text.count, [bytes([b]) for b in BLANKS]))
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    source = docs.select(
        docs[id_col].alias("doc_id"),
        docs[host_col].cast("string").alias("host"),
        docs[text_col].cast("binary").alias("text"),
    )
    fields = [
        source.schema["doc_id"],
        T.StructField("host", T.StringType()),
        T.StructField("mark", T.BinaryType()),
        *[T.StructField(n, T.LongType()) for n in COUNTS],
        T.StructField("lines", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
    ]

    def work(slices):
        for s in slices:
            found = [measures(t or b"") for t in s["text"]]
            lines = [normal_lines(t or b"") for t in s["text"]]
            yield {
                "doc_id": s["doc_id"],
                "host": s["host"],
                "mark": [hashlib.blake2b(t or b"", digest_size=16).digest() for t in s["text"]],
                "lines": [[_number(line) for line, _ in x] for x in lines],
                "sizes": [[n for _, n in x] for x in lines],
            } | {n: [m[n] for m in found] for n in COUNTS}

    return map_rows(source, fields, work)


def common_lines(measured: DataFrame, least: int, share: float) -> DataFrame:
    """``(host, line, n_docs)`` of lines in more than ``least`` distinct documents of a host and in
    more than ``share`` of them. Exact copies of a text are one document."""
    once = measured.groupBy("host", "mark").agg(F.first("lines").alias("lines"))
    sizes = once.groupBy("host").agg(F.count("*").alias("host_docs"))
    counted = (
        once.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") > least)
    )
    joined = counted.join(sizes, counted["host"].eqNullSafe(sizes["host"])).drop(sizes["host"])
    return joined.filter(F.col("n_docs") > share * F.col("host_docs")).select("host", "line", "n_docs")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    least: int = 10,
    share: float = 0.001,
    left_words: int = 10,
    left_share: float = 0.3,
) -> DataFrame:
    """Judge whole texts by their own measures and by the lines they share with their host.

    One row per document row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_common_words`` (in common lines, which are removed),
    ``common`` (hashes of the removed lines) and ``kept``.

    A line is common if more than ``least`` distinct documents of its host have it, and more than
    ``share`` of all. A document is kept if it passes the base rules and, without common lines,
    holds ``left_words`` words and ``left_share`` of its words.

    Null texts count as empty: all counts 0, base rules failed. Rows without a host are one host.
    Repeated rows are judged one by one and count once for the frequencies. Only the named columns
    are read.
    """
    measured = saved(_measured(docs, id_col, text_col, host_col))
    common = common_lines(measured, least, share).withColumn("found", F.lit(True))
    # A text's verdict depends on host and text only: resolve each distinct text once.
    once = measured.groupBy("host", "mark").agg(F.first("lines").alias("lines"), F.first("sizes").alias("sizes"))
    each = once.select("host", "mark", F.explode(F.arrays_zip("lines", "sizes")).alias("l")).select(
        "host", "mark", F.col("l.lines").alias("line"), F.col("l.sizes").alias("size")
    )
    same = each["host"].eqNullSafe(common["host"]) & (each["line"] == common["line"])
    hit = each.join(common, same).select(each["host"], "mark", each["line"], "size")
    removed = hit.groupBy("host", "mark").agg(
        F.sum("size").alias("n_common"), F.array_sort(F.collect_set("line")).alias("common")
    )
    both = measured["host"].eqNullSafe(removed["host"]) & (measured["mark"] == removed["mark"])
    joined = measured.join(removed, both, "left").drop(removed["host"]).drop(removed["mark"])
    n, gone = F.col("n_words"), F.coalesce(F.col("n_common"), F.lit(0))
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    enough = (n - gone >= left_words) & (n - gone >= left_share * n)
    return joined.select(
        "doc_id",
        *COUNTS,
        failed.alias("base_failed"),
        gone.alias("n_common_words"),
        F.coalesce("common", F.array().cast("array<bigint>")).alias("common"),
        (~failed & enough).alias("kept"),
    )


def without_common_lines(
    docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text)`` of the kept documents, without the common lines. Ids must be unique; rows
    without an id are left out."""
    kept = judged.filter("kept").select(F.col("doc_id").alias("key"), "common")
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    both = source.join(kept, source["doc_id"] == kept["key"]).drop("key")
    fields = [source.schema["doc_id"], T.StructField("text", T.StringType())]

    def clean(text: bytes, common: list[int]) -> str:
        held = set(common)
        lines = text.split(b"\n")
        stay = [x for x in lines if not held or _number(b" ".join(x.lower().split())) not in held]
        return b"\n".join(stay).decode("utf-8", "replace")

    def work(slices):
        for s in slices:
            found = [clean(t or b"", c) for t, c in zip(s["text"], s["common"])]
            yield {"doc_id": s["doc_id"], "text": found}

    return map_rows(both, fields, work)


SQL = """
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM w WHERE len(words) >= 5),
g AS (SELECT doc_id, k, array_to_string(words[k:k+4], ' ') AS win FROM i),
h AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT k + o) AS n_repeat_words FROM h, (SELECT unnest(range(0, 5)) AS o) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT w.doc_id, host, text, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, lines
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
u AS (SELECT DISTINCT host, text, lines FROM b),
l AS (SELECT host, text, array_to_string(regexp_extract_all(translate(unnest(lines), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS line FROM u),
c AS (SELECT host, line, count(DISTINCT text) AS n FROM l GROUP BY host, line),
z AS (SELECT host, count(*) AS m FROM u GROUP BY host),
x AS (SELECT c.host, line FROM c JOIN z ON c.host IS NOT DISTINCT FROM z.host WHERE n > 10 AND n > 0.001 * m),
q AS (SELECT l.host, l.text, sum(len(string_split(l.line, ' '))) AS gone FROM l JOIN x ON l.host IS NOT DISTINCT FROM x.host AND l.line = x.line GROUP BY l.host, l.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - coalesce(gone, 0) >= 10 AND n_words - coalesce(gone, 0) >= 0.3 * n_words AS kept
FROM f LEFT JOIN q ON f.host IS NOT DISTINCT FROM q.host AND f.text = q.text
"""
