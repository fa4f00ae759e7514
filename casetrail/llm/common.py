"""Helpers shared by the operators: table reads, text passes and dictionary sums."""

from __future__ import annotations

import ctypes
import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from casetrail.session import configure, ensure_checkpoint_dir

# Rows, and bytes of text, handed to a Python function at a time; a longer text comes alone. What a
# function holds for each byte of text is so held for a slice, never for a batch.
SLICE = 256
SLICE_BYTES = 1 << 20
# Rows and bytes that Spark puts into an Arrow batch: a batch is held whole on both sides.
BATCH, BATCH_BYTES = 1000, 8 << 20


def visible(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver imports it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return visible(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def texts(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``(doc_id, text as UTF-8 bytes, ...)``; other columns never reach the scan."""
    return df.select(
        df[id_col].alias("doc_id"), df[text_col].cast("binary").alias("text"), *more
    )


def slices_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``SLICE`` rows and ``SLICE_BYTES`` bytes of text, or a single row."""
    if not batch.num_rows:
        return
    sizes = np.zeros(batch.num_rows, "i8")
    for column in batch.columns:
        if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = int(upto[start - 1]) if start else 0
        stop = int(np.searchsorted(upto, before + SLICE_BYTES, "right"))
        stop = max(start + 1, min(stop, start + SLICE))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on and serves other passes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(
    df: DataFrame,
    fields: list[T.StructField],
    work: Callable[[Iterator[dict]], Iterable[dict]],
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """``mapInArrow`` over small slices. ``work`` gets dicts of column lists and yields dicts of
    column lists (any number of rows), in the order of ``fields``.

    ``carry`` names fields that are columns of ``df`` handed through; they never become Python objects. Then
    ``work`` has to yield once for each slice, with a row for each of its rows.
    """
    visible(df.sparkSession)
    schema, carried = T.StructType(fields), carry or {}

    def run(batches):
        out = to_arrow_schema(schema)
        waiting: deque[pa.RecordBatch] = deque()
        unseen = set(carried.values()) - {"text"}

        def slices():
            for batch in batches:
                for part in slices_of(batch):
                    if carried:
                        waiting.append(part)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names) if n not in unseen}

        for made in work(slices()):
            part = waiting.popleft() if carried else None
            columns = [
                part.column(carried[f.name]).cast(f.type) if f.name in carried else pa.array(made[f.name], type=f.type) for f in out
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=out)
        give_back()

    return df.mapInArrow(run, schema)


def handed_through(source: DataFrame, text_as: str | None) -> tuple[list[T.StructField], dict[str, str]]:
    """Fields and ``carry`` of all columns of ``source`` but the text, which comes as ``text_as`` if wanted."""
    kept = [f for f in source.schema.fields if f.name != "text"]
    carry = {f.name: f.name for f in kept}
    if text_as:
        kept.append(T.StructField(text_as, T.StringType()))
        carry[text_as] = "text"
    return kept, carry


def saved(df: DataFrame) -> DataFrame:
    """A copy on the shared checkpoint folder; later stages read it instead of computing again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def document_frequencies(
    source: DataFrame, wanted: list[bytes], words_of: Callable[[bytes | None], list[bytes]]
) -> tuple[int, np.ndarray]:
    """Number of all rows of ``source.text``, and of those that hold each wanted term."""
    place = {t: k for k, t in enumerate(wanted)}

    def work(slices):
        numbers, total = [0] * len(wanted), 0
        for s in slices:
            for text in s["text"]:
                for w in place.keys() & words_of(text):
                    numbers[place[w]] += 1
            total += len(s["text"])
        held = [k for k, n in enumerate(numbers) if n]
        yield {"key": [-1, *held], "n": [total, *[numbers[k] for k in held]]}

    fields = [T.StructField("key", T.IntegerType()), T.StructField("n", T.LongType())]
    rows = map_rows(source.select("text"), fields, work).groupBy("key").agg(F.sum("n")).collect()
    found = dict(map(tuple, rows))
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(len(wanted))], "f8")


# --- sums over documents of values kept in a dictionary -----------------------------------------


def hot_terms(counts: DataFrame, most: int, longest: int) -> list:
    """The commonest terms of at most ``longest`` characters, ``most`` at the utmost: a bounded
    broadcast, since every term outside of it is joined by a shuffle.

    A small histogram of the counts gives the least count to take, so that the driver receives the
    chosen terms and nothing else.
    """
    short = counts.filter(F.length("term") <= longest).select("term", "n", *counts.columns[2:])
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = short.groupBy(step.alias("step")).agg(F.count("*").alias("terms")).collect()
    least, taken = None, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        taken += row["terms"]
        if taken > most:
            break
        least = row["step"]
    return [] if least is None else short.filter(step >= least).collect()


def dictionary_sums(
    stream: DataFrame, dictionary: DataFrame, keys: list[str], sums: dict[str, Column], value: str
) -> DataFrame:
    """Finish per-document sums whose common part is known already.

    ``stream`` has, per document, one row for each term that is not in the broadcast part, with its
    frequency ``freq``; the first row of a document also carries the sums of the broadcast part. A
    document without such a term has one row with a term that matches nothing. ``dictionary`` is
    ``(term, <value>)``.
    """
    joined = stream.join(dictionary.select("term", value), "term", "left")
    return joined.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
