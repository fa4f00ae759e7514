"""Contiguous shards of near equal bytes, in DataFrame functions alone.

The rows are cut into ranges of their order. A range's total of bytes and rows, summed over the
ranges before it, tells where the range begins; running sums inside of a range do the rest. So no
task ever orders more than its range, and what is gathered is one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.llm.common import saved, visible

OVERHEAD = 8  # bytes that a row takes besides its text


def sizes(id_col: str, text_col: str) -> list[Column]:
    """Key, bytes and checksum of each row; a null text has no bytes."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return [
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ]


def numbered(rows: DataFrame) -> DataFrame:
    """``range, place, before, total`` for rows with ``doc_id, size, text_crc32, row``: the place of
    each row in the order of key, checksum and size, and the bytes before it, counted over all rows.

    ``row`` ends the order, so that one key with many rows is spread over several ranges.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc("text_crc32"), F.asc("size"), F.asc("row")]
    # Saved, so that both passes below see the same ranges.
    ranged = saved(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    # One row for each range.
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.select(
        "*", F.sum("size").over(inside).alias("upto"), F.count(F.lit(1)).over(inside).alias("nth")
    )
    return running.join(F.broadcast(starts), "range").select(
        *rows.columns,
        "total",
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("before"),
    )


def assign_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """Put every row into one of ``shards`` contiguous shards whose bytes are nearly equal.

    One row for each row of ``docs``: ``doc_id``, ``size`` (UTF-8 bytes of the text and 8 more),
    ``text_crc32``, ``shard`` and ``slot`` (place in the shard, from 0 without gaps); with
    ``row_col`` (a column that is unique for each row) also ``row``.

    The rows are ordered by key (nulls first), checksum and size. Cut k lies at k / ``shards`` of all
    bytes, moved to the nearest border between two rows: a row belongs to the shard that holds its
    middle byte. So a shard is off the equal size by half of its first and half of its last row at
    most. A row longer than a shard leaves shards empty; with fewer rows than shards some are empty.

    Null texts count as empty ones. Rows that share a key, also a null one, may be cut apart; equal
    rows are interchangeable. An empty table gives no rows. Bytes are counted in 64 bits, enough
    for 2^62 / ``shards`` bytes. Only the named columns are read.
    """
    visible(docs.sparkSession)
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    # Saved, so that the texts are read once and a row keeps its number.
    slim = saved(docs.select(*sizes(id_col, text_col), row.alias("row")))
    # Twice the middle of the row against twice the total; the whole row lies inside, so the
    # quotient is below the number of shards.
    shard = F.expr(f"int(((2 * before + size) * {int(shards)}L) div (2 * total))")
    placed = saved(numbered(slim).select("doc_id", "size", "text_crc32", "row", "place", shard.alias("shard")))
    # One row for each shard.
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    slot = (F.col("place") - F.col("first")).alias("slot")
    more = [] if row_col is None else ["row"]
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", slot, *more)


def write_shards(
    docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", parts: int = 8
) -> None:
    """Write ``docs`` as Parquet folders ``shard=0`` and so on, with ``slot`` as an added column.

    A shard is written as ``parts`` files, each a run of its slots in order, so that a task holds
    a part of a shard. The rows are saved once to give each a number, then joined to their places.
    """
    visible(docs.sparkSession)
    kept = saved(docs.withColumn("_row", F.monotonically_increasing_id()))
    places = assign_shards(kept, shards, id_col, text_col, "_row").select(F.col("row").alias("_row"), "shard", "slot")
    rows = kept.join(places, "_row").drop("_row")
    ordered = rows.repartitionByRange(shards * parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").mode("errorifexists").parquet(path)


def by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The columns that the registered query returns."""
    placed = assign_shards(docs, shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# CRC-32 in SQL: the table of the polynomial 3988292384, the bytes of a text, a fold over them.
CRC_TABLE = """SELECT list(CAST(v AS BIGINT) ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of ``text``, in a query that also reads ``CRC_TABLE``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = "lambda a, b: xor(a >> 8, crcs[xor(a & 255, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), {step}), 4294967295)"


SQL = f"""
WITH T AS ({CRC_TABLE}),
  D AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, T),
  O AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS nth, sum(size) OVER () AS total FROM D
    WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
  S AS (SELECT *, CAST(((2 * upto - size) * 24) // (2 * total) AS INTEGER) AS shard FROM O)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM S"""
