"""Fill-in-the-middle: texts cut at two units and put together in another order.

The cuts are found on whole batches of UTF-8 at once, eight bytes to a word. Arithmetic on the words
marks each byte that ends a unit, a population count tells how many units end in a word, a search
in the running counts finds the word of the k-th unit, and a select inside of the word finds its
byte. Spark itself takes the texts apart and puts them together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.llm.common import visible

LOWEST, HIGHEST = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
BREAKS = np.uint64(0x0A0A0A0A0A0A0A0A)
MARKERS = ("<P>", "<S>", "<M>")
CUTS = "struct<n: bigint, first: bigint, second: bigint, first_byte: bigint, second_byte: bigint>"


def _shift(by: int) -> np.uint64:
    return np.uint64(by)


def character_ends(words: np.ndarray) -> np.ndarray:
    """A bit in each byte that the start of a code point follows. Continuation bytes are 10xxxxxx."""
    going_on = (words >> _shift(7)) & ~(words >> _shift(6)) & LOWEST
    starts = going_on ^ LOWEST
    following = np.append(starts[1:], LOWEST)
    return (starts >> _shift(8)) | ((following & np.uint64(1)) << _shift(56))


def line_ends(words: np.ndarray) -> np.ndarray:
    """A bit in each byte that is a line feed: there the difference is zero."""
    apart = words ^ BREAKS
    return (~(((apart & ~HIGHEST) + ~HIGHEST) | apart) & HIGHEST) >> _shift(7)


UNITS = {"character": character_ends, "line": line_ends}


class Units:
    """The unit ends of a run of texts that lie one after the other."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, unit: str):
        """``edges`` are the texts' first bytes and the end of the last."""
        padded = np.zeros(-(-max(len(data), 1) // 8) * 8, "u1")
        padded[: len(data)] = data
        self.edges = edges
        self.ends = UNITS[unit](padded.view("<u8"))
        # The last byte of a text ends a unit, whatever follows.
        last = edges[1:][edges[1:] > edges[:-1]] - 1
        np.bitwise_or.at(self.ends, last >> 3, np.uint64(1) << (8 * (last & 7)).astype("u8"))
        if len(data) & 7:
            self.ends[-1] &= (np.uint64(1) << _shift(8 * (len(data) & 7))) - np.uint64(1)
        self.upto = np.cumsum(np.bitwise_count(self.ends), dtype="i8")
        self.before = self.rank(edges)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each byte."""
        word = at >> 3
        inside = (np.uint64(1) << (8 * (at & 7)).astype("u8")) - np.uint64(1)
        ends = np.append(self.ends, np.uint64(0))[word]
        return np.append(0, self.upto)[word] + np.bitwise_count(ends & inside)

    def counts(self) -> np.ndarray:
        return np.diff(self.before)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th unit of each text, counted from the start of the text."""
        want = self.before[:-1] + k
        word = np.searchsorted(self.upto, want)
        ends = self.ends[np.minimum(word, len(self.ends) - 1)]
        rest = (want - np.append(0, self.upto)[word]).astype("u8")
        # Byte j of the product counts the units that end in the bytes up to j.
        running = ends * LOWEST
        reached = ((running | HIGHEST) - rest * LOWEST) & HIGHEST
        byte = 8 * word + 8 - np.bitwise_count(reached) + 1
        return np.where(k > 0, byte - self.edges[:-1], 0)


def cut_points(texts: pa.Array, one: pa.Array, two: pa.Array, unit: str) -> pa.Array:
    """``CUTS`` for binary texts: two cuts at the numbers modulo one more than the units."""
    texts = texts.cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, "u1")[edges[0] : edges[-1]] if body is not None else np.zeros(0, "u1")
    units = Units(data, edges - edges[0], unit)
    n = units.counts()
    cuts = np.sort([one.to_numpy() % (n + 1), two.to_numpy() % (n + 1)], axis=0)
    columns = [n, *cuts, units.after(cuts[0]), units.after(cuts[1])]
    return pa.StructArray.from_arrays(
        [pa.array(c.astype("i8")) for c in columns], ["n", "first", "second", "first_byte", "second_byte"]
    )


def _cutter(unit: str):
    @F.arrow_udf(CUTS)
    def cuts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        return cut_points(texts, one, two, unit)

    return cuts


def draws(key: Column, seed: int, many: int = 4) -> list[Column]:
    """Numbers from 0 to 2^32 - 1 that depend on the seed and key alone; a null key counts as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(many)]


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of. In a marked output each marker stands once."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers), -1)
    part = [F.try_element_at(parts, F.lit(k)) for k in (2, 3, 4)]
    return (
        F.when(form == "psm", F.concat(part[0], part[2], part[1]))
        .when(form == "spm", F.concat(part[1], part[2], part[0]))
        .otherwise(output)
    )


def fill_in_middle(
    docs: DataFrame,
    unit: str = "character",
    plain_percent: int = 10,
    spm_percent: int = 20,
    seed: int = 1,
    markers: tuple[str, str, str] = MARKERS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rearrange whole texts as prefix, suffix and middle.

    One row for each row of ``docs``: ``doc_id``, ``n`` (units of the text), ``form`` (``plain``,
    ``psm`` or ``spm``), ``prefix_chars`` and ``middle_chars`` (units; null if plain) and ``output``.
    ``restored`` gives the text back.

    ``unit`` is ``character`` (code points) or ``line`` (up to and with a line feed). The cuts and the
    form are drawn from ``seed`` and the key, so they are the same in every run. ``markers`` stand
    before the prefix, suffix and middle; each has to begin with a character that it does not hold
    again and that no marker ends with. Empty texts, and texts that hold a marker, stay plain.

    Null texts count as empty ones. Repeated rows, and rows without a key, get the same draws. A text
    of any length takes linear time. Only the named columns are read.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    visible(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[h.alias(f"h{k}") for k, h in enumerate((h1, h2, h3, h4), 1)])
    cut = rows.withColumn("cut", _cutter(unit)(F.col("text").cast("binary"), "h1", "h2"))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains("text", F.lit(m))
    stays = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(stays, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    body, at, to = F.col("text").cast("binary"), F.col("cut.first_byte").cast("int"), F.col("cut.second_byte").cast("int")
    prefix = F.substring(body, F.lit(1), at).cast("string")
    middle = F.substring(body, at + 1, to - at).cast("string")
    suffix = F.substring(body, to + 1, F.octet_length(body) - to).cast("string")
    p, s, m = map(F.lit, markers)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(moved, F.col("cut.first")).alias("prefix_chars"),
        F.when(moved, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        output.alias("output"),
    )


def digest(made: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    back = restored(F.col("output"), F.col("form"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256")
    )


_NUMBER = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
SQL = f"""
WITH H AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  N AS (SELECT doc_id, t, length(t) AS n, {", ".join(_NUMBER.format(8 * k + 1) + f" AS h{k + 1}" for k in range(4))} FROM H),
  F AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM N),
  C AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM F)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM C"""
