"""Cheapest repair of conversations whose turns are blank, repeated, cut off or out of order.

A generalised LR parser reads the rows of a conversation in order. Its stacks form a graph whose
tops stand for all ways to edit the rows so far: keep, rerole or delete the row, or insert one. Of
equal tops the cheapest stays, of equally cheap ones that with the least audit. What a row does to the
tops depends on their relative costs and on how their audits compare, so steps are computed once
and looked up from then on.

Rows stream through the parser: a task holds the audits of one conversation, never its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from casetrail.llm.common import saved, visible
from casetrail.llm.sharding import CRC_TABLE, crc_sql

BLANKS = b" \t\n\x0b\x0c\r"
NAMES = {b"u": b"user", b"a": b"assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1

# The role grammar: dialogue -> nothing | opening turns; opening -> nothing | s; turns -> pair | turns pair;
# pair -> u a. Its LR(1) table: states, what they shift, reduce on any input, reduce on u, go to.
START, OPENED, ASKED, TURNS = 0, 2, 3, 6
SHIFT = {(0, b"s"): 1, (2, b"u"): 3, (3, b"a"): 4, (6, b"u"): 3}
REDUCE = {1: (1, "opening"), 4: (2, "pair"), 5: (1, "turns"), 7: (2, "turns")}
REDUCE_BEFORE = {(0, b"u"): (0, "opening")}
GOTO = {(0, "opening"): 2, (2, "turns"): 6, (2, "pair"): 5, (6, "pair"): 7}
ACCEPTING = (START, TURNS)


class Node(NamedTuple):
    """A parser state on top of another node; nodes with the same stack below are shared."""

    state: int
    below: Node | None


class Top(NamedTuple):
    node: Node
    cost: int
    audit: str


def reduced(node: Node, rule: tuple[int, str]) -> Node:
    many, name = rule
    for _ in range(many):
        node = node.below
    return Node(GOTO[node.state, name], node)


def shifted(node: Node, role: bytes) -> Node | None:
    """The stack after a role, reduced as far as it goes; None if the role does not fit."""
    if (node.state, role) in REDUCE_BEFORE:
        node = reduced(node, REDUCE_BEFORE[node.state, role])
    if (node.state, role) not in SHIFT:
        return None
    node = Node(SHIFT[node.state, role], node)
    while node.state in REDUCE:
        node = reduced(node, REDUCE[node.state])
    return node


class Edit(NamedTuple):
    """One edit of an audit: its letter and the role that comes out ('' where the row's own or none)."""

    letter: str
    role: bytes


class Move(NamedTuple):
    """How a top came about: the place of the top before and the edits since."""

    parent: int
    edits: tuple[Edit, ...]


Trail = tuple[Top, Move]


def better(one: Trail, other: Trail | None) -> bool:
    return other is None or (one[0].cost, one[0].audit) < (other[0].cost, other[0].audit)


def with_insertions(tops: dict[int, Trail]) -> dict[int, Trail]:
    """All tops that insertions reach as well; two of them close a pair."""
    found, new = dict(tops), list(tops.values())
    while new:
        top, move = new.pop()
        for role in NAMES:
            node = shifted(top.node, role)
            if node is None:
                continue
            trail = Top(node, top.cost + INSERT, top.audit + "I"), Move(move.parent, (*move.edits, Edit("I", role)))
            # Equal tops: both stacks go on alike, as a pair always ends in the same turns.
            if better(trail, found.get(node.state)):
                found[node.state] = trail
                new.append(trail)
    return found


def after_row(tops: tuple[Top, ...], initial: bytes, removed: bool, cut_off: bool) -> dict[int, Trail]:
    """The tops after one row. ``removed`` rows have to go; ``cut_off`` ones cost more where they stay."""
    found: dict[int, Trail] = {}

    def offer(node: Node | None, cost: int, top: Top, parent: int, letter: str, role: bytes = b"") -> None:
        if node is not None:
            trail = Top(node, top.cost + cost, top.audit + letter), Move(parent, (Edit(letter, role),))
            if better(trail, found.get(node.state)):
                found[node.state] = trail

    for parent, top in enumerate(tops):
        offer(top.node, DELETE, top, parent, "D")
        if not removed:
            offer(shifted(top.node, initial), CUT_OFF * cut_off, top, parent, "K")
            for role in NAMES:
                offer(shifted(top.node, role), REROLE + CUT_OFF * cut_off, top, parent, "R", role)
    return with_insertions(found)


def outline(audits: list[str]) -> list[str]:
    """Short strings in place of ``audits`` that compare and begin alike: what all have in common goes,
    and of the letters between two places where audits part or end only the first stays."""
    ends = {len(a) for a in audits}
    for one in audits:
        ends |= {len(commonprefix([one, other])) for other in audits if other != one}
    keep = [k for k in sorted(ends) if k >= len(commonprefix(audits))]
    return ["".join(a[k] for k in keep if k < len(a)) for a in audits]


def normal(trails: dict[int, Trail]) -> tuple[int, tuple[Top, ...], tuple[Move, ...]]:
    """Least cost, tops relative to it in a fixed order, and their moves.

    A top that costs over a deletion more than complete turns is dropped: those can go on like it, at
    the price of deleting one opening row.
    """
    least = min(top.cost for top, _ in trails.values())
    limit = trails[TURNS][0].cost + DELETE if TURNS in trails else None
    kept = [trails[s] for s in sorted(trails) if limit is None or trails[s][0].cost <= limit]
    short = outline([top.audit for top, _ in kept])
    tops = tuple(Top(top.node, top.cost - least, audit) for (top, _), audit in zip(kept, short))
    return least, tops, tuple(move for _, move in kept)


class Parser:
    """Steps of the stack graph, computed once for each kind of tops and row."""

    LIMIT = 50_000  # steps that are remembered; how many occur is bounded by the grammar

    def __init__(self):
        self.known: dict = {}
        self.origin = normal(with_insertions({START: (Top(Node(START, None), 0, ""), Move(0, ()))}))

    def step(self, tops: tuple[Top, ...], kind: tuple[bytes, bool, bool]):
        found = self.known.get((tops, kind))
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            found = self.known[tops, kind] = normal(after_row(tops, *kind))
        return found


class Audit:
    """An audit that grows at its end and shares its beginning with others."""

    __slots__ = ("before", "letters")

    def __init__(self, before: Audit | None = None, letters: str = ""):
        self.before, self.letters = before, letters

    def plus(self, letters: str) -> Audit:
        if len(self.letters) < 256:
            return Audit(self.before, self.letters + letters)
        return Audit(self, letters)

    def text(self) -> str:
        parts, part = [], self
        while part is not None:
            parts.append(part.letters)
            part = part.before
        return "".join(reversed(parts))


class Version:
    """What one top would give out: its audit and the digest of the repaired rows."""

    __slots__ = ("audit", "sha", "begun")

    def __init__(self, audit: Audit, sha, begun: bool):
        self.audit, self.sha, self.begun = audit, sha, begun

    def grown(self, move: Move, role: bytes, text: bytes) -> Version:
        if not move.edits:
            return self
        sha, begun = self.sha, self.begun
        for letter, new in move.edits:
            if letter != "D":
                if sha is self.sha:
                    sha = sha.copy()
                own = text if letter != "I" else b""
                sha.update((b"\n" if begun else b"") + (new and NAMES[new] or role) + b":" + own)
                begun = True
        return Version(self.audit.plus("".join(e.letter for e in move.edits)), sha, begun)


class Conversation:
    """Rows of one conversation, in order, as they come in."""

    def __init__(self, key, parser: Parser):
        self.key, self.parser = key, parser
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.turn = None
        self.turns, self.rows = 0, 0
        self.last = None  # turn, role and text of the row before
        self.cost, self.tops, moves = parser.origin
        empty = Version(Audit(), hashlib.sha256(), False)
        self.versions = [empty.grown(m, b"", b"") for m in moves]

    def row(self, turn, role: bytes, text: bytes, repeated: bool) -> None:
        """``repeated``: an earlier turn has the same role and text; equal rows of one turn follow
        each other and are told here."""
        initial = role[:1] if role[:1] in b"sua" else b"?"
        if self.last is not None and self.last[1][:1] + role[:1] not in (b"su", b"ua", b"au"):
            self.illegal += 1
        again = repeated or self.last == (turn, role, text)
        self.last = turn, role, text
        if turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn, self.turns = turn, self.turns + 1
        end = text.rstrip(BLANKS)
        blank, cut_off = not end, end[-1:] not in (b".", b"!", b"?")
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut_off and not again and not blank
        kind = initial, blank or again, cut_off and not (blank or again)
        more, self.tops, moves = self.parser.step(self.tops, kind)
        self.cost += more
        self.versions = [self.versions[m.parent].grown(m, role, text) for m in moves]

    def result(self) -> dict:
        best = min(
            ((top.cost, top.audit, v) for top, v in zip(self.tops, self.versions) if top.node.state in ACCEPTING),
            key=lambda x: x[:2],
        )
        span = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {
            "conv_id": self.key,
            "gaps": span,
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
            "cost": self.cost + best[0],
            "audit": best[2].audit.text(),
            "repaired_sha256": best[2].sha.hexdigest(),
        }


FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PLAIN = {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}


def _mark(role: Column, text: Column) -> Column:
    """128 bits that stand for role and text."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def _mark_of(role: bytes, text: bytes) -> bytes:
    return hashlib.md5(b"%d:" % len(role.decode("utf-8", "replace")) + role + text).digest()


def _ordered(rows: DataFrame, *more: DataFrame) -> DataFrame:
    """Each conversation in one partition, its rows by turn; of a turn, first the rows of ``more``, then
    the rows by role and text.

    The digest of a conversation is made row by row, so its rows pass through one task, as a sorted
    stream that spills; no task holds them. What can be counted apart from the order is counted before.
    """
    both = rows
    for other in more:
        both = both.unionByName(other, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), F.col("live").asc_nulls_first(), "role", "text"
    )


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield from zip(*(c.to_pylist() for c in part.columns))


def prepared(rows: DataFrame, live: Column | None = None, columns: dict[str, str] = PLAIN) -> DataFrame:
    """``conv_id, turn, role, text, live`` with one blank for a null role or text."""
    name = PLAIN | columns
    or_blank = lambda c: F.coalesce(F.col(name[c]).cast("string"), F.lit(" ")).alias(c)
    held = F.lit(True) if live is None else F.coalesce(live, F.lit(False))
    return rows.select(
        F.col(name["conv_id"]).alias("conv_id"), F.col(name["turn"]).cast("long").alias("turn"), or_blank("role"), or_blank("text"), held.alias("live")
    )


def repair(rows: DataFrame, live: Column | None = None, columns: dict[str, str] = PLAIN) -> DataFrame:
    """Faults of each conversation and its cheapest repair to roles ``(s?(ua)+)?``.

    One row for each conversation of ``rows`` (``conv_id, turn, role, text``, other names by ``columns``):
    ``conv_id``; ``gaps`` (turns missing between the first and last); ``blank``, ``duplicate`` (role and
    text of an earlier row) and ``truncated`` (last visible character is none of ``.!?``) rows, each
    row counted under its first fault; ``illegal`` (neighbours whose roles' initials are not su, ua or
    au); ``cost`` and ``audit`` of the repair, and ``repaired_sha256`` of the repaired rows, as
    ``role:text`` joined by line feeds. ``repaired_rows`` gives those rows.

    The audit has a letter for each edit: K keeps a row (0), R makes it a user's or assistant's (2),
    D deletes it (3; blank and duplicate rows have to go), I inserts an empty turn (2); a truncated
    row that stays adds 1. Of equally cheap audits the least in ASCII order counts.

    Rows where ``live`` is false or null count as absent, but their conversation gets its row: without
    live rows zeros, an empty audit and the digest of nothing. Rows are taken by turn, nulls first,
    those of one turn by role and text. A null role or text is one blank; null ids are one conversation.
    Equal rows are duplicates. An empty table gives no rows. Only the named columns are read.

    An audit takes a byte for each edit, so a conversation's result fits in memory where its rows
    need not. Repeated texts are found by counting role and text, as 128-bit marks, before the stream.
    """
    spark = visible(rows.sparkSession)
    base = prepared(rows, live, columns)
    kind = base.schema["conv_id"].dataType
    visible_rows = base.filter(F.col("live") & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    slim = saved(visible_rows.select("conv_id", "turn", _mark(F.col("role"), F.col("text")).alias("mark")))
    # Nulls sort below all turns.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = slim.groupBy("conv_id", "mark").agg(F.min(place).alias("first"), F.max(place).alias("final"))
    seen = seen.filter("final > first").select(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark"), "first")
    again = slim.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark")))
    later = again.filter(place > F.col("first")).select("conv_id", "turn", "mark").distinct()
    fields = [
        T.StructField("conv_id", kind),
        *[T.StructField(c, T.LongType()) for c in FAULTS],
        T.StructField("audit", T.StringType()),
        T.StructField("repaired_sha256", T.StringType()),
    ]
    schema = T.StructType(fields)
    stream = _ordered(base, later).select(
        "conv_id", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), "live", "mark"
    )

    def run(batches):
        out, parser = to_arrow_schema(schema), Parser()
        talk, done, marks, marked_turn = None, [], set(), None

        def batch():
            made = pa.RecordBatch.from_pylist(done, schema=out)
            done.clear()
            return made

        for key, turn, role, text, is_live, mark in _slices(batches):
            if talk is None or talk.key != key:
                if talk is not None:
                    done.append(talk.result())
                    if len(done) >= 500:
                        yield batch()
                talk = Conversation(key, parser)
                marks.clear()
            if mark is not None:  # a repeated text of this turn; its rows follow
                if turn != marked_turn:
                    marks.clear()
                    marked_turn = turn
                marks.add(mark)
            elif is_live:
                repeated = bool(marks) and turn == marked_turn and _mark_of(role, text) in marks
                talk.row(turn, role, text, repeated)
        if talk is not None:
            done.append(talk.result())
            yield batch()

    return stream.mapInArrow(run, schema)


def repaired_rows(
    rows: DataFrame, repairs: DataFrame, live: Column | None = None, columns: dict[str, str] = PLAIN
) -> DataFrame:
    """The rows that the audits of ``repairs`` leave: ``conv_id, step, edit, turn, role, text``.

    ``step`` counts the rows of a conversation from 0; inserted ones have no turn and an empty text.
    ``rows``, ``live`` and ``columns`` have to be those that ``repairs`` was made of. The audit comes
    first in the stream, then the rows follow it letter by letter.
    """
    spark = visible(rows.sparkSession)
    base = prepared(rows, live, columns)
    plans = repairs.select("conv_id", F.lit(None).cast("long").alias("turn"), "audit")
    fields = [
        T.StructField("conv_id", base.schema["conv_id"].dataType),
        T.StructField("step", T.LongType()),
        T.StructField("edit", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
    schema = T.StructType(fields)
    stream = _ordered(base.filter("live"), plans).select("conv_id", "turn", "role", "text", "audit")

    def made(source):
        key, node, letters, at, step = None, None, "", 0, 0

        def inserted():
            nonlocal node, at, step
            while at < len(letters) and letters[at] == "I":
                role, node = fitting(node)
                yield key, step, "I", None, NAMES[role].decode(), ""
                at, step = at + 1, step + 1

        for conv, turn, role, text, audit in source:
            if audit is not None:
                key, node, letters, at, step = conv, Node(START, None), audit, 0, 0
                yield from inserted()
                continue
            letter = letters[at]
            at += 1
            if letter == "K":
                node = shifted(node, role[:1].encode())
            elif letter == "R":
                new, node = fitting(node)
                role = NAMES[new].decode()
            if letter != "D":
                yield key, step, letter, turn, role, text
                step += 1
            yield from inserted()

    def run(batches):
        out, some = to_arrow_schema(schema), []

        def batch():
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*some), out)]
            some.clear()
            return pa.RecordBatch.from_arrays(columns, schema=out)

        for row in made(_slices(batches)):
            some.append(row)
            if len(some) >= 256:
                yield batch()
        if some:
            yield batch()

    return stream.mapInArrow(run, schema)


def fitting(node: Node) -> tuple[bytes, Node]:
    """The role that an insertion or a change brings; the grammar allows one at a time."""
    return next((role, after) for role in NAMES if (after := shifted(node, role)) is not None)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with a fifth or so of them dropped, emptied, cut off, repeated or given to the user, as the
    checksum of conversation and turn tells; dropped rows stay, with ``live`` false."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(or_blank("text"), "[.!?]", "")).otherwise(or_blank("text"))
    times = F.sequence(F.lit(1), F.when(harm == 3, 2).otherwise(1))
    return rows.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(or_blank("role")).alias("role"),
        text.alias("text"),
        (harm != 0).alias("live"),
        F.explode(times).alias("_copy"),
    ).drop("_copy")


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_VISIBLE = r"[^\x20\x09-\x0D]"
SQL = f"""
WITH RECURSIVE T AS ({CRC_TABLE}),
  A AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql(_KEY)} % 20 AS harm FROM conversations, T),
  B AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS copy FROM A WHERE harm <> 0),
  C AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g FROM B),
  I AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM C),
  R AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
    NOT regexp_matches(text, '{_VISIBLE}') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut FROM I WINDOW w AS (PARTITION BY g ORDER BY i)),
  N AS (SELECT g, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM R GROUP BY g),
  X(a, b, role, letter, price) AS (VALUES (0, 2, 's', 'K', 0), (0, 3, 'u', 'K', 0), (2, 3, 'u', 'K', 0), (3, 6, 'a', 'K', 0), (6, 3, 'u', 'K', 0),
    (0, 3, NULL, 'R', 2), (2, 3, NULL, 'R', 2), (3, 6, NULL, 'R', 2), (6, 3, NULL, 'R', 2),
    (0, 0, NULL, 'D', 3), (2, 2, NULL, 'D', 3), (3, 3, NULL, 'D', 3), (6, 6, NULL, 'D', 3)),
  Y(b, c, letters, price) AS (VALUES (0, 0, '', 0), (2, 2, '', 0), (3, 3, '', 0), (6, 6, '', 0), (0, 3, 'I', 2), (2, 3, 'I', 2), (3, 6, 'I', 2),
    (6, 3, 'I', 2), (0, 6, 'II', 4), (2, 6, 'II', 4)),
  P AS (SELECT g, CAST(0 AS BIGINT) AS i, Y.c AS s, min(ROW(CAST(price AS BIGINT), letters)) AS v FROM N, Y WHERE Y.b = 0 GROUP BY ALL
    UNION ALL SELECT P.g, P.i + 1 AS i, Y.c AS s,
      min(ROW(P.v[1] + X.price + Y.price + CASE WHEN R.cut AND X.letter <> 'D' THEN 1 ELSE 0 END, P.v[2] || X.letter || Y.letters)) AS v
    FROM P JOIN R ON R.g = P.g AND R.i = P.i + 1 JOIN X ON X.a = P.s AND (X.role IS NULL OR X.role = R.r)
      AND (X.letter = 'D' OR NOT (R.blank OR R.again)) JOIN Y ON Y.b = X.b GROUP BY ALL),
  Q AS (SELECT N.*, (SELECT min(P.v) FROM P WHERE P.g = N.g AND P.i = N.n AND P.s IN (0, 6)) AS v FROM N),
  L AS (SELECT g, v[2] AS audit, unnest(range(1, length(v[2]) + 1)) AS k FROM Q),
  M AS (SELECT g, k, audit[k] AS letter, length(replace(left(audit, k), 'I', '')) AS i, length(replace(left(audit, k), 'D', '')) AS o FROM L),
  O AS (SELECT M.*, R.role, R.text, max(CASE WHEN o = 1 AND letter = 'K' AND R.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY M.g) AS opened
    FROM M LEFT JOIN R ON R.g = M.g AND R.i = M.i AND M.letter <> 'I'),
  Z AS (SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - 1 - opened) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
    chr(10) ORDER BY o) AS repaired FROM O WHERE letter <> 'D' GROUP BY g),
  V AS (SELECT DISTINCT conv_id FROM conversations)
SELECT V.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v[1], 0) AS cost, coalesce(v[2], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM V LEFT JOIN Q ON V.conv_id IS NOT DISTINCT FROM Q.conv_id LEFT JOIN Z USING (g)"""
