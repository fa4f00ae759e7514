"""Byte-level BPE encoding and decoding in linear time.

The vocabulary is an Aho-Corasick automaton over bytes mapped to Latin-1. A pre-token is covered
from left to right with the longest match; where two neighbours could not stand side by side after
the merges, the search goes back to the next shorter match. Which neighbours fit is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.llm.common import map_rows, texts

# Entries that a memo of pre-tokens may hold before a new one is begun.
MEMO = 600_000
# White space of several characters: only there a pre-token may hold a cut between chunks.
WIDE = re.compile(r"\s[ \n]|\n\s")
BORDER = regex.compile(r"(?<=\S)(?=[ \n])")


def chunks(text: str) -> list[str]:
    """Cut before every blank or line end that follows a non-blank. Pre-tokens never cross such a
    place, so the pieces of a chunk do not depend on what stands around it."""
    if WIDE.search(text):
        return BORDER.split(text)
    out: list[str] = []
    for number, line in enumerate(text.split("\n")):
        if number:
            out.append("\n")
        head, *rest = line.split(" ")
        out.append(head)
        out += [" " + r for r in rest]
    return out


class Vocabulary:
    """Ranks of one tokenizer and the tables that the search needs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        self.left_of, self.right_of, self.shorter = [-1] * size, [-1] * size, [-1] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.left_of[rank], self.right_of[rank] = self.last_merge(token)
            self.shorter[rank] = self.next_shorter(token)
        self.split = regex.compile(pattern).findall
        self.machine = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.machine.add_word(token.decode("latin-1"), rank)
        self.machine.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        # Ids of pre-tokens; when the newer memo is full, it becomes the older one.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            rows = (line.split() for line in file if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in rows}, pattern)

    def last_merge(self, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; (-1, -1) for a single byte."""
        ranks, own = self.ranks, self.ranks[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
            best = min(pairs)
            if best >= own:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-1, -1)

    def next_shorter(self, token: bytes) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        found = (self.ranks.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
        return next((r for r in found if r >= 0), -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side.

        Undo the merges on both sides of the border, the latest first. The tokens that meet at the
        border at that time must not merge before the undone merge took place.
        """
        ranks, tokens, left_of, right_of = self.ranks, self.tokens, self.left_of, self.right_of
        a, b, before, good = left, right, len(tokens) + 1, True
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < before:
                good = False
                break
            inner_a, inner_b = right_of[a], left_of[b]
            if inner_a >= 0 and (a > b or inner_b < 0):
                before, a = a, inner_a
            elif inner_b >= 0:  # of equal merges the left one takes place first
                before, b = b + 1, inner_b
            else:
                break
        self.fits[(left, right)] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        tokens, fits, shorter = self.tokens, self.fits, self.shorter
        longest = [0] * size
        for end, rank in self.machine.iter(piece.decode("latin-1")):
            longest[end + 1 - len(tokens[rank])] = rank
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(tokens[token])
            if not dead[end]:
                good = not out
                if not good:
                    good = fits.get((out[-1], token))
                    if good is None:
                        good = self.compatible(out[-1], token)
                if good:
                    out.append(token)
                    if end == size:
                        return out
                    at, token = end, longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                at -= len(tokens[out[-1]])
                token = shorter[out.pop()]

    def encoded(self, part: str) -> bytes:
        """Ids of a chunk or pre-token that the newer memo does not hold."""
        ids = self.older.get(part)
        if ids is None:
            body = part[1:] if part[:1] == " " else part
            plain = part.isascii() or max(part) < "\u0250"  # here isalpha() is exactly \p{L}
            if plain and body.isalpha():
                ids = np.array(self.encode_piece(part.encode()), "<u4").tobytes()
            elif plain and body[:-1].isalpha() and body[-1] in ",.;:!?":
                return self.known(part[:-1]) + self.known(part[-1])
            else:
                pieces = self.split(part)
                if len(pieces) != 1:
                    return b"".join([self.known(p) for p in pieces])
                ids = np.array(self.encode_piece(part.encode()), "<u4").tobytes()
        if len(part) <= 64:
            self.memo[part] = ids
        return ids

    def known(self, part: str) -> bytes:
        ids = self.memo.get(part)
        return self.encoded(part) if ids is None else ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        get, encoded = self.memo.get, self.encoded
        out = b"".join([get(p) or encoded(p) for p in chunks(text)])
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        if len(self.fits) > 4 * MEMO:
            self.fits.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Encode whole texts and decode the ids again.

    One row per document row: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers in
    a binary value; left out unless ``with_ids``), ``ids_sha256, decoded_sha256`` and ``lossless``
    (the decoded bytes are the text's bytes).

    ``path`` names a file of ranks that every executor can read; ``pattern`` splits the text into
    pre-tokens. Null texts are encoded as empty ones: no ids and the digests of nothing. Repeated
    rows are encoded one by one. A pre-token of any length takes linear time. Only the named
    columns are read.
    """
    source = texts(docs, id_col, text_col)
    ids = [T.StructField("ids", T.BinaryType())] if with_ids else []
    fields = [
        T.StructField("doc_id", source.schema["doc_id"].dataType),
        T.StructField("n_tokens", T.LongType()),
        *ids,
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("lossless", T.BooleanType()),
    ]

    def work(slices):
        vocabulary = Vocabulary.load(path, pattern)
        for s in slices:
            out = {f.name: [] for f in fields} | {"doc_id": s["doc_id"]}
            for text in s["text"]:
                made = vocabulary.encode((text or b"").decode("utf-8", "replace"))
                back = vocabulary.decode(made)
                out["n_tokens"].append(len(made) // 4)
                if with_ids:
                    out["ids"].append(made)
                out["ids_sha256"].append(hashlib.sha256(made).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                out["lossless"].append(back == (text or b""))
            yield out

    return map_rows(source, fields, work)


def decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``(doc_id, text)`` of encoded ids; null ids give a null text. Bytes that are no UTF-8 become
    replacement characters, as a text column can't hold them."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[ids_col].alias("ids"))
    fields = [
        T.StructField("doc_id", source.schema["doc_id"].dataType),
        T.StructField("text", T.StringType()),
    ]

    def work(slices):
        vocabulary = Vocabulary.load(path, pattern)
        for s in slices:
            yield {
                "doc_id": s["doc_id"],
                "text": [
                    None if i is None else vocabulary.decode(i).decode("utf-8", "replace")
                    for i in s["ids"]
                ],
            }

    return map_rows(source, fields, work)


def digest(encoded: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("lossless"))
