"""Token counts of documents without their ids: pieces are counted once per distinct pre-token."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.llm.bpe import chunks
from casetrail.llm.common import dictionary_sums, hot_terms, map_rows, saved, texts

# Distinct pre-tokens that a task may count before it hands the counts on.
FLUSH = 300_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        return Tokenizer.from_str(file.read())


def _specials(path: str) -> list[str]:
    added = tokenizer(path).get_added_tokens_decoder().values()
    return sorted((a.content for a in added), key=len, reverse=True)


class Splitter:
    """Pre-tokens of a text, through a memo of chunks. Special strings are terms of their own."""

    def __init__(self, path: str, pattern: str):
        self.findall = regex.compile(pattern).findall
        specials = _specials(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.specials = specials

    def parts(self, text: str) -> Counter:
        """Frequencies of chunks."""
        if self.special is None or not any(s in text for s in self.specials):
            return Counter(chunks(text))
        out: Counter = Counter()
        for number, part in enumerate(self.special.split(text)):
            out.update([part] if number % 2 else chunks(part))
        return out

    def pieces(self, chunk: str) -> list[str]:
        if chunk in self.specials:
            return [chunk]
        body = chunk[1:] if chunk[:1] == " " else chunk
        plain = chunk.isascii() or max(chunk) < "ɐ"  # here isalpha() is exactly \p{L}
        if plain and body.isalpha():
            return [chunk]
        if plain and body[:-1].isalpha() and body[-1] in ",.;:!?":
            return [chunk[:-1], chunk[-1]]
        return self.findall(chunk)


def _frequencies(source: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(term, n)``: distinct pre-tokens of all texts, counted in each task first."""

    def emit(splitter, seen):
        pieces: Counter = Counter()
        for chunk, n in seen.items():
            for p in splitter.pieces(chunk):
                pieces[p] += n
        return {"term": list(pieces), "n": list(pieces.values())}

    def work(slices):
        splitter, seen = Splitter(path, pattern), Counter()
        for s in slices:
            for text in s["text"]:
                seen.update(splitter.parts((text or b"").decode("utf-8", "replace")))
                if len(seen) > FLUSH:
                    yield emit(splitter, seen)
                    seen.clear()
        yield emit(splitter, seen)

    fields = [T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
    per_task = map_rows(source.select("text"), fields, work)
    return per_task.groupBy("term").agg(F.sum("n").alias("n"))


def _counted(terms: DataFrame, path: str) -> DataFrame:
    """Add ``pieces``, the number of tokens of each distinct pre-token."""

    def work(slices):
        model = tokenizer(path)
        for s in slices:
            made = model.encode_batch_fast(s["term"], add_special_tokens=False)
            yield s | {"pieces": [len(m) for m in made]}

    fields = [
        T.StructField("term", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("pieces", T.LongType()),
    ]
    return map_rows(terms.select("term", "n"), fields, work)


def count_tokens(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    hot: int = 300_000,
    longest: int = 64,
) -> DataFrame:
    """Tokens of whole texts as the ``tokenizers`` library counts them, without added tokens.

    One row per document row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit``).

    Each distinct pre-token of the corpus is tokenised once. The counts of the ``hot`` commonest
    ones, of at most ``longest`` characters each, are sent to all tasks (a fixed bound); the rest
    are joined to the documents' frequencies by a shuffle, so no key is hot.

    ``path`` names a byte-level BPE file that every executor can read and ``pattern`` its split of
    texts. Strings of special tokens count as one token. Null texts count as empty: no bytes, no
    tokens. Repeated rows are counted one by one. Only the named columns are read.
    """
    spark = docs.sparkSession
    source = texts(docs, id_col, text_col)
    counted = saved(_counted(_frequencies(source, path, pattern), path))
    common = hot_terms(counted, hot, longest)
    sent = spark.sparkContext.broadcast({r["term"]: r["pieces"] for r in common})

    def work(slices):
        splitter, known = Splitter(path, pattern), sent.value
        memo: dict = {}  # chunk -> (tokens of common pieces, the other pieces)

        def resolve(chunk):
            tokens, rest = 0, []
            for p in splitter.pieces(chunk):
                n = known.get(p)
                if n is None:
                    rest.append(p)
                else:
                    tokens += n
            return tokens, rest

        for s in slices:
            out = {f.name: [] for f in fields}
            for doc, row, text in zip(s["doc_id"], s["row"], s["text"]):
                total, cold = 0, Counter()
                for chunk, n in splitter.parts((text or b"").decode("utf-8", "replace")).items():
                    tokens = known.get(chunk)
                    if tokens is None:
                        held = memo.get(chunk)
                        if held is None:
                            held = resolve(chunk)
                            if not held[1]:
                                memo[chunk] = held
                        tokens, rest = held
                        for p in rest:
                            cold[p] += n
                    total += tokens * n
                # Digits never follow a control character in one pre-token: this matches nothing.
                terms = list(cold) or [f"\x00{row}"]
                out["doc_id"] += [doc] * len(terms)
                out["row"] += [row] * len(terms)
                out["n_bytes"] += [len(text or b"")] * len(terms)
                out["plus"] += [total] + [0] * (len(terms) - 1)
                out["term"] += terms
                out["freq"] += list(cold.values()) or [0]
            if len(memo) > FLUSH:
                memo.clear()
            yield out

    fields = [
        T.StructField("doc_id", source.schema["doc_id"].dataType),
        T.StructField("row", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("plus", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("freq", T.LongType()),
    ]
    stream = map_rows(source.withColumn("row", F.monotonically_increasing_id()), fields, work)
    tokens = F.col("plus") + F.col("freq") * F.coalesce(F.col("pieces"), F.lit(0))
    summed = dictionary_sums(
        stream, counted, ["row", "doc_id", "n_bytes"], {"n_tokens": tokens}, "pieces"
    )
    return summed.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
