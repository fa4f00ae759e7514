"""Small inputs and plain versions of the operators."""

import random
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0D]+")
ALPHABET = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()
# Columns whose names the operators use themselves.
CLASHING = "row int, term string, freq int, n int, host string, class string, score string, token int"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def documents(seed=3, many=60):
    """Texts with nulls, empty and long ones, copies, near copies and a repeated row."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "One", "two words", "%%% ***", "a b c d é ü 字"]
    base = [rng.choice(ALPHABET) + str(rng.randint(0, 30)) for _ in range(120)]
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = "changed" + str(rng.randint(0, 9))
        texts.append(" ".join(near))
    texts += [" ".join(base), " ".join(base).upper(), "  ".join(base) + "\n"]
    texts.append("\n".join(" ".join(rng.choice(ALPHABET) for _ in range(9)) for _ in range(900)))
    texts.append("x" * 30_000)
    while len(texts) < many:
        lines = [" ".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(lines))
    rows = [(100 + k, t) for k, t in enumerate(texts)]
    return rows + [rows[-1], (None, "no id here at all"), (None, None)]


def frame(spark, rows, more=CLASHING):
    """``doc_id, text`` with clashing extra columns."""
    extra = len(more.split(","))
    return spark.createDataFrame([(*r, *[None] * extra) for r in rows], f"doc_id long, text string, {more}")


def fold(doc_id, folds):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def collected(df):
    """Rows in a fixed order, as dicts."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))
