"""Exact Jaccard self-join of word shingles through a token-group matrix.

Documents with equal shingle sets are one class. Classes that share rare shingles are compared with
the first class of each list; those that are similar form groups. The token-group matrix has a row
for each shingle and block of a group, taken from the union of its members. A class of another
group opens a block only if the block's union holds enough of its shingles, and is compared with
its members one by one.

Which shingles are looked at follows from the prefix principle: two sets with Jaccard similarity of
at least t share one of the first n - ceil(t n) + 1 of their n elements in any order common to all.
The order puts rare shingles first, so that passages which many documents hold make no candidates
unless a document consists of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.llm.common import map_rows, saved, texts

WIDTH = 5
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93]
# Shingles whose hash lies below this share of all hashes are counted over the corpus, which gives
# the order; it must be well above the share of a prefix (1 - t).
COUNTED = int(0.3 * 2**64)
BLOCK = 128  # members of a block, on average
ASKING = 4096  # classes that ask for a block in one task, on average
BUCKETS = 1 << 22  # of the fixed-size filter on rows whose text is needed again


class Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of all five-word shingles; fewer words are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, "u8")
    each = np.fromiter(map(hashes.__getitem__, words), "u8", len(words))
    many = max(1, len(words) - WIDTH + 1)
    out = np.full(many, min(len(words), WIDTH), "u8")
    for k, factor in zip(range(min(len(words), WIDTH)), FACTORS):
        out += each[k : k + many] * np.uint64(factor)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(size, percent: int):
    """Shingles that a set must share with any similar one."""
    return -(-size * percent // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


LONG, INT = T.LongType(), T.IntegerType()


def _profiles(source: DataFrame) -> DataFrame:
    """``(doc_id, row, n, class)``; ``row`` is a hash of text and id."""

    def work(slices):
        hashes = Hashes()
        for s in slices:
            sets = [shingles(t, hashes) for t in s["text"]]
            yield {
                "doc_id": s["doc_id"],
                "row": s["row"],
                "n": [len(x) for x in sets],
                "class": [class_of(x) for x in sets],
            }

    fields = [source.schema["doc_id"], *[T.StructField(n, LONG) for n in ("row", "n", "class")]]
    return map_rows(source, fields, work)


def _rare_first(source: DataFrame, percent: int) -> DataFrame:
    """``(token, class, n, rest, alone)``: each class's prefix, as far as other classes hold the
    shingle. ``rest`` is how many of its shingles come later in the order, ``alone`` how many of
    those counted no other class has.

    A class emits all its counted shingles, and later ones only as far as they may fill its prefix
    up. So that no other class emits a late shingle says nothing, and its place in the class's
    sorted list is its rank: all counted shingles come before it, and hashes order the late ones.

    Each task gives a class once; copies in other tasks repeat its rows, which changes counts but
    not what is found, as every row of a shingle sees the same count.
    """

    def work(slices):
        hashes, seen = Hashes(), set()
        for s in slices:
            out: list = []
            for text in s["text"]:
                tokens = shingles(text, hashes)
                own = class_of(tokens)
                if len(tokens) and own not in seen:
                    seen.add(own)
                    prefix = len(tokens) - needed(len(tokens), percent) + 1
                    counted = int(np.searchsorted(tokens, np.uint64(COUNTED)))
                    many = max(counted, prefix)
                    out.append((tokens[:many].astype("i8"), own, len(tokens), counted))
            if out:
                sizes = [len(t) for t, *_ in out]
                spread = [np.repeat([x[k] for x in out], sizes) for k in (1, 2, 3)]
                at = np.concatenate([np.arange(1, many + 1) for many in sizes])
                yield dict(zip(names, [np.concatenate([t for t, *_ in out]), *spread, at]))

    # ``m``: counted shingles of the class; ``at``: place of the shingle in its sorted list.
    names = ("token", "class", "n", "m", "at")
    fields = [*[T.StructField(n, LONG) for n in names[:2]], *[T.StructField(n, INT) for n in names[2:]]]
    rows = map_rows(source.select("text"), fields, work)
    same = Window.partitionBy("token")
    held = (
        rows.withColumns(
            {
                "df": F.count("*").over(same),
                "low": F.min("class").over(same),
                "high": F.max("class").over(same),
            }
        )
        .filter("low <> high")
        .groupBy("class", "token")
        .agg(*[F.first(c).alias(c) for c in ("n", "m", "at", "df")])
    )
    # Counted shingles of one class only come first in the order; they fill the prefix up.
    late = F.col("at") > F.col("m")
    order = Window.partitionBy("class").orderBy(late, F.when(~late, F.col("df")), "token")
    size = F.col("n").cast("long")
    prefix = size - F.ceil(size * percent / 100) + 1
    ranked = held.withColumns(
        {
            "alone": F.col("m") - F.count(F.when(~late, 1)).over(Window.partitionBy("class")),
            "place": F.row_number().over(order),
        }
    )
    rank = F.when(late, F.col("at")).otherwise(F.col("alone") + F.col("place")).cast("long")
    return ranked.filter(rank <= prefix).select(
        "token", "class", size.alias("n"), (size - rank).alias("rest"), F.col("alone").cast("long").alias("alone")
    )


def _comparable(a, b, percent: int):
    """Sizes that allow the similarity."""
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _reachable(rest_a, rest_b, size_a, size_b, percent: int):
    """Whether two sets can be similar if this shingle is the first that they share: it and what
    comes later in both must make up the intersection that the similarity needs. A similar pair
    passes at its first common shingle, so the test may be made at each shingle by itself."""
    return (100 + percent) * (F.least(rest_a, rest_b) + 1) >= percent * (size_a + size_b)


class Lookup:
    """Texts of chosen classes, read again from the documents."""

    def __init__(self, source: DataFrame, classes: DataFrame):
        self.source, self.classes = source, classes

    def of(self, wanted: DataFrame) -> DataFrame:
        """``(class, text)`` of the classes in ``wanted``. A bitmap of fixed size on the hash of
        the row spares most other texts the shuffle; the join that follows is exact."""
        rows = saved(self.classes.join(wanted.select("class").distinct(), "class").select("class", "row"))
        marks = rows.select(F.pmod("row", F.lit(BUCKETS)).cast("int").alias("b")).distinct().toArrow()
        bitmap = np.zeros(BUCKETS, bool)
        bitmap[marks["b"].to_numpy()] = True
        sent = self.source.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

        def work(slices):
            held, seen = np.unpackbits(sent.value), set()
            for s in slices:
                passing = np.flatnonzero(held[np.mod(np.array(s["row"], "i8"), BUCKETS)]).tolist()
                keep = {s["row"][k]: k for k in passing if s["row"][k] not in seen}
                seen.update(keep)
                if keep:
                    yield {n: [s[n][k] for k in keep.values()] for n in ("row", "text")}

        fields = [T.StructField("row", LONG), T.StructField("text", T.BinaryType())]
        passed = map_rows(self.source.select("row", "text"), fields, work)
        return passed.join(rows, "row").select("class", "text")


def _verify(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar."""
    left = held.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = held.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def work(slices):
        hashes, last, tokens = Hashes(), None, None
        for s in slices:
            out = {"a": [], "b": []}
            for a, b, one, two in zip(s["a"], s["b"], s["text_a"], s["text_b"]):
                if b != last:
                    last, tokens = b, shingles(two, hashes)
                if similar(shingles(one, hashes), tokens, percent):
                    out["a"].append(a)
                    out["b"].append(b)
            yield out

    return map_rows(both, [T.StructField("a", LONG), T.StructField("b", LONG)], work)


class Block:
    """Members of a block as one sorted list of shingles with their owners."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.classes = [c for c, _, _ in members]
        self.roots = [r for _, r, _ in members]
        self.sizes = np.array([len(t) for *_, t in members])
        tokens = np.concatenate([t for *_, t in members])
        order = np.argsort(tokens, kind="stable")
        self.tokens = tokens[order]
        self.owners = np.repeat(np.arange(len(members)), self.sizes)[order]

    def similar(self, tokens: np.ndarray, percent: int) -> list[int]:
        """Members similar to a set; nobody is looked at if the union holds too few of it."""
        low = np.searchsorted(self.tokens, tokens, "left")
        many = np.searchsorted(self.tokens, tokens, "right") - low
        if np.count_nonzero(many) < needed(len(tokens), percent):
            return []
        # The places of all equal shingles: each run from its first place on.
        steps = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        both = np.bincount(self.owners[np.repeat(low, many) + steps], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (len(tokens) + self.sizes - both)).tolist()


def _open_blocks(pairs: DataFrame, members: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """``pairs`` is ``(a, root, block)``: compare class ``a`` with the members of blocks whose union
    holds enough of its shingles; ``members`` is ``(class, root, block)``.

    The members of a block, whose number is bounded, come first in their partition and the classes
    that ask stream past them. A block that very many ask for is dealt to several tasks.
    """
    asked = pairs.groupBy("block").agg(F.ceil(F.count("*") / ASKING).alias("parts"))
    columns = ["block", "part", "asks", "class", "root", "text"]
    inside = (
        members.join(asked, "block")
        .join(held, "class")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("asks", F.lit(False))
    )
    asking = (
        pairs.withColumnRenamed("a", "class")
        .join(asked, "block")
        .join(held, "class")
        .withColumn("part", F.pmod(F.xxhash64("class"), "parts"))
        .withColumn("asks", F.lit(True))
    )
    stream = (
        inside.select(*columns)
        .union(asking.select(*columns))
        .repartition("block", "part")
        .sortWithinPartitions("block", "part", "asks")
    )

    def work(slices):
        hashes, last, members, block = Hashes(), None, {}, None
        parent: dict[int, int] = {}

        def top(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for s in slices:
            out = {"a": [], "b": []}
            for name, part, asks, own, root, text in zip(*(s[n] for n in columns)):
                if (name, part) != last:
                    last, members, block = (name, part), {}, None
                tokens = shingles(text, hashes)
                if not asks:
                    members[own] = (own, root, tokens)
                    continue
                block = block or Block(list(members.values()))
                for k in block.similar(tokens, percent):
                    # Roots name classes: what this task has found connected needs no second link.
                    mine, its = top(root), top(block.roots[k])
                    if mine != its:
                        parent[mine] = its
                        out["a"].append(own)
                        out["b"].append(block.classes[k])
            yield out

    return map_rows(stream, [T.StructField("a", LONG), T.StructField("b", LONG)], work)


def components(edges: DataFrame) -> DataFrame:
    """``(class, root)`` for all ends of ``(a, b)`` edges: the smallest label reaches every node, by
    taking the least of the neighbours' labels and then the label's own label."""
    both = saved(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    )
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    labels = saved(labels.select(F.col("a").alias("class"), "root"))
    while True:
        near = both.join(labels.select(F.col("class").alias("b"), "root"), "b")
        least = near.groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(least, labels["class"] == least["a"]).select(
            "class", "root", F.least("root", "near").alias("lower")
        )
        jump = labels.select(F.col("class").alias("lower"), F.col("root").alias("further"))
        fresh = saved(
            step.join(jump, "lower", "left").select(
                "class", F.coalesce("further", "lower").alias("root"), (F.col("root")).alias("old")
            )
        )
        moved = fresh.filter(F.col("root") < F.col("old")).limit(1).count()
        labels = fresh.select("class", "root")
        if not moved:
            return labels


def find_links(source: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` between classes: enough of them to connect whatever is connected
    by similar pairs. ``classes`` is ``(class, row)``."""
    prefixes = saved(_rare_first(source, percent))
    lookup = Lookup(source, classes)
    # Groups: every class against one of each of its lists, the one with the fewest shingles of its
    # own, which is nearest to what the others were copied from.
    first = Window.partitionBy("token")
    pivot = prefixes.withColumn("p", F.min(F.struct("alone", "class", "n", "rest")).over(first))
    stars = (
        pivot.filter(F.col("class") != F.col("p.class"))
        .filter(_comparable(F.col("n"), F.col("p.n"), percent))
        .filter(_reachable(F.col("rest"), F.col("p.rest"), F.col("n"), F.col("p.n"), percent))
        .select(F.col("class").alias("a"), F.col("p.class").alias("b"))
        .distinct()
    )
    stars = saved(stars)
    ends = stars.select(F.col("a").alias("class")).union(stars.select("b"))
    held = lookup.of(ends)
    near = saved(_verify(stars, held, percent))
    groups = components(near)
    # Blocks. Linked classes make a group; the others join the group of the class that they were
    # compared with, in blocks apart, so that most blocks of a group have one root.
    families = pivot.groupBy("class").agg(F.min("p").alias("p")).select("class", F.col("p.class").alias("near"))
    grouped = saved(
        families.join(groups, "class", "left").select(
            "class",
            F.coalesce("root", "class").alias("root"),
            F.xxhash64(F.coalesce("root", "near"), F.col("root").isNotNull()).alias("group"),
        )
    )
    sizes = grouped.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    part = F.pmod(F.xxhash64("class"), F.col("blocks"))
    placed = grouped.join(sizes, "group").select("class", "root", F.xxhash64("group", part).alias("block"))
    rows = saved(prefixes.select("token", "class", "n", "rest").join(placed, "class"))
    # Lists with one root only are done.
    spread = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    open_rows = rows.join(spread.select("token"), "token")
    # The token-group matrix, with what bounds the members of a block at this shingle.
    matrix = open_rows.groupBy("token", F.col("block").alias("other")).agg(
        F.min("root").alias("root_low"),
        F.max("root").alias("root_high"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.max("rest").alias("most"),
    )
    # Each pair of blocks is looked at from one side; a block also looks at itself.
    new = (F.col("root_low") != F.col("root_high")) | (F.col("root_low") != F.col("root"))
    fits = (100 * F.col("n") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("n"))
    reach = _reachable(F.col("rest"), F.col("most"), F.col("n"), F.col("low"), percent)
    asked = saved(
        open_rows.join(matrix, "token")
        .filter((F.col("block") <= F.col("other")) & new & fits & reach)
        .select(F.col("class").alias("a"), "root", F.col("other").alias("block"))
        .distinct()
    )
    members = placed.join(asked.select("block").distinct(), "block")
    ends = asked.select(F.col("a").alias("class")).union(members.select("class"))
    held = lookup.of(ends)
    return near.union(_open_blocks(asked, members, held, percent))


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80
) -> DataFrame:
    """Group documents that are connected by pairs of similar shingle sets.

    One row per document row: ``doc_id, n_shingles, component_id`` (the smallest id that links
    reach, its own included). Two documents link if their sets of five-word shingles have a Jaccard
    similarity of at least ``percent`` percent; words are parted by ASCII white space, A-Z in lower
    case. Fewer than five words are one shingle. The join is exact up to equal 64-bit hashes.

    Null texts and texts without words have no shingles and link with nothing. A null id is never
    the smallest: a document without an id takes the component of its links, or null. Repeated rows
    link with each other and stay as rows. Only the named columns are read.
    """
    own = docs[id_col].cast("string")
    row = F.xxhash64(docs[text_col], F.coalesce(own, F.lit(""))).alias("row")
    source = texts(docs, id_col, text_col, row)
    profiles = saved(_profiles(source))
    worded = profiles.filter("n > 0")
    classes = worded.groupBy("class").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
    labels = components(find_links(source, classes.select("class", "row"), percent))
    rooted = classes.join(labels, "class", "left").select(
        "class", "least", F.coalesce("root", "class").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(smallest, "root").select("class", "component_id")
    linked = worded.join(known, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = profiles.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone)


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
k AS (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS t FROM k),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reached FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""
