"""Licence scans: TF-IDF cosine of text regions to templates, and inheritance from directories."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.llm.common import document_frequencies, map_rows, saved, texts

# Short public notices of common licences, by SPDX identifier. Several notices of one
# licence are templates of their own.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
)

# Regions are lines and the texts between tags, and windows over blocks. Blocks end at block-level
# elements, ends of comments and empty lines (also those with a comment mark only).
REGION = re.compile(rb"\n|<[^<>]*>")
TAG = re.compile(rb"<[^<>]*>")
BLOCK = re.compile(
    rb"(?i)<!--|-->|</?(?:address|article|aside|blockquote|body|caption|dd|div|dl|dt|figcaption|figure|footer|"
    rb"form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|script|section|style|table|tbody|td|"
    rb"textarea|tfoot|th|thead|title|tr|ul)(?:[\s/][^<>]*)?>|(?:\r?\n[^\S\n]*(?:[*#;/%]+|--)?[^\S\n]*)(?=\r?\n)"
)
WORD = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")
SIGNS = b"\"'()[].,;:!?"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|legal|terms)[^/]*$|/(index\.[a-z]+)?$"


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


class Scanner:
    """Unit TF-IDF vectors of the templates as postings by term."""

    def __init__(self, templates, terms: list[bytes], total: int, numbers: np.ndarray):
        idf = np.log((1 + total) / (1 + numbers)) + 1
        self.idf = dict(zip(terms, idf.tolist()))
        self.other = float(np.log((1 + total) / 2) + 1)  # a word that no template has counts as rare
        self.names = [name for name, _ in templates]
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(templates):
            weights = self.weights(words_of(text.encode()))
            norm = sum(w * w for w in weights.values()) ** 0.5
            for term, w in weights.items():
                self.postings.setdefault(term, []).append((k, w / norm))
        # A region must hold one of the words that tell licences from prose: half of each
        # template's squared weight lies in its heaviest terms.
        self.sizes = [len(words_of(text.encode())) for _, text in templates]
        each = [self._anchors(k) for k in range(len(templates))]
        self.anchors = set().union(*each)
        self.anchored: dict[bytes, list[int]] = {}
        for k, held in enumerate(each):
            for term in held:
                self.anchored.setdefault(term, []).append(k)

    def _anchors(self, k: int) -> set[bytes]:
        out: set[bytes] = set()
        own = sorted(((w, t) for t, p in self.postings.items() for j, w in p if j == k), reverse=True)
        covered = 0.0
        for w, term in own:
            out.add(term)
            covered += w * w
            if covered > 0.5:
                break
        return out

    def weights(self, words: list[bytes]) -> dict[bytes, float]:
        return {
            w: (1 + float(np.log(n))) * self.idf.get(w, self.other) for w, n in Counter(words).items()
        }

    def cosines(self, words: list[bytes]) -> dict[int, float]:
        weights = self.weights(words)
        norm = sum(w * w for w in weights.values()) ** 0.5
        sums: dict[int, float] = {}
        for term, w in weights.items():
            for k, p in self.postings.get(term, ()):
                sums[k] = sums.get(k, 0.0) + w * p / norm
        return sums

    def windows(self, text: bytes):
        """``(template, words, region)`` of the windows as long as a template that hold one of its
        anchors. Inline tags and single ends of lines are blanks."""
        start = 0
        for end, after in [*((m.start(), m.end()) for m in BLOCK.finditer(text)), (len(text), 0)]:
            block, start = text[start:end], after
            flat = TAG.sub(lambda m: b" " * len(m[0]), block)
            found = list(WORD.finditer(flat.lower()))
            words = [m[0] for m in found]
            if self.anchors.isdisjoint(words):
                continue
            spots: set[tuple[int, int]] = set()
            for at, word in enumerate(words):
                for k in self.anchored.get(word, ()):
                    last = max(0, len(words) - self.sizes[k])
                    spots.update((low, k) for low in range(max(0, at - self.sizes[k] + 1), min(at, last) + 1))
            for low, k in sorted(spots):
                many = words[low : low + self.sizes[k]]
                first, stop = found[low].start(), found[low + len(many) - 1].end()
                # Signs that touch the first and last word belong to the region.
                first = len(flat[:first].rstrip(SIGNS))
                stop = len(flat) - len(flat[stop:].lstrip(SIGNS))
                yield k, many, block[first:stop]

    def best(self, text: bytes | None, least: float):
        """Licence, cosine and region of the best match of a text, or nothing."""
        found = (None, None, None)
        for region in REGION.split(text or b""):
            words = words_of(region)
            if not words or self.anchors.isdisjoint(words):
                continue
            sums = self.cosines(words)
            # Of equal cosines the earlier template and the earlier region win.
            k = max(sums, key=lambda j: (sums[j], -j), default=None)
            if k is not None and sums[k] >= least and (found[1] is None or sums[k] > found[1] + 1e-12):
                found = (self.names[k], min(1.0, sums[k]), region)
        for k, words, region in self.windows(text or b""):
            cosine = self.cosines(words).get(k, 0.0)
            if cosine >= least and (found[1] is None or cosine > found[1] + 1e-12):
                found = (self.names[k], min(1.0, cosine), region)
        return found


def scan(
    files: DataFrame,
    id_col: str = "path",
    text_col: str = "text",
    least: float = 0.75,
    templates=TEMPLATES,
) -> DataFrame:
    """``(id, license, cosine, region)`` of each file's own licence notice; nulls without one.

    Document frequencies of the templates' words count all files. With ``least`` above
    ``sqrt(0.5)`` no region over it lacks an anchor word, so the anchors drop nothing.
    """
    if not least > 0.5**0.5:
        raise ValueError("least must be above sqrt(0.5)")
    source = texts(files, id_col, text_col)
    terms = sorted({w for _, t in templates for w in words_of(t.encode())})
    total, numbers = document_frequencies(source, terms, words_of)
    fields = [
        source.schema["doc_id"],
        T.StructField("license", T.StringType()),
        T.StructField("cosine", T.DoubleType()),
        T.StructField("region", T.StringType()),
    ]

    def work(slices):
        scanner = Scanner(templates, terms, total, numbers)
        for s in slices:
            found = [scanner.best(t, least) for t in s["text"]]
            yield {
                "doc_id": s["doc_id"],
                "license": [x[0] for x in found],
                "cosine": [x[1] for x in found],
                "region": [None if x[2] is None else x[2].decode("utf-8", "replace") for x in found],
            }

    return map_rows(source, fields, work)


def directory(path):
    """Everything up to the last ``/``, without it; the root is the empty text."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder):
    """The folder, its parent and so on up to the root, as ``(folder, depth)``."""
    parts = F.split(folder, "/")
    deep = F.when(folder == "", 0).otherwise(F.size(parts))
    return F.transform(
        F.sequence(F.lit(0), deep),
        lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("folder"), n.alias("depth")),
    )


def inherit(scanned: DataFrame, licence_file: str = LICENCE_FILE) -> DataFrame:
    """Give files without a notice the licence of the nearest directory above them.

    ``scanned`` is ``(doc_id, path, license, cosine)``. A directory's licence is that of its
    licence files (paths that match ``licence_file``) with the greatest cosine, ties by name. Only
    distinct directories are joined to their ancestors; files then join their own directory.
    """
    files = scanned.withColumn("folder", directory(F.col("path")))
    order = Window.partitionBy("folder").orderBy(F.desc("cosine"), "license")
    held = (
        files.filter(F.col("path").rlike(licence_file) & F.col("license").isNotNull())
        .groupBy("folder", "license")
        .agg(F.max("cosine").alias("cosine"))
        .withColumn("place", F.row_number().over(order))
        .filter("place = 1")
        .select("folder", F.col("license").alias("given"))
    )
    above = files.select("folder").distinct().select(
        F.col("folder").alias("below"), F.explode(ancestors(F.col("folder"))).alias("a")
    )
    near = (
        above.select("below", F.col("a.folder").alias("folder"), F.col("a.depth").alias("depth"))
        .join(held, "folder")
        .groupBy("below")
        .agg(F.max_by(F.struct("given", "folder"), "depth").alias("found"))
        .select(F.col("below").alias("folder"), "found")
    )
    own = F.col("license").isNotNull()
    return files.join(near, "folder", "left").select(
        "doc_id",
        "path",
        F.coalesce("license", "found.given").alias("license"),
        F.col("license").alias("own_license"),
        F.col("cosine").alias("own_cosine"),
        F.when(~own, F.col("found.folder")).alias("inherited_from"),
        F.when(own, "own").when(F.col("found").isNotNull(), "inherited").otherwise("none").alias("origin"),
    )


def scan_licenses(
    files: DataFrame,
    id_col: str,
    path_col: str,
    text_col: str,
    least: float = 0.75,
    licence_file: str = LICENCE_FILE,
    templates=TEMPLATES,
) -> DataFrame:
    """Licences of a tree of files.

    One row per file row: ``doc_id, path, license, own_license, own_cosine, inherited_from`` (the
    directory), ``origin`` (own, inherited or none) and ``region`` (the notice found). A file's own
    notice is the region (line, text between tags, or window of a template's length in words over a
    block of lines) with the greatest cosine to a template, if it reaches ``least``; a file without one inherits from the nearest directory above it that has
    a licence file with a notice.

    Null and empty texts have no notice but inherit; a null path counts as empty and lies in the
    root. Repeated rows are scanned one by one. Only the named columns are read.
    """
    named = files.select(
        F.struct(files[id_col].alias("id"), F.coalesce(files[path_col], F.lit("")).alias("path")).alias("key"),
        files[text_col].alias("text"),
    )
    # Files, folders and licence files all read the scan; it is made once.
    found = saved(scan(named, "key", "text", least, templates))
    flat = found.select(
        F.col("doc_id.id").alias("doc_id"), F.col("doc_id.path").alias("path"), "license", "cosine", "region"
    )
    keyed = inherit(
        flat.select(F.struct("doc_id", "region").alias("doc_id"), "path", "license", "cosine"), licence_file
    )
    return keyed.select(F.col("doc_id.doc_id"), *[c for c in keyed.columns if c != "doc_id"], F.col("doc_id.region"))
