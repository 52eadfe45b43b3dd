"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every block of a file (up to WINDOW neighbouring lines, and each paragraph) is compared with the
templates by the cosine of TF-IDF vectors over words and bigrams; a file declares the template of its
best block, if that reaches the threshold. Document frequencies are counted over all files.
A licence file (its name says so, or its blocks are mostly licence text) declares for its directory;
a file that declares nothing inherits from its nearest ancestor directory that does.

A block can only reach the threshold if it holds one of a template's heaviest terms: the others
together are too light. Only blocks of lines with such a term are scored, which changes no result.

Defined results: a null text counts as empty and declares nothing; very long texts are read whole; a
null path has no directory and inherits nothing; of equal scores the template first in order wins; a
licence that another one contains gives way to it; several licence files of a directory give the one
with the best score, then the first path; repeated rows stay; an empty table gives an empty one;
columns of the result's names are replaced, other columns stay, but for text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, stored

# Licence identifiers, and the notices and sentences by which files declare them.
NOTICES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)
#: Every licence can be declared by its identifier, too.
TEMPLATES = NOTICES + tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in NOTICES) if name != "Proprietary")
CONTAINED = {"BSD-2-Clause": "BSD-3-Clause", "Proprietary": None}  # what gives way to the licence that contains it, or to any other
WINDOW = 5  # lines of a block that isn't a paragraph
SALT = 16  # parts in which the files of a directory are dealt out
THRESHOLD = 0.6
_WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice)(\.[a-z]+)?$"


def terms(text: str) -> list[str]:
    """Words and bigrams of a lower-case text."""
    found = _WORD.findall(text)
    return found + [f"{a} {b}" for a, b in zip(found, found[1:])]


class Matcher:
    """Templates as unit TF-IDF vectors, for given document frequencies."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[str, int], files: int, threshold: float) -> None:
        self.names, self.threshold = [name for name, _ in templates], threshold
        counts = [Counter(terms(text.lower())) for _, text in templates]
        self.idf = {t: math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for c in counts for t in c}
        self.vectors = [self._unit(c) for c in counts]
        anchors: set[str] = set()
        for v in self.vectors:  # without these terms a template can't be reached
            light = 0.0
            for term, weight in sorted(v.items(), key=lambda x: (x[1], x[0])):
                light += weight * weight
                if light >= threshold * threshold * 0.999:
                    anchors.add(term)
        # A bigram whose words are both anchors, or one of them, adds nothing to the search.
        single = {a for a in anchors if " " not in a}
        search = single | {a for a in anchors if not single.intersection(a.split())}
        patterns = [r"[^a-z0-9]+".join(map(re.escape, a.split())) for a in sorted(search)]
        self.anchor = re.compile(r"\b(?:" + "|".join(patterns) + r")\b")
        self.inverted: dict[str, list[tuple[int, float]]] = {}
        for k, v in enumerate(self.vectors):
            for term, weight in v.items():
                self.inverted.setdefault(term, []).append((k, weight))

    def _unit(self, counts: Counter) -> dict[str, float]:
        raw = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {t: x / norm for t, x in raw.items()}

    def scores(self, text: str) -> list[float]:
        """The cosine of a block with each template. Terms that no template has count like the rarest one."""
        counts = Counter(terms(text))
        strange = max(self.idf.values(), default=1.0)
        norm, dots = 0.0, [0.0] * len(self.names)
        for term, n in counts.items():
            x = n * self.idf.get(term, strange)
            norm += x * x
            for k, weight in self.inverted.get(term, ()):
                dots[k] += x * weight
        return [d / math.sqrt(norm) for d in dots] if norm else dots

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Line ranges of the blocks that hold an anchor: windows within a paragraph, and paragraphs."""
        lines = text.split("\n")
        ends = [0]
        for line in lines:
            ends.append(ends[-1] + len(line) + 1)
        found, first = set(), 0
        full = [bool(x.strip()) for x in lines]
        for m in self.anchor.finditer(text):
            a, z = bisect_right(ends, m.start()) - 1, bisect_right(ends, m.end() - 1) - 1
            for i in range(max(0, z - WINDOW + 1), a + 1):
                for j in range(z, min(len(lines), i + WINDOW)):
                    if all(full[i : j + 1]):
                        found.add((i, j + 1))
            if a >= first and all(full[a : z + 1]):
                i, j = a, z
                while i and full[i - 1]:
                    i -= 1
                while j + 1 < len(lines) and full[j + 1]:
                    j += 1
                found.add((i, j + 1))
                first = j + 1
        return sorted(found)

    def match(self, text: str) -> tuple[str | None, float, float]:
        """Name and score of the best template, and the share of the text's lines in blocks that reach one."""
        if not self.anchor.search(lowered := text.lower()):
            return None, 0.0, 0.0
        lines = lowered.split("\n")
        best: dict[str, tuple[float, int]] = {}
        reached: list[tuple[int, int]] = []
        for i, j in self.blocks(lowered):
            scores = self.scores(" ".join(lines[i:j]))
            k = max(range(len(scores)), key=lambda k: (scores[k], -k))
            if scores[k] >= self.threshold:
                reached.append((i, j))
                best[self.names[k]] = max(best.get(self.names[k], (0.0, 0)), (scores[k], -k))
        if not best:
            return None, 0.0, 0.0
        own: set[int] = set()
        for i, j in sorted(reached, key=lambda b: b[1] - b[0]):  # a block within another one is what counts
            if own.isdisjoint(range(i, j)):
                own.update(range(i, j))
        free = {name: x for name, x in best.items() if name not in CONTAINED or not (best.keys() & {CONTAINED[name]} if CONTAINED[name] else best.keys() - CONTAINED.keys())}
        name = max(free, key=lambda n: free[n])
        return name, free[name][0], sum(len(lines[k].strip()) for k in own) / max(1, sum(len(x.strip()) for x in lines))


def _frequencies(files: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """In how many files each template term occurs, over all files; one row a term comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        singles = {t for t in vocabulary if " " not in t}
        couples = {tuple(t.split(" ")): t for t in vocabulary - singles}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts[""] += 1
                if text:
                    found = _WORD.findall(text.lower())
                    counts.update(singles.intersection(found))
                    counts.update(couples[pair] for pair in couples.keys() & set(zip(found, found[1:])))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

    rows = map_arrow(files.select("text"), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found, found.pop("", 0)


def declared(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Add own_licence (null if none), its score (else 0) and licence_share to files (path, text, ...); text goes."""
    vocabulary = {t for _, text in templates for t in terms(text.lower())}
    frequency, n = _frequencies(files, vocabulary)
    kept = [c for c in files.columns if c not in ("text", "own_licence", "score", "licence_share")]
    schema = files.select(*kept).withColumns({"own_licence": F.lit(None).cast("string"), "score": F.lit(0.0), "licence_share": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, frequency, n, threshold)
        for batch in pieces(batches, "text"):
            names, scores, shares = zip(*(matcher.match(x or "") for x in batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=[*kept, "own_licence", "score", "licence_share"])

    return map_arrow(files.select(*kept, "text"), run, schema)


def scan(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licence of every file: files' columns without text, own_licence, score, licence, licence_from.

    licence_from is the path of the file that declares the licence: its own, that of a licence file
    in its nearest ancestor directory, or null.
    """
    found = declared(files, templates, threshold)
    rest = [c for c in found.columns if c not in ("own_licence", "score", "licence_share", "licence", "licence_from")]
    own = stored(found.select(F.struct(*rest).alias("file"), "path", "own_licence", "score", "licence_share"), "declared")
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    standing = own.where("own_licence is not null and path is not null").where(F.rlike("path", F.lit(_FILE)) | (F.col("licence_share") >= 0.8))
    first = standing.withColumn("dir", directory).groupBy("dir").agg(F.max("score").alias("score"))
    holders = standing.withColumn("dir", directory).join(first, ["dir", "score"]).groupBy("dir").agg(F.min(F.struct("path", "own_licence")).alias("best"))
    # Each directory is looked up once, whatever number of files it holds.
    dirs = own.where("own_licence is null and path is not null").select(directory.alias("dir")).distinct()
    parts = F.split("dir", "/", -1)
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))).alias("a")).select("dir", "a.depth", "a.up")
    met = ancestors.join(holders.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "best"))["best"].alias("best"))
    # A directory may hold a third of all files: they are dealt out, and what it inherits is repeated.
    salt = F.pmod(F.xxhash64("path"), F.lit(SALT)).alias("salt")
    needy = own.select("*", F.when(F.col("own_licence").isNull() & F.col("path").isNotNull(), directory).alias("dir"), salt)
    everywhere = met.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    out = needy.join(everywhere, ["dir", "salt"], "left")
    return out.select(
        "file.*",
        "own_licence",
        "score",
        F.coalesce("own_licence", F.col("best")["own_licence"]).alias("licence"),
        F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("best")["path"]).alias("licence_from"),
    )
