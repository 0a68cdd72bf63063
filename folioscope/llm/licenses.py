"""Operator 2, licence scans: sparse TF-IDF cosine to templates, then inheritance from directories.

1. Document frequencies of the templates' words are counted over all files (one small row per word).
2. Every line and every sentence of every whole file (sentences run on over line ends, as in wrapped
   headers), and the whole text of licence files, is compared with the templates: cosine of TF-IDF
   vectors, where words that no template has weigh as much as a word that no file has, each a dimension
   of its own. A file's own licence is that of its best line or sentence, from LEAST upwards. One that
   has none of a template's weighty words cannot reach LEAST (the rest of the template's weight is too
   small, by Cauchy's inequality), and is passed over.
3. A licence file speaks for its directory. Each directory takes the licence of its nearest ancestor
   (itself first) by joining its ancestors' paths; files without an own licence take their directory's.

Defined results: null paths have no directory and inherit nothing; null texts have no licence; of
licence files in one directory the best score counts, then the least path; ties between templates (to
nine digits) go by name; repeated rows are scanned one by one; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialise, slices

LEAST = 0.6
#: Directories with a licence that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
# How files of each licence name it.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
_LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"
_WORD = re.compile(r"[a-z0-9]+")
#: Between sentences: an end mark and white space, or a blank line.
SENTENCE_END = r"[.!?][\t\n\f\r ]+|\n[\t\f\r ]*\n"
_SENTENCE_END = re.compile(SENTENCE_END)


class TemplateIndex:
    """Unit TF-IDF vectors of the templates, and the words that a similar line must share."""

    def __init__(self, n_files: int, frequencies: dict[str, int], templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST):
        idf = lambda w: math.log((1 + n_files) / (1 + frequencies.get(w, 0))) + 1
        self.least, self.other = least, math.log(1 + n_files) + 1
        counts = [(name, Counter(_WORD.findall(t.lower()))) for name, ts in sorted(templates.items()) for t in ts]
        self.idf = {w: idf(w) for _, c in counts for w in c}
        self.templates = []
        self.triggers: set[str] = set()
        for name, c in counts:
            v = {w: n * self.idf[w] for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            self.templates.append((name, v))
            rest = 1.0
            for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
                if rest < (least * 0.999) ** 2:
                    break
                self.triggers.add(w)
                rest -= x * x

    def best(self, text: str) -> tuple[float, str | None]:
        """Highest cosine of the text to a template, and the template's name (none under the limit)."""
        own = Counter(_WORD.findall(text.lower()))
        if self.triggers.isdisjoint(own):
            return 0.0, None
        unknown = sum(n * n for w, n in own.items() if w not in self.idf)
        v = {w: n * self.idf[w] for w, n in own.items() if w in self.idf}
        norm = math.sqrt(sum(x * x for x in v.values()) + unknown * self.other**2)
        score, name = 0.0, None
        for label, t in self.templates:
            dot = sum(x * t[w] for w, x in v.items() if w in t) / norm
            if dot > score + 1e-12:
                score, name = dot, label
        return (score, name) if score >= self.least else (0.0, None)

    def scan(self, text: str | None, whole: bool) -> tuple[float, str | None]:
        if not text or self.triggers.isdisjoint(_WORD.findall(text.lower())):
            return 0.0, None
        parts = {*text.split("\n"), *_SENTENCE_END.split(text), *([text] if whole else [])}
        found = [self.best(part) for part in parts]
        return min(found, key=lambda x: (-round(x[0], 9), x[1] or "", -x[0]), default=(0.0, None))


def frequencies(files: DataFrame, text_col: str, templates: dict[str, list[str]] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """How many files there are, and how many have each word of the templates: all files are read."""
    vocab = sorted({w for ts in templates.values() for t in ts for w in _WORD.findall(t.lower())})

    def count(batches):
        total, n, known = Counter(), 0, frozenset(vocab)
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                n += 1
                total.update(known.intersection(_WORD.findall((text or "").lower())))
        rows = [("", n), *sorted(total.items())]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in rows]), "n": pa.array([c for _, c in rows], pa.int64())})

    got = files.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    sums = {r.word: r.n for r in got.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sums.pop("", 0), sums


def own_licenses(files: DataFrame, *, id_col: str, path_col: str, text_col: str, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, path, dir, is_license_file, own_license, own_score."""
    sent = files.sparkSession.sparkContext.broadcast(TemplateIndex(*frequencies(files, text_col, templates), templates, least))
    path = F.col(path_col).cast("string")
    name = F.element_at(F.split(path, "/"), -1)
    src = files.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "").alias("dir"), F.coalesce(name.rlike(_LICENSE_FILE), F.lit(False)).alias("is_license_file"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        index = sent.value
        for b in slices(batches):
            found = [index.scan(t, w) for t, w in zip(b.column("text").to_pylist(), b.column("is_license_file").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "path", "dir", "is_license_file")), pa.array([n for _, n in found], pa.string()), pa.array(np.array([s for s, _ in found], float))], names=["doc_id", "path", "dir", "is_license_file", "own_license", "own_score"])

    return src.mapInArrow(scan, "doc_id long, path string, dir string, is_license_file boolean, own_license string, own_score double")


def licenses(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, path, own_license, own_score, license (own or inherited), inherited_from (directory)."""
    own = materialise(own_licenses(files, id_col=id_col, path_col=path_col, text_col=text_col, templates=templates, least=least), "own-licenses")
    rank = F.struct(-F.col("own_score"), F.col("path"), F.col("own_license").alias("license"))
    stated = own.filter("is_license_file AND own_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(rank)["license"].alias("license"))
    stated = materialise(stated, "licensed-dirs")
    sent = F.broadcast if stated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ancestors = own.filter("dir IS NOT NULL").select("dir").distinct().select("dir", F.posexplode(F.array_distinct(ups)).alias("depth", "above"))
    near = ancestors.join(sent(stated.withColumnRenamed("dir", "above")), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "license")).alias("m"))
    near = near.select("dir", F.col("m.above").alias("above"), F.col("m.license").alias("from_dir"))
    out = own.filter("dir IS NOT NULL").join(near, "dir", "left")
    nowhere = own.filter("dir IS NULL").withColumns({"above": F.lit(None).cast("string"), "from_dir": F.lit(None).cast("string")})
    return out.unionByName(nowhere).select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "from_dir").alias("license"), F.when(F.col("own_license").isNull(), F.col("above")).alias("inherited_from"))
