"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

1. Every line of every text that has a cue word is a header, however long it is. A file whose
   name says that it holds a license is one unit as a whole. In all other texts with a cue word, paragraphs joined
   over their line breaks, their sentences, and windows of each template's length around every cue are compared too.
2. Headers become sparse term vectors. A term's weight is log((N + 1) / (df + 1)) + 1 over all N headers of the corpus
   for terms of the templates, and that of df = 0 for all others, so the only statistics that leave the executors are
   the counts of the templates' terms, a fixed vocabulary. Cosines come from one join with the templates' weights.
3. A file is a license file if its name says so, or if its matched headers are a large share of its words. The
   directories of the corpus are expanded to their ancestors and joined with the directories of license files by path;
   the deepest match is what files without a license of their own inherit.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialize, text_of

#: License names (SPDX where there is one) and the headers that declare them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, Creative Commons public domain dedication."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
)
CUE = r"(?i)\b(?:licen[cs]e[ds]?|spdx|copyright|all rights reserved|public domain|creative commons|permission is hereby|redistribution and use|redistribute it|proprietary)\b"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)?"
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.-][^/]*)?$"
THRESHOLD, FILE_SHARE = 0.6, 0.2


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def headers_of(text: Column) -> Column:
    """The lines with a cue, in order, whole."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(CUE))
    return F.when(text.rlike(CUE), lines).otherwise(F.array().cast("array<string>"))


def template_terms(spark: SparkSession, templates) -> DataFrame:
    """template, license, term, tf: a table of fixed size."""
    df = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    return df.select("template", "license", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def header_terms(units: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """Terms of the templates, terms of the units (unit, header), idf of the templates' terms, and that of every other term."""
    spark = units.sparkSession
    of_template = materialize(template_terms(spark, templates), "license-templates")
    vocabulary = of_template.select("term").distinct()
    tf = units.select("unit", F.explode(terms_of(F.col("header"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    tf = materialize(tf, "license-terms")
    known = tf.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))  # a fixed vocabulary
    n = units.count()
    idf = lambda df: F.log(F.lit(n + 1.0) / (df + 1)) + 1
    weights = materialize(vocabulary.join(known, "term", "left").select("term", idf(F.coalesce("df", F.lit(0))).alias("idf")), "license-weights")
    return of_template, tf, weights, F.log(F.lit(n + 1.0)) + 1


def matched_headers(of_template: DataFrame, tf: DataFrame, weights: DataFrame, rest: Column) -> DataFrame:
    """unit, license, cosine (rounded to 9 places): the closest template of each unit that shares a term with one."""
    norms = of_template.join(weights, "term").groupBy("template").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    side = of_template.join(weights, "term").join(norms, "template").select("term", "template", "license", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))
    own = tf.join(F.broadcast(weights), "term", "left").select("unit", "term", (F.col("tf") * F.coalesce("idf", rest)).alias("value"))
    norm = own.groupBy("unit").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = own.join(F.broadcast(side), "term").groupBy("unit", "template", "license").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    best = dots.join(norm, "unit").select("unit", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"), "template")
    return best.groupBy("unit").agg(F.max_by(F.struct("license", "cosine"), F.struct("cosine", -F.col("template"))).alias("b")).select("unit", "b.license", "b.cosine")


class Windows:
    """The best match of a text's paragraphs, sentences and windows around cues.

    A template only counts where at least half of the terms that the fewest licenses use (its name, mostly) are there:
    what is left in a small window is otherwise the wording that all licenses share.
    """

    def __init__(self, templates, idf: dict[str, float], rest: float):
        self.idf, self.rest, self.cue = idf, rest, re.compile(CUE, re.ASCII)
        users = defaultdict(set)
        for name, text in templates:
            for w in re.findall(TERM, text.lower()):
                users[w].add(name)
        self.templates = []
        for name, text in templates:
            words, cues = self.parse(text.lower())
            least = min((len(users[w]) for w in words), default=0)
            vector = self.vector(words)
            self.templates.append((name, vector, self.norm(vector), {w for w in words if len(users[w]) == least}, len(words), cues))

    def parse(self, text: str) -> tuple[list[str], list[int]]:
        """The terms of a text in small letters, and which of them begin a cue."""
        found = list(re.finditer(TERM, text))
        starts = [m.start() for m in found]
        cues = {bisect_right(starts, m.start()) - 1 for m in self.cue.finditer(text)}
        return [m[0] for m in found], sorted(c for c in cues if c >= 0)

    def vector(self, words: list[str]) -> dict[str, float]:
        return {w: n * self.idf.get(w, self.rest) for w, n in Counter(words).items()}

    @staticmethod
    def norm(vector: dict[str, float]) -> float:
        return math.sqrt(sum(x * x for x in vector.values()))

    def best(self, text: str) -> tuple[float, str, int] | None:
        """Less of the cosine, license, number of words between white space."""
        found = None
        for block in re.split(r"\n[^a-z0-9]*\n", text.lower()):
            if not self.cue.search(block):
                continue
            words, cues = self.parse(block)
            there = set(words)
            wanted = [t for t in self.templates if 2 * len(t[3] & there) >= len(t[3])]
            if not wanted:
                continue
            parts = [block] + [x for x in re.split(r"[.;!?]\s", block) if self.cue.search(x)]
            tried = [(self.parse(x)[0], wanted, len(x.split())) for x in parts]
            begins = [m.start() for m in re.finditer(r"\S+", block)]
            of_word = [bisect_right(begins, m.start()) for m in re.finditer(TERM, block)]
            seen = set()
            for t in wanted:
                for i in cues:
                    for p in t[5]:
                        lo, hi = max(0, i - p), min(len(words), i - p + t[4])
                        window = words[lo:hi]
                        mark = (id(t), tuple(window))
                        if mark not in seen:
                            seen.add(mark)
                            tried.append((window, [t], of_word[hi - 1] - of_word[lo] + 1))
            for part, against, n_words in tried:
                vector = self.vector(part)
                norm = self.norm(vector)
                for name, other, size, own, *_ in against:
                    if norm and 2 * len(own & vector.keys()) >= len(own):
                        dot = sum(x * vector[w] for w, x in other.items() if w in vector)
                        match = (-round(dot / (norm * size), 9), name, n_words)
                        found = match if found is None else min(found, match)
        return found


def matched_windows(rows: DataFrame, templates, weights: DataFrame, rest: float) -> DataFrame:
    """row_no, license, cosine, words of the closest template of each row (row_no, body) that names one."""
    idf = {r.term: r.idf for r in weights.collect()}  # the templates' vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(templates, idf, rest)
        for batch in batches:
            found = [(no.as_py(), windows.best(body.as_py())) for no, body in zip(batch.column(0), batch.column(1), strict=True)]
            found = [(no, name, -less, n) for no, b in found if b for less, name, n in [b]]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["row_no", "license", "cosine", "words"])

    return rows.select("row_no", "body").mapInArrow(run, "row_no long, license string, cosine double, words long")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, up to the root "", each with its depth."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("above"), i.alias("depth")))


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """doc_id, path, n_headers, license, cosine, basis (own, inherited, none), licensed_dir of every row of files.

    A null text counts as empty, a null path as "" (a file without a name in the root). A file's own license is that of
    its header, paragraph, sentence or window of largest cosine of at least `threshold` (ties: the license first in the alphabet). Of the license
    files of one directory the one of largest cosine counts (ties: by name of the license). Repeated rows get the same
    result each; an empty table gives none; other columns are ignored.
    """
    spark, text = files.sparkSession, text_of(text_col)
    file = F.coalesce(path, F.lit(""))
    named = file.rlike(FILE_NAME)
    rows = files.select(
        F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(file, "^/+", "").alias("path"), named.alias("named"), F.monotonically_increasing_id().alias("row_no"),
        F.when(text.rlike(CUE) | named, F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))).alias("n_words"), F.when(named, F.array(text)).otherwise(headers_of(text)).alias("headers"),
        F.when(text.rlike(CUE) & ~named, text).alias("body"),
    ).withColumn("dir", F.regexp_replace("path", "/*[^/]*$", ""))
    rows = materialize(rows, "license-rows")
    units = rows.select("row_no", F.posexplode("headers").alias("pos", "header")).select(F.struct("row_no", "pos").alias("unit"), "header")
    units = materialize(units, "license-headers")
    of_template, tf, weights, rest = header_terms(units, templates)
    found = matched_headers(of_template, tf, weights, rest).filter(F.col("cosine") >= threshold)
    words = units.select("unit", F.size(F.filter(F.split("header", r"\s+"), lambda w: w != "")).alias("words"))
    own = found.join(words, "unit").groupBy("unit.row_no").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"), F.sum("words").alias("words")).select("row_no", "b.license", (-F.col("b.less")).alias("cosine"), "words")
    other = spark.range(1).select(rest).first()[0]
    around = matched_windows(rows.filter("body IS NOT NULL"), templates, weights, other).filter(F.col("cosine") >= threshold)
    both = own.unionByName(around).groupBy("row_no").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"), F.max("words").alias("words"))
    own = both.select("row_no", "b.license", (-F.col("b.less")).alias("cosine"), "words")
    counted = rows.withColumn("n_headers", F.size("headers").cast("long")).drop("headers", "body")
    marked = materialize(counted.join(own, "row_no", "left"), "license-own")
    is_file = F.col("license").isNotNull() & (F.col("named") | (F.col("words") >= file_share * F.col("n_words")))
    of_dir = marked.filter(is_file).groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"))
    of_dir = of_dir.select("above", F.col("b.license").alias("dir_license"), (-F.col("b.less")).alias("dir_cosine"))
    dirs = marked.groupBy("dir").agg(F.count("*").alias("n_files"))
    up = dirs.select("dir", "n_files", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "n_files", "a.above", "a.depth")
    below = up.groupBy("above").agg(F.count("*").alias("n_below"))  # of the root, all directories
    found = join_hot(up, of_dir.join(below, "above"), ["above"], "n_below").groupBy("dir").agg(F.max_by(F.struct("above", "dir_license", "dir_cosine"), "depth").alias("near"))
    near = materialize(dirs.join(found, "dir", "left"), "license-directories")
    kept = F.col("license").isNotNull()
    inherited = F.col("near.dir_license")
    return join_hot(marked, near, ["dir"], "n_files").select(
        "doc_id", "path", "n_headers", F.coalesce("license", inherited).alias("license"), F.coalesce("cosine", F.col("near.dir_cosine")).alias("cosine"),
        F.when(kept, F.lit("own")).when(inherited.isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("basis"),
        F.when(~kept, F.col("near.above")).alias("licensed_dir"),
    )
