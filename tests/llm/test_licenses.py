"""License scans against a brute-force version and by hand."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thalweg.llm import licenses

SCHEMA = "doc_id long, text string, path string, license string, dir string"


def terms(text):
    return re.findall(licenses.TERM, text.lower())


def brute(files):
    """{row number: (license, basis, directory)} of (text, path) pairs."""
    headers = [[t or ""] if re.search(licenses.FILE_NAME, p or "") else [line for line in (t or "").split("\n") if re.search(licenses.CUE, line)] for t, p in files]
    n = sum(map(len, headers))
    df = Counter(w for hs in headers for h in hs for w in set(terms(h)))
    vocabulary = {w for _, t in licenses.TEMPLATES for w in terms(t)}
    idf = lambda w: math.log((n + 1) / ((df[w] if w in vocabulary else 0) + 1)) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(terms(t)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    wanted = [(name, vector(t)) for name, t in licenses.TEMPLATES]
    own, share = [], []
    for (text, _), hs in zip(files, headers, strict=True):
        best, words = [], 0
        for h in hs:
            v = vector(h)
            scored = [(round(sum(x * w.get(k, 0) for k, x in v.items()) / ((size(v) * size(w)) or 1), 9), -i, name) for i, (name, w) in enumerate(wanted)]
            cosine, _, name = max(scored)
            if cosine >= licenses.THRESHOLD:
                best.append((-cosine, name))
                words += len(h.split())
        own.append(min(best) if best else None)
        share.append(words >= licenses.FILE_SHARE * len((text or "").split()))
    dirs = {}
    for (_, p), o, s in zip(files, own, share, strict=True):
        if o and (s or re.search(licenses.FILE_NAME, p or "")):
            d = "/".join((p or "").split("/")[:-1])
            dirs[d] = min(dirs.get(d, o), o)
    out = []
    for (_, p), o in zip(files, own, strict=True):
        if o:
            out.append((o[1], "own", None))
            continue
        parts = (p or "").split("/")[:-1]
        above = ["/".join(parts[:i]) for i in range(len(parts), -1, -1)]
        found = next((d for d in above if d in dirs), None)
        out.append((dirs[found][1], "inherited", found) if found is not None else (None, "none", None))
    return out


def scan(spark, files):
    df = spark.createDataFrame([(i, t, p, "clash", "clash") for i, (t, p) in enumerate(files)], SCHEMA)
    return {r.doc_id: r for r in licenses.scan(df, F.col("path")).collect()}


def test_licenses_equal_brute_force(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["alpha", "beta", "license", "of", "the", "work", "rights"]) for _ in range(rng.randint(0, 60)))
    files = [("", "a/b/empty.txt"), (None, None), ("word " * 50_000, "a/long.txt"), ("Released under the MIT License.", "a/LICENSE"), ("Released under the MIT License.", "a/LICENSE")]
    for _ in range(120):
        lines = [prose() for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(licenses.TEMPLATES)[1])
        files.append(("\n".join(lines), "/".join([rng.choice("abc") for _ in range(rng.randint(0, 3))] + [rng.choice(["LICENSE.txt", "x.py", "y.md", "COPYING"])])))
    got = scan(spark, files)
    assert len(got) == len(files)
    for i, (name, basis, above) in enumerate(brute(files)):
        assert (got[i].license, got[i].basis, got[i].licensed_dir) == (name, basis, above), files[i]


def test_the_nearest_license_file_is_inherited(spark):
    got = scan(spark, [("Licensed under CC BY-NC 4.0.", "LICENSE"), ("All rights reserved.", "lib/x/COPYING"), ("print(1)", "lib/x/y/z.py"), ("print(2)", "lib/w.py"), ("SPDX-License-Identifier: MIT\nprint(3)" + " word" * 99, "lib/x/own.py")])
    assert [(got[i].license, got[i].basis, got[i].licensed_dir) for i in (2, 3, 4)] == [("Proprietary", "inherited", "lib/x"), ("CC-BY-NC-4.0", "inherited", ""), ("MIT", "own", None)]


@pytest.mark.parametrize("long_line", [True, False])
def test_headers_of_long_lines(spark, long_line):
    text = ("x " * 5000 if long_line else "") + "Licensed under the Apache License, Version 2.0." + (" y" * 5000 if long_line else "")
    got = scan(spark, [(text, "a.txt")])
    assert got[0].n_headers == 1


def test_no_files(spark):
    assert scan(spark, []) == {}
