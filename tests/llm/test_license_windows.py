"""License notices that are not a line of their own."""

import textwrap

from pyspark.sql import functions as F

from thalweg.llm import licenses


def test_notices_in_long_lines_and_over_line_breaks(spark):
    template = lambda start: next(t for _, t in licenses.TEMPLATES if t.startswith(start))
    wrapped = lambda text: "\n".join(" * " + x for x in textwrap.wrap(text, 60))
    texts = [
        ("Our small library of parsers, writers and converters is released under the MIT License and we welcome patches from everyone.", "MIT"),
        ("The tools that we describe in the second chapter, and the tables that go with them, are licensed under the Apache License, Version 2.0, so that any reader may use them at work.", "Apache-2.0"),
        (wrapped(template("Permission is hereby granted")), "MIT"),
        (wrapped(template("Redistribution and use")), "BSD-3-Clause"),
        ("int x;\n\n" + wrapped("The code in this folder is distributed under the GNU General Public License, version 3. Ask us for the rest.") + "\n\nint y;", "GPL-3.0"),
        ("A driver needs a license, and the public has rights of its own on the road under the law of the land.", None),
        ("Licensed under the Zlib license, which our lawyers read and liked.", None),
    ]
    df = spark.createDataFrame([(i, t, f"src/{i}/x.c") for i, (t, _) in enumerate(texts)], "doc_id long, text string, path string")
    got = {r.doc_id: r.license for r in licenses.scan(df, F.col("path")).collect()}
    assert [got[i] for i in range(len(texts))] == [name for _, name in texts]
