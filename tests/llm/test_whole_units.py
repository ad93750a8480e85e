"""Units of many words and few bigrams, and notices wrapped inside longer files, against the licence templates."""

import textwrap

import pytest

from palimpsest.llm import licenses

from .test_native import plain


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    return [(r.n_matches, r.licenses, r.best_license, r.best_dice) for r in rows]


def test_repeated_notice_in_one_unit(spark):
    notice = licenses.TEMPLATES["MIT"][1]
    texts = [" ".join([notice] * 8), "\n".join([notice.replace(", to deal", ",\nto deal")] * 8), "Licensed under the Apache License, Version 2.0. " * 200]
    got = scanned(spark, texts)
    assert got == [plain(t) for t in texts]
    assert [g[2] for g in got] == ["MIT", "MIT", "Apache-2.0"] and all(g[3] >= 0.8 for g in got)


def test_wrapped_notice_in_a_long_file(spark):
    code = [f"def f{k}(x): return x + {k}" for k in range(200)]
    texts = []
    for name, k in (("MIT", 2), ("BSD-2-Clause", 0), ("Apache-2.0", 1), ("MIT", 1)):
        wrapped = ["# " + line for line in textwrap.wrap(licenses.TEMPLATES[name][k], 60)]
        texts.append("\n".join(code[:100] + wrapped + code[100:]))
    texts.append("a long line that says it is Released under the MIT License. and goes on for very many other words " * 3)
    got = scanned(spark, texts)
    assert got == [plain(t) for t in texts]
    assert [name in g[1].split(",") and g[3] == 1.0 for g, name in zip(got, ["MIT", "BSD-2-Clause", "Apache-2.0", "MIT", "MIT"])] == [True] * 5


def test_clashing_columns(spark):
    df = spark.createDataFrame([("Released under the MIT License.",)], "text string").selectExpr("*", *[f"'x' _{n}" for n in ("lines", "sets", "found", "best", "pairs", "known", "whole", "windows")])
    row = licenses.scan(df).first()
    assert row.best_license == "MIT" and row._best == "x" and row._lines == "x"
    for name in licenses.RESULT:
        with pytest.raises(ValueError):
            licenses.scan(df.selectExpr("*", f"1 as {name.upper()}"))
