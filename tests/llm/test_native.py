from collections import Counter

import pytest

from palimpsest.llm import licenses, sharding


def test_table_is_even_and_stable():
    names = sharding.shard_names(16)
    held = sharding.filled_table(names, 2003)
    shares = Counter(held).values()
    assert max(shares) - min(shares) <= 1
    fewer = sharding.filled_table(names[:-1], 2003)
    assert sum(a != b for a, b in zip(held, fewer) if a != 15) < 0.35 * 2003
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.filled_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.filled_table(["a"], 8)


def test_place(spark):
    df = spark.createDataFrame([(k, "t") for k in range(500)] + [(None, f"x{k}") for k in range(50)] + [(None, None)], "doc_id long, text string")
    rows = sharding.place(df, sharding.shard_names(4), 101).collect()
    assert len(rows) == 551 and len({r.shard for r in rows}) == 4 and len({r.shard for r in rows if r.doc_id is None}) > 1
    held = sharding.filled_table(sharding.shard_names(4), 101)
    assert all(r.shard == sharding.shard_names(4)[held[r.slot]] and r.slot == sharding._number(str(r.doc_id)) % 101 for r in rows if r.doc_id is not None)
    assert sharding.place(df.limit(0), sharding.shard_names(4), 101).count() == 0
    with pytest.raises(ValueError):
        sharding.place(df.selectExpr("*", "1 as slot"), ["a"], 7)


def plain(text, threshold=0.8):
    """Units that match, names, and the best (dice, name): each unit against each template, and every window, without bounds."""
    import re

    units = [re.sub(r"[\W_]+", " ", x.lower()).split() for x in (text or "").split("\n")]
    words = [w for u in units for w in u]
    if len(units) > 1:
        units.append(words)
    pairs = lambda u: [f"{a} {b}" for a, b in zip(u, u[1:])]
    score = lambda grams, t: (-2 * len(grams & set(t)) / (len(grams) + len(t))) if grams else 0
    found = [[(score(set(pairs(u)), t), name) for name, t, _ in licenses.templates()] for u in units]
    whole = pairs(words)
    for name, t, length in licenses.templates():
        found.append([(min((score(set(whole[i : i + length]), t) for i in range(len(whole)) if whole[i] in t), default=0), name)])
    found = [sorted(h for h in f if -h[0] >= threshold) for f in found]
    flat = sorted(h for f in found for h in f)
    return sum(map(bool, found)), ",".join(sorted({n for _, n in flat})), flat[0][1] if flat else None, round(-flat[0][0], 6) if flat else None


def test_scan(spark):
    mit = licenses.TEMPLATES["MIT"][1].replace(", ", ",\n")
    texts = [None, "", "x", "Released under the MIT License.", "some text\nlicensed UNDER the Apache License -- version 2.0\nmore", mit, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", "word " * 5000, "Licensed under the Apache License"]
    rows = licenses.scan(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, name int")).collect()
    got = {r.doc_id: (r.n_matches, r.licenses, r.best_license, r.best_dice) for r in rows}
    assert got == {k: plain(t) for k, t in enumerate(texts)}
    assert got[5][2] == "MIT" and got[4][2] == "Apache-2.0"
    assert licenses.scan(spark.createDataFrame([], "text string")).count() == 0
