"""Perspective warp against a linear solve of the eight coefficients, pixel by pixel."""

import numpy as np

from palimpsest.operators import images as I

W, H = 12, 9
QUADS = {1: (1, 1, 10, 0, 9, 8, 2, 7), 2: (0, 0, W, 0, W, H, 0, H), 3: (-3, 2, 14, 1, 11, 10, 0, 6), 5: (0, 0, 4, 4, 5, 5, 6, 6), 6: (None, 0, 4, 4, 5, 0, 6, 6)}


def plain(image, quad):
    x, y = np.array(quad[::2], float), np.array(quad[1::2], float)
    rows, right = [], []
    for (u, v), a, b in zip([(0, 0), (W, 0), (W, H), (0, H)], x, y, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * a, -v * a], [0, 0, 0, u, v, 1, -u * b, -v * b]]
        right += [a, b]
    c = np.linalg.solve(np.array(rows, float), np.array(right))
    out = {}
    for i in range(W):
        for j in range(H):
            z = c[6] * i + c[7] * j + 1
            a, b = (int(np.floor(round(t / z * 32, 6) + 0.5)) for t in (c[0] * i + c[1] * j + c[2], c[3] * i + c[4] * j + c[5]))
            total = [512] * 4
            for p in (0, 1):
                for q in (0, 1):
                    argb = image.get((a // 32 + p, b // 32 + q), 0) & 0xFFFFFFFF
                    weight = (a % 32 if p else 32 - a % 32) * (b % 32 if q else 32 - b % 32)
                    total = [t + weight * (argb >> s & 255) for t, s in zip(total, (24, 16, 8, 0), strict=True)]
            out[i, j] = int.from_bytes(bytes(t // 1024 for t in total), "big", signed=True)
    return out


def test_unwarp(spark):
    rng = np.random.default_rng(3)
    image = {(i, j): int(rng.integers(-(1 << 24), 0)) for i in range(W) for j in range(H)}
    pixels = spark.createDataFrame([(k, i, j, v) for k in range(1, 7) for (i, j), v in image.items()], "image_id int, x int, y int, argb int")
    quads = spark.createDataFrame([(k, *q) for k, q in QUADS.items()], "image_id int, x1 int, y1 int, x2 int, y2 int, x3 int, y3 int, x4 int, y4 int")
    got = {}
    for r in I.unwarp(pixels, quads).collect():
        assert (r.x, r.y) not in got.setdefault(r.image_id, {})
        got[r.image_id][r.x, r.y] = r.argb
    assert got[1] == plain(image, QUADS[1]) and got[3] == plain(image, QUADS[3])
    assert all(v == 0 for (x, y), v in got[3].items() if x == 0 and y == 0)  # outside the image
    assert got[2] == got[4] == got[5] == got[6] == image  # whole image, no quadrilateral, on a line, null
    assert I.unwarp(pixels.limit(0), quads).count() == 0
