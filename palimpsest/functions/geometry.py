"""Column expressions over boxes (struct left, top, right, bottom), quadrilaterals and image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A4 in points, and the lift of a drawn page.
A4_WIDTH, A4_HEIGHT, LIFT = 595.27563, 841.8898, 20.0


def box(left, top, right, bottom) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def width(b: Column) -> Column:
    return b["right"] - b["left"]


def height(b: Column) -> Column:
    return b["bottom"] - b["top"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> Column:
    return F.struct(((b["left"] + b["right"]) / 2).alias("x"), ((b["top"] + b["bottom"]) / 2).alias("y"))


def is_empty(b: Column) -> Column:
    return (width(b) <= 0) | (height(b) <= 0)


def intersects(a: Column, b: Column) -> Column:
    """Strict: boxes that only touch do not intersect."""
    return (a["left"] < b["right"]) & (a["right"] > b["left"]) & (a["top"] < b["bottom"]) & (a["bottom"] > b["top"])


def contains(b: Column, x: Column, y: Column) -> Column:
    """Closed: points on an edge are inside."""
    return x.between(b["left"], b["right"]) & y.between(b["top"], b["bottom"])


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["left"], b["left"]), F.least(a["top"], b["top"]), F.greatest(a["right"], b["right"]), F.greatest(a["bottom"], b["bottom"]))


def scale(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["left"] * sx, b["top"] * sy, b["right"] * sx, b["bottom"] * sy)


def trunc(x: Column) -> Column:
    return x.cast("int")


def coordinates(points: Column, axis: str) -> Column:
    return F.transform(points, lambda p: p[axis])


def quad_area(points: Column) -> Column:
    """Shoelace area of an array of four struct(x, y)."""
    at = lambda i, k: points[i % 4][k]
    terms = [at(i, "x") * at(i + 1, "y") - at(i + 1, "x") * at(i, "y") for i in range(4)]
    return F.abs(terms[0] + terms[1] + terms[2] + terms[3]) / 2


def quad_valid(points: Column) -> Column:
    return (F.size(F.array_distinct(points)) == 4) & (quad_area(points) > 0.1)


def quad_bounds(points: Column, w: Column, h: Column) -> Column:
    """Bounding rectangle in whole pixels, or the whole image for an invalid quadrilateral."""
    xs, ys = coordinates(points, "x"), coordinates(points, "y")
    inside = box(trunc(F.array_min(xs)), trunc(F.array_min(ys)), trunc(F.array_max(xs)), trunc(F.array_max(ys)))
    zero = F.lit(0)
    return F.when(quad_valid(points), inside).otherwise(box(zero, zero, trunc(w), trunc(h)))


def order_corners(points: Column, strict: bool = True) -> Column:
    """Corners by x + y: the least, the two others by x, the greatest last but one: (least, smaller x, greatest, larger x).

    With strict=False the right-hand one of the two comes second, as the names of the corners would have it.
    """
    ordered = F.array_sort(points, lambda a, b: F.signum(a["x"] + a["y"] - b["x"] - b["y"]).cast("int"))
    p, q = ordered[1], ordered[2]
    small, large = F.when(p["x"] <= q["x"], p).otherwise(q), F.when(p["x"] <= q["x"], q).otherwise(p)
    return F.array(ordered[0], small if strict else large, ordered[3], large if strict else small)


def page_fit(w: Column, h: Column) -> Column:
    """How an image is drawn on A4: struct(scale, start_x, drawn_width, drawn_height)."""
    s = F.least(A4_WIDTH / w, A4_HEIGHT / h)
    return F.struct(s.alias("scale"), ((A4_WIDTH - w * s) / 2).alias("start_x"), (w * s).alias("drawn_width"), (h * s).alias("drawn_height"))


def to_page(b: Column, fit: Column) -> Column:
    """Where a box's text starts on the page (origin at the lower left)."""
    y = (A4_HEIGHT - fit["drawn_height"] - LIFT) + (fit["drawn_height"] - b["bottom"] * fit["scale"])
    return F.struct((fit["start_x"] + b["left"] * fit["scale"]).alias("x"), y.alias("y"))


def crop_clamp(left: Column, top: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """Crop in whole pixels inside the image; one of at most 10 pixels to a side is the whole image."""
    x = F.least(F.greatest(trunc(left), F.lit(0)), image_w - 1)
    y = F.least(F.greatest(trunc(top), F.lit(0)), image_h - 1)
    cw, ch = F.least(trunc(w), image_w - x), F.least(trunc(h), image_h - y)
    whole, zero = (cw <= 10) | (ch <= 10), F.lit(0)
    pick = lambda a, b: F.when(whole, a).otherwise(b)
    return F.struct(pick(zero, x).alias("x"), pick(zero, y).alias("y"), pick(image_w, cw).alias("width"), pick(image_h, ch).alias("height"))


def aspect_fit(canvas_w: Column, canvas_h: Column, w: Column, h: Column) -> Column:
    s = F.least(canvas_w / w, canvas_h / h)
    return F.struct(s.alias("scale"), ((canvas_w - w * s) / 2).alias("offset_x"), ((canvas_h - h * s) / 2).alias("offset_y"))


def _sized(w: Column, h: Column) -> Column:
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))


def plan_recognition(w: Column, h: Column) -> Column:
    """Size for recognition: a short side under 400 goes to 600 (three times at most, 8 megapixels at most), else a long side over 3000 goes to 3000."""
    low, high = F.least(w, h), F.greatest(w, h)
    up, down = F.least(600 / low, F.lit(3.0)), 3000 / high
    uw, uh = trunc(w * up), trunc(h * up)
    fits = (low < 400) & (uw.cast("long") * uh.cast("long") <= 8_000_000)
    shrunk = _sized(F.greatest(trunc(w * down), F.lit(1)), F.greatest(trunc(h * down), F.lit(1)))
    return F.when(fits, _sized(uw, uh)).when(high > 3000, shrunk).otherwise(_sized(w, h))


def plan_app(w: Column, h: Column) -> Column:
    """struct(target long side, binarize): long sides go up to 800, which forces black and white, or down to 2048."""
    high = F.greatest(w, h)
    return F.struct(F.when(high < 800, 800).when(high > 2048, 2048).otherwise(high).cast("int").alias("side"), (high < 800).alias("binarize"))


def plan_preprocess(w: Column, h: Column, least: int, most: int) -> Column:
    low, high = F.least(w, h), F.greatest(w, h)
    s = F.when(low < least, least / low).when(high > most, most / high).otherwise(1.0)
    return _sized(w * s, h * s)


def page_mode(w: Column, h: Column) -> Column:
    ratio = w / h
    return F.when(~ratio.between(0.08, 12.0), "SINGLE_LINE").when(~ratio.between(0.25, 4.0), "SINGLE_BLOCK").when(F.greatest(w, h) < 500, "SINGLE_BLOCK").otherwise("AUTO")


def confidence_band(c: Column) -> Column:
    return F.when(c > 0.8, "GREEN").when(c > 0.5, "YELLOW").otherwise("RED")


def crop_to_original(left: Column, top: Column, w: Column, h: Column, sx: Column, sy: Column) -> Column:
    """A crop on the preview, in the original's pixels; sx and sy are original size by preview size."""
    return F.struct((left * sx).alias("left"), (top * sy).alias("top"), (w * sx).alias("width"), (h * sy).alias("height"))
