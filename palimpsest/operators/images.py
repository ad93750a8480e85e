"""Image kernels over pixel rows (image_id, x, y, argb) or gray rows (image_id, x, y, gray).

Neighbourhoods are windows over a row or a column of one image, so work is spread over rows and columns, and a frame
that reaches beyond the image is clipped by the window itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def along_row() -> WindowSpec:
    return W.partitionBy("image_id", "y").orderBy("x")


def down_column() -> WindowSpec:
    return W.partitionBy("image_id", "x").orderBy("y")


def channel(argb: Column, shift: int) -> Column:
    return F.shiftright(argb, shift).bitwiseAND(255)


def rgb(argb: Column) -> tuple[Column, Column, Column]:
    return channel(argb, 16), channel(argb, 8), channel(argb, 0)


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v.cast("int")))


def pack(r: Column, g: Column, b: Column) -> Column:
    """Opaque ARGB as a signed 32-bit number."""
    return (F.lit(-16777216) + r * 65536 + g * 256 + b).cast("int")


def luma(argb: Column) -> Column:
    r, g, b = rgb(argb)
    return (0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def gray(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "x", "y", luma(F.col("argb")).alias("gray"))


def threshold(pixels: DataFrame, t: int) -> DataFrame:
    return gray(pixels).select("image_id", "x", "y", F.when(F.col("gray") > t, 255).otherwise(0).alias("v"))


def contrast(pixels: DataFrame, factor: float) -> DataFrame:
    return _each(pixels, lambda c: clamp(F.round(c * factor + (1 - factor) / 2 * 255)))


def contrast_brightness(pixels: DataFrame, factor: float, brightness: float) -> DataFrame:
    """The preview's: the fixed point is 128, not 127.5."""
    return _each(pixels, lambda c: clamp(F.round(c * factor + brightness + (1 - factor) * 128)))


def _each(pixels: DataFrame, f) -> DataFrame:
    return pixels.select("image_id", "x", "y", pack(*[f(c) for c in rgb(F.col("argb"))]).alias("argb"))


def desaturate(pixels: DataFrame) -> DataFrame:
    """Gray in all channels by the weights of a colour matrix of zero saturation (fixed values), rounded."""
    r, g, b = rgb(F.col("argb"))
    v = F.floor((213 * r + 715 * g + 72 * b + 500) / 1000)
    return pixels.select("image_id", "x", "y", pack(v, v, v).alias("argb"))


def invert_dark(pixels: DataFrame, limit: float = 80.0) -> DataFrame:
    """Images whose mean gray is under the limit are inverted; the means are one small row for each image."""
    mean = gray(pixels).groupBy("image_id").agg(F.avg("gray").alias("_mean"))
    dark = F.col("_mean") < limit
    return pixels.join(mean, "image_id").select("image_id", "x", "y", pack(*[F.when(dark, 255 - c).otherwise(c) for c in rgb(F.col("argb"))]).alias("argb"))


def box_blur(grays: DataFrame, radius: int, value: str = "gray") -> DataFrame:
    """Mean over 2r + 1 pixels of the row, then of the column, in whole numbers; frames shrink at the edges."""
    along, down = along_row().rowsBetween(-radius, radius), down_column().rowsBetween(-radius, radius)
    mean = lambda c, w: F.floor(F.sum(c).over(w) / F.count(c).over(w)).cast("int")
    return grays.withColumn("_h", mean(value, along)).withColumn("blur", mean("_h", down)).drop("_h")


def remove_background(pixels: DataFrame, radius: int = 30) -> DataFrame:
    diff = F.greatest(F.lit(-255), F.least(F.lit(255), F.col("blur") - F.col("gray")))
    return box_blur(gray(pixels), radius).select("image_id", "x", "y", clamp(255 - clamp(255 + diff) + F.col("gray")).alias("v"))


def _inner(value: Column, otherwise: Column) -> Column:
    edge = F.lag("x").over(along_row()).isNull() | F.lead("x").over(along_row()).isNull() | F.lag("y").over(down_column()).isNull() | F.lead("y").over(down_column()).isNull()
    return F.when(edge, otherwise).otherwise(value)


def sharpen(pixels: DataFrame, center: float = 5.0) -> DataFrame:
    """center * pixel minus its four neighbours; edges are copied."""

    def one(c: Column) -> Column:
        return clamp(center * c - F.lag(c).over(along_row()) - F.lead(c).over(along_row()) - F.lag(c).over(down_column()) - F.lead(c).over(down_column()))

    argb = F.col("argb")
    return pixels.select("image_id", "x", "y", _inner(pack(*[one(c) for c in rgb(argb)]), argb).alias("argb"))


def median(pixels: DataFrame) -> DataFrame:
    """3 x 3 median of each channel; edges are copied."""
    around = pixels.withColumn("_row", F.array(F.lag("argb").over(along_row()), F.col("argb"), F.lead("argb").over(along_row())))
    nine = F.concat(F.lag("_row").over(down_column()), F.col("_row"), F.lead("_row").over(down_column()))
    around = around.withColumn("_nine", nine)
    middle = lambda s: F.get(F.array_sort(F.transform("_nine", lambda p: channel(p, s))), F.lit(4))
    return around.select("image_id", "x", "y", _inner(pack(middle(16), middle(8), middle(0)), F.col("argb")).alias("argb"))


def adaptive_threshold(pixels: DataFrame, window: int = 25, k: float = 0.08) -> DataFrame:
    """Black and white by mean and deviation around each pixel: sums of the row's frame, then of the column's."""
    r = window // 2
    along, down = along_row().rowsBetween(-r, r), down_column().rowsBetween(-r, r)
    g = F.col("gray")
    rows = gray(pixels).select("*", F.sum(g).over(along).alias("_s"), F.sum(g * g).over(along).alias("_q"), F.count(g).over(along).alias("_n"))
    sums = rows.select("*", *[F.sum(c).over(down).alias(c + c) for c in ("_s", "_q", "_n")])
    mean = F.col("_s_s") / F.col("_n_n")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("_q_q") / F.col("_n_n") - mean * mean))
    return sums.select("image_id", "x", "y", F.when(g > mean * (1 + k * (deviation / 128 - 1)), 255).otherwise(0).alias("v"))


def integral(grays: DataFrame) -> DataFrame:
    """Sums of gray and gray squared over everything to the upper left."""
    up_to = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    g = F.col("gray").cast("long")
    rows = grays.select("*", F.sum(g).over(up_to(along_row())).alias("_s"), F.sum(g * g).over(up_to(along_row())).alias("_q"))
    return rows.select("image_id", "x", "y", F.sum("_s").over(up_to(down_column())).alias("integral"), F.sum("_q").over(up_to(down_column())).alias("integral_sq"))


def yuv_to_rgb(luma_rows: DataFrame, chroma_rows: DataFrame) -> DataFrame:
    """Y rows (image_id, x, y, yv) with U and V at half resolution (image_id, cx, cy, u, v)."""
    joined = luma_rows.withColumn("cx", F.shiftright("x", 1)).withColumn("cy", F.shiftright("y", 1)).join(chroma_rows, ["image_id", "cx", "cy"])
    y, u, v = F.col("yv"), F.col("u") - 128, F.col("v") - 128
    r, g, b = clamp(y + 1.370705 * v), clamp(y - 0.337633 * u - 0.698001 * v), clamp(y + 1.732446 * u)
    return joined.select("image_id", "x", "y", pack(r, g, b).alias("argb"))


def rotate(pixels: DataFrame, degrees: Column | int) -> DataFrame:
    """Clockwise by 90, 180 or 270 degrees; other angles leave the image as it is."""
    degrees = degrees if isinstance(degrees, Column) else F.lit(degrees)
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    x, y, w, h = (F.col(c) for c in ("x", "y", "_w", "_h"))
    nx = F.when(degrees == 90, h - 1 - y).when(degrees == 180, w - 1 - x).when(degrees == 270, y).otherwise(x)
    ny = F.when(degrees == 90, x).when(degrees == 180, h - 1 - y).when(degrees == 270, w - 1 - x).otherwise(y)
    return pixels.join(sizes, "image_id").select("image_id", nx.alias("x"), ny.alias("y"), "argb")


def unwarp(pixels: DataFrame, quads: DataFrame) -> DataFrame:
    """Stretch a quadrilateral (image_id, x1, y1 .. x4, y4: from the upper left, clockwise) over the whole image.

    Each pixel of the result is traced back by the projective map of the unit square onto the quadrilateral and blended
    from its four neighbours, in weights of a 32nd; what lies outside the image counts as 0, alpha included. An image
    without a quadrilateral, or with one whose corners 2, 3 and 4 lie on a line, stays as it is.
    """
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    x, y = ([F.col(f"{c}{k}").cast("double") for k in range(1, 5)] for c in "xy")
    ax, ay, bx, by = x[1] - x[2], y[1] - y[2], x[3] - x[2], y[3] - y[2]
    sx, sy = x[0] - x[1] + x[2] - x[3], y[0] - y[1] + y[2] - y[3]
    area = F.nullif(ax * by - bx * ay, F.lit(0.0))
    quads = quads.select("image_id", *x, *y, ((sx * by - bx * sy) / area).alias("_g"), ((ax * sy - sx * ay) / area).alias("_k")).where("_g is not null and _k is not null")
    quads = quads.toDF("image_id", *[f"_{c}{k}" for c in "xy" for k in range(1, 5)], "_g", "_k")
    placed = pixels.join(sizes, "image_id").join(quads, "image_id")

    g, k, s, t = F.col("_g"), F.col("_k"), F.col("x") / F.col("_w"), F.col("y") / F.col("_h")
    below = F.nullif(g * s + k * t + 1, F.lit(0.0))

    def back(c: str) -> Column:
        one, two, four = (F.col(f"_{c}{n}") for n in (1, 2, 4))
        return F.floor(((two - one + g * two) * s + (four - one + k * four) * t + one) / below * 32 + 0.5)

    placed = placed.select("image_id", "x", "y", back("x").alias("_u"), back("y").alias("_v"))
    part = lambda c, n: F.col(c) - 32 * F.floor(F.col(c) / 32) if n else 32 * F.floor(F.col(c) / 32) + 32 - F.col(c)
    near = [F.struct((F.floor(F.col("_u") / 32) + i).alias("x"), (F.floor(F.col("_v") / 32) + j).alias("y"), (part("_u", i) * part("_v", j)).alias("w")) for i in (0, 1) for j in (0, 1)]
    near = placed.select("image_id", F.col("x").alias("_ox"), F.col("y").alias("_oy"), F.explode(F.array(*near)).alias("n")).select("image_id", "_ox", "_oy", "n.*")
    found = near.join(pixels.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "argb"), ["image_id", "x", "y"], "left")
    blend = lambda shift: F.floor((F.sum(F.coalesce(F.col("w") * channel(F.col("argb"), shift), F.lit(0))) + 512) / 1024)
    mixed = found.groupBy("image_id", "_ox", "_oy").agg(*[blend(b).alias(f"_{b}") for b in (24, 16, 8, 0)])
    alpha = F.when(F.col("_24") > 127, F.col("_24") - 256).otherwise(F.col("_24"))
    mixed = mixed.select("image_id", F.col("_ox").alias("x"), F.col("_oy").alias("y"), (alpha * 16777216 + F.col("_16") * 65536 + F.col("_8") * 256 + F.col("_0")).cast("int").alias("argb"))
    return mixed.unionByName(pixels.join(quads, "image_id", "left_anti").select("image_id", "x", "y", "argb"))


def otsu(grays: DataFrame) -> DataFrame:
    """(image_id, t): the threshold of the greatest variance between the two classes, from each image's histogram."""
    hist = grays.groupBy("image_id", "gray").agg(F.count("*").alias("n"))
    order = W.partitionBy("image_id").orderBy("gray")
    every = W.partitionBy("image_id")
    n, s = F.col("n"), F.col("n") * F.col("gray")
    sums = hist.select("image_id", "gray", F.sum(n).over(order).alias("n0"), F.sum(s).over(order).alias("s0"), F.sum(n).over(every).alias("n1"), F.sum(s).over(every).alias("s1"))
    high = F.col("n1") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s1") - F.col("s0")) / F.nullif(high, F.lit(0))
    between = F.coalesce(F.col("n0") * high * gap * gap, F.lit(0.0))
    return sums.groupBy("image_id").agg(F.min(F.struct(-F.round(between, 6), F.col("gray").alias("t"))).alias("best")).select("image_id", "best.t")


def binarize_otsu(pixels: DataFrame) -> DataFrame:
    g = gray(pixels)
    return g.join(otsu(g), "image_id").select("image_id", "x", "y", F.when(F.col("gray") > F.col("t"), 255).otherwise(0).alias("v"))


def skew(angles: DataFrame) -> DataFrame:
    """Median skew (image_id, angle) from Hough lines (image_id, line_no, theta in degrees): the first 20 lines, those within
    45 degrees of horizontal, the upper median, and only if beyond half a degree."""
    near = angles.where(F.col("line_no") < 20).withColumn("d", F.col("theta") - 90).where(F.abs("d") < 45)
    found = near.groupBy("image_id").agg(F.array_sort(F.collect_list("d")).alias("ds"))  # at most 20 of an image
    middle = F.get("ds", F.floor(F.size("ds") / 2).cast("int"))
    return found.select("image_id", F.when(F.abs(middle) > 0.5, middle).alias("angle"))


def document_pipeline(pixels: DataFrame, *, background: bool = False, contrast_factor: float | None = 1.3, denoise: bool = True, sharp: bool = True, adaptive: bool = False, binarize: int | None = None) -> DataFrame:
    """The steps of document preparation in their fixed order, each if asked for."""
    as_argb = lambda df: df.select("image_id", "x", "y", pack(F.col("v"), F.col("v"), F.col("v")).alias("argb"))
    if background:
        pixels = as_argb(remove_background(pixels))
    if contrast_factor is not None:
        pixels = contrast(pixels, contrast_factor)
    if denoise:
        pixels = median(pixels)
    if sharp:
        pixels = sharpen(pixels)
    if adaptive:
        return as_argb(adaptive_threshold(pixels))
    return as_argb(threshold(pixels, binarize)) if binarize is not None else pixels
