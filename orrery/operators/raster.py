"""Images as rows: ``(r, c, v)`` for one image, with an image's key before for many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ("r", "c")


def disc(radius: int) -> list[tuple[int, int]]:
    """Steps of a round kernel."""
    span = range(-radius, radius + 1)
    return [(i, j) for i in span for j in span if i * i + j * j <= radius * radius]


def ring(radius: int, thickness: int = 1) -> list[tuple[int, int]]:
    inner = radius - thickness
    return [(i, j) for i, j in disc(radius) if i * i + j * j > inner * inner]


def square(half: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-half, half + 1) for j in range(-half, half + 1)]


def _half(kernel: list[tuple[int, int]]) -> tuple[int, int]:
    return max(abs(i) for i, _ in kernel), max(abs(j) for _, j in kernel)


def _inner(height: int, width: int, kernel: list[tuple[int, int]]) -> Column:
    """Pixels whose kernel lies in the image; results exist there only."""
    h, w = _half(kernel)
    return F.col("r").between(h, height - 1 - h) & F.col("c").between(w, width - 1 - w)


def _moved(pixels: DataFrame, kernel: list[tuple[int, int]], sign: int) -> DataFrame:
    sent = [F.struct((F.col("r") + sign * i).alias("r"), (F.col("c") + sign * j).alias("c")) for i, j in kernel]
    return pixels.select(F.explode(F.array(*sent)).alias("p")).select("p.*")


def dilate(pixels: DataFrame, kernel: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    """``(r, c)`` of set pixels, each grown by the kernel; those nearer to the border than it don't grow."""
    return _moved(pixels.where(_inner(height, width, kernel)).select(*PIXEL), kernel, 1).distinct()


def erode(pixels: DataFrame, kernel: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    """Set pixels all of whose kernel is set."""
    reached = _moved(pixels.select(*PIXEL).distinct(), kernel, -1).groupBy(*PIXEL).agg(F.count("*").alias("n"))
    whole = reached.where((F.col("n") == len(kernel)) & _inner(height, width, kernel)).select(*PIXEL)
    return whole if (0, 0) in kernel else whole.join(pixels.select(*PIXEL), list(PIXEL), "left_semi")


def close(pixels: DataFrame, kernel: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    return erode(dilate(pixels, kernel, height, width), kernel, height, width)


def open(pixels: DataFrame, kernel: list[tuple[int, int]], height: int, width: int) -> DataFrame:  # noqa: A001
    return dilate(erode(pixels, kernel, height, width), kernel, height, width)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).join(b.select(*PIXEL), list(PIXEL), "left_anti")


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """``(r, c, v)`` of two images of whole numbers over the same pixels: and, or, xor."""
    ops = {"and": lambda x, y: x.bitwiseAND(y), "or": lambda x, y: x.bitwiseOR(y), "xor": lambda x, y: x.bitwiseXOR(y)}
    both = a.select(*PIXEL, F.col("v").alias("_a")).join(b.select(*PIXEL, F.col("v").alias("_b")), list(PIXEL))
    return both.select(*PIXEL, ops[how](F.col("_a"), F.col("_b")).alias("v"))


def masked(image: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels that the mask has set."""
    return image.join(mask.where("v <> 0").select(*PIXEL), list(PIXEL), "left_semi")


def blend(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    both = a.select(*PIXEL, F.col("v").alias("_a")).join(b.select(*PIXEL, F.col("v").alias("_b")), list(PIXEL))
    return both.select(*PIXEL, (F.col("_a") * alpha + F.col("_b") * (1 - alpha)).alias("v"))


def confusion(measured: DataFrame, truth: DataFrame, height: int, width: int) -> DataFrame:
    """One row ``(tp, fp, fn, tn)`` of two sets of pixels."""
    both = measured.select(*PIXEL, F.lit(1).alias("m")).join(truth.select(*PIXEL, F.lit(1).alias("t")), list(PIXEL), "full")
    count = lambda test: F.coalesce(F.count_if(test), F.lit(0))
    found = both.agg(count(F.expr("m = 1 and t = 1")).alias("tp"), count(F.expr("m = 1 and t is null")).alias("fp"), count(F.expr("m is null and t = 1")).alias("fn"))
    return found.withColumn("tn", F.lit(height * width) - F.col("tp") - F.col("fp") - F.col("fn"))


def stack_stats(images: DataFrame, image_count: int, keep: Column | None = None) -> DataFrame:
    """``(r, c, n, mean, variance, completeness)`` over a stack ``(image, r, c, v)``; ``keep`` filters values."""
    rows = images if keep is None else images.where(keep)
    variance = F.coalesce(F.var_samp("v"), F.lit(0.0))
    return rows.groupBy(*PIXEL).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), variance.alias("variance"), (F.count("v") / F.lit(float(image_count))).alias("completeness"))


def completeness_mask(stats: DataFrame, least: float) -> DataFrame:
    return stats.where(F.col("completeness") >= least).select(*PIXEL)


def otsu(histogram: DataFrame) -> DataFrame:
    """One row ``(threshold, between)``: the bin up to which values are dark, by the largest variance between classes.

    ``histogram``: ``(bin, weight)``, as many rows as there are grey values.
    """
    from pyspark.sql import Window

    front = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each grey value
    whole = Window.partitionBy(F.lit(0))
    sums = histogram.select(
        "bin", F.sum("weight").over(front).alias("w0"), F.sum(F.col("weight") * F.col("bin")).over(front).alias("s0"),
        F.sum("weight").over(whole).alias("w"), F.sum(F.col("weight") * F.col("bin")).over(whole).alias("s"),
    )
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    gap = F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(s1, w1)
    between = F.coalesce(F.col("w0") * w1 * gap * gap / (F.col("w") * F.col("w")), F.lit(0.0))
    return sums.select("bin", between.alias("between")).agg(F.min_by("bin", F.struct(-F.col("between"), F.col("bin"))).alias("threshold"), F.max("between").alias("between"))


def upscale(image: DataFrame, factor: int) -> DataFrame:
    """Each pixel as a square of ``factor`` pixels."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(factor) for j in range(factor)])
    return image.select("*", F.explode(steps).alias("_s")).select((F.col("r") * factor + F.col("_s.i")).alias("r"), (F.col("c") * factor + F.col("_s.j")).alias("c"), "v")


def flip(image: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """Top to bottom for a given height, left to right for a given width."""
    if height is not None:
        image = image.withColumn("r", height - 1 - F.col("r"))
    return image if width is None else image.withColumn("c", width - 1 - F.col("c"))


def sizes(images: DataFrame) -> DataFrame:
    """``(height, width, images)``: which images ``(image, height, width)`` share a size."""
    return images.groupBy("height", "width").agg(F.array_sort(F.collect_list("image")).alias("images"))


def merge_stacks(*stacks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, stacks)
