"""Grid filters, edges, marching and image operators on grids of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning, grid, raster
from ..registry import query, table

SIZE = (26, 11, 9)


def cells(spark, d):
    """Order lines counted by quantity, discount and tax: every value is a whole number."""
    at = [(F.col("l_quantity") / 2).cast("int").alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"), F.round(F.col("l_tax") * 100).cast("int").alias("z")]
    return table(spark, d, "lineitem").groupBy(*at).agg((F.count("*") % 31).cast("double").alias("v"))


CELLS = """g AS (SELECT CAST(trunc(l_quantity / 2) AS INTEGER) AS x, CAST(round(l_discount * 100) AS INTEGER) AS y, CAST(round(l_tax * 100) AS INTEGER) AS z,
    CAST(count(*) % 31 AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3)"""
STEPS = "d AS (SELECT dx, dy, dz FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dz))"
#: What each cell gets from its neighbours; ``{}`` takes the sums.
NEAR = f"""WITH {CELLS}, {STEPS}, s AS (SELECT x - dx AS x, y - dy AS y, z - dz AS z, dx, dy, dz, v FROM g, d WHERE x - dx BETWEEN 0 AND 25 AND y - dy BETWEEN 0 AND 10 AND z - dz BETWEEN 0 AND 8)"""
W = "CASE {0} WHEN 0 THEN 2.0 ELSE 1.0 END"
INNER = "x BETWEEN 1 AND 24 AND y BETWEEN 1 AND 9 AND z BETWEEN 1 AND 7"
SOBEL = f"""{NEAR}, f AS (SELECT x, y, z, abs(sum(dx * {W.format('dy')} * {W.format('dz')} * v)) AS gx, abs(sum(dy * {W.format('dx')} * {W.format('dz')} * v)) AS gy,
    abs(sum(dz * {W.format('dx')} * {W.format('dy')} * v)) AS gz FROM s GROUP BY x, y, z),
sob AS (SELECT x, y, z, CASE WHEN {INNER} THEN gx ELSE 0 END AS gx, CASE WHEN {INNER} THEN gy ELSE 0 END AS gy, CASE WHEN {INNER} THEN gz ELSE 0 END AS gz FROM f)"""


@query("gaussian_3d", f"""
{NEAR}, k AS (SELECT exp(-1 / (2 * 0.8 * 0.8)) / (1 + 2 * exp(-1 / (2 * 0.8 * 0.8))) AS side, 1 / (1 + 2 * exp(-1 / (2 * 0.8 * 0.8))) AS mid)
SELECT x, y, z, round(sum(v * CASE dx WHEN 0 THEN mid ELSE side END * CASE dy WHEN 0 THEN mid ELSE side END * CASE dz WHEN 0 THEN mid ELSE side END), 8) AS v FROM s, k GROUP BY x, y, z""")
def gaussian_3d(spark, d):
    return grid.gaussian(cells(spark, d), 3, 0.8, SIZE).select("x", "y", "z", F.round("v", 8).alias("v"))


@query("sobel_3d", f"{SOBEL} SELECT x, y, z, gx, gy, gz FROM sob")
def sobel_3d(spark, d):
    return grid.sobel(cells(spark, d), SIZE)


@query("sobel_2d", f"""
{NEAR} SELECT x, y, z, sum(dx * {W.format('dy')} * v) AS gx, sum(dy * {W.format('dx')} * v) AS gy FROM s WHERE dz = 0 GROUP BY x, y, z""")
def sobel_2d(spark, d):
    return grid.sobel_2d(cells(spark, d), SIZE)


@query("central_gradients", f"""
{NEAR}, f AS (SELECT x, y, z, sum(0.5 * dx * v) AS gx, sum(0.5 * dy * v) AS gy, sum(0.5 * dz * v) AS gz FROM s WHERE abs(dx) + abs(dy) + abs(dz) = 1 GROUP BY x, y, z)
SELECT x, y, z, CASE WHEN {INNER} THEN gx ELSE 0 END AS gx, CASE WHEN {INNER} THEN gy ELSE 0 END AS gy, CASE WHEN {INNER} THEN gz ELSE 0 END AS gz FROM f""")
def central_gradients(spark, d):
    found = grid.central_gradients(cells(spark, d), SIZE)
    return found.select("x", "y", "z", *[F.col(k).cast("double").alias(k) for k in ("gx", "gy", "gz")])


SUPPRESSED = f"""{SOBEL}, nms AS (SELECT a.x, a.y, a.z, CASE WHEN a.x BETWEEN 1 AND 24 AND a.y BETWEEN 1 AND 9 AND a.z BETWEEN 1 AND 7 THEN sqrt(
    CASE WHEN a.gx > coalesce(x0.gx, 0) AND a.gx > coalesce(x1.gx, 0) THEN a.gx ELSE 0 END ** 2 + CASE WHEN a.gy > coalesce(y0.gy, 0) AND a.gy > coalesce(y1.gy, 0) THEN a.gy ELSE 0 END ** 2
    + CASE WHEN a.gz > coalesce(z0.gz, 0) AND a.gz > coalesce(z1.gz, 0) THEN a.gz ELSE 0 END ** 2) ELSE 0 END AS v FROM sob a
    LEFT JOIN sob x0 ON x0.x = a.x - 1 AND x0.y = a.y AND x0.z = a.z LEFT JOIN sob x1 ON x1.x = a.x + 1 AND x1.y = a.y AND x1.z = a.z
    LEFT JOIN sob y0 ON y0.x = a.x AND y0.y = a.y - 1 AND y0.z = a.z LEFT JOIN sob y1 ON y1.x = a.x AND y1.y = a.y + 1 AND y1.z = a.z
    LEFT JOIN sob z0 ON z0.x = a.x AND z0.y = a.y AND z0.z = a.z - 1 LEFT JOIN sob z1 ON z1.x = a.x AND z1.y = a.y AND z1.z = a.z + 1)"""


@query("suppress_3d", f"{SUPPRESSED} SELECT x, y, z, round(v, 7) AS v FROM nms")
def suppress_3d(spark, d):
    return grid.suppress(grid.sobel(cells(spark, d), SIZE), SIZE).select("x", "y", "z", F.round("v", 7).alias("v"))


@query("hysteresis_3d", f"""
WITH RECURSIVE {CELLS}, c AS (SELECT x, y, z, v FROM g WHERE v >= 28), r AS (SELECT x, y, z FROM c WHERE v >= 30
    UNION SELECT c.x, c.y, c.z FROM r JOIN c ON abs(c.x - r.x) <= 1 AND abs(c.y - r.y) <= 1 AND abs(c.z - r.z) <= 1)
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM r""")
def hysteresis_3d(spark, d):
    return grid.hysteresis(cells(spark, d), 28, 30)


#: The filters above one after another: smoothed cells take the place of the given ones.
MIDDLE = "CASE {0} WHEN 0 THEN mid ELSE side END"
SMOOTHED = f"""kern AS (SELECT exp(-1 / (2 * 0.8 * 0.8)) / (1 + 2 * exp(-1 / (2 * 0.8 * 0.8))) AS side, 1 / (1 + 2 * exp(-1 / (2 * 0.8 * 0.8))) AS mid),
sm AS (SELECT x - dx AS x, y - dy AS y, z - dz AS z, sum(v * {MIDDLE.format('dx')} * {MIDDLE.format('dy')} * {MIDDLE.format('dz')}) AS v FROM g, d, kern
    WHERE x - dx BETWEEN 0 AND 25 AND y - dy BETWEEN 0 AND 10 AND z - dz BETWEEN 0 AND 8 GROUP BY 1, 2, 3)"""
CANNY = SUPPRESSED.replace("WITH ", "WITH RECURSIVE ", 1).replace(", s AS (", f", {SMOOTHED}, s AS (", 1).replace("v FROM g, d WHERE", "v FROM sm, d WHERE", 1)


@query("canny_3d", f"""
{CANNY}, c AS (SELECT x, y, z, v FROM nms WHERE v >= 5), r AS (SELECT x, y, z FROM c WHERE v >= 10
    UNION SELECT c.x, c.y, c.z FROM r JOIN c ON abs(c.x - r.x) <= 1 AND abs(c.y - r.y) <= 1 AND abs(c.z - r.z) <= 1)
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM r""")
def canny_3d(spark, d):
    return grid.canny(cells(spark, d), 3, 0.8, 5.0, 10.0)


@query("grid_normalize", f"WITH {CELLS}, m AS (SELECT min(v) AS a, max(v) AS b FROM g) SELECT x, y, z, round((v - a) / (b - a), 8) AS v FROM g, m")
def grid_normalize(spark, d):
    return grid.normalize(cells(spark, d)).select("x", "y", "z", F.round("v", 8).alias("v"))


@query("grid_threshold", f"WITH {CELLS} SELECT x, y, z FROM g WHERE v > 20")
def grid_threshold(spark, d):
    return grid.above(cells(spark, d), 20.0)


@query("grid_histogram", f"WITH {CELLS} SELECT CAST(trunc(v / 4.0) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM g GROUP BY 1")
def grid_histogram(spark, d):
    return binning.histogram(cells(spark, d), "v", 4.0)


@query("cross_sections", f"""
WITH {CELLS} SELECT 'x' AS axis, y AS u, z AS w, v FROM g WHERE x = 13 UNION ALL SELECT 'y', x, z, v FROM g WHERE y = 5 UNION ALL SELECT 'z', x, y, v FROM g WHERE z = 4""")
def cross_sections(spark, d):
    return grid.cross_sections(cells(spark, d), SIZE)


@query("zero_crossings", f"""
WITH {CELLS}, p AS (SELECT x, y, CASE WHEN v - 15 < 0 THEN -1 ELSE 1 END AS s FROM g WHERE z = 4)
SELECT a.x AS u, a.y AS w, min(b.s) <> max(b.s) AS crossing FROM p a JOIN p b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y""")
def zero_crossings(spark, d):
    plane = cells(spark, d).where("z = 4").select(F.col("x").alias("u"), F.col("y").alias("w"), (F.col("v") - 15).alias("v"))
    return grid.zero_crossings(plane)


@query("ray_march", f"""
WITH {CELLS}, o AS (SELECT x, y, z FROM g WHERE v >= 25), dirs(dx, dy, dz) AS (VALUES (1, 0, 0), (1, 1, 0), (1, -1, 1), (1, 0, -1)),
e AS (SELECT 0 AS x, y, z, dx, dy, dz FROM (SELECT unnest(generate_series(0, 10)) AS y), (SELECT unnest(generate_series(0, 8)) AS z), dirs),
f AS (SELECT e.* FROM e LEFT JOIN o USING (x, y, z) WHERE o.x IS NULL),
m AS (SELECT f.*, k FROM f, (SELECT unnest(generate_series(1, 25)) AS k)),
h AS (SELECT m.*, o.x AS hx, o.y AS hy, o.z AS hz, row_number() OVER (PARTITION BY m.x, m.y, m.z, dx, dy, dz ORDER BY k) AS n FROM m JOIN o ON o.x = m.x + k * dx AND o.y = m.y + k * dy AND o.z = m.z + k * dz),
b AS (SELECT *, abs(dx) + abs(dy) + abs(dz) AS parts, (SELECT count(*) FROM o WHERE (dx <> 0 AND o.x = hx AND o.y = hy - dy AND o.z = hz - dz) OR (dy <> 0 AND o.x = hx - dx AND o.y = hy AND o.z = hz - dz)
    OR (dz <> 0 AND o.x = hx - dx AND o.y = hy - dy AND o.z = hz)) AS beside FROM h WHERE n = 1)
SELECT DISTINCT CAST(hx AS BIGINT) AS x, CAST(hy AS BIGINT) AS y, CAST(hz AS BIGINT) AS z FROM b WHERE parts = 1 OR beside < parts""")
def ray_march(spark, d):
    n = spark.range(11 * 9)
    dirs = F.array(*[F.struct(*[F.lit(x).alias(k) for x, k in zip(s, ("dx", "dy", "dz"))]) for s in ((1, 0, 0), (1, 1, 0), (1, -1, 1), (1, 0, -1))])
    entries = n.select(F.lit(0).alias("x"), F.floor(F.col("id") / 9).alias("y"), (F.col("id") % 9).alias("z"), F.explode(dirs).alias("d")).select("x", "y", "z", "d.*")
    return grid.march(entries, cells(spark, d).where("v >= 25"))


def pixels(spark, d):
    """An image of 50 by 40: order lines by quantity and part."""
    at = [(F.col("l_quantity") - 1).cast("int").alias("r"), (F.col("l_partkey") % 40).cast("int").alias("c")]
    return table(spark, d, "lineitem").groupBy(*at).agg((F.count("*") % 7).cast("int").alias("v"))


PIXELS = "i AS (SELECT CAST(l_quantity - 1 AS INTEGER) AS r, CAST(l_partkey % 40 AS INTEGER) AS c, CAST(count(*) % 7 AS INTEGER) AS v FROM lineitem GROUP BY 1, 2)"
KERNEL = "k AS (SELECT * FROM (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) t(dr, dc))"
DILATED = f"{PIXELS}, {KERNEL}, a AS (SELECT r, c FROM i WHERE v >= 5), dil AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM a, k WHERE r BETWEEN 1 AND 48 AND c BETWEEN 1 AND 38)"
ERODED = f"{PIXELS}, {KERNEL}, a AS (SELECT r, c FROM i WHERE v >= 2), ero AS (SELECT a.r, a.c FROM a, k JOIN a AS b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.r BETWEEN 1 AND 48 AND a.c BETWEEN 1 AND 38 GROUP BY a.r, a.c HAVING count(*) = 5)"


@query("morph_dilate", f"WITH {DILATED} SELECT r, c FROM dil")
def morph_dilate(spark, d):
    return raster.dilate(pixels(spark, d).where("v >= 5"), raster.disc(1), 50, 40)


@query("morph_erode", f"WITH {PIXELS}, {KERNEL}, a AS (SELECT r, c FROM i WHERE v >= 2), m AS (SELECT a.r, a.c, a.r + dr AS nr, a.c + dc AS nc FROM a, k WHERE a.r BETWEEN 1 AND 48 AND a.c BETWEEN 1 AND 38) SELECT m.r, m.c FROM m JOIN a ON a.r = nr AND a.c = nc GROUP BY m.r, m.c HAVING count(*) = 5")
def morph_erode(spark, d):
    return raster.erode(pixels(spark, d).where("v >= 2"), raster.disc(1), 50, 40)


@query("morph_close", f"WITH {DILATED}, m AS (SELECT dil.r, dil.c, dil.r + dr AS nr, dil.c + dc AS nc FROM dil, k WHERE dil.r BETWEEN 1 AND 48 AND dil.c BETWEEN 1 AND 38) SELECT m.r, m.c FROM m JOIN dil ON dil.r = nr AND dil.c = nc GROUP BY m.r, m.c HAVING count(*) = 5")
def morph_close(spark, d):
    return raster.close(pixels(spark, d).where("v >= 5"), raster.disc(1), 50, 40)


OPENED = f"{ERODED}, opn AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM ero, k WHERE r BETWEEN 1 AND 48 AND c BETWEEN 1 AND 38)"


@query("morph_open", f"WITH {OPENED} SELECT r, c FROM opn")
def morph_open(spark, d):
    return raster.open(pixels(spark, d).where("v >= 2"), raster.disc(1), 50, 40)


@query("image_subtract", f"WITH {PIXELS} SELECT r, c FROM i WHERE v >= 2 AND v <> 4")
def image_subtract(spark, d):
    p = pixels(spark, d)
    return raster.subtract(p.where("v >= 2"), p.where("v = 4"))


@query("image_logic", f"WITH {PIXELS} SELECT r, c, v & 6 AS conj, v | 1 AS disj, xor(v, 3) AS excl, round(v * 0.25 + (6 - v) * 0.75, 8) AS mixed FROM i")
def image_logic(spark, d):
    p = pixels(spark, d)
    filled = lambda n: p.withColumn("v", F.lit(n))
    found = raster.combine(p, filled(6), "and").withColumnRenamed("v", "conj")
    found = found.join(raster.combine(p, filled(1), "or").withColumnRenamed("v", "disj"), ["r", "c"]).join(raster.combine(p, filled(3), "xor").withColumnRenamed("v", "excl"), ["r", "c"])
    mixed = raster.blend(p, p.withColumn("v", 6 - F.col("v")), 0.25).select("r", "c", F.round("v", 8).alias("mixed"))
    return found.join(mixed, ["r", "c"])


@query("image_confusion", f"""
WITH {PIXELS} SELECT count(*) FILTER (WHERE v >= 3 AND v % 2 = 0) AS tp, count(*) FILTER (WHERE v >= 3 AND v % 2 <> 0) AS fp, count(*) FILTER (WHERE v < 3 AND v % 2 = 0) AS fn,
    50 * 40 - count(*) FILTER (WHERE v >= 3 OR v % 2 = 0) AS tn FROM i""")
def image_confusion(spark, d):
    p = pixels(spark, d)
    return raster.confusion(p.where("v >= 3"), p.where("v % 2 = 0"), 50, 40)


@query("image_otsu", """
WITH h AS (SELECT p_size AS bin, count(*) AS w FROM part GROUP BY 1), s AS (SELECT bin, sum(w) OVER (ORDER BY bin) AS w0, sum(w * bin) OVER (ORDER BY bin) AS s0, sum(w) OVER () AS w, sum(w * bin) OVER () AS s FROM h),
b AS (SELECT bin, CASE WHEN w = w0 THEN 0 ELSE w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2 / (w * w) END AS between_ FROM s)
SELECT arg_max(bin, between_) AS threshold, round(max(between_), 6) AS between FROM b""")
def image_otsu(spark, d):
    h = table(spark, d, "part").groupBy(F.col("p_size").alias("bin")).agg(F.count("*").cast("double").alias("weight"))
    return raster.otsu(h).select("threshold", F.round("between", 6).alias("between"))


@query("image_stack", """
WITH s AS (SELECT l_linenumber AS image, CAST(l_quantity - 1 AS INTEGER) AS r, CAST(l_suppkey % 10 AS INTEGER) AS c, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT r, c, count(v) AS n, round(avg(v), 4) AS mean, round(coalesce(var_samp(v), 0), 0) AS variance, count(v) / 7.0 >= 0.9 AS complete FROM s WHERE v > 5000 GROUP BY r, c""")
def image_stack(spark, d):
    at = [F.col("l_linenumber").alias("image"), (F.col("l_quantity") - 1).cast("int").alias("r"), (F.col("l_suppkey") % 10).cast("int").alias("c")]
    stack = table(spark, d, "lineitem").groupBy(*at).agg(F.max("l_extendedprice").alias("v"))
    found = raster.stack_stats(stack, 7, F.col("v") > 5000)
    return found.select("r", "c", "n", F.round("mean", 4).alias("mean"), F.round("variance", 0).alias("variance"), (F.col("completeness") >= 0.9).alias("complete"))
