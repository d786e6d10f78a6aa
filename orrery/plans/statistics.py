"""Statistics, extremes, buckets and bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..operators import alignment, binning, stats
from ..registry import query, table


def rounded(df, digits: int = 4, whole: tuple[str, ...] = ()):
    """Doubles rounded, so that the order of summation doesn't show; ``whole`` to no digits."""
    return df.select(*[F.round(c, 0 if c in whole else digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("stats_running", """
SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(coalesce(var_samp(l_extendedprice), 0), 0) AS variance,
    round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_returnflag""")
def stats_running(spark, d):
    shipped = table(spark, d, "lineitem").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(stats.describe(shipped, "l_extendedprice", ["l_returnflag"]), whole=("variance",))


@query("stats_seeded_minmax", """
SELECT c_mktsegment, count(*) AS n, least(min(c_acctbal), 0) AS min, greatest(max(c_acctbal), 0) AS max FROM customer GROUP BY c_mktsegment""")
def stats_seeded_minmax(spark, d):
    return stats.describe(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"], seeded=True).select("c_mktsegment", "n", "min", "max")


@query("stats_merge", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(coalesce(var_samp(o_totalprice), 0) / 1000, 0) AS variance,
    min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def stats_merge(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate")).withColumn("month", F.month("o_orderdate"))
    merged = stats.merge_states(stats.describe(o, "o_totalprice", ["year", "month"]), ["year"])
    return rounded(merged.withColumn("variance", F.col("variance") / 1000), whole=("variance",))


@query("stats_vector", """
SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 9) AS x_mean, round(avg(CAST(embedding[2] AS DOUBLE)), 9) AS y_mean,
    round(var_samp(CAST(embedding[3] AS DOUBLE)), 9) AS z_variance, count(*) AS z_n FROM embeddings GROUP BY label""")
def stats_vector(spark, d):
    from .spatial import points

    found = points(spark, d).groupBy("label").agg(*stats.vector_stats("pos"))
    return rounded(found.select("label", "x_mean", "y_mean", "z_variance", "z_n"), 9)


@query("stats_color", """
SELECT p_brand, CAST(trunc(avg(p_size * 5)) AS INTEGER) AS r_mean, min(p_size * 5) AS r_min, max(p_size * 5) AS r_max, CAST(trunc(avg(p_partkey % 200)) AS INTEGER) AS g_mean
FROM part GROUP BY p_brand""")
def stats_color(spark, d):
    color = F.struct((F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 200).cast("int").alias("g"), F.lit(7).alias("b"))
    return table(spark, d, "part").withColumn("color", color).groupBy("p_brand").agg(*stats.color_stats("color")).select("p_brand", "r_mean", "r_min", "r_max", "g_mean")


@query("circular_mean", """
SELECT event_type, round(atan2(avg(sin(radians(value))), avg(cos(radians(value)))), 8) AS mean,
    round(sqrt(avg(sin(radians(value))) ** 2 + avg(cos(radians(value))) ** 2), 8) AS resultant FROM events GROUP BY event_type""")
def circular_mean(spark, d):
    return rounded(table(spark, d, "events").groupBy("event_type").agg(*stats.circular(F.radians("value"))), 8)


WRAPPED = "CASE WHEN {0} > pi() THEN {0} - 2 * pi() WHEN {0} < -pi() THEN {0} + 2 * pi() ELSE {0} END"
STEP = WRAPPED.format("(x.a - s.mean)")


@query("circular_running", f"""
WITH e AS (SELECT user_id, event_id, radians(value % 360) AS a FROM events),
g AS (SELECT user_id, list(struct_pack(n := 1.0::DOUBLE, mean := {WRAPPED.format('a')}, m2 := 0.0::DOUBLE, a := a) ORDER BY event_id, a) AS l FROM e WHERE a IS NOT NULL GROUP BY user_id),
r AS (SELECT user_id, list_reduce(l, lambda s, x: struct_pack(n := s.n + 1, mean := s.mean + ({STEP}) / (s.n + 1), m2 := s.m2 + ({STEP}) * ({STEP}) * s.n / (s.n + 1), a := x.a)) AS s FROM g)
SELECT user_id, CAST(s.n AS BIGINT) AS n, round(s.mean, 8) AS mean, round(CASE WHEN s.n > 1 THEN s.m2 / (s.n - 1) ELSE 0 END, 8) AS variance FROM r""")
def circular_running(spark, d):
    e = table(spark, d, "events").withColumn("angle", F.radians(F.col("value") % 360))
    return rounded(stats.circular_running(e, "angle", "event_id", ["user_id"]), 8)


@query("wmean", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS wmean FROM lineitem GROUP BY l_returnflag")
def wmean(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(stats.weighted_mean("l_extendedprice", "l_quantity").alias("wmean")))


@query("wmedian", """
WITH s AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM s)
SELECT l_returnflag, min(v) AS median FROM r WHERE run * 2 >= total GROUP BY l_returnflag""")
def wmedian(spark, d):
    return stats.weighted_median(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query("median_even", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY o_orderpriority")
def median_even(spark, d):
    return rounded(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("median")))


@query("median_rounded", "SELECT p_brand, CAST(round_even(median(p_size), 0) AS BIGINT) AS median FROM part GROUP BY p_brand")
def median_rounded(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(stats.median_rounded("p_size").alias("median"))


@query("rmse", "SELECT l_linestatus, round(sqrt(avg((l_discount - 0.05) * (l_discount - 0.05))), 8) AS rmse FROM lineitem GROUP BY l_linestatus")
def rmse(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_linestatus").agg(stats.rmse(F.col("l_discount") - 0.05).alias("rmse")), 8)


@query("stddev_samp", "SELECT l_linestatus, round(stddev_samp(l_tax), 8) AS deviation FROM lineitem GROUP BY l_linestatus")
def stddev_samp(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.stddev_samp("l_tax").alias("deviation")), 8)


@query("argmin_ties", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM part) WHERE k = 1")
def argmin_ties(spark, d):
    return stats.extremes(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_size", ["p_brand"])


@query("argmax_ties", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS k FROM part) WHERE k = 1")
def argmax_ties(spark, d):
    return stats.extremes(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_size", ["p_brand"], largest=True)


@query("argmax_global", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)")
def argmax_global(spark, d):
    return stats.extremes(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", largest=True)


@query("max_count_keys", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM c) WHERE k = 1""")
def max_count_keys(spark, d):
    return stats.most_frequent(table(spark, d, "events"), "event_type", ["user_id"])


@query("bucket_list", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def bucket_list(spark, d):
    found = table(spark, d, "orders").groupBy("o_custkey").agg(stats.bucket_list("o_orderkey", "orders"))
    return found.select("o_custkey", F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"))


@query("bucket_set", "SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand")
def bucket_set(spark, d):
    found = table(spark, d, "part").groupBy("p_brand").agg(stats.bucket_set("p_type", "types"))
    return found.select("p_brand", F.array_join("types", ",").alias("types"))


@query("all_distinct", "SELECT count(*) = count(DISTINCT p_partkey) AS p_partkey, count(*) = count(DISTINCT p_name) AS p_name FROM part")
def all_distinct(spark, d):
    return stats.distinct_flags(table(spark, d, "part"), ["p_partkey", "p_name"])


@query("minmax_pair", "SELECT min(o_custkey) AS low_a, min(o_totalprice) AS low_b, max(o_custkey) AS high_a, max(o_totalprice) AS high_b FROM orders")
def minmax_pair(spark, d):
    found = table(spark, d, "orders").agg(*stats.pair_extremes("o_custkey", "o_totalprice"))
    return found.select(F.col("low.o_custkey").alias("low_a"), F.col("low.o_totalprice").alias("low_b"), F.col("high.o_custkey").alias("high_a"), F.col("high.o_totalprice").alias("high_b"))


@query("any_all", "SELECT event_type, bool_and(value > 0) AS every, bool_or(value > 300) AS some FROM events GROUP BY event_type")
def any_all(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.every(F.col("value") > 0).alias("every"), F.some(F.col("value") > 300).alias("some"))


@query("hist_trunc", "SELECT event_type, CAST(trunc((value - 25.0) / 10.0) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1, 2")
def hist_trunc(spark, d):
    return binning.histogram(table(spark, d, "events"), "value", 10.0, 25.0, by=["event_type"])


@query("hist_weighted", "SELECT CAST(trunc(l_extendedprice / 5000.0) AS BIGINT) AS bin, sum(l_quantity) AS weight FROM lineitem GROUP BY 1")
def hist_weighted(spark, d):
    return binning.histogram(table(spark, d, "lineitem"), "l_extendedprice", 5000.0, weight="l_quantity")


@query("hist_dense", """
WITH h AS (SELECT CAST(trunc(value / 2.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1),
b AS (SELECT unnest(generate_series((SELECT min(bin) FROM h), (SELECT max(bin) - 1 FROM h))) AS bin)
SELECT b.bin, CAST(coalesce(n, 0) AS DOUBLE) AS weight FROM b LEFT JOIN h ON h.bin = b.bin""")
def hist_dense(spark, d):
    return binning.dense(binning.histogram(table(spark, d, "events"), "value", 2.0), include_last=False)


@query("hist_merge", "SELECT CAST(trunc(value / 10.0) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1")
def hist_merge(spark, d):
    e = table(spark, d, "events")
    return binning.merge_histograms(*[binning.histogram(e.where(t), "value", 10.0) for t in ("user_id % 2 = 0", "user_id % 2 <> 0")])


@query("hist_stats", """
SELECT CAST(trunc(l_quantity / 5.0) AS BIGINT) AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(coalesce(var_samp(l_extendedprice), 0), 0) AS variance
FROM lineitem GROUP BY 1""")
def hist_stats(spark, d):
    return rounded(binning.binned_stats(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 5.0).drop("min", "max"), whole=("variance",))


HEAT = """SELECT CAST(trunc(l_quantity / 5.0) AS BIGINT) AS bx, CAST(trunc(l_extendedprice / 10000.0) AS BIGINT) AS "by", CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2"""


def _heat(spark, d):
    return binning.heatmap(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", (5.0, 10000.0))


@query("heat2d", HEAT)
def heat2d(spark, d):
    return _heat(spark, d)


@query("heat_dense", f"""
WITH h AS ({HEAT}), x AS (SELECT unnest(generate_series((SELECT min(bx) FROM h), (SELECT max(bx) FROM h))) AS bx),
y AS (SELECT unnest(generate_series((SELECT min("by") FROM h), (SELECT max("by") FROM h))) AS "by")
SELECT x.bx, y."by", coalesce(weight, 0) AS weight FROM x CROSS JOIN y LEFT JOIN h ON h.bx = x.bx AND h."by" = y."by" """)
def heat_dense(spark, d):
    return binning.dense_heatmap(_heat(spark, d))


@query("heat_marginals", f"""
WITH h AS ({HEAT}) SELECT 'x' AS axis, bx AS bin, sum(weight) AS weight FROM h GROUP BY bx UNION ALL SELECT 'y', "by", sum(weight) FROM h GROUP BY "by" """)
def heat_marginals(spark, d):
    return binning.marginals(_heat(spark, d))


@query("heat2d_stats", """
SELECT CAST(trunc(l_quantity / 10.0) AS BIGINT) AS bx, CAST(trunc(l_extendedprice / 20000.0) AS BIGINT) AS "by", count(*) AS n, round(avg(l_tax), 8) AS mean,
    round(coalesce(var_samp(l_tax), 0), 8) AS variance FROM lineitem GROUP BY 1, 2""")
def heat2d_stats(spark, d):
    return rounded(binning.binned_stats_2d(table(spark, d, "lineitem"), "l_tax", "l_quantity", "l_extendedprice", (10.0, 20000.0)).drop("min", "max"), 8)


@query("heat2d_stats_merge", """
SELECT CAST(trunc(l_quantity / 10.0) AS BIGINT) AS bx, CAST(trunc(l_extendedprice / 20000.0) AS BIGINT) AS "by", count(*) AS n, round(avg(l_tax), 8) AS mean,
    round(coalesce(var_samp(l_tax), 0), 8) AS variance FROM lineitem GROUP BY 1, 2""")
def heat2d_stats_merge(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    parts = [binning.binned_stats_2d(l.where(f"l_returnflag {t} 'R'"), "l_tax", "l_quantity", "l_extendedprice", (10.0, 20000.0)) for t in ("=", "<>")]
    return rounded(binning.merge_binned_stats(*parts).drop("min", "max"), 8)


@query("fit_plane", """
SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 9) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 9) AS y, count(*) AS n, true AS unit_normal FROM embeddings GROUP BY label""")
def fit_plane(spark, d):
    from .spatial import points

    p = points(spark, d).select("label", "pos.*")
    found = stats.fit_plane(p, "x", "y", "z", ["label"])
    length = sum((F.col("normal")[a] * F.col("normal")[a] for a in "yz"), F.col("normal")["x"] * F.col("normal")["x"])
    return rounded(found.select("label", F.col("origin.x").alias("x"), F.col("origin.y").alias("y"), "n", (F.abs(length - 1) < 1e-9).alias("unit_normal")), 9)


E = "CAST(embedding[{}] AS DOUBLE)"


@query("pose_stats", f"""
WITH p AS (SELECT label, {E.format(1)} AS x, {E.format(2)} AS y FROM embeddings)
SELECT label, count(*) AS n, round(avg(x), 9) AS x, round(var_samp(y), 9) AS y_variance, round(atan2(avg(sin(x)), avg(cos(x))), 9) AS z_angle, round(sqrt(avg(sin(x)) ** 2 + avg(cos(x)) ** 2), 9) AS z_resultant
FROM p GROUP BY label""")
def pose_stats(spark, d):
    """Poses turned about Z by their own X."""
    from .spatial import points

    p = F.col("pos")
    found = stats.pose_stats(points(spark, d).withColumn("pose", g.pose(v.rotation_z(p["x"]), p)), by=["label"])
    return rounded(found.select("label", "n", g.pose_position(F.col("mean"))["x"].alias("x"), F.col("position_variance.y").alias("y_variance"), F.col("angles.z").alias("z_angle"), F.col("resultant.z").alias("z_resultant")), 9)


@query("vector_averages", f"""
WITH p AS (SELECT vec_id, vec_id % 7 + 1 AS w, {E.format(1)} AS x, {E.format(2)} AS y, {E.format(3)} AS z FROM embeddings),
r AS (SELECT *, sum(w) OVER (ORDER BY x) AS rx, sum(w) OVER (ORDER BY z) AS rz, sum(w) OVER () AS a FROM p)
SELECT round(sum(w * x) / sum(w), 9) AS mean_x, round(avg(y), 9) AS mean_y, round(median(z), 9) AS median_z, round(min(x) FILTER (WHERE 2 * rx >= a), 9) AS wmedian_x, round(min(z) FILTER (WHERE 2 * rz >= a), 9) AS wmedian_z FROM r""")
def vector_averages(spark, d):
    from .spatial import points

    rows = points(spark, d).withColumn("w", F.col("id") % 7 + 1)
    one = rows.agg(stats.mean_vector("pos", "w")["x"].alias("mean_x"), stats.mean_vector("pos")["y"].alias("mean_y"), stats.median_vector("pos")["z"].alias("median_z"))
    mid = stats.weighted_median_vector(rows, "pos", "w").select(F.col("median.x").alias("wmedian_x"), F.col("median.z").alias("wmedian_z"))
    return rounded(one.crossJoin(mid), 9)  # a row each


@query("orientation_bins", f"""
WITH p AS (SELECT {E.format(1)} AS x, {E.format(2)} AS y, {E.format(3)} AS z FROM embeddings), n AS (SELECT x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM p) WHERE l > 0),
t AS (SELECT CASE WHEN z < 0 THEN -x ELSE x END AS x, CASE WHEN z < 0 THEN -y ELSE y END AS y, abs(z) AS z FROM n), o AS (SELECT degrees(atan2(y, x)) AS a, degrees(acos(least(1, z))) AS i FROM t)
SELECT CAST(floor(CASE WHEN a < 0 THEN a + 360 ELSE a END) AS INT) AS azimuth, CAST(floor(i) AS INT) AS tilt, count(*) AS weight FROM o GROUP BY 1, 2""")
def orientation_bins(spark, d):
    from .spatial import points

    normals = points(spark, d).select(v.unit(F.col("pos")).alias("normal"), F.lit(1).alias("weight"))
    return alignment.orientation_bins(normals, (0.0, 0.0, 1.0), (1.0, 0.0, 0.0))


def facings(spark, d):
    """A normal of eight mirrored directions for each order line, weighted by its quantity."""
    flip = lambda c, k: F.when(F.col(c) % k == 0, -1.0).otherwise(1.0)
    normal = v.unit(v.vec((F.col("l_discount") - 0.0437) * flip("l_linenumber", 2), (F.col("l_tax") - 0.0391) * flip("l_linenumber", 3), flip("l_orderkey", 2) * 0.12))
    return table(spark, d, "lineitem").select(normal.alias("normal"), F.col("l_quantity").alias("weight"))


NORMAL_GRID = """
raw AS (SELECT (l_discount - 0.0437) * CASE WHEN l_linenumber % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS x, (l_tax - 0.0391) * CASE WHEN l_linenumber % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS y,
    CASE WHEN l_orderkey % 2 = 0 THEN -0.12::DOUBLE ELSE 0.12::DOUBLE END AS z, l_quantity AS w FROM lineitem),
nrm AS (SELECT x / l AS x, y / l AS y, z / l AS z, CASE WHEN z < 0 THEN -1 ELSE 1 END AS s, w FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM raw)),
c AS (SELECT CAST(floor(abs(abs(degrees(atan2(x, y))) - 90)) AS INTEGER) % 90 AS azimuth, CAST(floor(90 - abs(degrees(acos(z)) - 90)) AS INTEGER) AS tilt,
    CAST(x * s >= 0 AS INTEGER) * 2 + CAST(y * s >= 0 AS INTEGER) AS side, x * s AS x, y * s AS y, z * s AS z, w FROM nrm WHERE 90 - abs(degrees(acos(z)) - 90) < 40),
sums AS (SELECT azimuth, tilt, side, count(*) AS n, sum(w) AS weight, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM c GROUP BY 1, 2, 3),
near AS (SELECT a.azimuth, a.tilt, a.side, b.side AS other FROM sums a JOIN sums b USING (azimuth, tilt)
    WHERE a.side = b.side OR (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x ** 2 + a.y ** 2 + a.z ** 2) * sqrt(b.x ** 2 + b.y ** 2 + b.z ** 2)) > cos(radians(2))),
l1 AS (SELECT azimuth, tilt, side, min(other) AS k FROM near GROUP BY 1, 2, 3),
l2 AS (SELECT near.azimuth, near.tilt, near.side, min(k) AS k FROM near JOIN l1 ON l1.azimuth = near.azimuth AND l1.tilt = near.tilt AND l1.side = near.other GROUP BY 1, 2, 3),
l3 AS (SELECT near.azimuth, near.tilt, near.side, min(k) AS k FROM near JOIN l2 ON l2.azimuth = near.azimuth AND l2.tilt = near.tilt AND l2.side = near.other GROUP BY 1, 2, 3),
clusters AS (SELECT azimuth, tilt, k, sum(n) AS n, sum(weight) AS weight, sum(sum(n)) OVER (PARTITION BY azimuth, tilt) AS whole FROM sums JOIN l3 USING (azimuth, tilt, side) GROUP BY 1, 2, 3),
best AS (SELECT * FROM clusters QUALIFY row_number() OVER (PARTITION BY azimuth, tilt ORDER BY n DESC, k) = 1)"""


@query("normal_clusters", f"WITH {NORMAL_GRID} SELECT azimuth, tilt, CAST(n AS BIGINT) AS n, round(weight, 6) AS weight, CAST(whole - n AS BIGINT) AS removed FROM best")
def normal_clusters(spark, d):
    found = alignment.main_clusters(alignment.upright_cells(facings(spark, d), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)))
    return found.select("azimuth", "tilt", "n", F.round("weight", 6).alias("weight"), "removed").distinct()


@query("upright_clusters", f"""
WITH RECURSIVE {NORMAL_GRID}, peaks AS (SELECT azimuth, tilt, weight, azimuth * 40 + tilt AS cell FROM best WHERE weight >= 0.02 * (SELECT max(weight) FROM best)),
touch AS (SELECT a.cell AS a, b.cell AS b FROM peaks a JOIN peaks b ON a.cell = b.cell OR (abs(a.tilt - b.tilt) <= 1 AND (a.azimuth - b.azimuth + 91) % 90 <= 2) OR (a.tilt = 0 AND b.tilt = 0)),
reach AS (SELECT cell AS a, cell AS b FROM peaks UNION SELECT reach.a, touch.b FROM reach JOIN touch ON touch.a = reach.b),
named AS (SELECT a AS cell, min(b) AS cluster FROM reach GROUP BY a),
heavy AS (SELECT cluster FROM named JOIN peaks USING (cell) GROUP BY cluster ORDER BY sum(weight) DESC, cluster LIMIT 1),
kept AS (SELECT p.azimuth, p.tilt, l3.side FROM named JOIN heavy USING (cluster) JOIN peaks p USING (cell) JOIN best b ON b.azimuth = p.azimuth AND b.tilt = p.tilt JOIN l3 ON l3.azimuth = b.azimuth AND l3.tilt = b.tilt AND l3.k = b.k),
mean AS (SELECT sum(x * w) AS x, sum(y * w) AS y, sum(z * w) AS z, count(*) AS n FROM c JOIN kept USING (azimuth, tilt, side))
SELECT round(x / sqrt(x * x + y * y + z * z), 7) AS x, round(y / sqrt(x * x + y * y + z * z), 7) AS y, round(z / sqrt(x * x + y * y + z * z), 7) AS z, n FROM mean""")
def upright_clusters(spark, d):
    found = alignment.upright_by_clusters(facings(spark, d), peak=0.02)
    return found.select(*[F.round(a, 7).alias(a) for a in "xyz"], "n")
