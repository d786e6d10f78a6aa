"""Property bags of parts and suppliers, and disjoint boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..operators import properties as p
from ..operators import spatial
from ..registry import query, table
from .spatial import BOXES, boxes


def bagged(spark, d):
    """Parts with a bag: every part a size, two of three a price, one of five a point."""
    k = F.col("p_partkey")
    held = p.bag(size=("int", F.col("p_size")), price=("double", F.when(k % 3 != 0, F.col("p_retailprice"))), label=("string", F.col("p_name")), even=("bool", k % 2 == 0), at=("vector", F.when(k % 5 == 0, v.vec(k % 7, k % 11, 0.5))))
    return table(spark, d, "part").select(k.alias("id"), (k % 10).alias("box_id"), held.alias("properties"))


@query("property_columns", "SELECT p_partkey AS id, CAST(p_size AS INTEGER) AS size, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS price, p_name AS label, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 11 AS DOUBLE) END AS y, p_partkey % 3 <> 0 AS priced FROM part")
def property_columns(spark, d):
    found = p.as_columns(bagged(spark, d), {"size": "int", "price": "double", "label": "string", "at": "vector"})
    return found.select("id", "size", "price", "label", F.col("at.y").alias("y"), p.has(F.col("properties"), "price", "double").alias("priced"))


@query("property_descriptor", """
SELECT * FROM (SELECT 'size' AS name, 'int' AS kinds, count(*) AS n FROM part UNION ALL SELECT 'price', 'double', count(*) FILTER (WHERE p_partkey % 3 <> 0) FROM part UNION ALL SELECT 'label', 'string', count(*) FROM part
UNION ALL SELECT 'even', 'bool', count(*) FROM part UNION ALL SELECT 'at', 'vector', count(*) FILTER (WHERE p_partkey % 5 = 0) FROM part) WHERE n > 0""")
def property_descriptor(spark, d):
    return p.descriptor(bagged(spark, d)).select("name", F.array_join("kinds", ",").alias("kinds"), "n")


@query("property_propagation", """
SELECT p_partkey AS id, CAST(CASE WHEN b.n IS NOT NULL THEN b.n ELSE p_size END AS INTEGER) AS size, b.name AS owner FROM part LEFT JOIN
(SELECT s_suppkey AS k, CAST(s_nationkey AS INTEGER) + 100 AS n, s_name AS name FROM supplier WHERE s_suppkey < 8) b ON b.k = p_partkey % 10""")
def property_propagation(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey < 8")
    held = s.select(F.col("s_suppkey").alias("box_id"), p.bag(size=("int", F.col("s_nationkey") + 100), owner=("string", F.col("s_name"))).alias("properties"))
    found = p.propagate(bagged(spark, d), held, "box_id")
    return p.as_columns(found, {"size": "int", "owner": "string"}).select("id", "size", "owner")


@query("boxes_disjoint", f"""WITH {BOXES}, c AS (SELECT id, unnest(generate_series(CAST(2 * x0 AS INT), CAST(2 * x1 AS INT) - 1)) AS i, y0, y1, z0, z1 FROM b),
e AS (SELECT id, i, unnest(generate_series(CAST(2 * y0 AS INT), CAST(2 * y1 AS INT) - 1)) AS j, z0, z1 FROM c), f AS (SELECT id, i, j, unnest(generate_series(CAST(2 * z0 AS INT), CAST(2 * z1 AS INT) - 1)) AS k FROM e),
owned AS (SELECT i, j, k, min(id) AS id FROM f GROUP BY i, j, k) SELECT id, count(*) / 8.0::DOUBLE AS volume FROM owned GROUP BY id""")
def boxes_disjoint(spark, d):
    """The boxes overlap, so each keeps what none of smaller id covers."""
    left = spatial.disjoint_boxes(boxes(spark, d))
    return left.groupBy("id").agg(F.round(F.sum(g.box_volume(F.col("box"))), 8).alias("volume"))
