"""Cross sections of a relief of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..operators import sections
from ..registry import query, table
from .spatial import terrain


def relief(spark, d) -> DataFrame:
    """A height field over quantities and suppliers, two triangles a square; heights are numbers of order lines."""
    at = [F.col("l_quantity").cast("long").alias("r"), (F.col("l_suppkey") % 40).cast("long").alias("c")]
    heights = table(spark, d, "lineitem").groupBy(*at).agg(F.count("*").cast("double").alias("h"))
    shifted = lambda n, dr, dc: heights.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("h").alias(n))
    squares = shifted("h00", 0, 0).join(shifted("h10", 1, 0), ["r", "c"]).join(shifted("h01", 0, 1), ["r", "c"]).join(shifted("h11", 1, 1), ["r", "c"])
    p = lambda dr, dc: v.vec(F.col("r") + dr, F.col("c") + dc, F.col(f"h{dr}{dc}"))
    both = F.array(g.triangle(p(0, 0), p(1, 0), p(0, 1)), g.triangle(p(1, 0), p(1, 1), p(0, 1)))
    return squares.select("r", "c", F.posexplode(both).alias("k", "tri")).select((F.col("r") * 80 + F.col("c") * 2 + F.col("k")).alias("id"), "tri")


RELIEF = """
hh AS (SELECT CAST(l_quantity AS BIGINT) AS r, l_suppkey % 40 AS c, CAST(count(*) AS DOUBLE) AS h FROM lineitem GROUP BY 1, 2),
lev AS (SELECT floor(avg(h)) + 0.5 AS cut_at FROM hh),
sq AS (SELECT a.r, a.c, a.h AS h00, b.h AS h10, e.h AS h01, f.h AS h11 FROM hh a JOIN hh b ON b.r = a.r + 1 AND b.c = a.c JOIN hh e ON e.r = a.r AND e.c = a.c + 1 JOIN hh f ON f.r = a.r + 1 AND f.c = a.c + 1),
tri AS (SELECT r * 80 + c * 2 AS id, [r * 100 + c, (r + 1) * 100 + c, r * 100 + c + 1] AS n, [h00, h10, h01] AS h FROM sq UNION ALL
    SELECT r * 80 + c * 2 + 1, [(r + 1) * 100 + c, (r + 1) * 100 + c + 1, r * 100 + c + 1], [h10, h11, h01] FROM sq),
edges AS (SELECT id, k, least(n[k], n[k % 3 + 1]) AS n0, greatest(n[k], n[k % 3 + 1]) AS n1, h[k] >= cut_at AS p, h[k % 3 + 1] >= cut_at AS q, CASE WHEN n[k] < n[k % 3 + 1] THEN h[k] ELSE h[k % 3 + 1] END AS h0,
    CASE WHEN n[k] < n[k % 3 + 1] THEN h[k % 3 + 1] ELSE h[k] END AS h1, cut_at FROM tri, lev, range(1, 4) x(k)),
cuts AS (SELECT id, q AS rising, n0, n1, n0 // 100 + (n1 // 100 - n0 // 100) * (cut_at - h0) / (h1 - h0) AS x, n0 % 100 + (n1 % 100 - n0 % 100) * (cut_at - h0) / (h1 - h0) AS y FROM edges WHERE p <> q),
segs AS (SELECT s.id, (s.n0, s.n1) AS sk, (e.n0, e.n1) AS ek, s.x AS x0, s.y AS y0, e.x AS x1, e.y AS y1 FROM cuts s JOIN cuts e ON e.id = s.id AND s.rising AND NOT e.rising)"""


def level(spark, d) -> float:
    squares = table(spark, d, "lineitem").groupBy("l_quantity", F.col("l_suppkey") % 40).agg(F.count("*").alias("h"))
    return squares.agg(F.floor(F.avg("h"))).first()[0] + 0.5


@query("section_lines", f"WITH {RELIEF} SELECT id, round(x0, 8) AS x0, round(y0, 8) AS y0, round(x1, 8) AS x1, round(y1, 8) AS y1 FROM segs")
def section_lines(spark, d):
    found = sections.section_lines(relief(spark, d), "z", level(spark, d))
    return found.select("id", *[F.round(F.col(e)[a], 8).alias(f"{a}{i}") for i, e in enumerate(("start", "end")) for a in "xy"])


@query("section_outlines", f"""
WITH RECURSIVE {RELIEF}, nxt AS (SELECT a.id, b.id AS after FROM segs a JOIN segs b ON a.ek = b.sk),
fwd AS (SELECT id AS a, id AS b FROM segs UNION SELECT fwd.a, nxt.after FROM fwd JOIN nxt ON nxt.id = fwd.b),
least_ AS (SELECT a AS id, min(b) AS f FROM fwd GROUP BY a), back AS (SELECT b AS id, min(a) AS f FROM fwd GROUP BY b),
comp AS (SELECT id, least(l.f, k.f) AS line FROM least_ l JOIN back k USING (id)),
heads AS (SELECT comp.line, coalesce(min(comp.id) FILTER (WHERE p.id IS NULL), comp.line) AS head, count(*) FILTER (WHERE p.id IS NULL) = 0 AS closed FROM comp LEFT JOIN nxt p ON p.after = comp.id GROUP BY comp.line),
walk AS (SELECT line, head, closed, head AS id, 0 AS ord FROM heads UNION ALL SELECT line, head, closed, nxt.after, ord + 1 FROM walk JOIN nxt ON nxt.id = walk.id WHERE nxt.after <> head)
SELECT id, line, CAST(ord AS BIGINT) AS ord, closed FROM walk""")
def section_outlines(spark, d):
    return sections.chained(sections.section_lines(relief(spark, d), "z", level(spark, d))).select("id", "line", "ord", "closed")


#: Level triangles meet a cell if its slab holds them and the triangle meets its square: an axis of each edge and of the square parts them or none does.
@query("section_cells", """
WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
g AS (SELECT i, j, k, i * 0.1 - 0.4 AS cx, j * 0.1 - 0.4 AS cy, k * 0.1 - 0.4 AS cz FROM range(9) a(i), range(9) b(j), range(9) c(k) WHERE i = 4 OR j = 4 OR k = 4),
m AS (SELECT DISTINCT i, j, k FROM g JOIN p ON abs(z - cz) <= 0.05 AND x <= cx + 0.05 AND x + 0.05 >= cx - 0.05 AND y <= cy + 0.05 AND y + 0.05 >= cy - 0.05
    AND 0.05 * (cy - y) - 0.01 * (cx - x) >= -0.05 * 0.06 AND -0.04 * (cy - y - 0.01) - 0.04 * (cx - x - 0.05) >= -0.05 * 0.08 AND -0.01 * (cy - y - 0.05) + 0.05 * (cx - x - 0.01) >= -0.05 * 0.06)
SELECT 'x' AS axis, j AS u, k AS w FROM m WHERE i = 4 UNION SELECT 'y', i, k FROM m WHERE j = 4 UNION SELECT 'z', i, j FROM m WHERE k = 4""")
def section_cells(spark, d):
    return sections.section_cells(terrain(spark, d), 0.1, (-0.4, -0.4, -0.4), (0.4, 0.4, 0.4))
