"""JSON documents, result tables, quads, and rays at points."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vectors as v
from orrery.operators import grid
from orrery.sources import documents


def test_points_are_one_json_document(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1.0), (1, None), (3, 1e-7)], "i int, x double").select("i", F.when(F.col("x").isNotNull(), v.vec("x", 2.0, 3.0)).alias("pos"))
    documents.write_points_json(rows, f"{tmp_path}/a", ["i"], "cloud")
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*"))
    assert json.loads(text) == {"cloud": [[], [1.0, 2.0, 3.0], [1e-7, 2.0, 3.0]]}
    assert [(r.ord, r.pos and r.pos.x) for r in documents.read_points_json(spark, f"{tmp_path}/a").orderBy("ord").collect()] == [(0, None), (1, 1.0), (2, 1e-7)]
    documents.write_points_json(rows.where("false"), f"{tmp_path}/b", ["i"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "b").glob("part-*"))) == {"points": []}
    one = spark.range(1).select(documents.document(a=F.lit(1.5), b=v.vec(1.0, 2.0, 3.0), c=F.array(F.array(F.lit(1), F.lit(0)))).alias("d")).first().d
    assert json.loads(one) == {"a": 1.5, "b": {"x": 1.0, "y": 2.0, "z": 3.0}, "c": [[1, 0]]} and "\n" in one


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, 0.12345), ("a", 1, None)], "name string, n long, mean double")
    for single in (True, False):
        documents.write_results(rows, f"{tmp_path}/{single}", ["name", "n", "mean"], ["name"], single=single)
        got = documents.read_results(spark, f"{tmp_path}/{single}", "name string, n long, mean double").orderBy("name").collect()
        assert [tuple(r) for r in got] == [("a", 1, None), ("b", 2, 0.1235)]
    assert "".join(p.read_text() for p in (tmp_path / "True").glob("part-*")) == "name; n; mean\na; 1; \nb; 2; 0.1235\n"


def test_quads_and_points_on_rays(spark):
    corner = [v.vec(*map(float, p)) for p in ((0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0))]
    q = g.quad(*corner)
    down = lambda x, y: g.ray(v.vec(x, y, 3.0), v.vec(0.0, 0.0, -1.0))
    found = spark.range(1).select(
        g.quad_distance(q, v.vec(1.0, 1.5, 2.0)).alias("over"), g.quad_distance(q, v.vec(3.0, 3.0, 0.0)).alias("beside"),
        g.ray_quad_hits(down(0.5, 1.5), q).alias("hit"), g.ray_quad_hits(down(2.5, 1.5), q).alias("miss"),
        g.quad_hits_box(q, g.box(v.vec(0.1, 1.5, -1.0), v.vec(0.2, 1.6, 1.0))).alias("box"), g.quad_hits_box(q, g.box(v.vec(3.0, 3.0, 3.0), v.vec(4.0, 4.0, 4.0))).alias("no_box"),
        g.ray_meets_point(down(1.0, 1.0), v.vec(1.0, 1.0, 1.0)).alias("met"), g.ray_meets_point(down(1.0, 1.0), v.vec(1.0, 1.1, 1.0)).alias("passed"), g.ray_meets_point(down(1.0, 1.0), v.vec(1.0, 1.0, 4.0)).alias("behind"),
    ).first()
    assert found.over == 2 and abs(found.beside - math.sqrt(2)) < 1e-12 and found.hit == [3.0] and found.miss == []
    assert found.box and not found.no_box and found.met == 2.0 and found.passed is None and found.behind is None


def test_cells_out_of_a_crop_and_slices(spark):
    cells = spark.createDataFrame([(0, 1, 2, 5.0)], "x long, y long, z long, v double")
    turned = grid.from_crop(grid.to_world(cells, 1.0, (0.0, 0.0, 0.0)), v.rotation_z(F.lit(math.pi / 2)), (0.5, 0.5, 0.0)).first()
    assert np.allclose([turned.pos[a] for a in "xyz"], [-0.5, 0.5, 2.5])
    assert [tuple(r) for r in grid.slices(cells, "y").collect()] == [(1, 0, 2, 5.0)]
