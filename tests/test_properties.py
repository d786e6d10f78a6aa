"""Property bags, values of faces at vertices, and disjoint boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vectors as v
from orrery.operators import properties as p
from orrery.operators import spatial


def test_every_kind_comes_back(spark):
    given = {"bool": True, "byte": 200, "int": -7, "long": 1 << 40, "float": 0.5, "double": 1e300, "string": "é"}
    held = {k: (k, F.lit(x)) for k, x in given.items()}
    held |= {"vector": ("vector", v.vec(1.0, 2.0, 3.0)), "color": ("color", F.struct(*[F.lit(i).alias(c) for i, c in enumerate("rgba")])), "none": ("int", F.lit(None))}
    row = spark.range(1).select(p.bag(**held).alias("b"))
    kinds = {k: k for k in p.KINDS}
    got = p.as_columns(row, kinds, "b").select(*kinds).first()
    assert {k: got[k] for k in given} == given and tuple(got["vector"]) == (1.0, 2.0, 3.0) and tuple(got["color"]) == (0, 1, 2, 3)
    b = F.col("b")
    seen = row.select(p.names(b).alias("n"), p.names(b, "int").alias("i"), p.has(b, "none").alias("no"), p.has(b, "int", "long").alias("kind"), p.get(b, "none", "int").alias("null")).first()
    assert seen.n == sorted(p.KINDS) and seen.i == ["int"] and not seen.no and not seen.kind and seen.null is None
    with pytest.raises(Exception, match="int is no long but a int"):
        row.select(p.get(b, "int", "long")).collect()
    with pytest.raises(ValueError):
        p.entry("number", 1)


def test_put_propagate_and_descriptor(spark):
    rows = spark.range(4).select("id", (F.col("id") % 2).alias("k"), F.when(F.col("id") < 3, p.bag(a=("int", F.col("id")), c=("string", F.lit("own")))).alias("properties"))
    rows = rows.withColumn("properties", p.put(F.col("properties"), "a", "double", F.when(F.col("id") == 1, 2.5)))
    seen = {r.name: (r.kinds, r.n) for r in p.descriptor(rows).collect()}
    assert seen == {"a": (["double"], 1), "c": (["string"], 3)}
    other = p.descriptor(spark.range(1).select(p.bag(a=("int", F.lit(1))).alias("properties")))
    assert [(r.name, r.kind) for r in p.missing(other, p.descriptor(rows)).collect()] == [("a", "int")]
    boxes = spark.createDataFrame([(1,)], "k long").select("k", p.bag(c=("string", F.lit("box")), d=("bool", F.lit(False))).alias("properties"))
    got = p.as_columns(p.propagate(rows, boxes, "k"), {"a": "double", "c": "string", "d": "bool"}).orderBy("id").collect()
    assert [(r.a, r.c, r.d) for r in got] == [(None, "own", None), (2.5, "box", False), (None, "own", None), (None, "box", False)]
    assert p.descriptor(rows.where("false")).collect() == []


def test_faces_to_vertices(spark):
    vertices = spark.range(5).select(F.col("id").alias("vertex_id"), F.lit("x").alias("w"))
    faces = spark.createDataFrame([(0, 0, 1, 2, 1.0), (1, 1, 2, 3, 3.0), (2, 2, 3, 3, None)], "face_id long, v1 long, v2 long, v3 long, w double")
    got = {r.vertex_id: r.w for r in p.faces_to_vertices(vertices, faces, ["w"]).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 2.0, 3: 3.0, 4: None}
    assert sorted(r.value for r in p.values(faces, F.coalesce("w", F.lit(0.0))).collect()) == [0.0, 1.0, 3.0]


@pytest.mark.parametrize("chunk", [1, 3, 32])
def test_disjoint_boxes(spark, chunk):
    rng = np.random.default_rng(1)
    low = rng.integers(0, 8, size=(30, 3))
    high = low + rng.integers(1, 5, size=(30, 3))
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(low, high))]
    boxes = spark.createDataFrame(rows, "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double").select("id", g.box(v.vec("x0", "y0", "z0"), v.vec("x1", "y1", "z1")).alias("box"))
    left = spatial.disjoint_boxes(boxes, chunk).collect()
    owner = {}
    for i, (a, b) in enumerate(zip(low, high)):
        for cell in np.ndindex(*(b - a)):
            owner.setdefault(tuple(int(x) for x in a + cell), i)
    got = {}
    for r in left:
        a, b = ([int(r.box[e][k]) for k in "xyz"] for e in ("min", "max"))
        for cell in np.ndindex(*np.subtract(b, a)):
            at = tuple(int(x) for x in np.add(a, cell))
            assert at not in got
            got[at] = r.id
    assert got == owner
    assert spatial.disjoint_boxes(boxes.where("id = 3"), chunk).count() == 1
