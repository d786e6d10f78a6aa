"""Boxes, rectangles, triangles, planes and rays as Columns.

A box is ``struct<min, max>`` of vectors, a plane ``struct<origin, normal>``, a ray
``struct<origin, direction>``, a triangle ``struct<a, b, c>``.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as v

HUGE = sys.float_info.max


def box(low: Column, high: Column) -> Column:
    return F.struct(low.alias("min"), high.alias("max"))


def box_from_center(center: Column, size: Column) -> Column:
    half = v.scale(size, 0.5)
    return box(v.subtract(center, half), v.add(center, half))


def box_center(b: Column) -> Column:
    return v.scale(v.add(b["min"], b["max"]), 0.5)


def box_size(b: Column) -> Column:
    return v.subtract(b["max"], b["min"])


def box_volume(b: Column) -> Column:
    s = box_size(b)
    return s["x"] * s["y"] * s["z"]


def _all(test) -> Column:
    found = test("x")
    for axis in "yz":
        found = found & test(axis)
    return found


def box_contains(b: Column, p: Column) -> Column:
    """Closed: points on a face are inside."""
    return _all(lambda a: (p[a] >= b["min"][a]) & (p[a] <= b["max"][a]))


def boxes_intersect(a: Column, b: Column) -> Column:
    """Closed: touching boxes intersect."""
    return _all(lambda x: (a["min"][x] <= b["max"][x]) & (b["min"][x] <= a["max"][x]))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Strict: touching boxes don't overlap."""
    return _all(lambda x: (a["min"][x] < b["max"][x]) & (b["min"][x] < a["max"][x]))


def boxes_equal(a: Column, b: Column) -> Column:
    return v.approx_equal(a["min"], b["min"]) & v.approx_equal(a["max"], b["max"])


def box_distance(b: Column, p: Column) -> Column:
    """Distance of a point from a box, 0 inside."""
    return v.norm(v.vec(*[F.greatest(b["min"][a] - p[a], F.lit(0.0), p[a] - b["max"][a]) for a in v.AXES]))


@v.bound
def box_difference(a: Column, b: Column) -> Column:
    """``array<box>``: what is left of ``a`` without ``b``, up to six disjoint boxes, slabs of x, then y, then z."""
    low, high = a["min"], a["max"]
    inner = {x: (F.greatest(low[x], b["min"][x]), F.least(high[x], b["max"][x])) for x in v.AXES}
    rest = []
    for i, axis in enumerate(v.AXES):
        for above in (True, False):
            bounds = []
            for j, x in enumerate(v.AXES):
                if j < i:
                    bounds.append(inner[x])
                elif j > i:
                    bounds.append((low[x], high[x]))
                else:
                    bounds.append((b["max"][x], high[x]) if above else (low[x], b["min"][x]))
            piece = box(v.vec(*[p[0] for p in bounds]), v.vec(*[p[1] for p in bounds]))
            there = high[axis] > b["max"][axis] if above else low[axis] < b["min"][axis]
            rest.append(F.when(there, piece))
    return F.when(boxes_overlap(a, b), F.array_compact(F.array(*rest))).otherwise(F.array(box(low, high)))


@v.bound
def rectangle_difference(a: Column, b: Column) -> Column:
    """The same for rectangles ``struct<u0, v0, u1, v1>``: up to four."""
    rect = lambda u0, v0, u1, v1: F.struct(u0.alias("u0"), v0.alias("v0"), u1.alias("u1"), v1.alias("v1"))
    u0, u1 = F.greatest(a["u0"], b["u0"]), F.least(a["u1"], b["u1"])
    rest = [
        F.when(a["u1"] > b["u1"], rect(b["u1"], a["v0"], a["u1"], a["v1"])),
        F.when(a["u0"] < b["u0"], rect(a["u0"], a["v0"], b["u0"], a["v1"])),
        F.when(a["v1"] > b["v1"], rect(u0, b["v1"], u1, a["v1"])),
        F.when(a["v0"] < b["v0"], rect(u0, a["v0"], u1, b["v0"])),
    ]
    whole = F.array(rect(a["u0"], a["v0"], a["u1"], a["v1"]))
    return F.when(rectangles_overlap(a, b), F.array_compact(F.array(*rest))).otherwise(whole)


def rectangles_touch(a: Column, b: Column) -> Column:
    return (a["u0"] <= b["u1"]) & (b["u0"] <= a["u1"]) & (a["v0"] <= b["v1"]) & (b["v0"] <= a["v1"])


def rectangles_overlap(a: Column, b: Column) -> Column:
    return (a["u0"] < b["u1"]) & (b["u0"] < a["u1"]) & (a["v0"] < b["v1"]) & (b["v0"] < a["v1"])


def rectangle_box(axis: str, at, low_u, low_v, high_u, high_v) -> Column:
    """A rectangle at right angles to an axis, as a box without extent along it; box and ray functions take it as such.

    u and v are the two other axes in order.
    """
    corner = lambda u, w: v.with_axis(F.struct(v.col(u).cast("double").alias("u"), v.col(w).cast("double").alias("v")), axis, v.col(at))
    return box(corner(low_u, low_v), corner(high_u, high_v))


# --- rays -------------------------------------------------------------------------------


def ray(origin: Column, towards: Column) -> Column:
    """A ray with a direction of length 1."""
    return F.struct(origin.alias("origin"), v.unit(towards).alias("direction"))


@v.bound
def ray_at(r: Column, distance) -> Column:
    """The point at a distance; the origin for a negative one."""
    return v.add(r["origin"], v.scale(r["direction"], F.greatest(v.col(distance), F.lit(0.0))))


@v.bound
def ray_point_distance(r: Column, p: Column) -> Column:
    """Distance of a point from the ray's line."""
    return v.norm(v.cross(r["direction"], v.subtract(p, r["origin"])))


@v.bound
def ray_samples(r: Column, length: float, step: float) -> Column:
    """``array<vec>``: points along the ray, both ends included."""
    n = int(length / step + 1e-9)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: ray_at(r, i * F.lit(step)))


@v.bound
def segment_samples(a: Column, b: Column, step: float) -> Column:
    """``array<vec>``: points from ``a`` towards ``b`` at every ``step``, the start included."""
    way = v.direction(a, b)
    n = F.floor(v.distance(a, b) / step).cast("int")
    moved = F.transform(F.sequence(F.lit(0), n), lambda i: v.add(a, v.scale(way, i * F.lit(step))))
    return F.when(v.distance(a, b) == 0, F.array(v.each(lambda x: x, a))).otherwise(moved)


@v.bound
def slab(r: Column, b: Column) -> Column:
    """``struct<near, far>``: the distances at which a ray's line enters and leaves a box; they miss if near > far."""
    lows, highs = [], []
    for a in v.AXES:
        d = r["direction"][a]
        inverse = F.when(d == 0, F.lit(HUGE)).otherwise(F.try_divide(F.lit(1.0), d))
        t0, t1 = (b["min"][a] - r["origin"][a]) * inverse, (b["max"][a] - r["origin"][a]) * inverse
        lows.append(F.least(t0, t1))
        highs.append(F.greatest(t0, t1))
    return F.struct(F.greatest(*lows).alias("near"), F.least(*highs).alias("far"))


@v.bound
def ray_hits_box(r: Column, b: Column) -> Column:
    s = slab(r, b)
    return (s["far"] >= 0) & (s["near"] <= s["far"])


@v.bound
def ray_box_hits(r: Column, b: Column) -> Column:
    """``array<double>``: distances of entry (if ahead) and exit."""
    s = slab(r, b)
    ahead = F.array_compact(F.array(F.when(s["near"] > 0, s["near"]), s["far"]))
    return F.when(ray_hits_box(r, b), ahead).otherwise(F.array().cast("array<double>"))


@v.bound
def ray_plane(r: Column, p: Column, delta: float = 1e-12) -> Column:
    """Distance at which a ray meets a plane; null if parallel or behind the origin."""
    slope = v.dot(p["normal"], r["direction"])
    t = F.try_divide(v.dot(p["normal"], v.subtract(p["origin"], r["origin"])), slope)
    return F.when((F.abs(slope) >= delta) & (t >= -delta), t)


@v.bound
def ray_triangle(r: Column, t: Column) -> Column:
    """Distance at which a ray meets a triangle; null if it doesn't. Points on an edge are outside."""
    hit = ray_plane(r, triangle_plane(t))
    return F.when(triangle_contains(t, v.add(r["origin"], v.scale(r["direction"], hit))), hit)


@v.bound
def rays_cross_2d(a: Column, b: Column) -> Column:
    """Where two rays cross in the XY plane, as a point on ``a``; null if parallel or behind either."""
    dx, dy = b["origin"]["x"] - a["origin"]["x"], b["origin"]["y"] - a["origin"]["y"]
    da, db = a["direction"], b["direction"]
    det = db["x"] * da["y"] - db["y"] * da["x"]
    along_a = F.try_divide(dy * db["x"] - dx * db["y"], det)
    along_b = F.try_divide(dy * da["x"] - dx * da["y"], det)
    return F.when((along_a >= 0) & (along_b >= 0), ray_at(a, along_a))


@v.bound
def rays_midpoint(a: Column, b: Column) -> Column:
    """``struct<point, gap>``: the middle of the shortest link of two rays' lines, and its length; null if parallel."""
    c = v.cross(a["direction"], b["direction"])
    square = v.dot(c, c)
    t = v.subtract(b["origin"], a["origin"])
    s1 = F.try_divide(v.dot(v.cross(t, b["direction"]), c), square)
    s2 = F.try_divide(v.dot(v.cross(t, a["direction"]), c), square)
    p, q = v.add(a["origin"], v.scale(a["direction"], s1)), v.add(b["origin"], v.scale(b["direction"], s2))
    return F.when(square > 1e-18, F.struct(v.scale(v.add(p, q), 0.5).alias("point"), v.distance(p, q).alias("gap")))


# --- planes and triangles ---------------------------------------------------------------


def plane(origin: Column, normal: Column) -> Column:
    return F.struct(origin.alias("origin"), v.unit(normal).alias("normal"))


@v.bound
def plane_distance(p: Column, point: Column) -> Column:
    return F.abs(v.dot(p["normal"], v.subtract(point, p["origin"])))


@v.bound
def plane_hits_box(p: Column, b: Column) -> Column:
    half = v.scale(box_size(b), 0.5)
    reach = sum((half[a] * F.abs(p["normal"][a]) for a in "yz"), half["x"] * F.abs(p["normal"]["x"]))
    return F.abs(v.dot(p["normal"], v.subtract(box_center(b), p["origin"]))) <= reach


@v.bound
def plane_frame(p: Column) -> Column:
    """A matrix whose columns are the plane's X and Y axes and its normal."""
    z = p["normal"]
    y = v.unit(v.cross(v.vec(1.0, 0.0, 0.0), z))
    x = v.unit(v.cross(y, z))
    return v.transpose(v.mat(*v.parts(x), *v.parts(y), *v.parts(z)))


def triangle(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"))


@v.bound
def triangle_normal(t: Column) -> Column:
    """Unit normal; null components if the triangle has no area."""
    return v.unit(v.cross(v.subtract(t["b"], t["a"]), v.subtract(t["c"], t["a"])))


@v.bound
def triangle_area(t: Column) -> Column:
    return v.norm(v.cross(v.subtract(t["b"], t["a"]), v.subtract(t["c"], t["a"]))) / 2


def triangle_centroid(t: Column) -> Column:
    return v.scale(v.add(v.add(t["a"], t["b"]), t["c"]), 1 / 3)


@v.bound
def triangle_plane(t: Column) -> Column:
    return F.struct(t["a"].alias("origin"), triangle_normal(t).alias("normal"))


def triangle_box(t: Column) -> Column:
    return box(v.each(F.least, t["a"], t["b"], t["c"]), v.each(F.greatest, t["a"], t["b"], t["c"]))


@v.bound
def triangle_contains(t: Column, p: Column) -> Column:
    """Whether a point of the triangle's plane lies inside; not on an edge."""
    a, b, c = t["a"], t["b"], t["c"]
    turn = lambda x, y: v.cross(v.subtract(y, x), v.subtract(p, x))

    def same(n1, n2, n3):
        return (v.dot(n1, n2) > 0) & (v.dot(n2, n3) > 0) & (v.dot(n3, n1) > 0)

    return v.let(same, turn(a, b), turn(b, c), turn(c, a))


@v.bound
def segment_distance(a: Column, b: Column, p: Column) -> Column:
    def gap(way: Column, off: Column) -> Column:
        share = F.coalesce(F.try_divide(v.dot(off, way), v.dot(way, way)), F.lit(0.0))
        return v.let(lambda s: v.norm(v.subtract(off, v.scale(way, s))), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))

    return v.let(gap, v.subtract(b, a), v.subtract(p, a))


@v.bound
def triangle_distance(t: Column, p: Column) -> Column:
    """Distance of a point from a triangle: to its plane over the inside, to the nearest edge elsewhere."""
    edges = F.least(segment_distance(t["a"], t["b"], p), segment_distance(t["b"], t["c"], p), segment_distance(t["c"], t["a"], p))

    def over(normal: Column, height: Column) -> Column:
        inside = triangle_contains(t, v.subtract(p, v.scale(normal, height)))
        return F.when(inside, F.abs(height)).otherwise(edges)

    return v.let(lambda normal: v.let(lambda height: over(normal, height), v.dot(normal, v.subtract(p, t["a"]))), triangle_normal(t))


@v.bound
def triangle_hits_box(t: Column, b: Column) -> Column:
    """Closed separating-axis test: the box's faces, the triangle's plane, and nine edge products."""
    center, half = box_center(b), v.scale(box_size(b), 0.5)

    def test(p, q, r, half):
        edges = [v.subtract(q, p), v.subtract(r, q), v.subtract(p, r)]
        units = [v.vec(*[1.0 if i == j else 0.0 for j in range(3)]) for i in range(3)]
        axes = F.array(*units, v.cross(edges[0], edges[1]), *[v.cross(u, e) for u in units for e in edges])

        def meets(axis: Column) -> Column:
            shadows = [v.dot(axis, c) for c in (p, q, r)]
            reach = sum((half[a] * F.abs(axis[a]) for a in "yz"), half["x"] * F.abs(axis["x"]))
            return (F.least(*shadows) <= reach) & (F.greatest(*shadows) >= -reach)

        return F.forall(axes, meets)

    return v.let(test, *[v.subtract(t[k], center) for k in "abc"], half)


# --- quads: four corners in turn, as two triangles along their first diagonal -----------------


def quad(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))


def quad_triangles(q: Column) -> tuple[Column, Column]:
    return triangle(q["a"], q["b"], q["c"]), triangle(q["a"], q["c"], q["d"])


def quad_distance(q: Column, p: Column) -> Column:
    """Distance of a point from a quad."""
    return F.least(*[triangle_distance(t, p) for t in quad_triangles(q)])


def quad_hits_box(q: Column, b: Column) -> Column:
    one, other = (triangle_hits_box(t, b) for t in quad_triangles(q))
    return one | other


def ray_quad_hits(r: Column, q: Column) -> Column:
    """``array<double>``: the distances at which a ray meets a quad's triangles, in order, each once. Points on an edge are outside, so on the diagonal too."""
    found = F.array(*[ray_triangle(r, t) for t in quad_triangles(q)])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


@v.bound
def ray_meets_point(r: Column, p: Column, epsilon: float = v.EPSILON) -> Column:
    """Distance at which a ray meets a point, to within ``epsilon`` on each axis; null if it passes by or the point lies behind."""
    along = v.dot(v.subtract(p, r["origin"]), r["direction"])
    off = v.subtract(p, v.add(r["origin"], v.scale(r["direction"], along)))
    near = _all(lambda a: F.abs(off[a]) < epsilon)
    return F.when(near & (along > -epsilon), along)


# --- poses ------------------------------------------------------------------------------
# A pose is array<double>(12): the first three rows of a 4x4 matrix, row by row.


@v.bound
def pose(rotation: Column, position: Column) -> Column:
    rows = [[v.at(rotation, r, c) for c in range(3)] + [position["xyz"[r]]] for r in range(3)]
    return F.array(*[x.cast("double") for row in rows for x in row])


def pose_rotation(p: Column) -> Column:
    return F.array(*[F.get(p, F.lit(4 * r + c)) for r in range(3) for c in range(3)])


def pose_position(p: Column) -> Column:
    return v.vec(*[F.get(p, F.lit(4 * r + 3)) for r in range(3)])


def pose_axis(p: Column, axis: str) -> Column:
    c = v.AXES.index(axis)
    return v.vec(*[F.get(p, F.lit(4 * r + c)) for r in range(3)])


@v.bound
def pose_mul(a: Column, b: Column) -> Column:
    return pose(v.mat_mul(pose_rotation(a), pose_rotation(b)), pose_apply(a, pose_position(b)))


@v.bound
def pose_apply(p: Column, point: Column) -> Column:
    return v.add(v.mat_vec(pose_rotation(p), point), pose_position(p))


@v.bound
def pose_inverse(p: Column) -> Column:
    """Of a rigid pose."""
    turned = v.transpose(pose_rotation(p))
    return pose(turned, v.scale(v.mat_vec(turned, pose_position(p)), -1.0))


@v.bound
def pose_scale(p: Column) -> Column:
    """Length of each column of the rotation part."""
    return v.vec(*[v.norm(pose_axis(p, a)) for a in v.AXES])


def pose_is_rigid(p: Column) -> Column:
    return v.is_rotation(pose_rotation(p))


@v.bound
def look_at(position: Column, target: Column, up: Column) -> Column:
    """A pose whose Z axis points at the target and whose Y axis lies in the plane of Z and up."""
    z = v.direction(position, target)
    x = v.unit(v.cross(up, z))
    y = v.cross(z, x)
    return pose(v.transpose(v.mat(*v.parts(x), *v.parts(y), *v.parts(z))), position)


@v.bound
def affine_apply(m: Column, point: Column) -> Column:
    """A 3x4 or 4x4 matrix, given as ``array<array<double>>``, times a point."""
    cell = lambda r, c: F.get(F.get(m, F.lit(r)), F.lit(c))
    return v.vec(*[cell(r, 0) * point["x"] + cell(r, 1) * point["y"] + cell(r, 2) * point["z"] + cell(r, 3) for r in range(3)])


# --- cameras ----------------------------------------------------------------------------
# Intrinsics are struct<fx, fy, cx, cy>.


@v.bound
def pixel_ray(row, column, intrinsics: Column, camera: Column) -> Column:
    """The ray through a pixel of a camera with a given pose."""
    i = intrinsics
    local = v.vec((v.col(column) - i["cx"]) / i["fx"], (v.col(row) - i["cy"]) / i["fy"], 1.0)
    return ray(pose_position(camera), v.mat_vec(pose_rotation(camera), local))


@v.bound
def back_project(row, column, depth, intrinsics: Column) -> Column:
    """The point at a depth behind a pixel, in the camera's frame."""
    d, i = v.col(depth), intrinsics
    return v.vec((v.col(column) - i["cx"]) / i["fx"] * d, (v.col(row) - i["cy"]) / i["fy"] * d, d)


@v.bound
def project(point: Column, intrinsics: Column, height: int, width: int, k1: float = 0.0, k2: float = 0.0) -> Column:
    """``struct<x, y>`` in pixels of a point in the camera's frame, with radial distortion; (-1, -1) out of view."""
    i = intrinsics
    u, w = F.try_divide(point["x"], point["z"]), F.try_divide(point["y"], point["z"])
    square = u * u + w * w
    bend = 1 + k1 * square + k2 * square * square
    x, y = i["fx"] * u * bend + i["cx"], i["fy"] * w * bend + i["cy"]
    seen = (point["z"] > 0) & (x >= 0) & (y >= 0) & (x < width) & (y < height)
    off = F.struct(F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y"))
    return F.when(seen, F.struct(x.alias("x"), y.alias("y"))).otherwise(off)


@v.bound
def project_radial(point: Column, focal, cx, cy, k1) -> Column:
    """``struct<x, y>`` in pixels of a point in the camera's frame, by one focal length and one radial term; null behind the camera."""
    u, w = F.try_divide(point["x"], point["z"]), F.try_divide(point["y"], point["z"])
    bend = v.col(focal) * (1 + v.col(k1) * (u * u + w * w))
    return F.when(point["z"] > 0, F.struct((bend * u + v.col(cx)).alias("x"), (bend * w + v.col(cy)).alias("y")))


def chain(poses: Column) -> Column:
    """The product of an array of poses, the first one applied first; that of no move if it is empty."""
    none = pose(v.mat(*[F.lit(float(i % 4 == 0)) for i in range(9)]), v.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return F.aggregate(poses, none, lambda done, p: pose_mul(p, done))
