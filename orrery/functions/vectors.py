"""3-D vectors (``struct<x, y, z: double>``) and 3x3 matrices (``array<double>``, row-major) as Columns."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of equality of doubles; the comparison is strict.
EPSILON = 1e-4
AXES = ("x", "y", "z")


def col(value) -> Column:
    """A Column stays, a name becomes one, a number becomes a literal."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def let(f, *values: Column) -> Column:
    """``f`` of values that are computed once, however often ``f`` names them.

    Without this a formula of formulas would hold each inner one many times over.
    """

    held = F.struct(*[x.alias(f"_{i}") for i, x in enumerate(values)])
    return F.get(F.transform(F.array(held), lambda h: f(*[h[f"_{i}"] for i in range(len(values))])), F.lit(0))


def bound(f):
    """The function with its Column arguments bound by :func:`let`."""

    @wraps(f)
    def wrapped(*args, **options):
        given = [a for a in args if isinstance(a, Column)]

        def call(*columns):
            rest = iter(columns)
            return f(*[next(rest) if isinstance(a, Column) else a for a in args], **options)

        return let(call, *given) if given else f(*args, **options)

    return wrapped


def vec(x, y, z) -> Column:
    return F.struct(*[col(v).cast("double").alias(a) for v, a in zip((x, y, z), AXES)])


def parts(v: Column) -> tuple[Column, Column, Column]:
    return v["x"], v["y"], v["z"]


def each(f, *vectors: Column) -> Column:
    """A vector of ``f`` applied to each component."""
    return vec(*[f(*[v[a] for v in vectors]) for a in AXES])


def add(a: Column, b: Column) -> Column:
    return each(lambda x, y: x + y, a, b)


def subtract(a: Column, b: Column) -> Column:
    return each(lambda x, y: x - y, a, b)


def scale(a: Column, factor) -> Column:
    return each(lambda x: x * col(factor), a)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@bound
def unit(a: Column) -> Column:
    """The vector at length 1; null components for the zero vector."""
    n = norm(a)
    return each(lambda x: F.try_divide(x, n), a)


def distance(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def direction(a: Column, b: Column) -> Column:
    """Unit vector from ``a`` to ``b``."""
    return unit(subtract(b, a))


@bound
def angle(a: Column, b: Column) -> Column:
    """Angle between two vectors, 0 to pi; null if one is zero."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


@bound
def signed_angle(a: Column, b: Column, axis: Column) -> Column:
    """Angle from ``a`` to ``b`` about an axis, -pi to pi."""
    return F.atan2(dot(axis, cross(a, b)), dot(a, b))


def angle_2d(ax, ay, bx, by) -> Column:
    ax, ay, bx, by = map(col, (ax, ay, bx, by))
    cosine = F.try_divide(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


@bound
def orthogonal(a: Column) -> Column:
    """Some vector at a right angle to ``a``."""
    special = (F.abs(a["x"] + 1) < EPSILON) & (F.abs(a["y"] - 1) < EPSILON) & (F.abs(a["z"]) < EPSILON)
    return F.when(special, vec(-1.0, -1.0, -1.0)).otherwise(vec(a["z"], a["z"], -a["x"] - a["y"]))


def is_orthogonal(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return F.abs(dot(a, b)) <= epsilon


@bound
def project_orthogonal(a: Column, axis: Column) -> Column:
    """What is left of ``a`` without its part along a unit ``axis``."""
    return subtract(a, scale(axis, dot(a, axis)))


def approx_equal(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return (F.abs(a["x"] - b["x"]) < epsilon) & (F.abs(a["y"] - b["y"]) < epsilon) & (F.abs(a["z"] - b["z"]) < epsilon)


def same_sign(a: Column, b: Column) -> Column:
    """Whether both are negative or neither is, in each component."""
    return ((a["x"] < 0) == (b["x"] < 0)) & ((a["y"] < 0) == (b["y"] < 0)) & ((a["z"] < 0) == (b["z"] < 0))


def largest(a: Column) -> Column:
    return F.greatest(*parts(a))


def replace(a: Column, axis: str, value) -> Column:
    return vec(*[col(value) if x == axis else a[x] for x in AXES])


def drop_axis(a: Column, axis: str) -> Column:
    """The two other components as ``struct<u, v>``."""
    u, v = [x for x in AXES if x != axis]
    return F.struct(a[u].alias("u"), a[v].alias("v"))


def with_axis(uv: Column, axis: str, value) -> Column:
    """The inverse of :func:`drop_axis`."""
    rest = iter((uv["u"], uv["v"]))
    return vec(*[col(value) if x == axis else next(rest) for x in AXES])


# --- matrices ---------------------------------------------------------------------------


def mat(*values) -> Column:
    """Nine values, row by row."""
    if len(values) != 9:
        raise ValueError("a 3x3 matrix has nine values")
    return F.array(*[col(v).cast("double") for v in values])


def at(m: Column, row: int, column: int) -> Column:
    return F.get(m, F.lit(3 * row + column))


@bound
def mat_vec(m: Column, v: Column) -> Column:
    return vec(*[at(m, r, 0) * v["x"] + at(m, r, 1) * v["y"] + at(m, r, 2) * v["z"] for r in range(3)])


@bound
def mat_mul(a: Column, b: Column) -> Column:
    return mat(*[sum((at(a, r, k) * at(b, k, c) for k in range(1, 3)), at(a, r, 0) * at(b, 0, c)) for r in range(3) for c in range(3)])


@bound
def transpose(m: Column) -> Column:
    return mat(*[at(m, c, r) for r in range(3) for c in range(3)])


def mat_scale(m: Column, factor) -> Column:
    return F.transform(m, lambda x: x * col(factor))


def outer(a: Column, b: Column) -> Column:
    return mat(*[x * y for x in parts(a) for y in parts(b)])


@bound
def determinant(m: Column) -> Column:
    return (
        at(m, 0, 0) * (at(m, 1, 1) * at(m, 2, 2) - at(m, 1, 2) * at(m, 2, 1))
        - at(m, 0, 1) * (at(m, 1, 0) * at(m, 2, 2) - at(m, 1, 2) * at(m, 2, 0))
        + at(m, 0, 2) * (at(m, 1, 0) * at(m, 2, 1) - at(m, 1, 1) * at(m, 2, 0))
    )


@bound
def is_identity(m: Column, epsilon: float = EPSILON) -> Column:
    found = F.lit(True)
    for r in range(3):
        for c in range(3):
            found = found & (F.abs(at(m, r, c) - (1.0 if r == c else 0.0)) < epsilon)
    return found


@bound
def is_rotation(m: Column) -> Column:
    """Orthonormal; mirrored ones count too."""
    return is_identity(mat_mul(m, transpose(m))) & (F.abs(F.abs(determinant(m)) - 1.0) < EPSILON)


@bound
def rotation_about(axis: Column, angle_) -> Column:
    """The matrix that turns about an axis (of any length)."""
    a, t = unit(axis), col(angle_)

    def made(a, c, s):
        k = 1 - c
        x, y, z = parts(a)
        return mat(
            c + x * x * k, x * y * k - z * s, x * z * k + y * s,
            x * y * k + z * s, c + y * y * k, y * z * k - x * s,
            x * z * k - y * s, y * z * k + x * s, c + z * z * k,
        )

    return let(made, a, F.cos(t), F.sin(t))


def rotation_x(angle_) -> Column:
    return rotation_about(vec(1.0, 0.0, 0.0), angle_)


def rotation_y(angle_) -> Column:
    return rotation_about(vec(0.0, 1.0, 0.0), angle_)


def rotation_z(angle_) -> Column:
    return rotation_about(vec(0.0, 0.0, 1.0), angle_)


def rotation_between(a: Column, b: Column) -> Column:
    """The matrix that turns ``a``'s direction into ``b``'s; null for parallel ones, which have no axis."""
    return rotation_about(cross(a, b), angle(a, b))


@bound
def rotate(v: Column, m: Column, anchor: Column | None = None) -> Column:
    return mat_vec(m, v) if anchor is None else add(mat_vec(m, subtract(v, anchor)), anchor)


@bound
def quaternion_to_matrix(q: Column) -> Column:
    """``q``: ``struct<x, y, z, w>`` of any length."""
    n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"])

    def made(x, y, z, w):
        return mat(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    return let(made, *[F.try_divide(q[k], n) for k in ("x", "y", "z", "w")])


@bound
def matrix_to_quaternion(m: Column) -> Column:
    """``struct<x, y, z, w>`` with w not negative, by the largest of the four squares."""
    squares = [
        (1 + at(m, 0, 0) - at(m, 1, 1) - at(m, 2, 2)) / 4, (1 - at(m, 0, 0) + at(m, 1, 1) - at(m, 2, 2)) / 4,
        (1 - at(m, 0, 0) - at(m, 1, 1) + at(m, 2, 2)) / 4, (1 + at(m, 0, 0) + at(m, 1, 1) + at(m, 2, 2)) / 4,
    ]
    products = {
        (0, 1): (at(m, 0, 1) + at(m, 1, 0)) / 4, (0, 2): (at(m, 0, 2) + at(m, 2, 0)) / 4, (1, 2): (at(m, 1, 2) + at(m, 2, 1)) / 4,
        (0, 3): (at(m, 2, 1) - at(m, 1, 2)) / 4, (1, 3): (at(m, 0, 2) - at(m, 2, 0)) / 4, (2, 3): (at(m, 1, 0) - at(m, 0, 1)) / 4,
    }

    def by(i: int) -> Column:
        root = F.sqrt(F.greatest(squares[i], F.lit(0.0)))
        values = [root if j == i else products[min(i, j), max(i, j)] / root for j in range(4)]
        sign = F.when(values[3] < 0, -1.0).otherwise(1.0)
        return F.struct(*[(v * sign).alias(k) for v, k in zip(values, ("x", "y", "z", "w"))])

    most = F.greatest(*squares)
    chosen = F.when(squares[3] == most, by(3))
    for i in (0, 1):
        chosen = chosen.when(squares[i] == most, by(i))
    return chosen.otherwise(by(2))


@bound
def euler_from_matrix(m: Column) -> Column:
    """Angles about X, Y and Z. Not the inverse of :func:`matrix_from_euler`, whose axes differ."""
    return vec(
        F.atan2(at(m, 2, 1), at(m, 2, 2)),
        F.atan2(-at(m, 2, 0), F.hypot(at(m, 2, 1), at(m, 2, 2))),
        F.atan2(at(m, 1, 0), at(m, 0, 0)),
    )


@bound
def matrix_from_euler(e: Column) -> Column:
    """The product of turns about Y (by e.y), Z (by e.z) and X (by e.x)."""
    return mat_mul(mat_mul(rotation_y(e["y"]), rotation_z(e["z"])), rotation_x(e["x"]))


@bound
def rodrigues_from_matrix(m: Column) -> Column:
    """Axis times angle; the zero vector for no turn. Half turns, whose axis has no sign, use the diagonal."""
    raw = vec(at(m, 2, 1) - at(m, 1, 2), at(m, 0, 2) - at(m, 2, 0), at(m, 1, 0) - at(m, 0, 1))
    trace = at(m, 0, 0) + at(m, 1, 1) + at(m, 2, 2)
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))
    n = norm(raw)
    root = [F.sqrt(F.greatest((at(m, i, i) + 1) / 2, F.lit(0.0))) for i in range(3)]
    first = F.when(root[0] > EPSILON, root[0]).when(root[1] > EPSILON, root[1]).otherwise(root[2])
    row = F.when(root[0] > EPSILON, F.lit(0)).when(root[1] > EPSILON, F.lit(1)).otherwise(F.lit(2))
    half = vec(*[(F.get(m, 3 * row + i) + F.when(row == i, 1.0).otherwise(0.0)) / (2 * first) * theta for i in range(3)])
    return F.when(n > 1e-9, each(lambda x: x / n * theta, raw)).when(trace > 0, vec(0.0, 0.0, 0.0)).otherwise(half)


@bound
def matrix_from_rodrigues(v: Column) -> Column:
    identity = mat(1, 0, 0, 0, 1, 0, 0, 0, 1)
    return F.when(norm(v) == 0, identity).otherwise(rotation_about(v, norm(v)))
