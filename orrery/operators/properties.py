"""Property bags: named values of one of nine kinds on any row, as ``map<string, struct<kind, value: variant>>``.

Properties that all rows have belong into columns; a bag is for those that differ from row to row. The kind is kept beside the value, since a variant
doesn't tell an int from a long. :func:`descriptor` finds what there is, :func:`as_columns` turns it into columns of their types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v

#: Kinds and their types.
KINDS = {
    "bool": "boolean", "byte": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string",
    "vector": "struct<x:double,y:double,z:double>", "color": "struct<r:smallint,g:smallint,b:smallint,a:smallint>",
}
BAG = "map<string,struct<kind:string,value:variant>>"


def empty() -> Column:
    return F.create_map().cast(BAG)


def _kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    return KINDS[kind]


def entry(kind: str, value) -> Column:
    """A value of a kind, as bags hold it; null for null."""
    typed = v.col(value).cast(_kind(kind))
    variant = F.to_variant_object(typed) if kind in ("vector", "color") else typed.cast("variant")
    return F.when(typed.isNotNull(), F.struct(F.lit(kind).alias("kind"), variant.alias("value")))


def bag(**values: tuple[str, Column]) -> Column:
    """A bag of ``name=(kind, value)``; names whose value is null aren't in it."""
    pairs = [F.struct(F.lit(n).alias("key"), entry(kind, x).alias("value")) for n, (kind, x) in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else empty()


def put(bag_: Column, name: str, kind: str, value) -> Column:
    """The bag with a value under a name, in place of any other of that name; a null value takes it out."""
    rest = F.map_filter(F.coalesce(bag_, empty()), lambda k, _: k != name)
    return F.map_concat(rest, bag(**{name: (kind, value)}))


def has(bag_: Column, name: str, kind: str | None = None) -> Column:
    """Whether there is a value under a name, of that kind if one is given."""
    found = F.element_at(bag_, name)
    there = found.isNotNull() if kind is None else found["kind"] == kind
    return F.coalesce(there, F.lit(False))


def get(bag_: Column, name: str, kind: str) -> Column:
    """The value under a name, null if there is none; an error if it is of another kind."""
    found = F.element_at(bag_, name)
    clash = F.raise_error(F.concat(F.lit(f"{name} is no {kind} but a "), found["kind"])).cast(_kind(kind))
    return F.when(found.isNotNull(), F.when(found["kind"] != kind, clash).otherwise(F.variant_get(found["value"], "$", _kind(kind))))


def names(bag_: Column, kind: str | None = None) -> Column:
    """The names in a bag, in order, of all kinds or of one."""
    held = bag_ if kind is None else F.map_filter(bag_, lambda _, x: x["kind"] == kind)
    return F.array_sort(F.map_keys(held))


def descriptor(rows: DataFrame, bag_: str = "properties") -> DataFrame:
    """``(name, kinds, n)``: the names in any row's bag, the kinds they have and the rows that have them. One kind is as it should be."""
    return rows.select(F.explode(F.col(bag_)).alias("name", "p")).groupBy("name").agg(F.array_sort(F.collect_set("p.kind")).alias("kinds"), F.count("*").alias("n"))


def missing(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """``(name, kind)``: what the descriptor ``wanted`` has and ``there`` hasn't; without rows they are compatible."""
    of = lambda d: d.select("name", F.explode("kinds").alias("kind"))
    return of(wanted).join(of(there), ["name", "kind"], "left_anti")


def as_columns(rows: DataFrame, kinds: dict[str, str], bag_: str = "properties") -> DataFrame:
    """``rows`` with a column for each name of a kind; values of another kind are an error when read."""
    return rows.withColumns({n: get(F.col(bag_), n, kind) for n, kind in kinds.items()})


def propagate(rows: DataFrame, containers: DataFrame, key: str, bag_: str = "properties") -> DataFrame:
    """``rows`` with the properties of their containers (key, bag), which take the place of their own of the same names.

    Rows without a container keep what they have; a row's null bag is an empty one.
    """
    given = containers.select(key, F.col(bag_).alias("_given"))
    own, more = F.coalesce(bag_, empty()), F.coalesce("_given", empty())
    rest = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return rows.join(given, key, "left").withColumn(bag_, F.map_concat(rest, more)).drop("_given")


def faces_to_vertices(vertices: DataFrame, faces: DataFrame, columns: list[str]) -> DataFrame:
    """``vertices`` with numeric columns of their faces, averaged over the faces at each; null for vertices without a face.

    A column of vertices that has such a name is replaced. Null values of faces don't count.
    """
    at = faces.select(F.explode(F.array_distinct(F.array("v1", "v2", "v3"))).alias("vertex_id"), *columns)
    means = at.groupBy("vertex_id").agg(*[F.avg(c).alias(c) for c in columns])
    return vertices.drop(*columns).join(means, "vertex_id", "left")


def values(rows: DataFrame, value: Column) -> DataFrame:
    """``(value)``: the distinct values of a formula over vertices or faces."""
    return rows.select(value.alias("value")).distinct()
