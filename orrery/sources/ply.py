"""PLY files: vertices and triangular faces, text or binary of either byte order.

The header gives names and types, and with the counts also the place of each row of a binary file, which is
so read by ranges of rows and written by many tasks in place. A text file is read by blocks of lines. Only
files that lie where neither is possible are decoded whole, each by one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collections import with_ordinal
from ..storage import stash
from .lines import read_lines, write_lines
from .records import PlacedFile, dtype_of, file_system, read_records

#: Types by their names in headers: code of numpy and name in Spark.
TYPES = {
    "char": ("i1", "short"), "uchar": ("u1", "short"), "short": ("i2", "int"), "ushort": ("u2", "int"), "int": ("i4", "int"), "uint": ("u4", "long"), "float": ("f4", "float"), "double": ("f8", "double"),
    "int8": ("i1", "short"), "uint8": ("u1", "short"), "int16": ("i2", "int"), "uint16": ("u2", "int"), "int32": ("i4", "int"), "uint32": ("u4", "long"), "float32": ("f4", "float"), "float64": ("f8", "double"),
}
BATCH = 1 << 16


@dataclass
class Element:
    name: str
    count: int
    properties: list[tuple[str, str]] = field(default_factory=list)
    #: (type of the length, type of the items) of the one list, and its name.
    items: tuple[str, str, str] | None = None


@dataclass
class Header:
    encoding: str
    elements: dict[str, Element]
    #: Bytes and lines before the first row.
    length: int
    lines: int


def parse_header(raw: bytes) -> Header:
    end = raw.find(b"end_header")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    length = raw.index(b"\n", end) + 1
    encoding, elements, last = "", {}, None
    for words in (line.split() for line in raw[:end].decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            encoding = words[1]
        elif words[:1] == ["element"]:
            last = elements[words[1]] = Element(words[1], int(words[2]))
        elif words[:2] == ["property", "list"]:
            last.items = (words[2], words[3], words[4])
        elif words[:1] == ["property"]:
            last.properties.append((words[1], words[2]))
    return Header(encoding, elements, length, raw[:length].count(b"\n"))


def _binary(raw: bytes, header: Header, name: str):
    """A structured array of one element; faces get three indices."""
    import numpy as np

    order = ">" if header.encoding == "binary_big_endian" else "<"
    at = header.length
    for element in header.elements.values():
        kinds = [(n, order + TYPES[t][0]) for t, n in element.properties]
        if element.items:
            size, item, _ = element.items
            kinds = [("_n", order + TYPES[size][0]), ("_i", order + TYPES[item][0], (3,)), *kinds]
        found = np.frombuffer(raw, np.dtype(kinds), element.count, at)
        if element.items and element.count and not (found["_n"] == 3).all():
            raise ValueError("a face has not three corners")
        at += found.nbytes
        if element.name == name:
            return found
    return None


def _text(raw: bytes, header: Header, name: str):
    import numpy as np

    lines = iter(raw[header.length :].decode("ascii").splitlines())
    for element in header.elements.values():
        rows = [next(lines).split() for _ in range(element.count)]
        if element.name != name:
            continue
        kinds = [(n, TYPES[t][0]) for t, n in element.properties]
        if not element.items:
            return np.array([tuple(r[: len(kinds)]) for r in rows], np.dtype(kinds))
        if any(r[0] != "3" for r in rows):
            raise ValueError("a face has not three corners")
        return np.array([(3, tuple(r[1:4]), *r[4 : 4 + len(kinds)]) for r in rows], np.dtype([("_n", "i4"), ("_i", "i8", (3,)), *kinds]))
    return None


def peek(spark: SparkSession, path: str) -> Header:
    """The header of the first file."""
    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("head")).first()
    if first is None:
        raise ValueError(f"no file at {path}")
    return parse_header(bytes(first["head"]))


def headers(spark: SparkSession, path: str) -> dict[str, Header] | None:
    """The header of each file, of which only the first bytes are read; None where Arrow can't open them."""
    found = {}
    for (file,) in spark.read.format("binaryFile").load(path).select("path").collect():  # a row for each file
        try:
            system, inside = file_system(file)
        except (ValueError, NotImplementedError):
            return None
        with system.open_input_file(inside) as opened:
            raw = b""
            while b"end_header\n" not in raw and b"end_header\r\n" not in raw and (more := opened.read(1 << 12)):
                raw += more
            found[file] = parse_header(raw)
    return found


def _kinds(element: Element, order: str) -> list:
    kinds = [[n, order + TYPES[t][0]] for t, n in element.properties]
    if element.items:
        size, item, _ = element.items
        kinds = [["_n", order + TYPES[size][0]], ["_i", order + TYPES[item][0], [3]], *kinds]
    return kinds


def _ranges(found: dict[str, Header], element: str, number: str) -> list[dict]:
    """Where the rows of an element lie in each binary file."""
    files = []
    for file, header in found.items():
        order, at = ">" if header.encoding == "binary_big_endian" else "<", header.length
        for e in header.elements.values():
            kinds = _kinds(e, order)
            if e.name == element:
                files.append({"file": file, "offset": at, "rows": e.count, "kinds": kinds, "number": number, "items": {f"v{i + 1}": ["_i", i] for i in range(3)}})
            at += e.count * dtype_of(kinds).itemsize
    return files


def _lines(spark: SparkSession, path: str, found: dict[str, Header], element: str, number: str, corners: list[str], chosen: list) -> DataFrame:
    """The rows of an element of text files, by the numbers of their lines."""
    starts = []
    for file, header in found.items():
        first = header.lines
        for e in header.elements.values():
            if e.name == element:
                starts.append((file, first, e.count))
            first += e.count
    spans = spark.createDataFrame(starts, "_f string, _first long, _n long")
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    rows = read_lines(spark, path).join(F.broadcast(spans), plain(F.col("file")) == plain(F.col("_f")))  # a row for each file
    # other lines are null before they are left out, since filters may be tried in any order
    inside = (F.col("ord") >= F.col("_first")) & (F.col("ord") < F.col("_first") + F.col("_n"))
    words = F.when(inside, F.split(F.trim("line"), r"\s+"))
    rows = rows.where(inside).select(F.col("_f").alias("file"), (F.col("ord") - F.col("_first")).alias(number), words.alias("_t"))
    if corners:
        odd = F.get("_t", F.lit(0)) != "3"
        rows = rows.withColumn("_t", F.when(odd, F.raise_error(F.lit("a face has not three corners")).cast("array<string>")).otherwise(F.slice("_t", 2, 1 << 20)))
    names = [(c, "long", i) for i, c in enumerate(corners)] + [(n, t, len(corners) + i) for n, t, i in chosen]
    return rows.select("file", number, *[F.get("_t", F.lit(i)).cast("double" if t in ("float", "double") else "long").cast(t).alias(n) for n, t, i in names])


def read_ply(spark: SparkSession, path: str, element: str = "vertex", columns: list[str] | None = None, range_bytes: int | None = None) -> DataFrame:
    """``(file, vertex_id, x, y, z, ...)`` or ``(file, face_id, v1, v2, v3, ...)``, with the types of the first file's header.

    ``columns`` picks properties; others aren't decoded. Files that lack the element give no rows. A binary file is read
    in ranges of ``range_bytes`` (the session's size of file partitions), a text file in blocks.
    """
    found = headers(spark, path)
    spec = (next(iter(found.values())) if found else peek(spark, path)).elements.get(element)
    if spec is None:
        raise ValueError(f"the file has no element {element}")
    chosen = [(n, TYPES[t][1]) for t, n in spec.properties if columns is None or n in columns]
    number = "face_id" if spec.items else "vertex_id"
    corners = ["v1", "v2", "v3"] if spec.items else []
    schema = ", ".join(["file string", f"{number} long", *[f"{c} long" for c in corners], *[f"`{n}` {t}" for n, t in chosen]])
    if found:
        texts = {f: h for f, h in found.items() if h.encoding == "ascii"}
        places = {n: i for i, (_, n) in enumerate(spec.properties)}
        parts = []
        if len(texts) < len(found):
            parts.append(read_records(spark, _ranges({f: h for f, h in found.items() if f not in texts}, element, number), schema, range_bytes))
        if texts:
            parts.append(_lines(spark, path, texts, element, number, corners, [(n, t, places[n]) for n, t in chosen]))
        return reduce(DataFrame.unionByName, parts)

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        kinds = {"short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_py()
                header = parse_header(raw)
                rows = (_text if header.encoding == "ascii" else _binary)(raw, header, element)
                for first in range(0, 0 if rows is None else len(rows), BATCH):
                    part = rows[first : first + BATCH]
                    out = [pa.array([file] * len(part)), pa.array(np.arange(first, first + len(part)))]
                    out += [pa.array(part["_i"][:, i].astype(np.int64)) for i in range(len(corners))]
                    out += [pa.array(part[n].astype(part[n].dtype.newbyteorder("="))).cast(kinds[t]) for n, t in chosen]
                    yield pa.record_batch(out, names=["file", number, *corners, *[n for n, _ in chosen]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, schema)


def points_of(vertices: DataFrame) -> DataFrame:
    """``(vertex_id, pos, normal, color, ...)``: coordinates, normal and colour gathered into structs, as far as there are any."""
    names = vertices.columns
    gather = lambda parts, as_: F.struct(*[F.col(p).cast("double" if as_ != "color" else "short").alias(a) for p, a in parts]).alias(as_)
    groups = [((("x", "x"), ("y", "y"), ("z", "z")), "pos"), ((("nx", "x"), ("ny", "y"), ("nz", "z")), "normal"), ((("red", "r"), ("green", "g"), ("blue", "b")), "color")]
    used, out = set(), []
    for parts, name in groups:
        if all(p in names for p, _ in parts):
            out.append(gather(parts, name))
            used |= {p for p, _ in parts}
    return vertices.select("vertex_id", *out, *[n for n in names if n not in used | {"file", "vertex_id"}])


NAMES = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "int", "float": "float", "double": "double"}


def write_ply(vertices: DataFrame, path: str, faces: DataFrame | None = None, vertex_order: str = "vertex_id", face_order: str = "face_id", mode: str = "error") -> None:
    """A text PLY as one part file: numeric columns of the vertices but their number, then faces ``v1, v2, v3``."""
    v_columns = [(n, NAMES[t]) for n, t in vertices.dtypes if n != vertex_order and t in NAMES]
    f_columns = [(n, NAMES[t]) for n, t in faces.dtypes if n not in (face_order, "v1", "v2", "v3") and t in NAMES] if faces is not None else []
    head = ["ply", "format ascii 1.0", f"element vertex {vertices.count()}", *[f"property {t} {n}" for n, t in v_columns]]
    if faces is not None:
        head += [f"element face {faces.count()}", "property list uchar int vertex_indices", *[f"property {t} {n}" for n, t in f_columns]]
    head.append("end_header")
    spark = vertices.sparkSession
    line = lambda part, ord_, text: [F.lit(part).alias("part"), ord_.cast("long").alias("ord"), text.alias("line")]
    top = spark.createDataFrame([(0, i, h) for i, h in enumerate(head)], "part int, ord long, line string")
    joined = lambda df, columns, first=(): F.concat_ws(" ", *first, *[F.col(n).cast("string") for n, _ in columns])
    body = vertices.select(*line(1, F.col(vertex_order), joined(vertices, v_columns)))
    if faces is not None:
        corners = [F.lit("3"), *[F.col(k).cast("string") for k in ("v1", "v2", "v3")]]
        body = body.unionByName(faces.select(*line(2, F.col(face_order), joined(faces, f_columns, corners))))
    write_lines(top.unionByName(body), path, ["part", "ord"], single=True, mode=mode)


#: numpy codes of what is written, little-endian, by Spark's types.
CODES = {"tinyint": ("char", "<i1"), "smallint": ("short", "<i2"), "int": ("int", "<i4"), "bigint": ("int", "<i4"), "float": ("float", "<f4"), "double": ("double", "<f8")}
COLORS = ("red", "green", "blue", "alpha")


def write_ply_binary(
    vertices: DataFrame, path: str, faces: DataFrame | None = None, vertex_order: str = "vertex_id", face_order: str = "face_id",
    coordinates_as_float: bool = False, mode: str = "error",
) -> None:
    """A little-endian PLY of the same columns as :func:`write_ply`'s, written in place by as many tasks as there are ranges of rows.

    Rows are numbered in their order; faces' corners are the numbers of the vertices that ``v1, v2, v3`` name, so ids may have
    gaps; a face whose vertex is missing is an error. Colours are bytes. ``path`` is one file in a folder that all executors share; it
    appears under that name when all rows are in it.
    """

    def columns(df: DataFrame, *apart: str) -> list[tuple[str, str, str]]:
        found = []
        for n, t in df.dtypes:
            if n in apart or t not in CODES:
                continue
            kind = ("uchar", "<u1") if n in COLORS else ("float", "<f4") if coordinates_as_float and n in ("x", "y", "z") else CODES[t]
            found.append((n, *kind))
        return found

    spark = vertices.sparkSession
    v_columns = columns(vertices, vertex_order)
    dots = stash(with_ordinal(vertices, [vertex_order], "pos"))
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {dots.count()}", *[f"property {t} {n}" for n, t, _ in v_columns]]
    if faces is not None:
        f_columns = columns(faces, face_order, "v1", "v2", "v3")
        placed = with_ordinal(faces, [face_order], "pos")
        for c in ("v1", "v2", "v3"):
            at = dots.select(F.col(vertex_order).alias(c), F.col("pos").alias(f"_{c}"))
            placed = placed.join(at, c, "left").withColumn(c, F.coalesce(F.col(f"_{c}"), F.raise_error(F.lit("a face has a vertex that is missing")).cast("long"))).drop(f"_{c}")
        placed = stash(placed.sortWithinPartitions("pos"))
        head += [f"element face {placed.count()}", "property list uchar int vertex_indices", *[f"property {t} {n}" for n, t, _ in f_columns]]
    header = ("\n".join([*head, "end_header"]) + "\n").encode("ascii")
    with PlacedFile(spark, path, header, mode) as file:
        file.append(dots, dots.count(), [[n, code] for n, _, code in v_columns])
        if faces is not None:
            file.append(placed, placed.count(), [["_n", "<u1"], ["v1", "<i4"], ["v2", "<i4"], ["v3", "<i4"], *[[n, code] for n, _, code in f_columns]], {"_n": 3})
