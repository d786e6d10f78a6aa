"""Listings of image folders whose file names are timestamps, and numpy grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import file_system, read_records


def list_images(spark: SparkSession, folder: str, endings: tuple[str, ...] = ("png", "jpg", "tiff"), recursive: bool = False) -> DataFrame:
    """``(t, path)``: files with such endings; t is the name before the ending, as seconds, null if it is no number.

    Only the listing is used, contents aren't read.
    """
    glob = "*.{" + ",".join(endings) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).try_cast("double").alias("t"), "path")


def read_grids(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """``(file, x, y, z, v)``: the cells of numpy files of three axes and any numeric type, in either order of axes.

    A file is read in ranges of ``range_bytes`` (the session's size of file partitions), whatever its size; only where Arrow
    can't open it, by one task. A grid kept as split files along its first axis is read by all of them at once; their
    x then count within each file: see :func:`join_splits`.
    """
    import numpy as np

    files = []
    for (file,) in spark.read.format("binaryFile").load(path).select("path").collect():  # a row for each file
        try:
            system, inside = file_system(file)
        except (ValueError, NotImplementedError):
            return _whole_grids(spark, path)
        with system.open_input_file(inside) as opened:
            version = np.lib.format.read_magic(opened)
            shape, backwards, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(opened)
            offset = opened.tell()
        if len(shape) != 3 or kind.kind not in "biuf":
            raise ValueError(f"{file} is no grid of numbers with three axes")
        below = [1, shape[0], shape[0] * shape[1]] if backwards else [shape[1] * shape[2], shape[2], 1]
        files.append({"file": file, "offset": offset, "rows": shape[0] * shape[1] * shape[2], "kinds": [["v", kind.str]], "axes": {a: [b, n] for a, b, n in zip("xyz", below, shape)}})
    return read_records(spark, files, "file string, x long, y long, z long, v double", range_bytes)


def _whole_grids(spark: SparkSession, path: str) -> DataFrame:
    def cells(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                grid = np.load(io.BytesIO(raw.as_py()), allow_pickle=False)
                if grid.ndim != 3:
                    raise ValueError(f"{file} has {grid.ndim} axes, not 3")
                for x in range(grid.shape[0]):  # a slab at a time
                    y, z = (a.ravel() for a in np.indices(grid.shape[1:]))
                    yield pa.record_batch(
                        [pa.array([file] * len(y)), pa.array(np.full(len(y), x)), pa.array(y), pa.array(z), pa.array(grid[x].ravel().astype(np.float64))], names=["file", "x", "y", "z", "v"]
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cells, "file string, x long, y long, z long, v double")


def join_splits(grids: DataFrame) -> DataFrame:
    """``(x, y, z, v)``: split files ``..._<number>.npy`` put end to end along x, in order of their numbers."""
    from pyspark.sql import Window

    number = F.regexp_extract("file", r"_([0-9]+)\.npy$", 1).cast("int")
    sizes = grids.groupBy(number.alias("_i")).agg((F.max("x") + 1).alias("_n"))
    starts = sizes.select("_i", (F.sum("_n").over(Window.orderBy("_i")) - F.col("_n")).alias("_at"))  # a row for each file
    return grids.withColumn("_i", number).join(starts, "_i").select((F.col("x") + F.col("_at")).alias("x"), "y", "z", "v")
