"""Files of records of one size, read by ranges and written in place by many tasks.

A record's place in such a file follows from its number alone. So a reader cuts a file into ranges of records without
looking at it, and a writer, once the rows are numbered, lets each task put its rows where they belong; a task that runs
again writes the same bytes to the same place. Files lie in a folder that all executors share, or, for reading, in any
store that Arrow's file systems reach.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a task decodes at once.
CHUNK = 4 << 20


@dataclass
class Range(InputPartition):
    file: str
    offset: int
    first: int
    rows: int


@dataclass
class Written(WriterCommitMessage):
    rows: int


def file_system(path: str):
    """Arrow's file system for a path or URI, and the path in there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def local_path(path: str) -> str:
    """A path in a shared folder as the system's own; other stores can't be written in place."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: files are written in place, which needs a folder that all executors share")
    return path


def dtype_of(kinds: list):
    import numpy as np

    return np.dtype([(n, k, *map(tuple, more)) for n, k, *more in kinds])


class RecordReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.spec, self.bytes = schema, json.loads(options["spec"]), int(options["bytes"])

    def partitions(self) -> list[Range]:
        found = []
        for f in self.spec:
            size = dtype_of(f["kinds"]).itemsize
            step = max(1, self.bytes // size)
            found += [Range(json.dumps(f), f["offset"] + at * size, at, min(step, f["rows"] - at)) for at in range(0, f["rows"], step)]
        return found

    def read(self, partition: Range | None):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # no file has a record
            return
        f = json.loads(partition.file)
        kind, target = dtype_of(f["kinds"]), to_arrow_schema(self.schema)
        system, path = file_system(f["file"])
        with system.open_input_file(path) as file:
            step = max(1, CHUNK // kind.itemsize)
            for at in range(0, partition.rows, step):
                n = min(step, partition.rows - at)
                raw = file.read_at(n * kind.itemsize, partition.offset + at * kind.itemsize)
                rows = np.frombuffer(raw, kind, n)
                if "_n" in rows.dtype.names and not (rows["_n"] == 3).all():
                    raise ValueError(f"{f['file']}: a face has not three corners")
                number = np.arange(partition.first + at, partition.first + at + n)
                columns = []
                for field in target:
                    if field.name == "file":
                        columns.append(pa.array([f["file"]] * n))
                    elif field.name == f.get("number"):
                        columns.append(pa.array(number))
                    elif field.name in f.get("axes", {}):
                        below, extent = f["axes"][field.name]
                        columns.append(pa.array(number // below % extent))
                    else:
                        name, *item = f.get("items", {}).get(field.name, [field.name])
                        values = rows[name][:, item[0]] if item else rows[name]
                        columns.append(pa.array(values.astype(values.dtype.newbyteorder("="))).cast(field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=target)


class RecordWriter(DataSourceArrowWriter):
    """Writes rows ``(pos, ...)`` of the kinds in ``spec`` to their places."""

    def __init__(self, options):
        self.file, self.offset, self.expected = options["file"], int(options["offset"]), int(options["rows"])
        self.kinds, self.constants = json.loads(options["kinds"]), json.loads(options["constants"])

    def write(self, iterator) -> Written:
        import numpy as np

        kind = dtype_of(self.kinds)
        done = 0
        out = os.open(self.file, os.O_WRONLY)
        try:
            for batch in iterator:
                rows = np.zeros(len(batch), kind)
                for name, *_ in self.kinds:
                    rows[name] = self.constants[name] if name in self.constants else batch.column(name).to_numpy(zero_copy_only=False)
                at = batch.column("pos").to_numpy()
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):  # runs of neighbours
                    if len(part):
                        left, place = memoryview(rows[part[0] : part[-1] + 1].tobytes()), self.offset + int(at[part[0]]) * kind.itemsize
                        while left:
                            n = os.pwrite(out, left, place)
                            left, place = left[n:], place + n
                done += len(batch)
            os.fsync(out)
        finally:
            os.close(out)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        rows = sum(m.rows for m in messages if m)
        if rows != self.expected:
            raise ValueError(f"{rows} rows written, {self.expected} expected")

    def abort(self, messages: list[Written | None]) -> None:
        """What was written stays in a file of which the name isn't the final one."""


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_records"

    def reader(self, schema) -> RecordReader:
        return RecordReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options)


def read_records(spark: SparkSession, files: list[dict], schema: str, range_bytes: int | None = None) -> DataFrame:
    """The records of ``files``: each ``{file, offset, rows, kinds}`` with kinds as ``[name, numpy code]``.

    ``number`` names the column of the record's number, ``axes`` those that come from it as ``[below, extent]``, ``items`` those
    that are one item of a field. A range has ``range_bytes`` at most (the session's size of file partitions).
    """
    spark.dataSource.register(Records)
    size = range_bytes or int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return spark.read.format("orrery_records").schema(schema).option("spec", json.dumps(files)).option("bytes", str(size)).load()


class PlacedFile:
    """A file of sections that tasks write in place; it has its name only once :meth:`finish` was called."""

    def __init__(self, spark: SparkSession, path: str, header: bytes, mode: str = "error"):
        if mode not in ("error", "overwrite"):
            raise ValueError("mode must be error or overwrite")
        self.path = local_path(path)
        if mode == "error" and os.path.exists(self.path):
            raise FileExistsError(self.path)
        spark.dataSource.register(Records)
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.end = len(header)
        with open(self.temporary, "wb") as out:
            out.write(header)

    def append(self, rows: DataFrame, count: int, kinds: list, constants: dict | None = None) -> None:
        """A section of ``count`` rows; column ``pos`` has their numbers in it, from 0."""
        writer = rows.select("pos", *[n for n, *_ in kinds if n not in (constants or {})]).write.format("orrery_records").mode("append")
        size = dtype_of(kinds).itemsize
        options = {"file": self.temporary, "offset": self.end, "rows": count, "kinds": json.dumps(kinds), "constants": json.dumps(constants or {})}
        writer.options(**{k: str(x) for k, x in options.items()}).save()
        self.end += count * size

    def __enter__(self) -> PlacedFile:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and os.path.getsize(self.temporary) == self.end:
            os.replace(self.temporary, self.path)
        else:
            os.remove(self.temporary)
            if kind is None:
                raise ValueError(f"{self.path}: not all records were written")
