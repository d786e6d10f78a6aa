"""Streams: running states of arriving rows, and rows that arrive over a socket."""

from __future__ import annotations

import json
import socket
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader

from ..operators.binning import bin_of
from ..operators.stats import running


def running_stats(stream: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The state of each key so far, for output mode ``complete`` or ``update``."""
    return stream.groupBy(*by).agg(*running(value))


def windowed_stats(stream: DataFrame, value: str, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """The state of each key and window of time; rows later than ``late`` are left out, closed windows leave memory."""
    windows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(*running(value))
    return windows.select(F.col("w.start").alias("start"), *by, "n", "mean", "variance", "min", "max")


def running_histogram(stream: DataFrame, value: str, size: float, origin: float = 0.0) -> DataFrame:
    return stream.groupBy(bin_of(value, size, origin).alias("bin")).agg(F.count("*").cast("double").alias("weight"))


# --- framed messages over TCP -----------------------------------------------------------


def pack_frame(message: dict) -> bytes:
    """A message as JSON behind its length (four bytes, little-endian)."""
    raw = json.dumps(message).encode()
    return struct.pack("<i", len(raw)) + raw


class FrameReader(SimpleDataSourceStreamReader):
    """Reads what a server has sent so far; messages wait in memory until their batch is committed."""

    def __init__(self, options: dict):
        self.address = (options.get("host", "127.0.0.1"), int(options["port"]))
        self.limit = int(options.get("maxRowsPerBatch", "10000"))
        self.connection = None
        self.rest = b""
        self.waiting: dict[int, str] = {}
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _take(self) -> None:
        """What has arrived; a frame may come in parts."""
        if self.connection is None:
            self.connection = socket.create_connection(self.address, timeout=5)
            self.connection.settimeout(0.2)
        try:
            while len(self.waiting) < self.limit:
                part = self.connection.recv(1 << 16)
                if not part:
                    break
                self.rest += part
                while len(self.rest) >= 4 and len(self.rest) >= 4 + (n := struct.unpack("<i", self.rest[:4])[0]):
                    self.waiting[self.seen] = self.rest[4 : 4 + n].decode()
                    self.seen += 1
                    self.rest = self.rest[4 + n :]
        except TimeoutError:
            pass

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._take()
        rows = [(i, self.waiting[i]) for i in range(start["at"], self.seen) if i in self.waiting]
        return iter(rows), {"at": self.seen}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(i, self.waiting[i]) for i in range(start["at"], end["at"]) if i in self.waiting])

    def commit(self, end: dict) -> None:
        self.waiting = {i: x for i, x in self.waiting.items() if i >= end["at"]}


class FramedTcp(DataSource):
    """``readStream.format("framed_tcp").option("port", ...)``: rows ``(seq, message)``, message being JSON.

    One-way: nothing is answered. What a broken connection had not delivered is lost, as the server keeps nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "framed_tcp"

    def schema(self) -> str:
        return "seq long, message string"

    def simpleStreamReader(self, schema) -> FrameReader:
        return FrameReader(self.options)


__all__ = ["FramedTcp", "FrameReader", "InputPartition", "pack_frame", "running_histogram", "running_stats", "windowed_stats"]
