"""File sources: byte scans, container boxes, and the registry of pluggable codecs."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.octets import sniff

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf"}


class MissingDependency(RuntimeError):
    """A codec that no one has registered was asked for."""


_CODECS: dict[tuple[str, str], Callable[[bytes], object]] = {}


def register_codec(kind: str, direction: str, function: Callable[[bytes], object]) -> None:
    """Plug a third-party ``decode`` or ``encode`` function in for a codec."""
    _CODECS[kind, direction] = function


def codec(kind: str, direction: str = "decode") -> Callable[[bytes], object]:
    if (kind, direction) not in _CODECS:
        raise MissingDependency(f"no {direction} function is registered for {kind}")
    return _CODECS[kind, direction]


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, kind, content) of every file below ``path``; only the columns that are used are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", sniff(F.col("content")).alias("kind"), "content")


def boxes_of(data: bytes | memoryview, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[str, int, int, int]]:
    """(type, offset, size, depth) of all boxes of an MP4 file; a size of 0 reaches to the end, 1 has 8 more bytes of size."""
    end, at = len(data) if end is None else end, start
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            return
        kind = bytes(data[at + 4 : at + 8])
        yield kind.decode("latin-1"), at, size, depth
        if kind in CONTAINERS:
            yield from boxes_of(data, at + head, at + size, depth + 1)
        at += size


def mp4_boxes(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with the array ``boxes`` of their box headers.

    A batch may hold thousands of files: their bytes are looked at where they lie, and boxes are four columns instead of objects.
    """

    @F.arrow_udf("array<struct<type:string,offset:bigint,size:bigint,depth:int>>")
    def boxes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends, kinds, numbers = array("i", [0]), [], (array("q"), array("q"), array("i"))
            for x in batch:
                for kind, *found in boxes_of(memoryview(x.as_buffer()) if x.is_valid else b""):
                    kinds.append(sys.intern(kind))
                    for column, n in zip(numbers, found, strict=True):
                        column.append(n)
                ends.append(len(kinds))
            columns = [pa.array(kinds, pa.string()), *(pa.array(np.asarray(c)) for c in numbers)]
            yield pa.ListArray.from_arrays(pa.array(np.asarray(ends)), pa.StructArray.from_arrays(columns, names=["type", "offset", "size", "depth"]))

    return files.withColumn("boxes", boxes(content))
