"""Captions that stand in pictures' payloads: the payload without them, and a track of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.octets import CAPTION_MESSAGE, TRAILING, annexb_units, avcc_units, sei_messages

#: Fixed value: the type of units that hold messages.
SEI = 6
_FOUND = pa.struct([("ranges", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("captions", pa.binary()), ("held", pa.bool_()), ("readable", pa.bool_())])


def message_units(content: Column, form: str = "avcc", prefix: int = 4) -> Column:
    """Of a payload: the ``ranges`` of its message units with what precedes them, its ``captions`` as units of their own, whether it ``held`` any, and whether all units were ``readable``."""

    @F.arrow_udf("struct<ranges:array<struct<start:int,end:int>>,captions:binary,held:boolean,readable:boolean>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                units = [] if x is None else [u for u in (avcc_units(x, prefix) if form == "avcc" else annexb_units(x)) if u["type"] == SEI]
                captions, readable = b"", True
                for u in units:
                    data = x[u["byte_offset"] : u["byte_offset"] + u["size"]]
                    messages, whole = sei_messages(data)
                    body = b"".join(data[a : a + n] for kind, a, n in messages if kind == CAPTION_MESSAGE)
                    readable &= whole
                    if whole and body:
                        captions += (len(body) + 2).to_bytes(prefix, "big") + bytes([SEI]) + body + bytes([TRAILING])
                ranges = [{"start": u["byte_offset"] - u["prefix"], "end": u["byte_offset"] + u["size"]} for u in units]
                out.append({"ranges": ranges, "captions": captions, "held": bool(captions), "readable": readable})
            yield pa.array(out, _FOUND)

    return found(content)


def without(content: Column, ranges: Column) -> Column:
    """The bytes that no range (ordered, apart) covers."""
    starts = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["end"]))
    ends = F.concat(F.transform(ranges, lambda r: r["start"]), F.array(F.octet_length(content)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.hex(F.substring(content, a + 1, b - a)))
    return F.unhex(F.array_join(pieces, ""))


def split(samples: DataFrame, content: str = "content", form: str = "avcc", prefix: int = 4) -> DataFrame:
    """``samples`` with ``picture``, the payload without its message units if one of them is a caption, and ``caption``, its captions.

    A payload without captions stays whole, other messages included. ``caption`` is empty without captions, and null
    where a message unit can't be read, which is Invalid for a caption track.
    """
    parts = samples.withColumn("__parts", message_units(F.col(content), form, prefix))
    cut = F.when(F.col("__parts.held"), without(F.col(content), F.col("__parts.ranges"))).otherwise(F.col(content))
    return parts.withColumns({"picture": cut, "caption": F.when(F.col("__parts.readable"), F.col("__parts.captions"))}).drop("__parts")


def tracks(samples: DataFrame, content: str = "content", form: str = "avcc", prefix: int = 4) -> DataFrame:
    """Pictures without captions, and a caption row for every picture: ``samples`` twice, told apart by ``type``, with their own payload and size."""
    rows = split(samples.where("type = 'video'"), content, form, prefix)
    kinds = F.array(F.struct(F.lit("video").alias("type"), F.col("picture").alias("payload")), F.struct(F.lit("caption").alias("type"), F.col("caption").alias("payload")))
    both = rows.withColumn("__kind", F.explode(kinds))
    kept = [F.col(f"`{c}`") for c in samples.columns if c not in ("type", "size", content)]
    return both.select(*kept, F.col("__kind.type").alias("type"), F.octet_length("__kind.payload").alias("size"), F.col("__kind.payload").alias(content))
