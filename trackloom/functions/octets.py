"""Bytes: bit fields, NAL units, box headers, signatures, paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Container and image signatures in the order in which they are tried; (kind, offset, hex bytes).
SIGNATURES = (
    ("jpeg", 0, "FFD8FF"),
    ("png", 0, "89504E470D0A1A0A"),
    ("gif", 0, "47494638"),
    ("bmp", 0, "424D"),
    ("webp", 8, "57454250"),
    ("tiff", 0, "49492A00"),
    ("tiff", 0, "4D4D002A"),
    ("mp2ts", 0, "47"),
    ("webm", 0, "1A45DFA3"),
    ("mp4", 4, "66747970"),
)

NAL_LIST = "array<struct<type:int,byte_offset:int,size:int,prefix:int>>"
#: NAL types that are told apart; all others are 255.
NAL_TYPES = (1, 5, 6, 7, 8, 9, 10, 11, 12)


def number(content: Column, at: int, size: int) -> Column:
    """``size`` bytes from ``at`` (from 0) as an unsigned big-endian number."""
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("long")


def sniff(content: Column) -> Column:
    """The kind of file by its first bytes, or ``unknown``."""
    found = None
    for kind, at, digits in SIGNATURES:
        fits = F.substring(content, at + 1, len(digits) // 2) == F.unhex(F.lit(digits))
        found = F.when(fits, kind) if found is None else found.when(fits, kind)
    return F.coalesce(found, F.lit("unknown"))


def bits(content: Column, first: int, count: int) -> Column:
    """``count`` (1 to 32) bits from bit ``first``, most significant first."""
    start, end = first // 8, (first + count + 7) // 8
    return F.shiftright(number(content, start, end - start), end * 8 - first - count).bitwiseAND(F.lit((1 << count) - 1).cast("long"))


def nal_type(content: Column, at: int = 0) -> Column:
    kind = number(content, at, 1).bitwiseAND(F.lit(0x1F).cast("long")).cast("int")
    return F.when(kind.isin(*NAL_TYPES), kind).otherwise(F.lit(255))


def big_endian(n: Column, size: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(n), size * 2, "0"))


def _kind(first: int) -> int:
    return first & 0x1F if first & 0x1F in NAL_TYPES else 255


def annexb_units(data: bytes) -> list[dict[str, int]]:
    """NAL units between 3- or 4-byte start codes."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 4:
        return []
    marks = np.flatnonzero((raw[:-2] == 0) & (raw[1:-1] == 0) & (raw[2:] == 1)).tolist()
    if not marks:
        return []
    begins = [(m - 1, 4) if m and raw[m - 1] == 0 else (m, 3) for m in marks]
    ends = [b for b, _ in begins[1:]] + [len(raw)]
    return [{"type": _kind(data[b + p]), "byte_offset": b + p, "size": e - b - p, "prefix": p} for (b, p), e in zip(begins, ends, strict=True) if b + p < e]


def avcc_units(data: bytes, prefix: int = 4) -> list[dict[str, int]]:
    """NAL units that each follow their size; a size beyond the data ends the list."""
    found, at = [], 0
    while at + prefix < len(data):
        size = int.from_bytes(data[at : at + prefix], "big")
        if not size or at + prefix + size > len(data):
            break
        found.append({"type": _kind(data[at + prefix]), "byte_offset": at + prefix, "size": size, "prefix": prefix})
        at += prefix + size
    return found


_NAL = pa.list_(pa.struct([(c, pa.int32()) for c in ("type", "byte_offset", "size", "prefix")]))


def nal_units(content: Column, form: str = "annexb", prefix: int = 4) -> Column:
    """The NAL units of a payload, in ``annexb`` or ``avcc`` form."""

    @F.arrow_udf(NAL_LIST)
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([(annexb_units(x) if form == "annexb" else avcc_units(x, prefix)) if x is not None else None for x in batch.to_pylist()], _NAL)

    return units(content)


def convert_nals(content: Column, to: str, prefix: int = 4) -> Column:
    """A payload with start codes turned into sizes (``to`` is ``avcc``), or back (``annexb``)."""

    @F.arrow_udf("binary")
    def turned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                units = [] if x is None else annexb_units(x) if to == "avcc" else avcc_units(x, prefix)
                head = (lambda n: n.to_bytes(prefix, "big")) if to == "avcc" else (lambda n: b"\x00\x00\x00\x01")
                out.append(None if x is None else b"".join(head(u["size"]) + x[u["byte_offset"] : u["byte_offset"] + u["size"]] for u in units))
            yield pa.array(out, pa.binary())

    return turned(content)


#: The message of registered user data, which captions are, and the byte that keeps start codes out.
CAPTION_MESSAGE, PREVENTION, TRAILING = 4, 3, 0x80


def sei_messages(data: bytes) -> tuple[list[tuple[int, int, int]], bool]:
    """(type, first byte, size) of the messages of an SEI unit, headers included, and whether all could be read.

    Types and sizes are sums of bytes of which all but the last are 255; bytes that keep start codes out count
    besides the size.
    """
    found, at = [], 1
    while len(data) - at > 1:
        place, values = at, []
        for _ in range(2):
            value = 0
            while place < len(data) and data[place] == 255:
                value, place = value + 255, place + 1
            if place >= len(data):
                return found, False
            values.append(value + data[place])
            place += 1
        kind, size = values
        k = 0
        while k < size - 2:
            if place + k + 2 >= len(data):
                return found, False
            size += data[place + k : place + k + 3] == bytes([0, 0, PREVENTION])
            k += 1
        found.append((kind, at, place + size - at))
        at = place + size
    return found, True


def captions(content: Column, prefix: int = 4) -> Column:
    """The caption messages of an SEI unit as a unit of their own after its size; empty if there are none, null if the unit can't be read."""

    @F.arrow_udf("binary")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                found, whole = sei_messages(x) if x is not None else ([], False)
                body = b"".join(x[a : a + n] for kind, a, n in found if kind == CAPTION_MESSAGE)
                unit = bytes([6]) + body + bytes([TRAILING])
                out.append(None if not whole else len(unit).to_bytes(prefix, "big") + unit if body else b"")
            yield pa.array(out, pa.binary())

    return cut(content)


def has_type(units: Column, kind: int) -> Column:
    return F.exists(units, lambda u: u["type"] == kind)


def parameter_sets(units: Column) -> Column:
    """Whether a payload holds both parameter sets; only one of them is an error."""
    both, either = has_type(units, 7) & has_type(units, 8), has_type(units, 7) | has_type(units, 8)
    return F.when(either & ~both, F.raise_error(F.lit("Unsupported: one parameter set without the other"))).otherwise(both)


def extradata(sps: Column, pps: Column, size: int = 4, form: str = "iso") -> Column:
    """Parameter sets as bytes: with 2-byte sizes (``iso``), start codes (``annex_b``) or ``size``-byte sizes (``avcc``)."""
    if form == "annex_b":
        mark = F.unhex(F.lit("00000001"))
        return F.concat(mark, sps, mark, pps)
    n = 2 if form == "iso" else size
    return F.concat(big_endian(F.octet_length(sps), n), sps, big_endian(F.octet_length(pps), n), pps)


# ---------------------------------------------------------------- paths

def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


#: Output types by a part of the path, in the order in which they are tried.
OUTPUTS = ((".mp4", "mp4"), (".m4a", "mp4"), (".m4v", "mp4"), (".mov", "mp4"), (".ts", "mp2ts"), (".webm", "webm"))


def output_kind(path: Column) -> Column:
    """The type of the first known part that the path holds anywhere, or ``unknown``."""
    found = None
    for part, kind in OUTPUTS:
        fits = F.contains(path, F.lit(part))
        found = F.when(fits, kind) if found is None else found.when(fits, kind)
    return found.otherwise("unknown")


def offsets(text: Column) -> Column:
    """``a0:v0;a1:v1`` as an array of (audio, video) seconds."""
    pairs = F.filter(F.split(text, ";"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.split(p, ":")[0].cast("double").alias("audio"), F.split(p, ":")[1].cast("double").alias("video")))


def _parsed(text: Column, pattern: str, k: int) -> Column:
    """A group of the pattern as a number; null without a match or beyond its range."""
    return F.regexp_extract(text, pattern, k).try_cast("int")


def wanted_size(text: Column) -> Column:
    """``WxH``, ``W%xH%``, ``W%`` or ``W``, whatever follows, as (width, height, percent); one number is percent of both, with its mark or without. Null if it is none of them."""
    both, plain, one = r"^\s*(\d+)%x(\d+)", r"^\s*(\d+)x(\d+)", r"^\s*(\d+)"
    size = lambda w, h, p: F.struct(w.alias("width"), h.alias("height"), p.alias("percent"))
    return (
        F.when(_parsed(text, both, 1).isNotNull() & _parsed(text, both, 2).isNotNull(), size(_parsed(text, both, 1), _parsed(text, both, 2), F.lit(True)))
        .when(_parsed(text, plain, 1).isNotNull() & _parsed(text, plain, 2).isNotNull(), size(_parsed(text, plain, 1), _parsed(text, plain, 2), F.lit(False)))
        .when(_parsed(text, one, 1).isNotNull(), size(_parsed(text, one, 1), _parsed(text, one, 1), F.lit(True)))
    )


def region(text: Column) -> Column:
    """``WxH``, ``WxHTy``, ``WxHLx`` or ``WxHLxTy``, whatever follows, as (width, height, left, top), missing places being 0. Null if it is none of them."""
    size, only_top, places = r"^\s*(\d+)x(\d+)", r"^\s*\d+x\d+T(\d+)", r"^\s*\d+x\d+L(\d+)(?:T(\d+))?"
    or_0 = lambda c: F.coalesce(c, F.lit(0))
    top = F.coalesce(_parsed(text, only_top, 1), _parsed(text, places, 2))
    whole = F.struct(_parsed(text, size, 1).alias("width"), _parsed(text, size, 2).alias("height"), or_0(_parsed(text, places, 1)).alias("left"), or_0(top).alias("top"))
    return F.when(_parsed(text, size, 1).isNotNull() & _parsed(text, size, 2).isNotNull(), whole)


def hex_colour(text: Column) -> Column:
    """``#rrggbb`` as (r, g, b): the three bytes of the number behind the mark. Null without mark and digits, or if the number has more bytes."""
    digits = F.lpad(F.regexp_extract(text, "^#0*([0-9a-fA-F]*)", 1), 6, "0")
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    fits = F.regexp_like(text, F.lit("^#[0-9a-fA-F]")) & (F.length(F.regexp_extract(text, "^#0*([0-9a-fA-F]*)", 1)) <= 6)
    return F.when(fits, F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))
