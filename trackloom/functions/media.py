"""Headers of sound and video payloads as Column expressions, and the names of codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.arith import SAMPLE_RATES, VORBIS_BANDS  # noqa: F401
from trackloom.functions.octets import bits, number

#: How codecs and orientations are shown.
VIDEO_CODECS = {"h264": "H.264", "vp8": "VP8 [decode not supported]", "jpg": "JPG", "png": "PNG", "mpeg4": "MPEG-4 Visual [not supported]", "prores": "Apple ProRes [not supported]", "gif": "GIF", "bmp": "BMP", "webp": "WebP", "tiff": "TIFF"}
AUDIO_CODECS = {
    "aac_main": "AAC (Main)", "aac_lc": "AAC (LC)", "aac_lc_sbr": "AAC (LC-SBR)", "vorbis": "Vorbis [decode not supported]", "pcm_s16le": "PCM (Signed 16-bit Little Endian)",
    "pcm_s16be": "PCM (Signed 16-bit Big Endian)", "pcm_s24le": "PCM (Signed 24-bit Little Endian)", "pcm_s24be": "PCM (Signed 24-bit Big Endian)",
}
ORIENTATIONS = ("Landscape", "Portrait", "Landscape Reverse", "Portrait Reverse")


def shown_codec(codec: Column, kind: str) -> Column:
    """A codec as listings show it."""
    names = VIDEO_CODECS if kind == "video" else AUDIO_CODECS
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, codec), F.lit("Unknown"))


def shown_orientation(quarter: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, ORIENTATIONS)), quarter.cast("int")), F.lit("Unknown orientation"))


def _rate(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, SAMPLE_RATES)), index.cast("int"))


def adts(content: Column) -> Column:
    """The ADTS header that sound begins with: (codec, sample_rate, channels, header_size, data_size, error); null unless the whole frame is there.

    Invalid: no sync word, a layer, an unknown rate, or nothing behind the header; Unsupported: MPEG-2, channels other than one or two, several frames in one.
    """
    part = lambda first, count: bits(content, first, count)
    channels, length, header = part(23, 3), part(30, 13), F.when(part(15, 1) == 1, 7).otherwise(9)
    error = (
        F.when(part(0, 12) != 0xFFF, "Invalid")
        .when(part(12, 1) != 0, "Unsupported")
        .when((part(13, 2) != 0) | (part(18, 4) > 12), "Invalid")
        .when(~channels.isin(1, 2), "Unsupported")
        .when((length <= F.octet_length(content)) & (part(54, 2) != 0), "Unsupported")
        .when((length <= F.octet_length(content)) & (length <= header), "Invalid")
    )
    codec = F.when(part(16, 2) == 0, "aac_main").when(part(16, 2) == 1, "aac_lc").otherwise("unknown")
    whole = (F.octet_length(content) >= 7) & (error.isNotNull() | (length <= F.octet_length(content)))
    ok = lambda c: F.when(error.isNull(), c)
    return F.when(
        whole,
        F.struct(ok(codec).alias("codec"), ok(_rate(part(18, 4))).alias("sample_rate"), ok(channels.cast("int")).alias("channels"), ok(header).alias("header_size"), ok((length - header).cast("int")).alias("data_size"), error.alias("error")),
    )


def adts_header(size: Column, sample_rate: int, channels: int, object_type: int = 2) -> Column:
    """The seven bytes before a sound frame of ``size`` bytes."""
    frame, rate = size + 7, SAMPLE_RATES.index(sample_rate)
    fixed = (0xFF, 0xF1, ((object_type - 1) << 6) | (rate << 2) | (channels & 4))
    parts = [F.lit(b) for b in fixed] + [
        F.shiftright(frame, 11).bitwiseOR(F.lit((channels & 3) << 6)),
        F.shiftright(frame, 3).bitwiseAND(F.lit(0xFF)),
        F.shiftleft(frame, 5).bitwiseAND(F.lit(0xE0)).bitwiseOR(F.lit(0x1F)),
        F.lit(0xFC),
    ]
    return F.unhex(F.concat(*[F.lpad(F.hex(p.cast("long")), 2, "0") for p in parts]))


def audio_config(content: Column) -> Column:
    """Of an AAC configuration: (object_type, sample_rate, channels); a rate index of 15 is followed by the rate itself."""
    index = bits(content, 5, 4)
    own = index == 15
    rate = F.when(own, bits(content, 9, 24)).otherwise(_rate(index).cast("long"))
    channels = F.when(own, bits(content, 33, 4)).otherwise(bits(content, 9, 4))
    return F.struct(bits(content, 0, 5).cast("int").alias("object_type"), rate.alias("sample_rate"), channels.cast("int").alias("channels"))


#: Fixed value: bytes of a parameter set at most.
MOST_HEADER = 0x1000


def avc_config(content: Column) -> Column:
    """Of an H.264 configuration: (length_size, sps, pps, error), all but ``error`` null where there is one.

    Invalid: another version, too short, not one sequence set, an empty set, sizes that don't end with the data; Unsupported: sizes of one
    or three bytes, not one picture set, extensions; Unsafe: a set that is too large. Four more bytes may follow the sets.
    """
    byte = lambda at: F.conv(F.hex(F.substring(content, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    size = F.octet_length(content)
    length = (bits(content, 38, 2) + 1).cast("int")
    sps_size = number(content, 6, 2)
    at = sps_size + 8
    pps_size = byte(at + 1) * 256 + byte(at + 2)
    end = at + 3 + pps_size
    error = (
        F.when(size <= 8, "Invalid")
        .when(byte(F.lit(0)) != 1, "Invalid")
        .when(length.isin(1, 3), "Unsupported")
        .when((bits(content, 43, 5) != 1) | (sps_size == 0), "Invalid")
        .when(sps_size > MOST_HEADER, "Unsafe")
        .when(size <= at + 2, "Invalid")
        .when(byte(at) != 1, "Unsupported")
        .when(F.coalesce(pps_size, F.lit(0)) == 0, "Invalid")
        .when(pps_size > MOST_HEADER, "Unsafe")
        .when((end != size) & (end + 4 != size), "Invalid")
        .when((end + 4 == size) & (byte(end + 3) != 0), "Unsupported")
    )
    ok = lambda c: F.when(error.isNull(), c)
    sps, pps = F.substring(content, F.lit(9), sps_size.cast("int")), F.substring(content, (at + 4).cast("int"), pps_size)
    return F.when(content.isNotNull(), F.struct(ok(length).alias("length_size"), ok(sps).alias("sps"), ok(pps).alias("pps"), error.alias("error")))


def digits(text: Column) -> Column:
    """Whether a text is one or more ASCII digits."""
    return F.coalesce(F.regexp_like(text, F.lit(r"^[0-9]+\z")), F.lit(False))


def hex_dump(content: Column) -> Column:
    """Bytes as lower-case pairs of digits with blanks between them."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(content)), "(..)", "$1 "))
