"""Transport streams, read into frames and written from them, as array, window and grouping expressions.

A stream is cells of 188 bytes. Cells of one ``pid`` make packets, which begin where a cell says so, and
packets make frames: a picture begins at the first delimiter unit in a packet, what stands before it still
belongs to the picture before, so frames are a running count of delimiters and a grouping. Sound frames tell
their own length, so where one begins depends on all before it; that chain is a fold whose state is the bytes
left over from the last packet.

Written the other way: a picture's last bytes may wait for the next packet, where this saves a cell. How many
wait depends on those that waited before, a number below 184, so each picture maps 184 states to 184 states;
blocks of pictures are composed, then blocks, and no track is walked from its start.

Tables of programs are taken from one cell each. Times count 90,000 a second; frames have them in 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import media
from trackloom.functions.arith import div, once
from trackloom.functions.octets import big_endian, extradata, nal_units, number
from trackloom.sources.tables import materialise

CELL, CAPACITY = 188, 184
#: Kinds of streams by their type number, ids of packets, the delimiter before a picture, and how many frames a track may have.
KINDS = {0x1B: "video", 0x0F: "audio", 0x15: "data"}
PACKET_IDS = {"video": 0xE0, "audio": 0xC0, "data": 0xBD}
DELIMITER = bytes.fromhex("0000000109f0")
MOST_FRAMES = 0x1000
#: Numbers that written streams use.
PROGRAM, PIDS = 0x1000, {"video": 0x100, "audio": 0x101, "data": 0x102}
STREAM = ["path", "pid"]
#: Pictures whose carries are composed as one, and those that are walked as one.
BLOCK, CHAIN = 512, 32

_WRAP = 1 << 32


def _at(content: Column, first, size) -> Column:
    """``size`` bytes from byte ``first`` (from 0)."""
    as_int = lambda x: x.cast("int") if isinstance(x, Column) else F.lit(x)
    return F.substring(content, as_int(first) + 1, as_int(size))


def _byte(content: Column, first) -> Column:
    return F.conv(F.hex(_at(content, first, 1)), 16, 10).cast("int")


def _joined(order: str, piece: str = "piece") -> Column:
    return F.expr(f"listagg({piece}) within group (order by {order})")


# ---------------------------------------------------------------- reading

def cells(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(path, n, pid, starts, counter, random, payload, error) of every whole cell of files."""
    count = div(F.octet_length(content), CELL)
    # A row for each cell first and its bytes after that, as a lambda would be interpreted.
    rows = files.select(F.col(key).alias("path"), F.col(content).alias("__content"), F.explode(F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1))).alias("n"))
    rows = rows.select("path", "n", _at(F.col("__content"), F.col("n") * CELL, CELL).alias("cell"))
    head, control, extra = number(F.col("cell"), 1, 2), _byte(F.col("cell"), 3), _byte(F.col("cell"), 4)
    has = lambda flag: control.bitwiseAND(F.lit(flag)) != 0
    begin = F.when(has(0x20), extra + 5).otherwise(4)
    payload = F.when(has(0x10), _at(F.col("cell"), begin, F.greatest(F.lit(CELL) - begin, F.lit(0))))
    random = has(0x20) & (extra > 0) & (_byte(F.col("cell"), 5).bitwiseAND(F.lit(0x40)) != 0)
    return rows.select(
        "path", F.col("n").cast("long").alias("n"), head.bitwiseAND(F.lit(0x1FFF).cast("long")).cast("int").alias("pid"), (head.bitwiseAND(F.lit(0x4000).cast("long")) != 0).alias("starts"),
        control.bitwiseAND(F.lit(15)).alias("counter"), random.alias("random"), payload.alias("payload"), F.when(_byte(F.col("cell"), 0) != 0x47, "Invalid").alias("error"),
    )


def streams(rows: DataFrame) -> DataFrame:
    """(path, pid, kind) of the streams that the first program of each file lists."""
    first = rows.where("starts and pid = 0").groupBy("path").agg(F.min_by("payload", "n").alias("p"))
    start = _byte(F.col("p"), 0) + 1  # behind what the pointer skips
    program = first.select("path", number_at(F.col("p"), start + 10, 2).bitwiseAND(F.lit(0x1FFF).cast("long")).cast("int").alias("pid"))
    tables = rows.where("starts").join(program, STREAM).groupBy("path").agg(F.min_by("payload", "n").alias("p"))
    length = number_at(F.col("p"), start + 1, 2).bitwiseAND(F.lit(0xFFF).cast("long")).cast("int")
    skipped = number_at(F.col("p"), start + 10, 2).bitwiseAND(F.lit(0xFFF).cast("long")).cast("int")
    tables = tables.withColumns({"at": start + 12 + skipped, "end": start + 3 + length - 4})

    def entry(state: Column, _: Column) -> Column:
        at = state["at"]
        one = F.struct(_byte(F.col("p"), at).alias("type"), number_at(F.col("p"), at + 1, 2).bitwiseAND(F.lit(0x1FFF).cast("long")).cast("int").alias("pid"))
        info = number_at(F.col("p"), at + 3, 2).bitwiseAND(F.lit(0xFFF).cast("long")).cast("int")
        return F.when(at + 5 <= F.col("end"), F.struct((at + 5 + info).alias("at"), F.concat(state["found"], F.array(one)).alias("found"))).otherwise(state)

    none = F.struct(F.col("at").alias("at"), F.array().cast("array<struct<type:int,pid:int>>").alias("found"))
    listed = tables.select("path", F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(CAPACITY // 5)), none, entry)["found"]).alias("s"))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("s.type")]
    return listed.select("path", F.col("s.pid").alias("pid"), kind.alias("kind")).where("kind is not null")


def number_at(content: Column, first, size: int) -> Column:
    """``size`` bytes from a byte that a column tells, as an unsigned number."""
    return F.conv(F.hex(_at(content, first, size)), 16, 10).cast("long")


def _time(content: Column, first: int) -> Column:
    """The 33 bits of a time in five bytes."""
    b = [_byte(content, first + k).cast("long") for k in range(5)]
    return F.shiftleft(F.shiftright(b[0], 1).bitwiseAND(F.lit(7).cast("long")), 30) + F.shiftleft(b[1], 22) + F.shiftleft(F.shiftright(b[2], 1), 15) + F.shiftleft(b[3], 7) + F.shiftright(b[4], 1)


def packets(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, pid, kind, packet, pts, dts, data) of the streams of files, from their cells."""
    rows = rows.join(known if known is not None else streams(rows), STREAM).where("payload is not null and octet_length(payload) > 0")
    along = Window.partitionBy(*STREAM).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("packet", F.sum(F.col("starts").cast("long")).over(along)).where("packet > 0")
    whole = rows.groupBy(*STREAM, "kind", "packet").agg(_joined("n", "payload").alias("p"))
    p, flags, skipped = F.col("p"), F.shiftright(_byte(F.col("p"), 7), 6), _byte(F.col("p"), 8)
    length = number(p, 4, 2)
    size = F.when(length > 0, length - 3 - skipped).otherwise(F.octet_length(p) - 9 - skipped)
    pts = F.when(flags >= 2, _time(p, 9))
    return whole.select(*STREAM, "kind", (F.col("packet") - 1).alias("packet"), pts.alias("pts"), F.when(flags == 3, _time(p, 14)).otherwise(pts).alias("dts"), _at(p, skipped + 9, size).alias("data"))


def delimiter_at(content: Column) -> Column:
    """Where the first delimiter unit begins, its start code included, or -1."""
    kinds = "".join(f"\\x{9 + 32 * k:02x}" for k in range(8))
    return F.regexp_instr(F.decode(content, "ISO-8859-1"), F.lit(f"(?s)\\x00?\\x00\\x00\\x01[{kinds}]")) - 1


def pictures(rows: DataFrame) -> DataFrame:
    """(path, pid, idx, pts, dts, keyframe, content, sets, unit, error) of the pictures in packets.

    ``content`` begins with the picture's first slice; a keyframe's follows the newest parameter sets. ``unit``
    is the whole unit of access. Invalid: a packet with a delimiter but no time, or whose time goes back; one without
    a delimiter that has another time than its picture; data before the first delimiter; one parameter set without
    the other; no slice; a keyframe before any parameter sets. Unsafe: too many frames.
    """
    rows = rows.withColumn("at", delimiter_at(F.col("data")))
    along = Window.partitionBy(*STREAM).orderBy("packet").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("frame", F.sum((F.col("at") >= 0).cast("long")).over(along))
    head = F.struct((F.col("frame") - (F.col("at") >= 0).cast("long")).alias("frame"), F.when(F.col("at") >= 0, _at(F.col("data"), 0, F.col("at"))).otherwise(F.col("data")).alias("piece"), F.lit(False).alias("first"))
    tail = F.struct("frame", _at(F.col("data"), F.col("at"), F.octet_length("data") - F.col("at")).alias("piece"), F.lit(True).alias("first"))
    pieces = rows.select(*STREAM, "packet", "pts", "dts", (F.col("at") < 0).alias("alone"), F.explode(F.when(F.col("at") > 0, F.array(head, tail)).when(F.col("at") == 0, F.array(tail)).otherwise(F.array(head))).alias("x"))
    pieces = pieces.select(*STREAM, "packet", "pts", "dts", "alone", "x.frame", "x.piece", "x.first")
    own = lambda c: F.max(F.when(F.col("first"), F.col(c)))
    again = F.collect_set(F.when(F.col("alone") & F.col("pts").isNotNull(), F.struct("pts", "dts")))
    frames = pieces.groupBy(*STREAM, "frame").agg(own("pts").alias("pts"), own("dts").alias("dts"), _joined("packet").alias("unit"), again.alias("again"))
    frames = frames.withColumn("units", nal_units(F.col("unit")))

    picture = F.get(F.filter("units", lambda u: u["type"].isin(1, 5)), 0)
    numbered = F.transform("units", lambda u, i: F.struct(u.alias("u"), i.alias("i")))
    before = F.filter(numbered, lambda x: (x["u"]["type"] == 7) & F.coalesce(x["u"]["byte_offset"] < F.col("picture.byte_offset"), F.lit(True)))
    body = lambda u: _at(F.col("unit"), u["byte_offset"], u["size"])
    frames = frames.withColumn("picture", picture).withColumn("sps", F.get(before, F.size(before) - 1))
    frames = frames.withColumn("pps", F.get("units", F.col("sps.i") + 1))
    lone = F.col("sps").isNotNull() & ~F.coalesce(F.col("pps.type") == 8, F.lit(False))
    sets = F.when(F.col("sps").isNotNull() & ~lone, extradata(body(F.col("sps.u")), body(F.col("pps")), form="annex_b"))
    order = Window.partitionBy(*STREAM).orderBy("frame")
    newest = F.last("sets", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    frames = frames.withColumn("sets", sets).withColumns({"newest": newest, "before": F.lag("dts").over(order)})
    keyframe = F.col("picture.type") == 5
    start = F.col("picture.byte_offset") - F.col("picture.prefix")
    slices = _at(F.col("unit"), start, F.octet_length("unit") - start)
    invalid = (
        (F.col("frame") == 0) | F.col("pts").isNull() | F.coalesce(F.col("dts") < F.col("before"), F.lit(False)) | lone | F.col("picture").isNull() | (keyframe & F.col("newest").isNull())
        | F.exists("again", lambda t: (t["pts"] != F.col("pts")) | (t["dts"] != F.col("dts")))
    )
    return frames.select(
        *STREAM, (F.col("frame") - 1).alias("idx"), F.pmod("pts", F.lit(_WRAP)).alias("pts"), F.pmod("dts", F.lit(_WRAP)).alias("dts"), F.coalesce(keyframe, F.lit(False)).alias("keyframe"),
        F.when(keyframe, F.concat("newest", slices)).otherwise(slices).alias("content"), "sets", "unit", F.when(F.col("frame") > MOST_FRAMES, "Unsafe").when(invalid, "Invalid").alias("error"),
    )


_SOUND = "path string, pid int, packet long, nth long, pts long, dts long, frame binary, error string"


def _sound_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each packet's frames; what a packet begins and the next one ends counts to the first. The state is one frame's first bytes."""
    stream, rest, broken = None, b"", False
    began: tuple = ()
    for batch in batches:
        out = []
        for path, pid, packet, pts, dts, data in zip(*(batch.column(c).to_pylist() for c in ("path", "pid", "packet", "pts", "dts", "data")), strict=True):
            if (path, pid) != stream:
                stream, rest, broken, nth = (path, pid), b"", False, 0
            if broken:
                continue
            begun = len(rest)
            held, at, nth = rest + data, 0, 0
            rest = b""
            while at < len(held):
                first = (packet, nth, pts, dts) if at or not begun else began
                size = int.from_bytes(held[at + 3 : at + 6], "big") >> 5 & 0x1FFF if len(held) - at >= 7 else 0
                sound = held[at] == 0xFF and (len(held) - at < 2 or held[at + 1] >> 4 == 0xF)
                if not sound or (len(held) - at >= 7 and size <= 7):
                    out.append((path, pid, *first, held[at:], "Invalid"))
                    broken = True
                    break
                if len(held) - at < 7 or at + size > len(held):
                    if begun and not at:
                        out.append((path, pid, *first, held, "Unsupported"))  # a frame in more than two packets
                        broken = True
                    rest, began = held[at:], first
                    break
                out.append((path, pid, *first, held[at : at + size], None))
                nth += bool(at or not begun)
                at += size
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "pid", "packet", "nth", "pts", "dts", "frame", "error"), zip(*out, strict=True), strict=True)), schema=_SOUND_ARROW)


_SOUND_ARROW = pa.schema([("path", pa.string()), ("pid", pa.int32()), *[(c, pa.int64()) for c in ("packet", "nth", "pts", "dts")], ("frame", pa.binary()), ("error", pa.string())])


def sounds(rows: DataFrame) -> DataFrame:
    """(path, pid, idx, packet, pts, dts, codec, sample_rate, channels, content, error) of the sound frames in packets.

    Frames that begin in one packet share its time, moved by 1024 samples each. After an invalid frame, or one in more
    than two packets, a stream ends with a row that says so. Unsafe: too many frames.
    """
    ordered = rows.select(*STREAM, "packet", "pts", "dts", "data").repartition(*STREAM).sortWithinPartitions(*STREAM, "packet")
    found = ordered.mapInArrow(_sound_frames, _SOUND).withColumn("h", media.adts(F.col("frame")))
    later = div(F.col("nth") * (90000 * 1024), F.col("h.sample_rate"))
    number_ = (F.row_number().over(Window.partitionBy(*STREAM).orderBy("packet", "nth")) - 1).cast("long")
    content = _at(F.col("frame"), F.col("h.header_size"), F.col("h.data_size"))
    moved = lambda c: F.pmod(F.col(c) + F.coalesce(later, F.lit(0).cast("long")), F.lit(_WRAP)).alias(c)
    error = F.coalesce("error", F.col("h.error"), F.when(F.col("idx") >= MOST_FRAMES, "Unsafe"))
    return found.withColumn("idx", number_).select(*STREAM, "idx", "packet", moved("pts"), moved("dts"), "h.codec", "h.sample_rate", "h.channels", content.alias("content"), error.alias("error"))


def read(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(path, type, idx, pts, dts, keyframe, content, error) of all frames of transport streams; data packets are frames as they are.

    Packets are a table that the three kinds read, so files are cut into cells once for them.
    """
    all_packets = materialise(packets(cells(files, key, content)), "packets")
    video = pictures(all_packets.where("kind = 'video'")).select("path", F.lit("video").alias("type"), "idx", "pts", "dts", "keyframe", "content", "error")
    audio = sounds(all_packets.where("kind = 'audio'")).select("path", F.lit("audio").alias("type"), "idx", "pts", "dts", F.lit(True).alias("keyframe"), "content", "error")
    data = all_packets.where("kind = 'data'").select("path", F.lit("data").alias("type"), F.col("packet").alias("idx"), F.pmod("pts", F.lit(_WRAP)).alias("pts"), F.pmod("dts", F.lit(_WRAP)).alias("dts"), F.lit(True).alias("keyframe"), F.col("data").alias("content"), F.lit(None).cast("string").alias("error"))
    return video.unionByName(audio).unionByName(data)


# ---------------------------------------------------------------- writing

#: Bytes before the data of a packet with both times, and of the first cell's clock on a keyframe.
_LEAST, _TIME, _CLOCK = 9 + 5, 5, 8


def _carry(state: Column, f: Column) -> Column:
    """How many of a picture's last bytes wait, if ``state`` bytes waited before it."""
    total = state + len(DELIMITER) + f["size"] + _LEAST + F.when(f["pts"] != f["dts"], _TIME).otherwise(0) + F.when(f["keyframe"], _CLOCK).otherwise(0)
    wait = total % CAPACITY
    saves = (f["size"] > 0) & ~f["last"] & (total > CAPACITY) & (wait + _LEAST + _TIME + _CLOCK + len(DELIMITER) <= CAPACITY) & (f["unit"] >= wait)
    return F.when(saves, wait).otherwise(0).cast("int")


def carries(frames: DataFrame) -> DataFrame:
    """``frames`` (path, idx, pts, dts, keyframe, content) with ``waits``: how many of each picture's last bytes go into the next packet.

    Bytes wait if that ends the packet on a cell's end, if the next delimiter fits into the cell begun anew, and if
    they are of the last unit only; those of a track's last picture never do.
    """
    units = nal_units(F.col("content"))
    order = Window.partitionBy("path").orderBy("idx")
    rows = frames.withColumns({"__units": units, "__last": F.lead("idx").over(order).isNull()})
    facts = F.struct("idx", "pts", "dts", "keyframe", F.octet_length("content").alias("size"), F.coalesce(F.get("__units", F.size("__units") - 1)["size"], F.lit(-1)).alias("unit"), F.col("__last").alias("last"))
    blocks = rows.groupBy("path", div(F.col("idx"), BLOCK).alias("__block")).agg(F.array_sort(F.collect_list(facts)).alias("__frames"))
    # What a block makes of each state is only asked by a later block: of the first one for the state 0, of others for all states.
    along = Window.partitionBy("path").orderBy("__block")
    blocks = blocks.withColumns({"__first": F.lag("__block").over(along).isNull(), "__asked": F.lead("__block").over(along).isNotNull()})
    begins = F.when(F.col("__first"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(CAPACITY - 1)))
    blocks = blocks.withColumn("__table", F.when(F.col("__asked"), F.transform(begins, lambda s: F.aggregate("__frames", s, _carry))))
    # The block before leaves what its table says for the state it began with; tables of all blocks before are composed in order.
    before = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.aggregate(F.collect_list("__table").over(before), F.lit(0), lambda s, t: F.get(t, s))
    blocks = blocks.withColumn("__begun", begun)
    empty = F.array().cast("array<struct<idx:bigint,waits:int,held:int>>")
    # A block is walked in pieces of CHAIN pictures, as each step copies what its piece has found so far.
    pieces = F.transform(F.sequence(F.lit(0), div(F.size("__frames") - 1, CHAIN).cast("int")), lambda i: F.slice("__frames", i * CHAIN + 1, F.lit(CHAIN)))
    step = lambda a, f: once(_carry(a["s"], f), lambda w: F.struct(w.alias("s"), F.concat(a["out"], F.array(F.struct(f["idx"].alias("idx"), w.alias("waits"), a["s"].alias("held")))).alias("out")))
    walked = F.aggregate(
        pieces, F.struct(F.col("__begun").alias("s"), F.array().cast("array<array<struct<idx:bigint,waits:int,held:int>>>").alias("done")),
        lambda a, piece: once(F.aggregate(piece, F.struct(a["s"].alias("s"), empty.alias("out")), step), lambda p: F.struct(p["s"].alias("s"), F.concat(a["done"], F.array(p["out"])).alias("done"))),
        lambda a: F.flatten(a["done"]),
    )
    found = blocks.select("path", F.explode(walked).alias("w")).select("path", F.col("w.idx").alias("idx"), F.col("w.waits").alias("waits"), F.col("w.held").alias("held"))
    return frames.join(found, ["path", "idx"])


def video_packets(frames: DataFrame) -> DataFrame:
    """(path, kind, packet, pts, dts, random, data): a packet for each picture, with what the one before left and without what waits."""
    rows = carries(frames)
    left = F.substring(F.col("content"), F.octet_length("content") - F.col("waits") + 1, F.col("waits"))
    order = Window.partitionBy("path").orderBy("idx")
    given = F.coalesce(F.lag(left).over(order), F.unhex(F.lit("")))
    stays = _at(F.col("content"), 0, F.octet_length("content") - F.col("waits"))
    mark = F.when(F.octet_length("content") > 0, F.lit(DELIMITER)).otherwise(F.unhex(F.lit("")))
    return rows.select("path", F.lit("video").alias("kind"), F.col("idx").alias("packet"), "pts", "dts", F.col("keyframe").alias("random"), F.concat(given, mark, stays).alias("data"))


def audio_packets(frames: DataFrame, sample_rate: int, channels: int) -> DataFrame:
    """(path, kind, packet, pts, dts, random, data) of sound frames (path, idx, pts, dts, content, packet), which ``packed_adts`` has dealt to packets."""
    framed = frames.withColumn("piece", F.concat(media.adts_header(F.octet_length("content"), sample_rate, channels), "content"))
    grouped = framed.groupBy("path", "packet").agg(F.min_by("pts", "idx").alias("pts"), F.min_by("dts", "idx").alias("dts"), _joined("idx").alias("data"))
    return grouped.select("path", F.lit("audio").alias("kind"), "packet", "pts", "dts", F.lit(False).alias("random"), "data")


def _time_bytes(mark: int, t: Column) -> Column:
    """A time in five bytes behind a mark."""
    part = lambda shift, mask: F.shiftright(t, shift).bitwiseAND(F.lit(mask).cast("long"))
    return F.concat(big_endian(part(30, 7) * 2 + (mark * 16 + 1), 1), big_endian(part(15, 0x7FFF) * 2 + 1, 2), big_endian(part(0, 0x7FFF) * 2 + 1, 2))


def _packet_bytes() -> Column:
    """A packet's header and data, from its columns."""
    both = F.col("pts") != F.col("dts")
    stamps = F.when(both, F.concat(_time_bytes(3, F.col("pts")), _time_bytes(1, F.col("dts")))).otherwise(_time_bytes(2, F.col("pts")))
    kind = F.create_map(*[x for k, v in PACKET_IDS.items() for x in (F.lit(k), F.lit(bytes([v])))])[F.col("kind")]
    length = F.octet_length("data") + 3 + F.octet_length(stamps)
    return F.concat(F.lit(b"\x00\x00\x01"), kind, big_endian(F.when(length > 0xFFFF, 0).otherwise(length).cast("long"), 2), F.when(both, F.lit(b"\x80\xc0\x0a")).otherwise(F.lit(b"\x80\x80\x05")), stamps, F.col("data"))


def _checksum(data: bytes) -> bytes:
    """The CRC at the end of a table: polynomial 0x04C11DB7, highest bit first."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc.to_bytes(4, "big")


def _table(kind: int, body: bytes) -> bytes:
    section = bytes([kind]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    section += _checksum(section)
    return b"\x00" + section


def _table_cell(pid: int, table: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10" + table).ljust(CELL, b"\xff")


def program_cells(kinds: list[str]) -> list[bytes]:
    """The two cells that name the streams: the list of programs, and the program's streams; the first stream carries the clock."""
    numbers = {v: k for k, v in KINDS.items()}
    listed = b"".join(bytes([numbers[k]]) + (0xE000 | PIDS[k]).to_bytes(2, "big") + b"\xf0\x00" for k in kinds)
    programs = _table_cell(0, _table(0, b"\x00\x01" + (0xE000 | PROGRAM).to_bytes(2, "big")))
    return [programs, _table_cell(PROGRAM, _table(2, (0xE000 | PIDS[kinds[0]]).to_bytes(2, "big") + b"\xf0\x00" + listed))]


def packet_cells(rows: DataFrame, order: list[str]) -> DataFrame:
    """(path, n, pid, cell) of packets (path, kind, packet, pts, dts, random, data) laid on cells, behind the two that name the streams.

    A cell holds 184 bytes of one packet; the first of a random access point has a clock before them, and what is free
    in the last is filled up before its bytes. Where each packet begins, and each stream's counter, are sums of cells before.
    """
    clock = F.when(F.col("random"), _CLOCK).otherwise(0)
    rows = rows.withColumn("whole", _packet_bytes()).withColumns({"first": F.lit(CAPACITY) - clock, "size": F.octet_length("whole")})
    count = (F.lit(1) + F.greatest(F.ceil((F.col("size") - F.col("first")) / F.lit(float(CAPACITY))), F.lit(0))).cast("long")
    pid = F.create_map(*[F.lit(x) for pair in PIDS.items() for x in pair])[F.col("kind")]
    rows = rows.withColumns({"count": count, "pid": pid})
    before = lambda keys, by: F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumns({"begin": before(["path"], order) + 2, "counter": before(STREAM, ["packet"])})

    def cell(j: Column) -> Column:
        start = F.when(j == 0, 0).otherwise(F.col("first") + (j - 1) * CAPACITY)
        room = F.when(j == 0, F.col("first")).otherwise(F.lit(CAPACITY))
        taken = F.least(room.cast("long"), F.col("size") - start)
        free = (room - taken).cast("int")
        timed = F.col("random") & (j == 0)
        clocked = F.concat(F.lit(b"\x50"), big_endian(F.shiftright(F.col("dts"), 1), 4), big_endian(F.col("dts").bitwiseAND(F.lit(1).cast("long")) * 0x8000 + 0x7E00, 2))
        filled = F.unhex(F.repeat(F.lit("FF"), F.greatest(free - F.when(timed, 0).otherwise(2), F.lit(0))))
        extra = F.when(timed, F.concat(big_endian((free + 7).cast("long"), 1), clocked, filled)).when(free == 1, F.lit(b"\x00")).when(free > 1, F.concat(big_endian((free - 1).cast("long"), 1), F.lit(b"\x00"), filled)).otherwise(F.unhex(F.lit("")))
        head = F.col("pid") + F.when(j == 0, 0x4000).otherwise(0)
        control = F.pmod(F.col("counter") + j, F.lit(16)) + F.when(timed | (free > 0), 0x30).otherwise(0x10)
        return F.concat(F.lit(b"\x47"), big_endian(head.cast("long"), 2), big_endian(control.cast("long"), 1), extra, _at(F.col("whole"), start, taken))

    named = [[k for i, k in enumerate(PIDS) if mask >> i & 1] for mask in range(1, 1 << len(PIDS))]
    tables = F.create_map(*[x for c in named for x in (F.lit(",".join(c)), F.array(*map(F.lit, program_cells(c))))])
    kinds = F.array_sort(F.collect_set("kind").over(Window.partitionBy("path")), lambda a, b: F.when(a == b, 0).when(a == "video", -1).when(b == "video", 1).when(a < b, -1).otherwise(1))
    # The first packet makes the two cells that name the streams too, so packets are made once; a row for each cell first, its bytes after that.
    from_ = F.when(F.row_number().over(Window.partitionBy("path").orderBy(*order)) == 1, -2).otherwise(0).cast("long")
    rows = rows.withColumns({"kinds": kinds, "from": from_, "last": F.coalesce("count", F.lit(0).cast("long")) - 1})
    made = rows.withColumn("heads", F.when(F.col("from") < 0, tables[F.array_join("kinds", ",")]))
    made = made.withColumn("j", F.explode(F.when(F.col("from") <= F.col("last"), F.sequence("from", "last"))))
    j = F.col("j")
    return made.select("path", (F.col("begin") + j).alias("n"), F.when(j == -2, 0).when(j == -1, PROGRAM).otherwise(F.col("pid")).alias("pid"), F.when(j < 0, F.get("heads", (j + 2).cast("int"))).otherwise(cell(j)).alias("cell"))


def as_files(rows: DataFrame) -> DataFrame:
    """(path, content): the cells of each file joined."""
    return rows.groupBy("path").agg(_joined("n", "cell").alias("content"))
