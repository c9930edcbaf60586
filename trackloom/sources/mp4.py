"""Sample tables and fragments of MP4 files, read into the track schema and written from it, as array and window expressions.

Only the box headers are walked by a small helper; times, sizes, keyframes and byte positions are
decoded by Spark from the tables' bytes. A file holds fewer than 2**18 samples a track, so a table travels as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.arith import repaired_offset
from trackloom.functions.octets import big_endian
from trackloom.operators.transforms import interleaved
from trackloom.sources.readers import mp4_boxes

#: Handler names of tracks.
KINDS = {"vide": "video", "soun": "audio", "meta": "data"}
TABLES = ("mdhd", "hdlr", "stts", "ctts", "stss", "stsz", "stsc", "stco", "co64")


def _number(content: Column, at: Column, size: int = 4) -> Column:
    """``size`` bytes from byte ``at`` (from 0) as an unsigned number."""
    return F.conv(F.hex(F.substring(content, (at + 1).cast("int"), F.lit(size))), 16, 10).cast("long")


def _entries(content: Column, box: Column, fields: int, size: int = 4, head: int = 16) -> Column:
    """The rows of a table: after ``head`` bytes of box header, version and count, ``fields`` numbers each."""
    count = _number(content, box + head - 4)
    row = lambda i: F.array(*[_number(content, box + head + (i * fields + k) * size, size) for k in range(fields)])
    return F.when(box.isNull() | (count == 0), F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), row))


def _spread(runs: Column) -> Column:
    """Pairs (count, value) as that many values."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r[1], r[0].cast("int"))))


def sample_tables(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, trak, type, timescale, idx, pts, dts, keyframe, pos, size) of every sample of every track of MP4 files.

    Without a table of keyframes all samples are; composition offsets that were meant negative are repaired. Files without
    tracks, and tracks without samples, give no rows.
    """
    found = mp4_boxes(files.select(F.col(key).alias("key"), F.col(content).alias("content")))
    boxes = found.select("key", F.posexplode("boxes").alias("n", "b")).select("key", "n", "b.type", "b.offset")
    trak = F.sum((F.col("type") == "trak").cast("int")).over(Window.partitionBy("key").orderBy("n"))
    places = boxes.withColumn("trak", trak).where((F.col("trak") > 0) & F.col("type").isin(*TABLES)).groupBy("key", "trak").agg(*[F.min(F.when(F.col("type") == t, F.col("offset"))).alias(t) for t in TABLES])
    rows = files.select(F.col(key).alias("key"), F.col(content).alias("content")).join(places, "key")
    c = F.col("content")
    long = _number(c, F.col("mdhd") + 8, 1) == 1
    handler = F.decode(F.substring(c, (F.col("hdlr") + 17).cast("int"), F.lit(4)), "utf-8")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), handler), F.lit("caption"))
    fixed, many = _number(c, F.col("stsz") + 12), _number(c, F.col("stsz") + 16)
    sizes = F.when(fixed > 0, F.array_repeat(fixed, many.cast("int"))).otherwise(F.transform(_entries(c, F.col("stsz"), 1, head=20), lambda r: r[0]))
    chunks = F.when(F.col("co64").isNotNull(), F.transform(_entries(c, F.col("co64"), 1, 8), lambda r: r[0])).otherwise(F.transform(_entries(c, F.col("stco"), 1), lambda r: r[0]))
    rows = rows.select(
        "key", "trak", kind.alias("type"), F.when(long, _number(c, F.col("mdhd") + 28)).otherwise(_number(c, F.col("mdhd") + 20)).alias("timescale"), sizes.alias("sizes"), chunks.alias("chunks"),
        _spread(_entries(c, F.col("stts"), 2)).alias("steps"), _spread(_entries(c, F.col("ctts"), 2)).alias("offsets"), F.col("stss").isNull().alias("all_keys"),
        F.transform(_entries(c, F.col("stss"), 1), lambda r: r[0] - 1).alias("keys"), _entries(c, F.col("stsc"), 3).alias("runs"),
    )
    # A run of chunks (first, samples each) goes on to the next run's first chunk, the last one to the end.
    until = lambda i: F.coalesce(F.get("runs", i + 1)[0], F.size("chunks") + F.lit(1).cast("long"))
    per = F.flatten(F.transform("runs", lambda r, i: F.array_repeat(r[1], (until(i) - r[0]).cast("int"))))
    of = F.flatten(F.transform(per, lambda n, i: F.array_repeat(i, n.cast("int"))))
    rows = rows.withColumn("chunk", of).withColumn("at", F.transform("chunk", lambda n: F.get("chunks", n)))
    each = rows.select("key", "trak", "type", "timescale", "all_keys", F.posexplode(F.arrays_zip("sizes", "steps", "offsets", "chunk", "at")).alias("i", "s"))
    each = each.where("s.sizes is not null").select(
        "key", "trak", "type", "timescale", "all_keys", F.col("i").cast("long").alias("idx"), F.col("s.sizes").alias("size"), F.col("s.steps").alias("step"),
        repaired_offset(F.coalesce("s.offsets", F.lit(0).cast("long"))).alias("offset"), F.col("s.chunk").alias("chunk"), F.col("s.at").alias("at"),
    )
    marked = rows.select("key", "trak", F.explode("keys").alias("idx"), F.lit(True).alias("marked"))
    each = each.join(marked, ["key", "trak", "idx"], "left").withColumn("keyframe", F.col("all_keys") | F.coalesce("marked", F.lit(False)))
    track = Window.partitionBy("key", "trak").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("key", "trak", "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    dts = F.coalesce(F.sum("step").over(track), F.lit(0))
    return each.select(
        F.col("key").alias(key), "trak", "type", "timescale", "idx", (dts + F.col("offset")).alias("pts"), dts.alias("dts"), "keyframe", (F.col("at") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("pos"), "size"
    )


def _boxed(df: DataFrame, kind: str, *parts: Column, into: str | None = None) -> DataFrame:
    """``df`` with a box column: its bytes are a column of their own first, as both their size and they themselves are needed."""
    body = df.withColumn("__body", F.concat(*parts))
    return body.withColumn(into or kind, F.concat(big_endian(F.octet_length("__body") + 8), F.encode(F.lit(kind), "utf-8"), F.col("__body"))).drop("__body")


def _rows(rows: Column, *fields) -> Column:
    """Version, count, and each row's fields as 32 bits."""
    digits = F.array_join(F.transform(rows, lambda r: F.concat(*[F.lpad(F.hex(F.pmod(f(r).cast("long"), F.lit(1 << 32))), 8, "0") for f in fields])), "")
    return F.concat(big_endian(F.lit(0)), big_endian(F.size(rows)), F.unhex(digits))


def written(samples: DataFrame, handler: str = "vide") -> DataFrame:
    """(track_id, content): a movie box with the sample tables of each track (idx, pts, dts, size, keyframe, timescale), ten samples a chunk, bytes from 0.

    Decode times are written as steps, the last one as the one before it (or 1), as ``containers.written`` has them.
    """
    w = Window.partitionBy("track_id").orderBy("idx")
    step = F.coalesce(F.lead("dts").over(w) - F.col("dts"), F.col("dts") - F.lag("dts").over(w), F.lit(1).cast("long"))
    ahead = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = samples.withColumns({"step": step, "ahead": ahead})
    row = F.struct("idx", "step", (F.col("pts") - F.col("dts")).alias("offset"), "size", "keyframe", "ahead")
    listed = rows.groupBy("track_id").agg(F.array_sort(F.collect_list(row)).alias("s"), F.max("timescale").alias("timescale"))
    s = F.col("s")
    listed = listed.withColumns({"keys": F.filter(s, lambda r: r["keyframe"]), "firsts": F.filter(s, lambda r, i: i % 10 == 0)})
    zero, one = big_endian(F.lit(0)), F.lit(1)
    # All chunks hold ten samples but the last, which may hold fewer.
    whole, rest = F.call_function("div", F.size(s), F.lit(10)), F.size(s) % 10
    runs = F.filter(F.array(F.struct(one.alias("first"), F.lit(10).alias("n")), F.struct((whole + 1).cast("int").alias("first"), rest.alias("n"))), lambda r: (r["n"] > 0) & (r["first"] <= F.size("firsts")))
    runs = F.filter(runs, lambda r: (r["n"] < 10) | (F.size(s) >= 10))
    sizes = F.unhex(F.array_join(F.transform(s, lambda r: F.lpad(F.hex(r["size"].cast("long")), 8, "0")), ""))
    out = listed.withColumn("runs", runs)
    out = _boxed(out, "stts", _rows(s, lambda r: one, lambda r: r["step"]))
    out = _boxed(out, "ctts", _rows(s, lambda r: one, lambda r: r["offset"]))
    out = _boxed(out, "stss", _rows(F.col("keys"), lambda r: r["idx"] + 1))
    out = _boxed(out, "stsz", zero, zero, big_endian(F.size(s)), sizes)
    out = _boxed(out, "stsc", _rows(F.col("runs"), lambda r: r["first"], lambda r: r["n"], lambda r: one))
    out = _boxed(out, "stco", _rows(F.col("firsts"), lambda r: r["ahead"]))
    out = _boxed(out, "stbl", *map(F.col, ("stts", "ctts", "stss", "stsz", "stsc", "stco")))
    out = _boxed(out, "minf", F.col("stbl"))
    out = _boxed(out, "mdhd", zero, zero, zero, big_endian(F.col("timescale")), zero, zero)
    out = _boxed(out, "hdlr", zero, zero, F.encode(F.lit(handler), "utf-8"), zero, zero, zero, F.unhex(F.lit("00")))
    out = _boxed(out, "mdia", F.col("mdhd"), F.col("hdlr"), F.col("minf"))
    out = _boxed(_boxed(out, "trak", F.col("mdia")), "moov", F.col("trak"))
    return _boxed(out, "ftyp", F.encode(F.lit("isom"), "utf-8")).select("track_id", F.concat("ftyp", "moov").alias("content"))


# ---------------------------------------------------------------- whole files

#: Forms of a file: all of it, only what is before the payloads, only the payloads, the head of a fragmented file, and one fragment.
FORMS = ("regular", "header", "samples", "dash_init", "dash_data")
#: Number and handler of a type's track, how many samples a track may have, and the flags of a fragment's samples.
TRACKS = {"video": (1, "vide"), "audio": (2, "soun")}
MOST_SAMPLES = 1 << 18
SYNC, NOT_SYNC = 0x02000000, 0x01010000
#: Samples of a chunk at most.
CHUNK = 10


def _of_type(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col("type")]


def _fixed(kind: str, *numbers: tuple[int, int]) -> bytes:
    body = b"".join(n.to_bytes(size, "big") for n, size in numbers)
    return (8 + len(body)).to_bytes(4, "big") + kind.encode() + body


_MATRIX = [(0x10000, 4), (0, 12), (0x10000, 4), (0, 12), (0x40000000, 4)]
#: A movie's head: thousandths of a second, rate and volume 1; and each track's.
MOVIE_HEAD = _fixed("mvhd", (0, 12), (1000, 4), (0, 4), (0x10000, 4), (0x100, 2), (0, 10), *_MATRIX, (0, 24), (len(TRACKS) + 1, 4))
TRACK_HEADS = {t: _fixed("tkhd", (3, 4), (0, 8), (n, 4), (0, 8), (0, 8), (0, 2), (0, 2), (0x100 if t == "audio" else 0, 2), (0, 2), *_MATRIX, (0, 8)) for t, (n, _) in TRACKS.items()}
EXTENDS = _fixed("trex", (0, 4), (1, 4), (1, 4), (0, 12)), _fixed("trex", (0, 4), (2, 4), (1, 4), (0, 12))


def laid_out(samples: DataFrame, rebased: bool) -> DataFrame:
    """``samples`` (track_id, type, idx, pts, dts, size, keyframe, timescale) of files in the order of their payloads.

    With ``nth`` in its track, ``time`` (from 0 if ``rebased``), ``step`` to the next one, ``offset`` to the time shown, ``ahead`` bytes
    of the payloads before, whether a sample ``starts`` a chunk, and how many (``n``) that has: samples of one
    track that follow each other, ten at most. Times that don't go on are an error.
    """
    own = Window.partitionBy("track_id", "type").orderBy("idx")
    rows = samples.withColumn("time", F.col("dts") - F.first("dts").over(own)) if rebased else samples.withColumn("time", F.col("dts"))
    last = F.lag("time").over(own)
    time = F.when(F.coalesce(F.col("time") <= last, F.lit(False)), F.raise_error(F.lit("Invalid: decode times don't go on")).cast("long")).otherwise(F.col("time"))
    rows = rows.withColumns({"step": F.coalesce(F.lead("time").over(own) - F.col("time"), F.col("time") - last, F.lit(1).cast("long")), "time": time})
    rows = interleaved(rows.withColumn("offset", F.col("pts") - F.col("time")))
    ahead = F.sum("size").over(Window.partitionBy("track_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"ahead": F.coalesce(ahead, F.lit(0)).cast("long"), "__run": F.col("pos") - F.col("nth")})
    inside = F.row_number().over(Window.partitionBy("track_id", "type", "__run").orderBy("pos")) - 1
    rows = rows.withColumns({"starts": inside % CHUNK == 0, "__part": F.floor(inside / F.lit(CHUNK))})
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("track_id", "type", "__run", "__part"))).drop("__run", "__part")


def _listed(rows: DataFrame) -> DataFrame:
    """(track_id, type, s, firsts, timescale): each track's samples as an array, and those that start chunks."""
    row = F.struct("nth", "time", "step", "offset", "size", "keyframe", "ahead", "starts", "n")
    listed = rows.groupBy("track_id", "type").agg(F.array_sort(F.collect_list(row)).alias("s"), F.max("timescale").alias("timescale"))
    many = F.when(F.size("s") >= MOST_SAMPLES, F.raise_error(F.lit("Unsafe: too many samples")).cast(listed.schema["s"].dataType)).otherwise(F.col("s"))
    return listed.withColumn("s", many).withColumn("firsts", F.filter("s", lambda r: r["starts"]))


def _tracks(listed: DataFrame, first_byte: Column | None) -> DataFrame:
    """(track_id, type, trak): each track's box; chunk offsets count from behind the header that all tracks make, ``first_byte`` besides."""
    s, zero, one = F.col("s"), big_endian(F.lit(0)), F.lit(1)
    counted = F.transform("firsts", lambda r, i: F.struct((i + 1).alias("first"), r["n"].alias("n")))
    out = listed.withColumn("counted", counted)
    runs = F.filter("counted", lambda r, i: (i == 0) | (F.get("counted", i - 1)["n"] != r["n"]))
    keys = F.transform(F.filter(s, lambda r: r["keyframe"]), lambda r: F.struct((r["nth"] + 1).alias("k")))
    out = out.withColumns({"runs": runs, "keys": keys})
    sizes = F.unhex(F.array_join(F.transform(s, lambda r: F.lpad(F.hex(r["size"].cast("long")), 8, "0")), ""))
    out = _boxed(out, "stts", _rows(s, lambda r: one, lambda r: r["step"]))
    out = _boxed(out, "ctts", _rows(s, lambda r: one, lambda r: r["offset"]))
    out = _boxed(out, "stss", _rows(F.col("keys"), lambda r: r["k"]))
    out = out.withColumn("stss", F.when(F.size("keys") < F.size("s"), F.col("stss")).otherwise(F.lit(b"")))
    out = _boxed(out, "stsz", zero, zero, big_endian(F.size(s)), sizes)
    out = _boxed(out, "stsc", _rows(F.col("runs"), lambda r: r["first"], lambda r: r["n"], lambda r: one))
    out = out.withColumn("stsd", F.lit(_fixed("stsd", (0, 8))))
    out = out.withColumn("tkhd", _of_type(TRACK_HEADS)).withColumn("mdhd", F.concat(F.lit((32).to_bytes(4, "big") + b"mdhd" + bytes(12)), big_endian(F.col("timescale")), F.lit(bytes(8))))
    out = out.withColumn("hdlr", _of_type({t: _fixed("hdlr", (0, 8), (int.from_bytes(h.encode(), "big"), 4), (0, 13)) for t, (_, h) in TRACKS.items()}))
    tables = ("stsd", "stts", "ctts", "stss", "stsz", "stsc")
    # Every box but the offsets' own values is there, so what stands before the payloads has a known size.
    length = sum((F.octet_length(c) for c in (*tables, "tkhd", "mdhd", "hdlr")), F.lit(8 * 4 + 16)) + 4 * F.size("firsts")
    out = out.withColumn("__length", length)
    base = F.sum("__length").over(Window.partitionBy("track_id")) + first_byte if first_byte is not None else F.lit(0)
    out = out.withColumn("__base", base.cast("long"))
    out = _boxed(out, "stco", _rows(F.col("firsts"), lambda r: F.col("__base") + r["ahead"]))
    out = _boxed(out, "stbl", *map(F.col, (*tables, "stco")))
    out = _boxed(out, "minf", F.col("stbl"))
    out = _boxed(out, "mdia", F.col("mdhd"), F.col("hdlr"), F.col("minf"))
    return _boxed(out, "trak", F.col("tkhd"), F.col("mdia")).select("track_id", "type", "trak")


def _movie(tracks: DataFrame, ftyp: bytes, *more: bytes) -> DataFrame:
    """(track_id, head): the file type and the movie box."""
    order = _of_type({t: n for t, (n, _) in TRACKS.items()})
    joined = tracks.withColumn("__n", order).groupBy("track_id").agg(F.expr("listagg(trak) within group (order by __n)").alias("traks"))
    return _boxed(joined, "moov", F.lit(MOVIE_HEAD), F.col("traks"), *map(F.lit, more)).select("track_id", F.concat(F.lit(ftyp), "moov").alias("head"))


def _payloads(rows: DataFrame, content: str) -> DataFrame:
    return rows.groupBy("track_id").agg(F.expr(f"listagg({content}) within group (order by pos)").alias("payload"))


def whole(samples: DataFrame, form: str = "regular", content: str = "content") -> DataFrame:
    """(track_id, content): the file of each ``track_id``'s sound and pictures in one of ``FORMS``.

    ``header`` is made from sizes alone, the payload column isn't read; a regular file is its header followed by its samples. A
    fragment keeps its times, the other forms begin at 0.
    """
    if form not in FORMS:
        raise ValueError(f"InvalidArguments: {form}")
    if form == "dash_init":
        empty = samples.select("track_id", "type", "timescale").where(F.col("type").isin(*TRACKS)).groupBy("track_id", "type").agg(F.max("timescale").alias("timescale"))
        none = F.array().cast("array<struct<nth:bigint,time:bigint,step:bigint,offset:bigint,size:bigint,keyframe:boolean,ahead:bigint,starts:boolean,n:bigint>>")
        tracks = _tracks(empty.withColumns({"s": none, "firsts": none}), None)
        extends = (sum(map(len, EXTENDS)) + 8).to_bytes(4, "big") + b"mvex" + b"".join(EXTENDS)
        return _movie(tracks, _fixed("ftyp", (int.from_bytes(b"iso5", "big"), 4), (0, 4)), extends).select("track_id", F.col("head").alias("content"))
    rows = laid_out(samples if form in ("regular", "samples") else samples.drop(content), rebased=form != "dash_data")
    if form == "samples":
        return _payloads(rows, content).select("track_id", F.col("payload").alias("content"))
    if form == "dash_data":
        heads = _fragment(_listed(rows))
        return heads.join(_payloads(laid_out(samples, rebased=False), content), "track_id").select("track_id", F.concat("head", F.col("payload")).alias("content"))
    ftyp = _fixed("ftyp", (int.from_bytes(b"isom", "big"), 4), (0, 4))
    before = len(ftyp) + 8 + len(MOVIE_HEAD) + 8
    heads = _movie(_tracks(_listed(rows.drop(content)), F.lit(before)), ftyp)
    sizes = rows.groupBy("track_id").agg((F.sum("size") + 8).alias("all"))
    heads = heads.join(sizes, "track_id").select("track_id", F.concat("head", big_endian(F.col("all")), F.encode(F.lit("mdat"), "utf-8")).alias("head"))
    if form == "header":
        return heads.select("track_id", F.col("head").alias("content"))
    return heads.join(_payloads(rows, content), "track_id").select("track_id", F.concat("head", "payload").alias("content"))


def _fragment(listed: DataFrame) -> DataFrame:
    """(track_id, head): a fragment's box with a run for each chunk, and the head of the payloads behind it."""
    fixed = lambda n, size=4: F.lit(n.to_bytes(size, "big"))
    length = F.lit(8 + 16 + 20) + 20 * F.size("firsts") + 16 * F.size("s")  # of a track: its box, head and time, and its runs
    out = listed.withColumn("__length", length)
    out = out.withColumn("__base", (F.sum("__length").over(Window.partitionBy("track_id")) + (8 + 16 + 8)).cast("long"))
    word = lambda n: F.lpad(F.hex(F.pmod(n.cast("long"), F.lit(1 << 32))), 8, "0")
    entry = lambda r: F.concat(word(r["step"]), word(r["size"]), word(F.when(r["keyframe"], SYNC).otherwise(NOT_SYNC)), word(r["offset"]))

    def run(r: Column) -> Column:
        head = F.concat(word(20 + 16 * r["n"]), F.lit(b"trun".hex() + "01000f01"), word(r["n"]), word(F.col("__base") + r["ahead"]))
        return F.concat(head, F.array_join(F.transform(F.slice("s", (r["nth"] + 1).cast("int"), r["n"].cast("int")), entry), ""))

    out = out.withColumn("runs", F.unhex(F.array_join(F.transform("firsts", run), "")))
    number_ = _of_type({t: n for t, (n, _) in TRACKS.items()})
    head = F.concat(fixed(16), F.lit(b"tfhd\x00\x02\x00\x00"), big_endian(number_), fixed(20), F.lit(b"tfdt\x01\x00\x00\x00"), big_endian(F.get("s", 0)["time"], 8))
    out = out.withColumn("traf", F.concat(big_endian(F.col("__length")), F.lit(b"traf"), head, "runs")).withColumn("__n", number_)
    bytes_ = F.sum(F.aggregate("s", F.lit(0).cast("long"), lambda a, r: a + r["size"]))
    joined = out.groupBy("track_id").agg(F.expr("listagg(traf) within group (order by __n)").alias("trafs"), (bytes_ + 8).alias("all"))
    return _boxed(joined, "moof", F.lit(_fixed("mfhd", (0, 4), (1, 4))), F.col("trafs")).select("track_id", F.concat("moof", big_endian(F.col("all")), F.lit(b"mdat")).alias("head"))


def fragments(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, type, idx, pts, dts, keyframe, pos, size) of every sample of the fragments in files; runs have all four fields of a sample."""
    found = mp4_boxes(files.select(F.col(key).alias("key"), F.col(content).alias("content")))
    boxes = found.select("key", "content", F.posexplode("boxes").alias("n", "b")).select("key", "content", "n", "b.type", "b.offset")
    along = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newest = lambda t, v: F.last(F.when(F.col("type") == t, v), ignorenulls=True).over(along)
    c, at = F.col("content"), F.col("offset")
    runs = boxes.where(F.col("type").isin("moof", "tfhd", "tfdt", "trun")).select(
        "key", "n", "type", newest("moof", at).alias("base"), newest("tfhd", _number(c, at + 12)).alias("track"), newest("tfdt", _number(c, at + 12, 8)).alias("time"),
        F.when(F.col("type") == "trun", _number(c, at + 16)).alias("first"), F.when(F.col("type") == "trun", F.substring(c, (at + 21).cast("int"), (16 * _number(c, at + 12)).cast("int"))).alias("bytes"),
    ).where("type = 'trun'")
    field = lambda i, k: _number(F.col("bytes"), i * 16 + 4 * k)
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.octet_length("bytes") / F.lit(16)) - 1), lambda i: F.struct(*[field(i, k).alias(f) for k, f in enumerate(("step", "size", "flags", "offset"))]))
    rows = runs.where("octet_length(bytes) > 0").select("key", "n", "base", "track", "time", "first", F.posexplode(each).alias("i", "s"))
    track = Window.partitionBy("key", "track").orderBy("n", "i")
    before = lambda w, f: F.coalesce(F.sum(f"s.{f}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    dts = F.col("time") + before(track, "step")
    signed = F.when(F.col("s.offset") >= 1 << 31, F.col("s.offset") - (1 << 32)).otherwise(F.col("s.offset"))
    kind = F.create_map(*[x for t, (n, _) in TRACKS.items() for x in (F.lit(n).cast("long"), F.lit(t))])[F.col("track")]
    pos = F.col("base") + F.col("first") + before(Window.partitionBy("key", "n").orderBy("i"), "size")
    return rows.select(
        F.col("key").alias(key), kind.alias("type"), (F.row_number().over(track) - 1).cast("long").alias("idx"), (dts + signed).alias("pts"), dts.alias("dts"), (F.col("s.flags") == SYNC).alias("keyframe"), pos.alias("pos"), F.col("s.size").alias("size")
    )
