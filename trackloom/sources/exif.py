"""Image metadata in directories of tagged values, read and written with array expressions.

A block begins with its byte order; directories hold entries of twelve bytes, whose values of more than four
bytes stand elsewhere, and some entries and each directory's end name further directories. They are visited in
the order in which they are named, ``MOST_DIRECTORIES`` besides the first, so a directory that names itself or one before ends too.
All of it is row-local: no shuffle, and no Python.

Defined results: of a tag that stands more than once the first valid value counts; a value of another kind or
count, beyond the data, out of range or without its final zero byte counts as missing, as do all values of a
block that is null, cut off, or of another byte order mark or version; what is missing is null, or its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST_DIRECTORIES = 8
IMAGE, GPS = 0, 1
#: Fixed values: (name, number, directory, kind) of the tags that are read, and the two that name directories.
TAGS = (
    ("make", 0x010F, IMAGE, "text"), ("model", 0x0110, IMAGE, "text"), ("orientation", 0x0112, IMAGE, "short"), ("x_resolution", 0x011A, IMAGE, "rational"), ("y_resolution", 0x011B, IMAGE, "rational"),
    ("resolution_unit", 0x0128, IMAGE, "short"), ("software", 0x0131, IMAGE, "text"), ("modify_date", 0x0132, IMAGE, "text"), ("exposure_time", 0x829A, IMAGE, "rational"),
    ("latitude_ref", 0x01, GPS, "text"), ("latitude", 0x02, GPS, "three"), ("longitude_ref", 0x03, GPS, "text"), ("longitude", 0x04, GPS, "three"), ("altitude_ref", 0x05, GPS, "byte"), ("altitude", 0x06, GPS, "rational"),
    ("time_stamp", 0x07, GPS, "three"), ("speed_ref", 0x0C, GPS, "text"), ("speed", 0x0D, GPS, "rational"), ("direction_ref", 0x10, GPS, "text"), ("direction", 0x11, GPS, "rational"),
    ("bearing_ref", 0x17, GPS, "text"), ("bearing", 0x18, GPS, "rational"), ("date_stamp", 0x1D, GPS, "text"),
)
SUBDIRECTORIES = {0x8769: IMAGE, 0x8825: GPS}
#: Numbers of kinds (signed ones too), how many of them, and the bytes of one.
KINDS = {"text": ((2,), None, 1), "short": ((3, 8), 1, 2), "rational": ((5, 10), 1, 8), "three": ((5, 10), 3, 8), "byte": ((1, 6), 1, 1)}
#: The least and the largest of numbers that have limits.
LIMITS = {"orientation": (1, 8), "resolution_unit": (1, 3), "altitude_ref": (0, 1)}
LONGEST_TEXT = 255


#: Bytes of a value by its kind's number, from 0 on.
SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)


def _num(at: Column, size: int) -> Column:
    """``size`` bytes from byte ``at`` as a number in the block's order; null beyond the data.

    Numbers of a little-endian block are read from its bytes in reverse, where they stand the other way round and count from the end.
    """
    place = F.when(F.col("__big"), at).otherwise(F.col("__size") - at - size)
    return F.when((at >= 0) & (at + size <= F.col("__size")), F.conv(F.hex(F.substring("__bytes", (place + 1).cast("int"), F.lit(size))), 16, 10).cast("long"))


def _entries(at: Column, kind: Column) -> Column:
    """A directory's entries that lie within the data: (kind, tag, type, count, at), ``at`` being where the value or its place stands."""
    n = F.coalesce(F.least(_num(at, 2), F.floor((F.col("__size") - at - 2) / F.lit(12))), F.lit(0))
    one = lambda i: F.struct(kind.alias("kind"), _num(at + 2 + i * 12, 2).alias("tag"), _num(at + 4 + i * 12, 2).alias("type"), _num(at + 6 + i * 12, 4).alias("count"), (at + 10 + i * 12).alias("at"))
    # A sequence that ends before it begins counts down; of one row more the first is taken off.
    return F.transform(F.slice(F.sequence(F.lit(-1).cast("long"), n.cast("long") - 1), F.lit(2), n.cast("int")), one)


def _values(entries: Column, name: str, kind: str) -> Column:
    """The values of entries (with ``place`` and ``length``) of one tag, null where they aren't valid."""
    _, many, size = KINDS[kind]
    if kind == "text":
        ended = lambda e: (e["count"] > 0) & (e["count"] <= LONGEST_TEXT) & (_num(e["place"] + e["length"] - 1, 1) == 0)
        return F.transform(entries, lambda e: F.when(ended(e), F.decode(F.substring("__c", (e["place"] + 1).cast("int"), (e["length"] - 1).cast("int")), "ISO-8859-1")))
    if kind in ("short", "byte"):
        low, high = LIMITS.get(name, (0, (1 << 8 * size) - 1))
        numbers = F.transform(entries, lambda e: F.when(e["count"] == many, _num(e["place"], size).cast("int")))
        return F.transform(numbers, lambda v: F.when(v.between(low, high), v))
    parts = lambda e: F.array(*[F.struct(_num(e["place"] + 8 * k, 4).alias("numerator"), _num(e["place"] + 8 * k + 4, 4).alias("denominator")) for k in range(many)])
    ratios = F.transform(entries, lambda e: F.when(e["count"] == many, parts(e)))
    sound = lambda r: (r["denominator"] > 0) & (r["denominator"] < 1 << 31) & (r["numerator"] < 1 << 31)
    return F.transform(ratios, lambda v: F.when(F.forall(v, lambda r: F.coalesce(sound(r), F.lit(False))), v[0] if kind == "rational" else v))


def read(blocks: DataFrame, content: str = "content", defaults: dict | None = None) -> DataFrame:
    """``blocks`` with a column for each of ``TAGS``, from a block without or with the six bytes of its marker."""
    marked = F.substring(content, 1, 6) == F.lit(b"Exif\x00\x00")
    rows = blocks.withColumn("__c", F.when(marked, F.substring(F.col(content), F.lit(7), F.octet_length(content))).otherwise(F.col(content)))
    big = F.substring("__c", 1, 2) == F.lit(b"MM")
    turned = F.encode(F.reverse(F.decode("__c", "ISO-8859-1")), "ISO-8859-1")
    rows = rows.withColumns({"__big": big, "__size": F.octet_length("__c").cast("long"), "__bytes": F.when(big, F.col("__c")).otherwise(turned)})
    valid = F.coalesce((_num(F.lit(2), 2) == 42) & (_num(F.lit(4), 4) == 8), F.lit(False))
    rows = rows.withColumn("__next", F.when(valid, _num(F.lit(10) + 12 * _num(F.lit(8), 2), 4)))
    fits = lambda at: at + 14 <= F.col("__size")  # noqa: E731  a directory has a number and an entry at least
    directory = lambda at, kind: F.struct(at.cast("long").alias("at"), kind.cast("int").alias("kind"))
    known = F.array(directory(F.lit(8), F.lit(IMAGE)), directory(F.col("__next"), F.lit(IMAGE)))
    start = F.when(valid, F.filter(known, lambda d: (d["at"] > 0) & fits(d["at"]))).otherwise(F.array().cast("array<struct<at:bigint,kind:int>>"))
    rows = rows.withColumn("__start", start)
    kind_of = F.create_map(*[F.lit(x) for pair in SUBDIRECTORIES.items() for x in pair])

    def named(d: Column) -> Column:
        """The directories that a directory's entries name."""
        entries = F.filter(_entries(d["at"], d["kind"]), lambda e: (e["kind"] == IMAGE) & e["tag"].isin(*SUBDIRECTORIES))
        found = F.transform(entries, lambda e: directory(_num(e["at"], 4), kind_of[e["tag"].cast("int")]))
        return F.filter(found, lambda x: fits(x["at"]))

    visit = lambda queue, i: F.slice(F.concat(queue, F.flatten(F.transform(F.slice(queue, i + 1, F.lit(1)), named))), 1, MOST_DIRECTORIES + 1)
    rows = rows.withColumn("__queue", F.aggregate(F.sequence(F.lit(0), F.lit(MOST_DIRECTORIES)), F.col("__start"), visit))
    rows = rows.withColumn("__entries", F.flatten(F.transform("__queue", lambda d: _entries(d["at"], d["kind"]))))
    sizes = F.array(*map(F.lit, SIZES))
    measured = F.transform("__entries", lambda e: F.struct(e.alias("e"), (e["count"] * F.coalesce(F.get(sizes, e["type"].cast("int")), F.lit(0))).alias("length")))
    placed = F.transform(measured, lambda m: F.struct(m["e"]["kind"].alias("kind"), m["e"]["tag"].alias("tag"), m["e"]["type"].alias("type"), m["e"]["count"].alias("count"), m["length"].alias("length"), F.when(m["length"] <= 4, m["e"]["at"]).otherwise(_num(m["e"]["at"], 4)).alias("place")))
    rows = rows.withColumn("__entries", placed)

    def first(name: str, tag: int, where: int, kind: str) -> Column:
        fitting = F.filter("__entries", lambda e: (e["tag"] == tag) & (e["kind"] == where) & e["type"].isin(*KINDS[kind][0]))
        return F.get(F.filter(_values(fitting, name, kind), lambda v: v.isNotNull()), 0)

    values = {name: first(name, tag, where, kind) for name, tag, where, kind in TAGS}
    for name, value in (defaults or {}).items():
        values[name] = F.coalesce(values[name], F.lit(value))
    return rows.withColumns(values).drop("__c", "__big", "__size", "__bytes", "__next", "__start", "__queue", "__entries")


# ---------------------------------------------------------------- writing

def _stored(name: str, kind: str) -> Column:
    """A value's bytes as digits, from its column; null if there is none."""
    v = F.col(f"`{name}`")
    word = lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")
    ratio = lambda r: F.concat(word(r["numerator"]), word(r["denominator"]))
    if kind == "text":
        return F.concat(F.hex(F.encode(F.substring(v, 1, LONGEST_TEXT - 1), "ISO-8859-1")), F.lit("00"))
    if kind in ("short", "byte"):
        return F.lpad(F.hex(v.cast("long")), 2 * KINDS[kind][2], "0")
    return ratio(v) if kind == "rational" else F.array_join(F.transform(v, ratio), "")


def _directory(items: Column, at: Column, last: Column) -> Column:
    """A directory's bytes as digits: ``items`` (tag, type, count, digits) in order, values of more than four bytes behind it, from byte ``at``."""
    first = at + 6 + 12 * F.size(items)
    word = lambda n, k=8: F.lpad(F.hex(n.cast("long")), k, "0")

    def add(state: Column, e: Column) -> Column:
        size = F.length(e["digits"]) / 2
        inline = F.rpad(e["digits"], 8, "0")
        field = F.when(size <= 4, inline).otherwise(word(first + F.length(state["data"]) / 2))
        head = F.concat(state["head"], word(e["tag"], 4), word(e["type"], 4), word(e["count"]), field)
        return F.struct(head.alias("head"), F.when(size > 4, F.concat(state["data"], e["digits"])).otherwise(state["data"]).alias("data"))

    done = F.aggregate(items, F.struct(F.lit("").alias("head"), F.lit("").alias("data")), add)
    return F.concat(word(F.size(items), 4), done["head"], last, done["data"])


def written(rows: DataFrame, into: str = "content") -> DataFrame:
    """``rows`` with the block, in big-endian order, of those columns of ``TAGS`` that they have; places follow from the sizes of the values before."""
    def items(where: int) -> Column:
        found = []
        for name, tag, of, kind in TAGS:
            if of == where and name in rows.columns:
                many = KINDS[kind][1]
                digits = _stored(name, kind)
                count = F.lit(many).cast("long") if many else (F.length(digits) / 2).cast("long")
                found.append(F.struct(F.lit(tag).alias("tag"), F.lit(KINDS[kind][0][0]).alias("type"), count.alias("count"), digits.alias("digits")))
        none = F.array().cast("array<struct<tag:int,type:int,count:bigint,digits:string>>")
        return F.filter(F.array(*found), lambda e: e["digits"].isNotNull()) if found else none

    listed = rows.withColumns({"__image": items(IMAGE), "__gps": items(GPS)})
    bytes_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, e: n + F.when(F.length(e["digits"]) > 8, (F.length(e["digits"]) / 2).cast("long")).otherwise(0))
    has_gps = F.size("__gps") > 0
    place = 8 + 6 + 12 * (F.size("__image") + 1) + bytes_of("__image")
    pointer = F.array(F.struct(F.lit(0x8825).alias("tag"), F.lit(4).alias("type"), F.lit(1).cast("long").alias("count"), F.lpad(F.hex(place.cast("long")), 8, "0").alias("digits")))
    listed = listed.withColumn("__image", F.array_sort(F.when(has_gps, F.concat("__image", pointer)).otherwise(F.col("__image"))))
    listed = listed.withColumn("__gps", F.array_sort("__gps")).withColumn("__place", 8 + 6 + 12 * F.size("__image") + bytes_of("__image"))
    end = F.lit("00000000")
    digits = F.concat(F.lit((b"Exif\x00\x00MM\x00\x2a\x00\x00\x00\x08").hex()), _directory(F.col("__image"), F.lit(8), end), F.when(has_gps, _directory(F.col("__gps"), F.col("__place"), end)).otherwise(F.lit("")))
    return listed.withColumn(into, F.unhex(digits)).drop("__image", "__gps", "__place")
