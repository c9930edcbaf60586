"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

A dialogue is rendered once for every participant: that speaker's turns become the assistant's, the
other speakers' turns come from named users, system turns stay system turns. The loss mask is the
list of character spans of the assistant's turns, each with the end mark, so a model learns to stop.

Every participant of a dialogue gets the whole dialogue, whether or not they speak late or early in it.
A dialogue of any length is rendered in parts, cut where its turns reach another ``part_chars``
characters, so that no task holds more than that and one turn. The parts of a participant, one after the
other, are exactly the whole rendering: ``start`` says where in it a part begins, and spans count from
the beginning of their part. Dialogues shorter than that are one part, 0.

Turns are dealt out by ranges of (dialogue, turn, speaker, text, row), so a dialogue that holds a large
part of all rows is spread over tasks, and their places are found from counts of each range: running
sums within a range, plus the sums of the ranges before, of which there are few. The speakers of
a dialogue are counted before they are shuffled. Parts and participants meet on (dialogue, part).

Defined results: speakers are named by their percent-encoded name (blanks, ``<``, ``|``, ``>`` and ``%``), so
different speakers stay different; a null speaker is ``%null``, which no name can be; a null text is
empty; turns are ordered by number (null first), then speaker and text, so ties and repeated rows have
a fixed order and all are rendered; turns with a null dialogue form a dialogue of their own; a dialogue
in which only the system speaks has no participant and so no rendering; marks inside texts are broken
up (``<|`` becomes ``< |``) so that no text can forge a turn; extra columns are not carried, as an output row
stands for many input rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import materialise

PART_CHARS = 1 << 20
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"
#: Characters of a speaker's name that are percent-encoded; ``%`` comes first.
ENCODED = (("%", "%25"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), ("<", "%3C"), ("|", "%7C"), (">", "%3E"))
NOBODY = "%null"


def plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def speaker_name(speaker: Column) -> Column:
    name = speaker.cast("string")
    for raw, code in ENCODED:
        name = F.replace(name, F.lit(raw), F.lit(code))
    return F.coalesce(name, F.lit(NOBODY))


def placed(said: DataFrame, part_chars: int) -> DataFrame:
    """``said`` (dialogue, turn, speaker, text) with ``n``, each turn's place in its dialogue, and ``part``."""
    parts = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dialogue", "turn", "speaker", "text", "tie"]
    dealt = said.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id numbers the rows of each range in their order; its high bits are the range.
    dealt = materialise(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "turns")
    weight = F.length("text") + len(START) + len(END) + 2
    sums = dealt.groupBy("dialogue", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("chars"))
    before = Window.partitionBy("dialogue").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "dialogue", "range", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars")
    )
    within = Window.partitionBy("dialogue", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.withColumn("ahead", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    same = ahead["dialogue"].eqNullSafe(sums["dialogue"]) & (ahead["range"] == sums["range"])
    return ahead.join(sums, same).select(
        ahead["dialogue"],
        "turn",
        "speaker",
        "text",
        (F.col("at") - F.col("first") + F.col("rows")).alias("n"),
        F.call_function("div", F.col("chars") + F.col("ahead"), F.lit(part_chars)).alias("part"),
    )


def rotate(df: DataFrame, dialogue: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """(dialogue, part, perspective, n_turns, n_learned, start, rendered, spans): a row for each participant and part of a dialogue."""
    said = df.select(
        F.col(f"`{dialogue}`").alias("dialogue"),
        F.col(f"`{turn}`").alias("turn"),
        speaker_name(F.col(f"`{speaker}`")).alias("speaker"),
        plain(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("text"),
    )
    turns = placed(said, part_chars)
    parts = turns.groupBy("dialogue", "part").agg(F.sort_array(F.collect_list(F.struct("n", "speaker", "text"))).alias("turns"))
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("dialogue").alias("of"), F.col("speaker").alias("perspective")).distinct()
    views = parts.join(people, F.col("dialogue").eqNullSafe(F.col("of"))).drop("of")

    def piece(t: Column) -> Column:
        own = t["speaker"] == F.col("perspective")
        name = F.when(t["speaker"] == SYSTEM, SYSTEM).when(own, "assistant").otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.struct(F.concat(F.lit(START), name, F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), own.alias("own"))

    views = views.withColumn("pieces", F.transform("turns", piece)).drop("turns")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(p["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    rendered = views.select(
        "dialogue",
        "part",
        "perspective",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_learned"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", zero, step, lambda acc: acc["spans"]).alias("spans"),
    )
    earlier = Window.partitionBy("dialogue", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("rendered")).over(earlier), F.lit(0)).cast("long")
    return rendered.withColumn("start", start).select(F.col("dialogue").alias(dialogue), "part", "perspective", "n_turns", "n_learned", "start", "rendered", "spans")
