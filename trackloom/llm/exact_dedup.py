"""Exact deduplication by distributed MSD radix partitioning.

Texts are split into groups by successive digits of their bytes, most significant first. A digit
is a run of bytes whose width grows by level (64, 448, 3584, ... so the digits end at 64, 512,
4096, ... bytes), hence the number of rounds is logarithmic in the longest text. A group that is
down to one row, or whose texts have all ended, leaves; only the rest goes on to the next digit.
No digest takes part: two texts meet at the end if and only if all their digits were equal.

Shuffles: the first digit with a count (pre-aggregated), one pass of the texts to their first
group, then only the digits of what is still undecided. A hot group (thousands of copies) is one
row on the aggregated side of each join, and AQE splits the row side; no group is ever collected.

Defined results: null text counts as empty and empty texts equal each other; null keys are larger
than all others, so they stay only if the whole group has none; of rows that share the smallest key
and the text exactly one is kept; input columns stay (a result replaces one of its name); an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ROW, discard, materialise, pack, text_or_empty, unpack

FIRST_DIGIT = 64
GROWTH = 8


def normal_space(text: Column) -> Column:
    """Each run of ASCII white space as one blank."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", normalise=normal_space) -> DataFrame:
    """``df`` with ``keep_id``, ``group_size``, ``kept`` and ``normal_text``; every input row is returned."""
    columns = df.columns
    body = F.encode(normalise(F.coalesce(F.col(f"{ROW}.`{text}`").cast("string"), F.lit(""))), "utf-8")
    first_digit = F.substring(F.encode(normalise(text_or_empty(text)), "utf-8"), 1, FIRST_DIGIT)
    rows = pack(df, digit=first_digit, key=F.col(f"`{key}`"))
    groups = rows.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = rows.join(groups.select("digit", F.lit(True).alias("shared")), "digit", "left")
    dealt = materialise(dealt.withColumn("rid", F.monotonically_increasing_id()), "radix-first")

    alone = dealt.where("shared is null")
    shared = dealt.where("shared")
    active = shared.select("rid", F.col("digit").alias("part"), body.alias("rest")).withColumn("rest", F.expr(f"substring(rest, {FIRST_DIGIT + 1})"))
    ended, steps, width = [], [], FIRST_DIGIT * (GROWTH - 1)
    while True:
        split = active.withColumn("digit", F.substring("rest", 1, width)).withColumn("over", F.expr(f"octet_length(rest) <= {width}"))
        groups = split.groupBy("part", "digit", "over").agg(F.min("rid").alias("group"), F.count(F.lit(1)).alias("n"))
        step = split.join(groups, ["part", "digit", "over"]).select(
            "rid", "group", F.expr("over or n = 1").alias("done"), F.expr(f"case when not over and n > 1 then substring(rest, {width + 1}) end").alias("rest")
        )
        step = materialise(step, "radix-level")
        steps.append(step)
        ended.append(step.where("done").select("rid", "group"))
        active = step.where("not done").select("rid", F.col("group").alias("part"), "rest")
        width *= GROWTH
        if active.isEmpty():
            break

    members = reduce(DataFrame.unionAll, ended).join(shared.select("rid", "key"), "rid")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid")).alias("first")
    classes = members.groupBy("group").agg(F.count(F.lit(1)).alias("group_size"), first)
    verdicts = members.join(classes, "group").select("rid", "group_size", F.col("first.key").alias("keep"), (F.col("first.rid") == F.col("rid")).alias("stays"))
    verdicts = materialise(verdicts, "radix-verdicts")  # short rows; the levels, which hold rests of texts, can go
    discard(*steps)
    again = shared.select("rid", ROW).join(verdicts, "rid").select(ROW, "keep", "group_size", "stays")
    whole = alone.select(ROW, F.col("key").alias("keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("stays")).unionByName(again)
    normal = normalise(F.coalesce(F.col(f"{ROW}.`{text}`").cast("string"), F.lit("")))
    return unpack(whole, columns, keep_id=F.col("keep"), group_size=F.col("group_size"), kept=F.col("stays"), normal_text=normal)
