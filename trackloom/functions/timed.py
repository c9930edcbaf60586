"""Timed metadata: the clock and the orientation that a data sample's text frames hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.arith import once

#: The frames of the clock and of the orientation, bytes of a frame's head, and the mark of UTF-8 text.
CLOCK, TURN, HEAD, UTF8 = "TIT3", "TKEY", 10, 3


def _code(text: Column, at: Column) -> Column:
    return F.ascii(F.substring(text, (at + 1).cast("int"), F.lit(1))).cast("long")


def timed_info(content: Column) -> Column:
    """Of a data sample: (clock in seconds, orientation in quarter turns, error).

    Frames are looked for byte by byte; a frame tells its size in four numbers of seven bits, and what it holds isn't searched. The last
    of each kind counts, missing ones are null. A frame's text ends with a zero byte and begins with digits, of which the number that
    they begin counts. Invalid: other text, or a frame beyond the data; Unsupported: another encoding than UTF-8. An error ends the search.
    """
    # One character a byte.
    return F.when(content.isNotNull(), once(F.decode(content, "ISO-8859-1"), _walked))


def _walked(text: Column) -> Column:
    """``timed_info`` of a text of one character a byte, cut before each place where a frame could begin; the pieces are walked in order."""
    pieces = F.split(text, f"(?={CLOCK}|{TURN})")
    number = lambda s: F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)", 1).cast("double")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("until"), F.lit(None).cast("double").alias("clock"), F.lit(None).cast("double").alias("turn"), F.lit(None).cast("string").alias("error"))

    def step(state: Column, piece: Column) -> Column:
        kind, at = F.substring(piece, 1, 4), state["at"]
        frame = kind.isin(CLOCK, TURN) & (at >= state["until"]) & state["error"].isNull()
        then = lambda until, clock, turn, error: F.struct((at + F.length(piece)).alias("at"), until.alias("until"), clock.alias("clock"), turn.alias("turn"), error.alias("error"))

        def sized(size: Column) -> Column:
            body = F.substring(text, (at + HEAD + 2).cast("int"), (size - 1).cast("int"))
            error = (
                F.when((size < 2) | (at + HEAD + size > F.length(text)), "Invalid")
                .when(_code(text, at + HEAD) != UTF8, "Unsupported")
                .when(~F.regexp_like(body, F.lit(r"(?s)^[0-9].*\x00$")), "Invalid")
            )
            last = lambda e, of, old: F.when(e.isNull() & (kind == of), number(body)).otherwise(old)
            return once(error, lambda e: then(at + HEAD + size, last(e, CLOCK, state["clock"]), last(e, TURN, state["turn"]), e))

        size = F.shiftleft(_code(text, at + 4), 21) + F.shiftleft(_code(text, at + 5), 14) + F.shiftleft(_code(text, at + 6), 7) + _code(text, at + 7)
        return F.when(frame, once(size, sized)).otherwise(then(*[state[c] for c in ("until", "clock", "turn", "error")]))

    found = lambda s: F.struct(
        F.when(s["error"].isNull(), s["clock"]).alias("clock"), F.when(s["error"].isNull(), F.floor(F.pmod(F.floor(s["turn"]), F.lit(360)) / 90.0 + 0.5) % 4).cast("int").alias("orientation"), s["error"].alias("error")
    )
    return F.aggregate(pieces, start, step, found)
