"""Byte-level BPE encoding and decoding with a local rank file (tiktoken).

``encode`` adds the token ids of every whole text, ``decode`` turns ids back into raw bytes. Both
are row-local Arrow functions: no shuffle, nothing broadcast but the path of the rank file, which
each Python worker loads once. Each text is encoded as the library would encode it in one call:
a long text is cut only at places where the split pattern always ends a match.

Defined results: null text counts as empty; empty text has no ids and decodes to no bytes; special
tokens are ordinary text; null ids are left out when decoding; repeated rows are encoded each; other columns are kept and a column of
the name ``into`` is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import pack, text_or_empty, unpack

#: Characters that are handed to the library at once; longer texts are cut at safe places.
PIECE_CHARS = 50_000
#: Rows that are encoded before their ids go back to the JVM.
STEP_ROWS = 128

# A letter or digit never shares a match with an ASCII blank, line feed or punctuation mark after
# it, and no look-ahead of an earlier match reads past it.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n!-/:-@\[-`{-~])")
# White space as the pattern's engine has it (without the four ASCII separators that Python adds).
_BLANKS = regex.compile(r"[\t-\r \x85\xa0  -     　]{%d,}" % PIECE_CHARS)


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, once per process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters, cut only where every match ends."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """All ids of one text, as one call of the library would give them."""
    if len(text) <= PIECE_CHARS:
        return np.asarray(encoding.encode_ordinary(text), np.int32)
    ids, at = [], 0
    for run in _BLANKS.finditer(text):
        # A run of blanks is one match up to its last character, which belongs to what follows.
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in safe_pieces(text[at : run.start()]):
            ids += encoding.encode_ordinary(piece)
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    for piece in safe_pieces(text[at:]):
        ids += encoding.encode_ordinary(piece)
    return np.asarray(ids, np.int32)


def _ids(encoding: tiktoken.Encoding, texts: pa.Array) -> pa.ListArray:
    found = [encode_text(encoding, x or "") for x in texts.to_pylist()]
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))


def _bytes(encoding: tiktoken.Encoding, ids: pa.ListArray) -> pa.BinaryArray:
    if ids.flatten().null_count:
        return pa.array([encoding.decode_bytes([i for i in x or [] if i is not None]) for x in ids.to_pylist()], pa.binary())
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    offsets = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
    return pa.array([encoding.decode_bytes(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def _in_steps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same rows, few at a time: what is held beside the input stays small."""
    for batch in batches:
        for lo in range(0, max(len(batch), 1), STEP_ROWS):
            yield batch.slice(lo, STEP_ROWS)


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the array ``into`` of token ids of the column ``text``."""

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load_encoding(rank_file, pattern)
        for texts in _in_steps(batches):
            yield _ids(encoding, texts)

    return df.withColumn(into, ids_of(text_or_empty(text)))


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes ``into`` that the ids stand for; they need not be valid UTF-8. Null lists count as empty, null ids are left out."""

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load_encoding(rank_file, pattern)
        for ids in _in_steps(batches):
            yield _bytes(encoding, ids)

    return df.withColumn(into, bytes_of(F.col(f"`{ids}`")))


def encode_and_decode(df: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and with ``decoded``, made from the ids, in one pass of one Python worker."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load_encoding(rank_file, pattern)
        for texts in _in_steps(batches):
            ids = _ids(encoding, texts)
            yield pa.StructArray.from_arrays([ids, _bytes(encoding, ids)], ["ids", "decoded"])

    return unpack(pack(df, both=both_of(text_or_empty(text))), df.columns, ids=F.col("both.ids"), decoded=F.col("both.decoded"))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one blank."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
