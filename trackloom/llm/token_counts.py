"""Token counts by heap-and-linked-list byte-pair merging, from a local vocabulary file.

The number of tokens of a text, as the library of the vocabulary file gives it, without making the tokens.
A word's symbols (its bytes, the last one marked as the word's end) stand in a doubly linked list, each
adjacent pair that has a merge in a heap by the merge's rank and its place. The lowest pair is popped and
merged, its two new neighbours are pushed, and pairs that are no longer there are skipped when they are
popped, so a word of n bytes takes n log n steps however long it is. The count is what the word began with
less its merges; no identifiers are emitted.

A text becomes words as the file says: strings of special tokens stand for one token each, what is between
them is cut at white space, composed (NFC) and lower-cased, and the pattern's matches are the words. Equal
chunks of a text are counted once, and each worker keeps the counts of up to twice ``KEPT`` short ones.

All work is row-local: no shuffle, nothing broadcast but the file's path, which each worker loads once.
Words of chunks beyond ``LONG`` characters are taken as they are found, not listed.

Defined results: null text counts as empty; an empty or blank text has no tokens; repeated rows are
counted each; other columns are kept and result columns replace those of their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import pack, text_or_empty, unpack

#: Short words and chunks whose counts a worker keeps, and as many of those before.
KEPT = 500_000
KEPT_CHARS = 64
#: Characters from which on a chunk's words are taken one by one.
LONG = 1_000_000
#: Bits of a place in a word, and of a symbol's number.
SHIFT = 32
PLACE = (1 << SHIFT) - 1

#: Letters and digits of the regex module that the library's older tables don't know.
NEWER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb "
    "\U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 "
    "\U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 "
    "\U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 "
    "\U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 "
    "\U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).replace(" ", "")
#: Capitals that Python's tables don't lower yet, and how far off their small letters are.
CAPITALS = {
    **{c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}, 0xA7CB: 0x264, 0xA7DC: 0x19B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)}, ord("Σ"): ord("σ"),
}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be printed, else one from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a vocabulary file, over numbers instead of strings, and what is needed to split texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        mark = model["end_of_word_suffix"] or ""
        steps = [s["type"] for s in held["normalizer"]["normalizers"]], [s["type"] for s in held["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"{path}: only word-end byte-pair vocabularies of this kind are counted")
        ids = model["vocab"]
        letters = byte_letters()
        self.inner, self.final = [ids.get(c) for c in letters], [ids.get(c + mark) for c in letters]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.ranks = {(a << SHIFT) + b: rank for rank, (a, b, _) in enumerate(self.merges)}
        pattern = held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pattern_ascii = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{NEWER}]]")
        self.words, self.ascii_words = regex.compile(pattern, regex.V1), re.compile(pattern_ascii, re.ASCII)
        self.specials = sorted((t["content"] for t in held["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials)))
        self.odd = re.compile("[\x1c-\x1f]")  # white space for Python's split, but not for the pattern
        self.capitals = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")
        self.kept: dict[str, int] = {}  # the newest words, and those before them
        self.older: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """How many symbols a word ends in. A heap entry is a merge's rank and its place; the rank tells the pair."""
        inner, rank_of = self.inner, self.ranks.get
        ids = [inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        if None in ids:  # a vocabulary without some byte leaves it out
            ids = [i for i in ids if i is not None]
        left = n = len(ids)
        heap = [(rank << SHIFT) + at for at in range(n - 1) if (rank := rank_of((ids[at] << SHIFT) + ids[at + 1])) is not None]
        if not heap:
            return n
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            rank, at = entry >> SHIFT, entry & PLACE
            first, second, made = self.merges[rank]
            other = after[at]
            if other == n or ids[at] != first or ids[other] != second:
                continue  # one of the two has been merged meanwhile
            ids[at], ids[other] = made, -1
            left -= 1
            after[at] = third = after[other]
            if third < n:
                before[third] = at
                if (rank := rank_of((made << SHIFT) + ids[third])) is not None:
                    heapq.heappush(heap, (rank << SHIFT) + at)
            if (prior := before[at]) >= 0 and (rank := rank_of((ids[prior] << SHIFT) + made)) is not None:
                heapq.heappush(heap, (rank << SHIFT) + prior)
        return left

    def keep(self, chunk: str, n: int) -> int:
        if len(chunk) <= KEPT_CHARS:
            if len(self.kept) >= KEPT:
                self.kept, self.older = {}, self.kept
            self.kept[chunk] = n
        return n

    def count_word(self, word: str) -> int:
        return self.kept.get(word) or self.keep(word, self.older.get(word) or self.merged(word.encode()))

    def count_chunk(self, chunk: str) -> int:
        """Tokens of a lower-cased chunk of letters and other marks."""
        if chunk.isalpha():
            return self.count_word(chunk)
        words = self.words if not chunk.isascii() else self.ascii_words
        found = words.findall(chunk) if len(chunk) <= LONG else (m.group() for m in words.finditer(chunk))
        return self.keep(chunk, sum(map(self.count_word, found)))

    def count_part(self, part: str) -> int:
        """Tokens of a part without special strings: words, and composed letters, never reach over white space.

        Letters are lower-cased each by itself, so a final sigma is as any other.
        """
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
            if self.capitals.search(part):
                part = part.translate(CAPITALS)
        part = part.lower()
        chunks = (part,) if self.odd.search(part) else part.split()
        return sum(n * (self.kept.get(chunk) or self.count_chunk(chunk)) for chunk, n in Counter(chunks).items())

    def count(self, text: str) -> int:
        if not any(t in text for t in self.specials):
            return self.count_part(text)
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += 1 + self.count_part(text[at : m.start()])
            at = m.end()
        return n + self.count_part(text[at:])


@lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    """The merges of a file, once per process."""
    return Merges(path)


def count(df: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""

    @F.arrow_udf("long")
    def tokens_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = load_merges(path)
        for texts in batches:
            yield pa.array([merges.count(x.as_py()) for x in texts], pa.int64())

    whole = text_or_empty(text)
    counted = pack(df, n_bytes=F.octet_length(whole).cast("long"), n_tokens=tokens_of(whole))
    return unpack(counted, df.columns, n_bytes=F.col("n_bytes"), n_tokens=F.col("n_tokens"), over_limit=F.col("n_tokens") > limit)
