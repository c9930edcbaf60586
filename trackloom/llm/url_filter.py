"""URL rules by a sort-merge range join over reversed-host keys.

A host becomes a canonical key: its labels reversed, each ended by a dot (``www.example.com`` is
``com.example.www.``). All subdomains of a rule's host then form one interval of keys, and the
intervals of different rules are nested or disjoint. The urls are dealt out by ranges of (key,
path, row) and sorted, so equal urls of one hot host still spread over tasks; a sweep over each
sorted range keeps a stack of the rule hosts whose intervals are open. The path rules of a host are
nested intervals of paths in the same way: the one that holds a url's path is the interval that begins
last before it, or one of those around that. So a url costs a search in each open host (one for each of
its labels at most), not a look at each rule; the longest of what these give wins.

Rules are sorted and swept in blocks of ``block_rules`` (the proven bound of what a task holds);
a longer list takes more sweeps over the same sorted urls and the longest rule of all blocks wins,
so no rule is dropped. Nothing is shuffled but one range exchange of (url key, row).

Defined results: a null url, or one without ``://``, has empty host and path; a host is lower-cased
in A-Z only and keeps ports as they are; of two fitting rules of equal length the one with the
longer host wins, of the same rule given twice the one that blocks; no rule gives ``default``;
repeated urls are judged each; result columns replace input columns of their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ROW, pack, unpack

#: Rules that one sweep holds.
BLOCK_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def plain_host_key(host: str) -> str:
    return ".".join(host.split(".")[::-1]) + "."


def split_rule(rule: str) -> tuple[str, str]:
    """``example.com/en/`` as host and path; a rule without a slash fits every path."""
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


class Paths:
    """The path rules of one host as nested intervals: each path knows the longest other one that begins it."""

    def __init__(self):
        self.paths: list[str] = []
        self.outer: list[int] = []
        self.rules: list[tuple[str, str]] = []
        self._open: list[int] = []

    def add(self, path: str, rule: str, verdict: str) -> None:
        """Paths come in order; of the same path given again the first stays."""
        if self.paths and self.paths[-1] == path:
            return
        while self._open and not path.startswith(self.paths[self._open[-1]]):
            self._open.pop()
        self.outer.append(self._open[-1] if self._open else -1)
        self._open.append(len(self.paths))
        self.paths.append(path)
        self.rules.append((rule, verdict))

    def longest(self, path: str) -> int:
        """The number of the longest path that begins ``path``, or -1: the interval that begins last before it, or one around that."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


def _sweep(rules: list[tuple[str, str, str, str]]):
    """A function over sorted batches that keeps the longest rule found so far.

    ``rules``: (key, path, rule, verdict), sorted by key and path, of the same path the one that wins first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, last, judged = 0, [], None, None
        for batch in batches:
            keys, paths = batch["key"].to_pylist(), batch["path"].to_pylist()
            best, verdicts, sizes = batch["rule"].to_pylist(), batch["verdict"].to_pylist(), batch["size"].to_pylist()
            for i, (key, path) in enumerate(zip(keys, paths, strict=True)):
                if key != last:
                    while at < len(rules) and rules[at][0] <= key:  # intervals that begin up to here
                        while stack and not rules[at][0].startswith(stack[-1][0]):
                            stack.pop()
                        if not stack or stack[-1][0] != rules[at][0]:
                            stack.append((rules[at][0], Paths()))
                        stack[-1][1].add(*rules[at][1:])
                        at += 1
                    while stack and not key.startswith(stack[-1][0]):  # intervals that ended before it
                        stack.pop()
                    last, judged = key, None
                if judged is None or judged[0] != path:
                    found = (-1, None, None)
                    for opened, listed in stack:
                        k = listed.longest(path)
                        if k >= 0:
                            size = (len(opened) - 1 + len(listed.paths[k])) * 4096 + min(len(opened), 2047) * 2 + (listed.rules[k][1] == "block")
                            found = max(found, (size, *listed.rules[k]), key=lambda f: f[0])
                    judged = (path, *found)
                if judged[1] > sizes[i]:
                    _, sizes[i], best[i], verdicts[i] = judged
            yield batch.set_column(batch.schema.get_field_index("rule"), "rule", pa.array(best, pa.string())).set_column(
                batch.schema.get_field_index("verdict"), "verdict", pa.array(verdicts, pa.string())
            ).set_column(batch.schema.get_field_index("size"), "size", pa.array(sizes, pa.int64()))

    return run


def judge(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` lists (verdict, rule)."""
    columns = df.columns
    listed = sorted({(plain_host_key(split_rule(r)[0]), split_rule(r)[1], r, v) for v, r in rules}, key=lambda x: (*x[:2], x[3] != "block", x[2]))
    host, path = url_parts(F.col(f"`{url}`"))
    packed = pack(df, host=host, path=path)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = packed.select(
        ROW, "host", "path", host_key(F.col("host")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(-1).cast("long").alias("size"), F.monotonically_increasing_id().alias("tie")
    )
    found = found.repartitionByRange(n, "key", "path", "tie").sortWithinPartitions("key")
    for first in range(0, len(listed), block_rules):
        found = found.mapInArrow(_sweep(listed[first : first + block_rules]), found.schema)
    return unpack(found, columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), verdict=F.col("verdict"))
