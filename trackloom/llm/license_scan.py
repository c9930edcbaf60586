"""Licence scan with a positional rare-token index, in DataFrame functions only.

Each template is a licence notice as words, with a mandatory key phrase at a known place. The index
has a posting (word, template, place) for every place of the ``INDEXED`` words of each template that
have the highest inverse document frequency over the whole table, and of the rarest word of its key
phrase. Every file is looked up by all indexed words it holds, which are the rarest of some licence, so a
file of many notices loses none of them; each of their places in the file, less their place in a
template, proposes where that template would begin. Proposals are intersected by position: a notice
begins only where at least ``AGREE`` rare words propose it, a base phrase wherever its word does. There
the mandatory key phrase is verified, and the share of the template's words that stand at their places
is the match's score. Base phrases are templates that are their own key phrase; the method's own
templates need at least ``MIN_SHARE`` of their words.

As a base phrase's rarest word is always looked up, every place of the phrase is proposed whatever the
frequencies are. Templates are data: postings, words and phrases are constant values of the plan, whose
size doesn't grow with their number. All work is row-local but the document frequencies, a count of
distinct licence words that is summed before it is shuffled and whose result has one row per licence
word. Proposals are sorted and compared with their neighbours, so a file with any number of them takes
no more than a sort. No Python runs on the executors.

Defined results: null text counts as empty; no words, no places (null first and last word, empty
labels, score 0); overlapping and repeated places all count; words of equal frequency rank by their
letters; the files are returned as often as they are given; result columns replace input columns of
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ROW, pack, text_or_empty, unpack

INDEXED = 8
AGREE = 2
MIN_SHARE = 0.5
#: ASCII characters that no word holds, and those that change.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool = False

    @property
    def at(self) -> int:
        """Where the key phrase stands in the template."""
        return next(i for i in range(len(self.words)) if self.words[i : i + len(self.key)] == self.key)


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    return Template(label, tuple(text.split()), tuple((key or text).split()), base)


BASE = [
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
]

#: The method's own notices. The words of the licences' public notices, lower-cased.
OWN = [
    template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 2",
    ),
    template(
        "lgpl-2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 2 1 of the license or at your option any later version",
        "gnu lesser general public license as published by the free software foundation",
    ),
    template("cc-by-nc-4", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    template("cc-by-4", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    template("cc-by-sa-4", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international"),
    template("cc-by-nc-4", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international"),
    template("apache-2", "licensed under the apache license version 2 0 the license", "under the apache license version 2 0"),
    template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
        "you may not use this file except in compliance with the license",
    ),
    template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "subject to the terms of the mozilla public license v 2 0",
    ),
    template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        "free and unencumbered software released into the public domain",
    ),
]


def words_of(text: Column) -> Column:
    """Words of lower-cased text: what stands between blanks when all other ASCII marks are blanks too."""
    blanked = F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(blanked, " "), "")


def constant(value, schema: str) -> Column:
    """A constant of any size as one value of the plan."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def frequencies(df: DataFrame, templates: list[Template], text: str = "text") -> dict[str, int]:
    """In how many rows of ``df`` each word of a template occurs; one row per licence word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(constant(vocabulary, "array<string>"), words_of(text_or_empty(text)))
    rows = df.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in rows}


def index(templates: list[Template], counts: dict[str, int], indexed: int = INDEXED) -> tuple[list[str], list[list[dict]]]:
    """The indexed words, rarest first, and the postings of each."""
    rarity = lambda w: (counts[w], w)
    chosen = [{*sorted(set(t.words), key=rarity)[:indexed], min(t.key, key=rarity)} for t in templates]
    words = sorted({w for c in chosen for w in c}, key=rarity)
    postings = [[{"t": n, "p": p} for n, (t, c) in enumerate(zip(templates, chosen, strict=True)) for p, x in enumerate(t.words) if x == w and w in c] for w in words]
    return words, postings


def scan(df: DataFrame, templates: list[Template] | None = None, text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """``df`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``."""
    templates = templates or BASE + OWN
    listed, posted = index(templates, frequencies(df, templates, text))
    rare_words = constant(listed, "array<string>")
    postings = constant(posted, "array<array<struct<t:int,p:int>>>")
    known = constant(
        [{"label": t.label, "base": t.base, "words": t.words, "key": t.key, "at": t.at} for t in templates], "array<struct<label:string,base:boolean,words:array<string>,key:array<string>,at:int>>"
    )

    rows = pack(df, words=words_of(text_or_empty(text)))
    rows = rows.withColumn("held", F.array_intersect(rare_words, "words"))  # rarest first, as the index lists them
    located = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("held", x["w"]))

    def proposals(x: Column) -> Column:
        found = F.get(postings, (F.array_position(rare_words, x["w"]) - 1).cast("int"))
        return F.transform(found, lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("at")))

    proposed = F.sort_array(F.flatten(F.transform(located, proposals)))
    rows = rows.withColumn("proposed", F.when(F.size("held") > 0, proposed))

    def agreed(x: Column, i: Column) -> Column:
        same = lambda k: F.coalesce(F.get("proposed", i + k) == x, F.lit(False))
        return ~same(-1) & (F.get(known, x["t"])["base"] | same(AGREE - 1)) & (x["at"] + F.get(known, x["t"])["at"] >= 0)

    def match(x: Column) -> Column:
        t = F.get(known, x["t"])
        standing = F.size(F.filter(F.transform(t["words"], lambda w, k: F.get("words", x["at"] + k) == w), lambda same: F.coalesce(same, F.lit(False))))
        return F.struct(
            t["label"].alias("label"),
            t["base"].alias("base"),
            x["at"].cast("long").alias("at"),
            (F.slice("words", x["at"] + t["at"] + 1, F.size(t["key"])) == t["key"]).alias("verified"),
            (standing / F.size(t["words"]).cast("double")).alias("share"),
        )

    matches = F.filter(F.transform(F.filter("proposed", agreed), match), lambda m: m["verified"] & (m["base"] | (m["share"] >= min_share)))
    rows = rows.withColumn("found", F.coalesce(F.when(F.size("proposed") > 0, matches), F.array().cast("array<struct<label:string,base:boolean,at:bigint,verified:boolean,share:double>>")))
    rows = rows.select(ROW, F.size("words").cast("long").alias("n_words"), "found", F.filter("found", lambda m: m["base"]).alias("based"))

    def labels(matches: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return unpack(
        rows,
        df.columns,
        n_words=F.col("n_words"),
        n_base=F.size("based").cast("long"),
        first_word=F.array_min(F.transform("based", lambda m: m["at"])),
        last_word=F.array_max(F.transform("based", lambda m: m["at"])),
        base_labels=labels("based"),
        labels=labels("found"),
        score=F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)),
    )
