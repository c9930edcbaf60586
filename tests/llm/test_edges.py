"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tests.llm.brute import components, negatives, repeated_words, shingles, variants
from trackloom.llm import bpe, chat_format, decontaminate, exact_dedup, hard_negatives, jaccard_join, langid, license_scan, quality, spelling, substring_dedup, token_counts, url_filter

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = "lorem ipsum dolor sit amet " * 40_000


def docs(spark, rows, more="", values=()):
    return spark.createDataFrame([(*r, *values) for r in rows], "doc_id long, text string" + more)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_no_column_of_the_caller_is_touched(spark):
    """Columns with the names that operators use inside, and odd ones, come back as they were."""
    names = ["__row", "__r1", "__r2", "__same", "__found", "__match", "__text", "__length", "__key", "__ranges", "__twin", "__cut", "__both", "a.b", "r1", "r2", "cid", "digit", "rid", "found", "hit", "digest", "both", "words", "held", "key", "path x"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, t, *[f"{n} {i}" for n in names]) for i, t in enumerate(["one two three", None, "one two  three", "four five six " * 30, "four five six " * 30])]
    df = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(1, "two three"), (2, "five six")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")
    model, share = quality.train(df, labels)
    outputs = [
        decontaminate.find(df, items), decontaminate.find(df, items, block_words=1), exact_dedup.dedup(df), jaccard_join.dedup(df), substring_dedup.remove(df), license_scan.scan(df),
        bpe.encode_and_decode(df, RANKS, PATTERN), quality.score(df, model, share), langid.predict(df, langid.fit([("one two three", "en")])), decontaminate.clean(df, items),
        url_filter.judge(df, [("block", "x/")], url="text"), token_counts.count(df, public_tokenizers.path("word_bpe_49k.json")),
    ]
    for n, out in enumerate(outputs):
        assert len(out.columns) == len(set(out.columns))
        for r in out.collect():
            assert all(r[c] == f"{c} {r['doc_id']}" for c in names), (n, r)


# ---------------------------------------------------------------- tokens

def test_bpe(spark):
    odd = "  tabs\t\tand \x1f\u2003blanks 'S it's\r\n\n" + "\u00e9\u4e2d\U0001f600" * 5
    rows = [(1, None), (2, ""), (3, LONG), (4, odd), (4, odd), (5, " " * 200_000 + "x"), (6, "a" * 120_000), (7, "1,2;" * 60_000)]
    df = docs(spark, rows, ", ids string, decoded int", ("mine", 7))
    found = bpe.encode_and_decode(df, RANKS, PATTERN).collect()
    assert len(found) == len(rows) and found[0]["ids"] == [] and bytes(found[0]["decoded"]) == b""
    library = bpe.load_encoding(RANKS, PATTERN)
    for r in found:
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
    apart = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert [(r["ids"], r["decoded"]) for r in apart] == [(r["ids"], r["decoded"]) for r in found]
    assert bpe.encode_and_decode(df.where("false"), RANKS, PATTERN).count() == 0
    assert bytes(bpe.decode(spark.createDataFrame([(None,), ([220, 50],)], "ids array<int>"), RANKS, PATTERN).collect()[1]["decoded"]) == library.decode_bytes([220, 50])


def test_bpe_pieces_do_not_change_ids():
    library, rng = bpe.load_encoding(RANKS, PATTERN), random.Random(1)
    alphabet = ["a", "B", "é", "中", "7", " ", "  ", "\n", "\t", "'s", "'", "!", "…", "\u00a0", "x" * 9]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(60))
        assert [i for p in bpe.safe_pieces(text, 7) for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


# ---------------------------------------------------------------- exact copies

def test_exact_dedup(spark):
    base = "x" * 5000
    rows = [(None, "a  b"), (9, "a b"), (4, "a\tb"), (4, "a\tb"), (1, None), (2, ""), (3, " "), (5, base + "1"), (6, base + "2"), (7, base + "1"), (8, LONG), (10, LONG), (None, "only"), (11, base), (12, base[:64]), (13, base[:64])]
    df = docs(spark, rows, ", keep_id string, rid int, `group` int", ("mine", 1, 2))
    found = exact_dedup.dedup(df).collect()
    assert len(found) == len(rows) and "rid" in found[0].asDict()
    groups = {}
    for r in found:
        groups.setdefault(r["normal_text"], []).append(r)
    for text, members in groups.items():
        ids = [r["doc_id"] for r in members if r["doc_id"] is not None]
        assert {r["group_size"] for r in members} == {len(members)}
        assert {r["keep_id"] for r in members} == {min(ids) if ids else None}
        assert sum(r["kept"] for r in members) == 1
        assert next(r["doc_id"] for r in members if r["kept"]) == (min(ids) if ids else None)
    assert len(groups["a b"]) == 4 and len(groups[""]) == 2 and len(groups[" "]) == 1
    assert exact_dedup.dedup(df.where("false")).count() == 0


# ---------------------------------------------------------------- near copies

def test_jaccard_join(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(200)]
    near = base[:100] + ["changed"] + base[101:]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (None, " ".join(base)), (7, None), (8, ""), (9, "one two"), (10, "One, two!"), (11, "three"), (12, LONG), (12, LONG), (13, " ".join(words))]
    df = docs(spark, rows, ", cid string, key int", ("mine", 3))
    found = jaccard_join.groups(jaccard_join.join(df)).collect()
    got = {}
    for r in found:
        got.setdefault(r["key"], []).append((r["class_id"], r["n_links"]))
    assert got == {5: [(3, 2)], 3: [(3, 2)], None: [(3, 2)], 7: [(7, 1)], 8: [(7, 1)], 9: [(9, 1)], 10: [(9, 1)], 11: [(11, 0)], 12: [(12, 1), (12, 1)], 13: [(13, 0)]}
    kept = jaccard_join.dedup(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 9, 11, 12, 13]
    assert jaccard_join.dedup(df.where("false")).count() == 0


def test_large_buckets_are_split_and_no_pair_is_judged_twice(spark, monkeypatch):
    """With tiny limits every path of the join is taken: splits, blocks, streams of buckets, matrices."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    base = [str(x) for x in rng.choice(words, 60)]
    texts = []
    for _ in range(90):
        near = list(base)
        near[rng.integers(60)] = str(rng.choice(words))
        texts.append(" ".join(near[: 60 - rng.integers(6)]))
    links, roots = components({i: shingles(t) for i, t in enumerate(texts)}, 0.8)
    df = docs(spark, list(enumerate(texts)))
    for small, tiny in ((2048, 48), (2048, 200), (16, 48), (16, 2)):
        monkeypatch.setattr(jaccard_join, "TINY", tiny)
        found = by_id(jaccard_join.groups(jaccard_join.join(df.withColumnRenamed("doc_id", "key"), "key", small=small)).withColumnRenamed("key", "doc_id"))
        assert {i: r["n_links"] for i, r in found.items()} == links
        assert {i: r["class_id"] for i, r in found.items()} == roots


def test_pairs_of_unequal_size_at_the_threshold_are_found(spark):
    """A text of 160 runs and itself with 40 more, a similarity of exactly 0.8, for which the chance to share too few picks is largest."""
    assert jaccard_join.runs_and_share(0.8, 0.9999) == (2, 0.25) and jaccard_join.split_chance(0.8, 2) < 1e-5
    assert 9e-4 < jaccard_join.miss_chance(0.8, 2, 0.4) < 2e-3
    rows = []
    for i in range(6000):
        words = [f"p{i}w{j}" for j in range(204)]
        rows += [(2 * i, " ".join(words[:164])), (2 * i + 1, " ".join(words))]
    found = by_id(jaccard_join.groups(jaccard_join.join(docs(spark, rows))).withColumnRenamed("key", "doc_id"))
    missed = sum(r["n_links"] != 1 for r in found.values())
    assert missed <= 2


def test_pairs_of_unequal_size_in_large_buckets_are_found(spark):
    """Sets of 160 and 200 runs, a similarity of exactly 0.8, whose runs are all held by a quarter of the other sets too."""
    rng = random.Random(9)
    passages = [" ".join(f"p{i}w{j}" for j in range(16)) for i in range(40)]
    rows = []
    for _ in range(800):
        chosen = rng.sample(passages, 10)
        rows += ["and so it is " + " and so it is ".join(chosen[:k]) + " and so it is" for k in (8, 10)]
    links, roots = components({i: shingles(t) for i, t in enumerate(rows)}, 0.8)
    found = by_id(jaccard_join.groups(jaccard_join.join(docs(spark, list(enumerate(rows))), small=64)).withColumnRenamed("key", "doc_id"))
    assert {i: r["n_links"] for i, r in found.items()} == links
    assert {i: r["class_id"] for i, r in found.items()} == roots


def test_large_buckets_are_split(spark, monkeypatch):
    """A line that all texts share makes a bucket of all of them; further picks split it, so it isn't compared pair by pair, and no link is lost."""
    rng = random.Random(12)
    text = lambda shared, i: f"{shared} " + " ".join(f"t{i}w{j}" for j in range(60))
    lines = [" ".join(f"v{v}b{i}" for i in range(7)) for v in range(60)]
    pairs = spark.createDataFrame([(v, i, text(line, i)) for v, line in enumerate(lines) for i in range(2)], "v int, i int, text string")
    sketched = pairs.select("v", "i", jaccard_join._sketcher(5, 2)("text").alias("s"))
    shared = {}
    for r in sketched.collect():
        mine = [set(r["s"][f"picks{level}"]) for level in (0, 1)]
        shared[r["v"]] = [a & b for a, b in zip(shared.get(r["v"], mine), mine)]
    line = lines[next(v for v, (top, deeper) in shared.items() if top and not deeper)]
    rows = []
    for i in range(600):
        rows.append(text(line, i))
        if i % 5 == 0:
            rows.append(rows[-1].replace(f"w{rng.randrange(60)} ", "w99 ", 1))
    links, roots = components({i: shingles(t) for i, t in enumerate(rows)}, 0.8)
    split, made = jaccard_join._split, []
    monkeypatch.setattr(jaccard_join, "runs_and_share", lambda threshold, target: (2, 0.05))  # a share so low that no pick may be left out
    monkeypatch.setattr(jaccard_join, "_split", lambda large, classes, small: made.append((large.count(), split(large, classes, small))) or made[-1][1])
    found = by_id(jaccard_join.groups(jaccard_join.join(docs(spark, list(enumerate(rows))), small=8)).withColumnRenamed("key", "doc_id"))
    assert {i: r["n_links"] for i, r in found.items()} == links and {i: r["class_id"] for i, r in found.items()} == roots
    before, ends = made[0]
    assert before >= 600 and sum(links.values()) >= 200 and ends.agg({"blocks": "max"}).first()[0] < 20


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_recall_with_real_splits(spark, threshold):
    """Every pair at the threshold is found, whatever it is, where buckets are split and cut into blocks."""
    rng = random.Random(int(threshold * 100))
    passages = [" ".join(f"p{i}w{j}" for j in range(16)) for i in range(60)]
    rows = []
    for _ in range(500):
        base = rng.sample(passages, 12)
        rows += [" and so it is ".join(base[: rng.choice([8, 10, 11, 12])]) for _ in range(2)]
    links, roots = components({i: shingles(t) for i, t in enumerate(rows)}, threshold)
    found = by_id(jaccard_join.groups(jaccard_join.join(docs(spark, list(enumerate(rows))), threshold=threshold, small=16)).withColumnRenamed("key", "doc_id"))
    lost = sum(links.values()) - sum(r["n_links"] for r in found.values())
    assert sum(links.values()) > 200 and 0 <= lost <= 2 and all(r["n_links"] <= links[i] for i, r in found.items())


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 12)] + [(20, 25), (22, 25)], "a long, b long")
    assert {r["cid"]: r["root"] for r in jaccard_join.components(chain).collect()} == {**{i: 0 for i in range(13)}, 20: 20, 22: 20, 25: 20}
    assert jaccard_join.components(chain.where("false")).count() == 0


# ---------------------------------------------------------------- repeated passages

@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup_against_brute_force(spark, window):
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(5)] + ["naïve", "中"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, window - 1, window, window + 1, 90]))) for _ in range(30)]
    texts += ["a " * 100, "a " * 40 + "b " + "a " * 40, "a b " * 50, None, "", " \n\t", "the same \t text " * 9, "the same \t text " * 9, "the  same text " * 9]
    for _ in range(25):
        x, y = rng.choice(texts) or "", rng.choice(texts) or ""
        at = rng.randrange(len(x.split()) + 1)
        texts.append(" ".join([*x.split()[at:], "~", *y.split()]))
    df = docs(spark, list(enumerate(texts)), ", r1 int, ranges string", (1, "mine"))
    found = by_id(substring_dedup.remove(df, window=window))
    assert len(found) == len(texts)
    for i, kept in enumerate(repeated_words(texts, window)):
        assert found[i]["kept_text"] == " ".join(kept), i
        assert found[i]["n_words"] == len((texts[i] or "").encode().split()) and found[i]["n_removed"] == found[i]["n_words"] - len(kept)
    assert substring_dedup.remove(df.where("false"), window=window).count() == 0


def test_substring_dedup_of_long_texts(spark):
    words = [f"w{i % 977}x{i % 1013}" for i in range(60_000)]
    found = by_id(substring_dedup.remove(docs(spark, [(1, " ".join(words)), (2, " ".join(words[100:200])), (2, "short")])))
    assert found[1]["n_removed"] == 100 and found[1]["n_words"] == 60_000


def test_windows_of_substring_dedup_are_shuffled_without_their_spelling(spark, monkeypatch):
    """Passages cut at a place of each text's own: comparing the windows at their edges a second time shuffles about what the first time does."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(90)] for _ in range(40)]
    rows = [(i, " ".join([*(word() for _ in range(20)), *passages[i % 40][rng.randrange(30) : 60 + rng.randrange(30)], *(word() for _ in range(20))])) for i in range(800)]
    sc, written, materialise = spark.sparkContext, {}, substring_dedup.materialise

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(x := found.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(found.size())}

    def counted(df, name):
        before = max(stages(), default=-1)
        table = materialise(df, name)
        written[name] = sum(n for stage, n in stages().items() if stage > before)
        return table

    monkeypatch.setattr(substring_dedup, "materialise", counted)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = by_id(substring_dedup.remove(docs(spark, rows)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for (i, _), kept in zip(rows, repeated_words([t for _, t in rows], 35), strict=True):
        assert found[i]["kept_text"] == " ".join(kept), i
    assert 0 < written["good"] < 2 * written["windows"], written


# ---------------------------------------------------------------- benchmark passages

def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "short item"), (None, "null id item here"), (3, None), (4, "..."), (1, "one two three four five six seven eight nine zehn")], "item_id long, text string")
    rows = [
        (1, f"before. {item.upper()}! after the end of it, and so on and so on for a good while more than that"),
        (2, "a Short, item é in the middle"), (3, None), (4, ""), (5, "one two three four five six seven eight nine"), (6, "a null id item here"), (7, item),
        (8, LONG + item), (2, "a Short, item é in the middle"),
    ]
    df = docs(spark, rows, ", spans string, __text int, n_hit int", ("mine", 3, 4))
    found = {}
    for r in decontaminate.find(df, items).collect():
        found[r["doc_id"]] = (r["n_words"], r["n_hit"], r["items"])
    assert found[1][1:] == (12, ["1"]) and found[2] == (7, 2, ["2"]) and found[3] == found[4] == (0, 0, [])
    assert found[5] == (9, 0, []) and found[6] == (5, 4, ["null"]) and found[7] == (12, 12, ["1"]) and found[8][1:] == (12, ["1"])
    blocks = decontaminate.find(df, items, block_words=5)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in blocks.collect()} == found
    shared = items.unionByName(items.selectExpr("item_id + 10 as item_id", "text"))
    both = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find(df, shared).collect()}
    assert both[1] == (12, ["1", "11"]) and both[2] == (2, ["12", "2"]) and both[6] == (4, ["null"])
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find(df, shared, block_words=13).collect()} == both
    kept = {r["doc_id"]: r for r in decontaminate.clean(df, items).collect()}
    assert sorted(kept) == [1, 2, 3, 4, 5, 8] and kept[1]["text"] == "before. ! after the end of it, and so on and so on for a good while more than that"
    assert kept[2]["text"] == "a  é in the middle" and kept[3]["text"] is None and kept[8]["text"] == LONG and kept[1]["spans"] == "mine" and kept[1]["n_hit"] == 4
    assert decontaminate.find(df.where("false"), items).count() == 0
    assert decontaminate.find(df, items.where("false")).where("n_hit > 0").count() == 0


def test_automaton_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        items = [(str(i), [bytes([97 + rng.randrange(3)]) for _ in range(rng.randint(1, 9))]) for i in range(4)]
        held = decontaminate.Automaton(items, 4)
        words = [bytes([97 + rng.randrange(4)]) for _ in range(40)]
        covered, owners = set(), set()
        for name, item in items:
            size = min(4, len(item))
            for s in range(len(item) - size + 1):
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == item[s : s + size]:
                        covered |= set(range(p, p + size))
                        owners.add(name)
        spans, found = held.scan(held.numbers(words))
        assert found == owners and {p for a, b in spans for p in range(a, b)} == covered and sum(b - a for a, b in spans) == len(covered)


# ---------------------------------------------------------------- licences

def test_license_scan(spark):
    rows = [(1, "Released under the MIT License. Under the MIT-license!"), (2, None), (3, ""), (4, LONG + "Apache License, Version 2.0"), (5, "cc cc by by nc CC BY-NC"), (6, "under the mit"),
            (7, "This work is licensed under the GNU General Public License, version 3."), (7, "é under the mit license"), (8, "mit " * 3000)]
    df = docs(spark, rows, ", labels string, __words int, score string", ("mine", 3, "x"))
    found = {}
    for r in license_scan.scan(df).collect():
        found.setdefault(r["doc_id"], []).append(r)
    one = found[1][0]
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"], one["base_labels"], one["score"]) == (9, 2, 1, 5, "mit", 1.0)
    assert [(r["n_words"], r["n_base"], r["first_word"], r["base_labels"], r["labels"], r["score"]) for r in found[2] + found[3]] == [(0, 0, None, "", "", 0.0)] * 2
    assert found[4][0]["base_labels"] == "apache-2" and found[4][0]["first_word"] == 200_000
    assert (found[5][0]["n_base"], found[5][0]["first_word"]) == (1, 5) and found[6][0]["n_base"] == 0 and found[8][0]["labels"] == ""
    assert sorted(r["labels"] for r in found[7]) == ["gpl-3", "mit"]
    notices = [(i, f"{LONG if i == 3 else ''}{'* ' * i}{' '.join(t.words)} and more") for i, t in enumerate(license_scan.OWN)] + [(100, " ".join(w for t in license_scan.OWN for w in sorted(t.words)))]
    notices.append((101, " x ".join(" ".join(t.words) for t in license_scan.OWN)))
    read = by_id(license_scan.scan(docs(spark, notices)))
    assert {*read[101]["labels"].split(",")} >= {t.label for t in license_scan.OWN}  # a file of all notices keeps every label
    for i, t in enumerate(license_scan.OWN):
        assert t.label in read[i]["labels"].split(",") and read[i]["score"] == 1.0, t
    assert read[100]["base_labels"] == ""
    plan = license_scan.scan(df, license_scan.BASE + license_scan.OWN * 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains") < 10
    assert license_scan.scan(df.where("false")).count() == 0


# ---------------------------------------------------------------- chats

def test_chat_format(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, None, "x"), (1, 2, None, "x"), (None, 5, "ann", "y"), (2, None, "a b", "z"), (2, -3, "a_b", "w"), (2, 1, "unknown", "u"), (2, 2, None, "v"),
            (3, 0, "system", "alone"), (4, 0, "ann", "p"), (4, 2000, "bob", "q"), (5, 1, "a%20b", ""), (5, 1, "a b", "")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, part string")
    found = {(r["conv_id"], r["part"], r["perspective"]): r for r in chat_format.rotate(df).collect()}
    people = {(1, "ann"), (1, "bob"), (1, "%null"), (None, "ann"), (2, "a%20b"), (2, "a_b"), (2, "unknown"), (2, "%null"), (4, "ann"), (4, "bob"), (5, "a%2520b"), (5, "a%20b")}
    assert set(found) == {(c, 0, p) for c, p in people}
    for (conv, _, who), r in found.items():
        parts = [r["rendered"][s["start"] : s["end"]] for s in r["spans"]]
        assert len(parts) == r["n_learned"] and all(p.endswith("<|im_end|>") for p in parts) and r["rendered"].count("<|im_start|>") == r["n_turns"]
        assert f"name={who}\n" not in r["rendered"] and r["n_turns"] == sum(c == conv for c, *_ in rows) and r["start"] == 0
    ann = found[1, 0, "ann"]["rendered"]
    assert ann.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n") and "user name=bob\n<|im_end|>" in ann
    assert found[1, 0, "%null"]["n_learned"] == 2
    assert found[2, 0, "a_b"]["rendered"].index("z<") < found[2, 0, "a_b"]["rendered"].index("w<")
    assert "name=bob\nq" in found[4, 0, "ann"]["rendered"] and "name=ann\np" in found[4, 0, "bob"]["rendered"]
    assert chat_format.rotate(df.where("false")).count() == 0


def test_chat_format_parts_are_the_whole(spark):
    """Long dialogues and texts, without turn numbers too, come in parts that make the very rendering in one part."""
    rng = random.Random(8)
    rows = [(c, rng.choice([None, -1, t, 7]), rng.choice(["system", "ann", "bob", "cy", None]), "x" * rng.choice([0, 3, 40, 900])) for c in (1, 2, None) for t in range(120)]
    rows += [(2, 50, "ann", LONG), (2, 51, "dee", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["perspective"]): r for r in chat_format.rotate(df, part_chars=1 << 40).collect()}
    assert len(whole) == 4 + 5 + 4 and all(r["n_turns"] == {1: 120, 2: 122, None: 120}[c] for (c, _), r in whole.items())
    parts = {}
    for r in chat_format.rotate(df, part_chars=2000).orderBy("part").collect():
        parts.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(parts) == set(whole)
    for k, listed in parts.items():
        assert len(listed) > 5 and "".join(r["rendered"] for r in listed) == whole[k]["rendered"]
        assert [(r["start"] + s["start"], r["start"] + s["end"]) for r in listed for s in r["spans"]] == [(s["start"], s["end"]) for s in whole[k]["spans"]]
        assert all(len(r["rendered"]) < 2000 + 80 * r["n_turns"] + max(map(len, (t or "" for *_, t in rows))) for r in listed)


# ---------------------------------------------------------------- classifiers

def test_langid(spark):
    rows = [(f"the cat and number {i} sat on the mat with that", "en") for i in range(60)] + [(f"der hund und nummer {i} liegt auf dem bett mit dem", "de") for i in range(60)]
    model = langid.fit(rows)
    df = docs(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "the mat with that"), (5, "auf dem bett"), (6, LONG), (6, LONG), (7, "é")], ", score string, __found int", ("mine", 1))
    found = {}
    for r in langid.predict(df, model).collect():
        found.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert found[1] == found[2] == found[3] == [("und", 0.0)] and found[4][0][0] == "en" and found[5][0][0] == "de"
    assert len(found[6]) == 2 and found[6][0] == found[6][1] and found[7][0][0] in ("en", "de")
    assert langid.predict(df.where("false"), model).count() == 0
    labelled = spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string")
    assert langid.fit(langid.sample(labelled, "text", "lang", 5)) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}


def test_langid_learns_from_long_texts(spark):
    """A language that only long texts have is learned, from a bounded part of each that is spread over the whole."""
    rows = [(i, f"der hund und nummer {i} liegt auf dem bett mit dem " * 3, "de") for i in range(40)] + [(100 + i, f"the cat and number {i} sat on the mat with that " * 3000, "en") for i in range(40)]
    taken = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", 40)
    assert {l for _, l in taken} == {"de", "en"} and all(len(t) <= langid.FIT_PIECES * langid.PIECE_CHARS for t, _ in taken)
    model = langid.fit(taken)
    found = by_id(langid.predict(docs(spark, [(1, "the mat with that"), (2, "auf dem bett"), (3, rows[-1][1])]), model))
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["en", "de", "en"] and 0 <= model.threshold <= 1


def test_quality(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["river", "stone", "walks", "gently", "over", "hills"]) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY", "NOW!!", "$$$", "WIN!!"]) for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(3, None), (None, 1), (999, 0)], "doc_id long, quality int")
    df = docs(spark, [*rows, (500, None), (501, ""), (502, LONG), (503, good[0] + " x"), (504, bad[0] + " X!!")], ", score string, predicted string", ("a", "b"))
    model, share = quality.train(df, labels)
    found = by_id(quality.score(df, model, share))
    assert found[503]["predicted"] == 1 and found[504]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in found.values())
    assert found[500]["score"] == found[501]["score"]
    assert quality.score(df.where("false"), model, share).count() == 0
    again = [r for r in quality.score(docs(spark, [(i, t) for i in range(3) for t in (None, good[0], LONG, bad[0] + " x")]), model, share).collect()]
    assert len(again) == 12 and len({(r["text"], r["score"]) for r in again}) == 4
    long_only = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    stretched = docs(spark, [(i, " ".join([t] * 200)) for i, t in enumerate(good[:40] + bad[:40])])
    learned = by_id(quality.score(stretched, *quality.train(stretched, long_only)))
    assert all(r["predicted"] == int(i < 40) for i, r in learned.items())
    model, share = quality.train(df, labels.where("false"))
    assert model is None and {r["score"] for r in quality.score(df, model, share).collect()} == {1.0}


def test_attention_gradients():
    rng = np.random.default_rng(0)
    first = np.array([0, 2, 3, 6])
    x, y = rng.normal(size=(6, 5)), np.array([1.0, 0.0, 1.0])
    shapes = {"A": (5, 4), "a": (4,), "V": (4, 3), "U": (4, 3), "g": (3,), "c": (4,), "d": (1,)}
    model = quality.Model(np.zeros(5), np.ones(5), {k: rng.normal(size=s) for k, s in shapes.items()})

    def loss():
        p = model.forward(x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    found = quality.gradients(model, model.forward(x, first), y, first)
    for k, w in model.w.items():
        at = tuple(0 for _ in w.shape)
        keep, eps = w[at], 1e-6
        w[at] = keep + eps
        up = loss()
        w[at] = keep - eps
        down = loss()
        w[at] = keep
        assert abs((up - down) / (2 * eps) - found[k][at]) < 1e-4, k


# ---------------------------------------------------------------- urls

def test_url_filter(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "bare.org")]
    urls = [None, "", "no scheme", "http://", "http://COM/x", "https://a.Example.com/en/1?q", "http://www.example.com/en/#f", "x://www.example.com/de", "http://notexample.com/en/", "http://a.net/es/x", "http://a.net/es",
            "http://bare.org", "http://x.bare.org?y", "a://b://example.com/en/", "http://example.com:80/en/", "http://www.example.com\n/en/", "http://a.net/es/" + "y" * 100_000, "http://a.net/es/x"]
    df = spark.createDataFrame([(i, u, "mine", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, size int")
    expected = {}
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else None
        host = path = ""
        if rest is not None:
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        best = None
        for verdict, rule in rules:
            h, slash, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
        expected[i] = (host, path, best[1] if best else None, best[0] if best else "allow")
    for block in (100, 2, 1):
        found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules, block_rules=block).collect()}
        assert found == expected
    nested = [("block" if n % 2 else "allow", f"{'a.' * (n % 3)}b.org/{'x' * n}") for n in range(40)] + [("block", "b.org/xxxy/z"), ("allow", "b.org/xy/"), ("block", "B.org/xxx"), ("allow", "org/xxxxxxxxxx")]
    paths = [f"http://{h}b.org/{'x' * n}{t}" for h in ("", "a.", "c.a.a.") for n in range(45) for t in ("", "y/z/1")]
    rows = spark.createDataFrame(list(enumerate(paths)), "page_id long, url string")
    for r in url_filter.judge(rows, nested, block_rules=7).collect():
        fits = [(len(f), len(f.partition("/")[0]), v == "block") for v, f in nested if ("." + r["host"]).endswith("." + f.partition("/")[0].lower()) and r["path"].startswith("/" + f.partition("/")[2])]
        assert (len(r["rule"]), len(r["rule"].partition("/")[0]), r["verdict"] == "block") == max(fits), r
    assert url_filter.judge(df.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, [], default="block").collect()} == {"block"}


# ---------------------------------------------------------------- the pipeline

def test_pipeline_stages(spark, tmp_path):
    """Every stage on nulls in any column, empty and very long texts, ties, repeated rows, clashing columns and an empty table."""
    import corpus_pipeline

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(1, plain, "en", "a", 1), (1, plain, "en", "a", 1), (2, plain + "  more", None, None, None), (None, None, None, None, None), (3, "", "en", "a", 0), (4, " ", "en", "a", 1), (5, LONG, "la", "b", 9),
            (6, f"{plain.upper()} {item}. {plain}", "en", "a", 7), (7, item, "en", "a", 7), (None, item + " x", None, "a", 7), (8, "\u00e9 short", "fr", "b", 7)]
    extra = {"row": "r", "score": "s", "predicted": "p", "kept": "k", "keep_id": "i", "ids": "d", "decoded": "e", "__length": "l", "__key": "y", "a.b": "z"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    df = spark.createDataFrame([(*r, *extra.values()) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    found = {name: stage(spark, df, str(tmp_path)).collect() for name, stage in stages.items()}
    for name, stage in stages.items():
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0
        if name != "tokenise":
            assert all(r.asDict().keys() == dict(zip(df.columns, df.columns)).keys() and all(r[c] == v for c, v in extra.items()) for r in found[name])
    ids = lambda name: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found[name])
    every = sorted((i is None, i or 0) for i, *_ in rows)
    assert ids("quality") == every  # no labels
    assert ids("exact_dedup") == [(False, i) for i in range(1, 9)] + [(True, 0)]  # the null text is a copy of 3
    assert ids("near_dedup") == [(False, i) for i in (1, 3, 5, 6, 7, 8)]
    clean = {(r["doc_id"], r["source"]): r for r in found["decontaminate"]}
    assert ids("decontaminate") == sorted(x for x in every if x not in ((False, 7),)) [:-1]
    assert clean[6, "a"]["text"] == f"{plain.upper()} . {plain}" and clean[6, "a"]["n_chars"] == len(clean[6, "a"]["text"])
    assert clean[None, None]["text"] is None and clean[None, None]["n_chars"] is None and clean[5, "b"]["n_chars"] == 9
    tokens = {(r["doc_id"], r["source"]): r for r in found["tokenise"]}
    assert len(found["tokenise"]) == len(rows) and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in found["tokenise"])
    assert tokens[None, None]["ids"] == [] and tokens[5, "b"]["n_tokens"] > 100_000


# ---------------------------------------------------------------- token counts

def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    odd = ["  It's\u2003ΣΑΣ İstanbul e\u0301 \x1c\x1d\x85 '\u2019LL <|endoftext|>x<|startoftext|>", "中文字符" * 300, "9½²", "a" * 50_000, "x\t" * 30_000, "\ua7cb\u0558\U00032808\U00010d50"]
    rows = [(1, None), (2, ""), (3, LONG), *[(4 + i, t) for i, t in enumerate(odd)], (4, odd[0])]
    found = token_counts.count(docs(spark, rows, ", n_tokens string, other int", ("mine", 7)), path, limit=3).collect()
    assert len(found) == len(rows) and all(r["other"] == 7 for r in found)
    for r in found:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 3)
    assert token_counts.count(docs(spark, []), path).count() == 0


def test_merging_takes_the_lowest_rank_first():
    """Against plain merging: the lowest pair of all, the leftmost of equal ones, again and again."""
    held = token_counts.load_merges(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    for _ in range(300):
        word = bytes(rng.choice(b"aeinrsthlo\xc3\xa9") for _ in range(rng.randint(1, 24)))
        ids = [held.inner[b] for b in word[:-1]] + [held.final[word[-1]]]
        while True:
            ranks = [(held.ranks[(a << token_counts.SHIFT) + b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (a << token_counts.SHIFT) + b in held.ranks]
            if not ranks:
                break
            rank, i = min(ranks)
            ids[i : i + 2] = [held.merges[rank][2]]
        assert held.merged(word) == len(ids)


# ---------------------------------------------------------------- spelling variants

def spelled(df, **options):
    rows = [tuple(r) for r in spelling.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spelling_variants(spark):
    rng = random.Random(2)
    letters = "abcé×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 9))) for _ in range(40)]
    words = [w[: (i := rng.randrange(len(w)))] + rng.choice(["", *letters]) + w[i + rng.randint(0, 1) :] for w in base * 8] + base * 30 + ["internat" + rng.choice(letters) + "nal" for _ in range(200)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40)]
    rows += [(None, "Variant1Variant_variant Varianté"), (7, None), (8, ""), (9, "x" * 300 + " " + "x" * 299 + "y"), (9, "x" * 300 + " " + "x" * 299 + "y"), (10, LONG)]
    df = docs(spark, rows, ", word string, n int", ("mine", 7))
    wanted = variants(rows)
    assert any(r[1] for r in wanted) and any(r[4] > 3 for r in wanted)
    for block in (None, 25):
        assert spelled(df, block=block) == wanted
    assert spelled(docs(spark, [])) == set() and spelled(docs(spark, [(1, None)])) == set()


def test_spelling_sub_blocks(spark, monkeypatch):
    """Words beyond what is worked on at once are taken in parts."""
    rows = [(i, "wordone wordtwo wordsix wardone wordon wordone " * 12 + "ab" * 40 + " " + "ab" * 39 + "ac") for i in range(3)]
    monkeypatch.setattr(spelling, "CELLS", 16)
    held = [f"{a}{b}{c}etter".encode() for a in "lmn" for b in "abc" for c in "xyz"]
    found = spelling.near(held, 8, held, np.zeros(27, int), np.full(27, 9))
    assert len(found[0]) == 27 * 6
    assert spelled(docs(spark, rows)) == variants(rows)


# ---------------------------------------------------------------- hard negatives

def mined(df, anchor="id % 5 = 0", **options):
    found = hard_negatives.mine(df, F.expr(anchor), **options)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def whole(rows):
    width = max(len(v) for _, v, _ in rows)
    return [(i, l, [math.floor(256 * x) for x in v] + [0] * (width - len(v))) for i, v, l in rows]


SCHEMA = "vec_id long, embedding array<float>, label int, id string, cid string"


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0.3, 0.4, 6).round(2)], int(rng.integers(3))) for i in range(160)]
    rows += [(200 + i, [0.5] * 6, i % 2) for i in range(60)]  # one vector in many rows
    rows += [(300, [], 1), (305, [0.25], 2), (310, [0.0] * 6, 0), (20, rows[20][1], rows[20][2])]  # short ones, zeros, a repeated row
    odd = [(400, None, 1), (405, [0.1, None], 1), (410, [float("nan")] * 6, 1), (415, [float("inf")] * 6, 1), (420, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows + odd], SCHEMA)
    wanted = negatives(whole(rows), lambda i: i % 5 == 0)
    assert mined(df) == wanted and len(wanted) > 300
    small = hard_negatives.LEAST_CELL, hard_negatives.LEAST_SAMPLED, hard_negatives.QUERIES
    try:  # several cells, buckets and blocks of anchors
        hard_negatives.LEAST_CELL, hard_negatives.LEAST_SAMPLED, hard_negatives.QUERIES = 8, 8, 16
        assert mined(df, cell=8) == wanted
    finally:
        hard_negatives.LEAST_CELL, hard_negatives.LEAST_SAMPLED, hard_negatives.QUERIES = small
    assert mined(df.where("false")) == [] and mined(df, "id = 1000000") == []
    with pytest.raises(ValueError, match="2\\*\\*53"):
        mined(spark.createDataFrame([(0, [1e30, 1.0], 1, "", "")], SCHEMA))


def test_tree_walk_is_nearest_first():
    """A small leaf size: the walk inside a window gives what sorting all rows gives."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-40, 60, (500, 5)).astype(float)
    square = (rows**2).sum(1)
    tree = hard_negatives.Tree(rows, np.sqrt(square.max() - square), 8)
    ids, fits = [[i] for i in range(500)], rng.random(500) < 0.6
    queries = rng.integers(-40, 60, (30, 5)).astype(float)
    far = tree.vantages(queries)
    for q, query in enumerate(queries):
        scores = rows @ query
        for low, high in ((-1e9, 1e9), (100, 900), (-50, 0), (5000, 4000)):
            best = hard_negatives.Best(4, low)
            found = hard_negatives.walk(tree, query, far[q], (query**2).sum() + square.max(), low, high, fits, ids, best, {})
            wanted = sorted((-int(scores[i]), i, i) for i in range(500) if fits[i] and low <= scores[i] <= high)[:4]
            assert found == wanted


# ---------------------------------------------------------------- samples of repeated rows

def test_language_sample_of_repeated_rows(spark):
    """Copies of one text count once, so they take no place from another language; junk labels are an error."""
    rows = [("the same words again", "en")] * 3000 + [(f"der Satz Nummer {i} ist noch da", "de") for i in range(40)] + [(None, "fr"), ("", "it"), ("no label", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    found = langid.sample(df, "text", "lang", 400)
    assert sorted(found) == sorted(set(r for r in rows if r[0] and r[1]))
    assert langid.fit(found).labels == ["de", "en"]
    assert len(langid.sample(df, "text", "lang", 10)) == 11
    with pytest.raises(ValueError, match="labels"):
        langid.sample(df, "text", "lang", 400, max_labels=1)


def test_quality_sample_of_repeated_rows(spark):
    """Many rows of a labelled id are one to learn from: both labels are learned, and one row a key is collected."""
    rows = [(i, f"good words in a row {i} here" if i % 2 else "### 000 $$$ " * 5) for i in range(300) for _ in range(12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] * 3 + [(i, 1) for i in range(1000, 3000)], "doc_id long, quality int")
    model, share = quality.train(docs(spark, rows), labels, per_label=100)
    assert model is not None and 0.9 < share < 1
    judged = {r["text"]: r["score"] for r in quality.score(docs(spark, rows[:24]), model, share).collect()}
    assert judged["good words in a row 1 here"] > judged["### 000 $$$ " * 5]


def test_long_items_come_in_pieces(spark):
    """A benchmark item of more words than a block is cut into overlapping pieces; every window of it is still found, once for its id."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(300)}" for _ in range(500)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short item here"), (3, None)], "item_id long, text string")
    rows = [(i, " ".join(["x"] + words[a : a + n] + ["y"])) for i, (a, n) in enumerate([(0, 10), (37, 10), (38, 9), (490, 10), (100, 60), (0, 500), (31, 12)])] + [(50, "short item here")]
    whole = by_id(decontaminate.find(docs(spark, rows), items))
    cut = by_id(decontaminate.find(docs(spark, rows), items, block_words=40))
    assert {i: r.asDict() for i, r in whole.items()} == {i: r.asDict() for i, r in cut.items()}
    assert whole[5]["n_hit"] == 500 and whole[2]["n_hit"] == 0 and cut[4]["items"] == ["1"]
