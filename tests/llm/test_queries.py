"""The thin queries: against DuckDB where SQL can say it, else against brute force or held-out labels."""

import base64
import collections
import hashlib
import math
import re

import pytest
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from tests.llm.brute import components, negatives, shingles, variants
from tests.oracle_tools import connect, same
from trackloom.llm.oracle import ORACLE_SQL
from trackloom.llm.queries import QUERIES, read

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, data, name):
    same(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name])


def test_language_of_held_out_texts(spark):
    found = QUERIES["op1_langid"](spark, SMALL).join(read(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_held_out_texts(spark):
    found = QUERIES["op5_quality"](spark, SMALL)
    assert found.count() == read(spark, SMALL, "documents").count()
    rows = found.where("held_out").join(read(spark, SMALL, "labels").select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(1, len(bad)) < 0.25


def test_tokens_as_the_library_makes_them(spark, data):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in QUERIES["op8_bpe"](spark, data).collect()}
    for r in read(spark, data, "documents").collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert found[r["doc_id"]]["n_tokens"] == len(ids)
        assert found[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_spelling_variants_as_brute_force_finds_them(spark):
    texts = [(r["doc_id"], r["text"]) for r in read(spark, SMALL, "documents").collect()]
    rows = [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, SMALL).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == variants(texts) and any(r[1] for r in rows)


def test_token_counts_as_the_library_makes_them(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, SMALL, "documents").collect()}
    found = {r["doc_id"]: r for r in QUERIES["op12_token_counts"](spark, SMALL).collect()}
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_hard_negatives_as_brute_force_finds_them(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in r["embedding"]]) for r in read(spark, SMALL, "embeddings").collect()]
    found = QUERIES["op13_hard_negatives"](spark, SMALL).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, found.collect())) == negatives(rows, lambda i: i % 50 == 0)


def test_similar_texts_as_brute_force_finds_them(spark):
    texts = {r["doc_id"]: r["text"] for r in read(spark, SMALL, "documents").collect()}
    links, roots = components({i: shingles(t) for i, t in texts.items()}, 0.8)
    found = {r["doc_id"]: r for r in QUERIES["op6_jaccard_join"](spark, SMALL).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == links
    assert {i: r["class_id"] for i, r in found.items()} == roots


def test_licences_run_no_python(spark, data):
    for name in ("op3_license_scan", "op4_chat_format"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages_against_brute_force(spark, data):
    import corpus_pipeline
    from trackloom.llm.decontaminate import words_of

    docs = read(spark, data, "documents")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, data), f"test-{name}")
        kept.append({r["doc_id"]: r.asDict() for r in docs.collect()})
        if name != "tokenise":
            assert docs.columns == read(spark, data, "documents").columns
    quality, exact, near, clean, tokens = kept
    labels = {r["doc_id"]: r["quality"] for r in read(spark, data, "labels").collect()}
    assert all(i in quality for i in held if labels.get(i) == 1)
    first = {}
    for i in sorted(quality):
        first.setdefault(" ".join((quality[i]["text"] or "").split()), i)
    assert sorted(exact) == sorted(first.values())
    _, roots = components({i: shingles(r["text"]) for i, r in exact.items()}, 0.8)
    assert sorted(near) == sorted(set(roots.values()))
    windows = set()
    for r in read(spark, data, "benchmark").collect():
        w = words_of(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    leaks = 0
    for i, r in near.items():
        w = words_of(r["text"])
        hit = {p for size in {len(x) for x in windows} for s in range(len(w) - size + 1) if tuple(w[s : s + size]) in windows for p in range(s, s + size)}
        leaks += bool(hit)
        if len(hit) > 0.5 * len(w):
            assert i not in clean
        elif hit:
            assert words_of(clean[i]["text"]) == [x for p, x in enumerate(w) if p not in hit] and clean[i]["n_chars"] == len(clean[i]["text"])
        else:
            assert clean[i] == r
    assert leaks
    assert sorted(tokens) == sorted(clean) and all(r["exact"] for r in tokens.values())


def test_registered(spark):
    import __spark_entry__ as entry

    names = collections.Counter(n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n))
    assert names == {f"op{n}": 1 for n in range(1, 14)} and "pipeline" in entry.queries()
    assert F.col("x") is not None


def test_pipeline_leaves_only_its_result(spark, data):
    import pathlib

    import corpus_pipeline
    from trackloom.llm.common import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    rows = corpus_pipeline.run(spark, data)
    left = {p.name for p in folder.iterdir() if p.is_dir()} - before
    assert len(left) == 1 and left.pop().startswith("stage-tokenise") and rows.count() > 0
