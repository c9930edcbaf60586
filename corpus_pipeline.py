"""A training corpus from raw documents: quality, exact and near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as a table in the shared folder
and reads them again, so a lost executor never costs more than one stage. A stage's result reads tables
that the stage has written; it has to be written itself before the next stage is called, which deletes
those of them that its own ``docs`` don't read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from trackloom.llm.common import discard_made, materialise, recorded
from trackloom.llm.queries import read, remainder

#: Folders of the tables that stages have written and that are still there, by application.
_LEFT: dict[str, list[str]] = {}


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the tables of stages before it, but for those that its documents are read from."""

    @wraps(work)
    def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        discard_made(spark, left, docs)
        with recorded() as made:
            done = work(spark, docs, sf_dir)
            discard_made(spark, made, done)
        left += made
        return done

    return clean


def held(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): each document whole beside what the operators look at, so that no column of it can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels of these documents, doesn't reject.

    Null and empty texts are judged as the empty text, long ones by all their passages; equal texts are
    judged alike, so repeated rows stay or go together; without labels of both kinds all stay. Rows come
    back as they were, whatever other columns they have; an empty table gives an empty one.
    """
    model, share = quality.train(docs, read(spark, sf_dir, "labels").where(remainder(5) != 0))
    return quality.score(held(docs), model, share).where("predicted = 1").select("row.*")


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the one with the smallest doc_id.

    Null and empty texts are copies of each other; a null doc_id stays only in a group of such; of rows
    with the same doc_id and text one stays. Texts of any length are compared whole. Rows come back as
    they were, whatever other columns they have; an empty table gives an empty one.
    """
    return exact_dedup.dedup(held(docs)).where("kept").select("row.*")


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word runs: the one with the smallest doc_id.

    Texts without words form one group; texts of fewer than five words are one run; a null doc_id stays
    only in a group of such; of rows with the same doc_id and text one stays. Rows come back as they
    were, whatever other columns they have; an empty table gives an empty one.
    """
    return jaccard_join.dedup(held(docs)).select("row.*")


@stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages they share with the benchmark; texts of which such passages are more than half go.

    ``n_chars``, where there is one, follows the text. Null and empty texts have no passages and stay as
    they are, as do all documents without one; repeated rows are judged each; texts of any length are
    read whole. All other columns come back as they were; an empty table gives an empty one.
    """
    cleaned = decontaminate.clean(held(docs), read(spark, sf_dir, "benchmark"), max_coverage=0.5)
    changed = ~F.col("text").eqNullSafe(F.col("row.text"))
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return cleaned.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): the ids of each text, and whether they decode to its very bytes.

    Null and empty texts have no ids; every row is encoded, repeated ones each, and texts of any length
    as the library would encode them whole; other columns are left out; an empty table gives an empty one.
    """
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    exact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("tokenise", tokenise),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, the only table that is left."""
    docs = read(spark, sf_dir, "documents")
    left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
    for name, work in STAGES:
        with recorded() as made:
            done = materialise(work(spark, docs, sf_dir), f"stage-{name}")
        left += [x for x in made if x not in left]
        discard_made(spark, left, done)
        docs = done
    left.clear()  # the result is the caller's
    return docs
