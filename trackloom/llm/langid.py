"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte 3- and 4-grams of lower-cased words with a blank at each word's edges, hashed
into ``BUCKETS`` rows of an embedding table. A text is the average of its subwords' embeddings; a
linear softmax on it gives the languages. The table and the softmax are trained by mini-batch
stochastic gradient descent in numpy on a bounded sample: ``per_label`` different texts a language, fewer
where there are more than ``TOTAL`` / ``per_label`` languages; of a text longer than ``FIT_PIECES`` pieces of
``PIECE_CHARS`` characters so many pieces, evenly spaced over all of it, so long texts are learned from
and what the driver holds is bounded. The texts are cut into segments of ``SEGMENT_BYTES``, of which
``MAX_SEGMENTS`` in all are learned, so that short texts are learned too. A fifth of the sampled texts,
with all their copies, is kept back whole (as sampled) to fit a temperature and, from it, the score
below which a prediction should not be relied on (``accepted`` is false): rejection is calibrated on
texts as they are judged, not guessed.

As the model is linear after the embedding, a text's logits are the average over its subwords of
``table @ weights``; that product (BUCKETS x languages floats, a size set by the model and not by
the data) is what is broadcast. Prediction is row-local over every whole text: no shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a text with letters
always gets a learned language; without any training row every text is ``und``;
repeated rows are learned once and predicted each; an empty table gives an empty result; of equal scores the
language first in alphabetical order wins; result columns replace input columns of their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import evenly, pack, text_or_empty, text_slices, unpack

BUCKETS = 1 << 15
DIM = 16
PER_LABEL = 400
TOTAL = 4000
MAX_LABELS = 1000
FIT_PIECES, PIECE_CHARS = 32, 512
SEGMENT_BYTES = 256
MAX_SEGMENTS = 4000
TARGET_PRECISION = 0.995

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


def subwords(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all texts, text by text within each length, and the text of each."""
    k = len(off) - 1
    folded = np.append(np.insert(_FOLD[raw], off[:-1], 32), np.uint8(32))
    text = np.append(np.repeat(np.arange(k, dtype=np.int32), np.diff(off) + 1), np.int32(k))
    b = folded.astype(np.uint32)
    blank = folded == 32
    three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16)) if len(b) > 2 else np.zeros(0, np.uint32)
    keep3 = ~blank[1:-1] if len(b) > 2 else np.zeros(0, bool)
    four = three[:-1] | (b[3:] << np.uint32(24)) if len(b) > 3 else np.zeros(0, np.uint32)
    keep4 = (keep3[:-1] & keep3[1:]) if len(b) > 3 else np.zeros(0, bool)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    h3 = (three[keep3] * np.uint32(0x9E3779B1)) >> shift
    h4 = ((four[keep4] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA77)) >> shift
    # The middle of a subword tells its text: its first byte may be the blank that ends the text before.
    return np.concatenate([h3, h4]), np.concatenate([text[1 : 1 + len(keep3)][keep3], text[1 : 1 + len(keep4)][keep4]])


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        k = len(off) - 1
        bucket, text = subwords(raw, off)
        n = np.maximum(np.bincount(text, minlength=k)[:k], 1)
        logits = np.stack([np.bincount(text, self.table[:, c][bucket], minlength=k)[:k] for c in range(len(self.labels))], 1) / n[:, None] + self.bias
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(df: DataFrame, text: str, label: str, per_label: int, max_labels: int = MAX_LABELS) -> list[tuple[str, str]]:
    """At most ``per_label`` different texts of each label, and ``TOTAL`` in all, chosen by a hash of the text; copies count once.

    More than ``max_labels`` labels are an error: such a column doesn't name languages.
    """
    words = F.col(f"`{text}`").cast("string")
    rows = df.select(words.alias("t"), F.col(f"`{label}`").cast("string").alias("l"), F.xxhash64(words).alias("rank"), F.hash(words).alias("more")).where("l is not null and t <> ''")
    names = rows.select("l").distinct().limit(max_labels + 1).count()
    if names > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not names:
        return []
    first = Window.partitionBy("l").orderBy("rank", "more")
    known = rows.select("l", "rank", "more").distinct().withColumn("place", F.row_number().over(first))
    known = known.where(F.col("place") <= min(per_label, max(1, TOTAL // names))).drop("place")  # TOTAL short rows at most
    picked = rows.join(F.broadcast(known), ["l", "rank", "more"]).groupBy("l", "rank", "more").agg(F.first(evenly(F.col("t"), FIT_PIECES, PIECE_CHARS)).alias("t"))
    return [(r["t"], r["l"]) for r in picked.orderBy("rank", "more", "l").collect()]


def fit(rows: list[tuple[str, str]], epochs: int = 3, batch: int = 64, rate: float = 6.0, seed: int = 7) -> Model | None:
    """The model of a bounded sample of (text, label)."""
    rows = [(t, l) for t, l in rows if t and _LETTER.search(t)]
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    labels = sorted({l for _, l in rows})
    index = {l: i for i, l in enumerate(labels)}
    kept_back = np.array([zlib.crc32(t.encode()) % 5 == 0 for t, _ in rows])  # copies stay on one side
    lang = np.array([index[l] for _, l in rows])
    kept_back &= np.isin(lang, lang[~kept_back])  # a language is learned even if all its few texts would be kept back
    parts: list[tuple[bytes, int]] = []
    for (text, label), back in zip(rows, kept_back.tolist(), strict=True):
        data = text.encode()
        if not back:
            parts += [(data[a : a + SEGMENT_BYTES], index[label]) for a in range(0, len(data), SEGMENT_BYTES)]
    per = {c: [i for i, p in enumerate(parts) if p[1] == c] for c in range(len(labels))}
    chosen = np.concatenate([rng.permutation(np.array(v, np.int64))[: MAX_SEGMENTS // max(1, min(len(labels), 8))] for v in per.values()])
    train = [parts[i] for i in chosen.tolist()]
    whole = [(t.encode(), index[l]) for t, l in rows]
    check = [w for w, back in zip(whole, kept_back.tolist(), strict=True) if back] or whole

    def laid(items):
        off = np.cumsum([0, *[len(p[0]) for p in items]])
        return np.frombuffer(b"".join(p[0] for p in items), np.uint8), off, np.array([p[1] for p in items])

    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIM, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)
    steps, done = epochs * -(-len(train) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(train))
        for at in range(0, len(order), batch):
            raw, off, y = laid([train[i] for i in order[at : at + batch].tolist()])
            bucket, text = subwords(raw, off)
            k, lr = len(y), rate * (1 - done / steps)
            n = np.maximum(np.bincount(text, minlength=k)[:k], 1).astype(np.float32)
            cell, count = np.unique(text.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            doc, row = cell // BUCKETS, cell % BUCKETS
            share = (count / n[doc]).astype(np.float32)
            hidden = np.zeros((k, DIM), np.float32)
            vectors = embed[row] * share[:, None]
            present = np.flatnonzero(np.diff(np.r_[-1, doc]))
            hidden[doc[present]] = np.add.reduceat(vectors, present, axis=0)
            p = softmax(hidden @ weight + bias)
            p[np.arange(k), y] -= 1
            back = (p @ weight.T).astype(np.float32)
            weight -= (lr / k) * (hidden.T @ p)
            bias -= (lr / k) * p.sum(0)
            order_r = np.argsort(row, kind="stable")
            sorted_rows = row[order_r]
            starts = np.flatnonzero(np.diff(np.r_[-1, sorted_rows]))
            embed[sorted_rows[starts]] -= (lr * 8) * np.add.reduceat((back[doc] * share[:, None])[order_r], starts, axis=0)
            done += 1
    model = Model(labels, (embed @ weight).astype(np.float32), bias, 1.0, 0.0)
    y = np.array([c for _, c in check])
    logits = np.log(np.maximum(np.concatenate([model.probabilities(*laid(check[at : at + batch])[:2]) for at in range(0, len(check), batch)]), 1e-30))
    temperatures = np.geomspace(0.05, 5, 40)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-30)).mean() for t in temperatures]
    model.temperature = float(temperatures[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    top, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-top)
    precision = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precision >= TARGET_PRECISION)
    model.threshold = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (calibrated, 0 to 1) and ``accepted``."""
    if model is None:
        return unpack(pack(df), df.columns, lang_pred=F.lit("und"), score=F.lit(0.0), accepted=F.lit(False))
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = sent.value
        for batch in batches:
            names, scores = [], []
            for lo, hi, raw, off in text_slices(batch):
                p = held.probabilities(raw, off)
                best = p.argmax(1)
                for i, t in enumerate(batch.slice(lo, hi - lo).to_pylist()):
                    lettered = bool(t and _LETTER.search(t))
                    names.append(held.labels[best[i]] if lettered else "und")
                    scores.append(float(p[i, best[i]]) if lettered else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    found = pack(df, __found=identify(text_or_empty(text)))
    return unpack(found, df.columns, lang_pred=F.col("__found.lang_pred"), score=F.col("__found.score"), accepted=F.col("__found.score") >= model.threshold)
