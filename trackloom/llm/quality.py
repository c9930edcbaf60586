"""Quality classification by attention-based multiple-instance learning.

A text is a bag of passages (runs of ``PASSAGE_BYTES`` bytes, so the whole text is covered). Every
passage is encoded from its byte profile and its word statistics; gated attention weights, learned
from the labels of whole documents only, say how much each passage counts; the weighted passage
representation is scored by a logistic layer. The parameters are fitted in numpy on a bounded
sample (``per_label`` documents of each label; of a text longer than ``FIT_PIECES`` passages so many
passages, evenly spaced over all of it) with the labels balanced, and the bias is then moved to the
label shares of all labelled rows.

Scoring is row-local over every whole text; a model of fixed size is broadcast; nothing is shuffled.
Scores are computed in double precision and rounded to ``DIGITS`` places, so that a text's score does
not depend on the texts it shares a batch with.

Defined results: a null text counts as empty; an empty text is a bag of one empty passage and gets
the model's score for it; without any labelled row of one of the two labels the score is the share
of label 1 (1 if there are none at all); result columns replace input columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import evenly, find_words, pack, text_or_empty, text_slices, unpack, word_hashes, word_table

PASSAGE_BYTES = 1024
PER_LABEL = 1200
#: Passages of a text that are learned from at most.
FIT_PIECES = 64
#: Places of a score; matrix products of other shapes differ far behind them.
DIGITS = 6
HIDDEN, GATE = 24, 12

_WORDS = word_table("space")


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature row for each passage, and the first passage of each text (one more entry than texts)."""
    size = np.diff(off)
    count = np.maximum(-(-size // PASSAGE_BYTES), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(size)), size)
    where = (first[:-1][doc] + (np.arange(len(raw)) - off[:-1][doc]) // PASSAGE_BYTES) if len(raw) else np.zeros(0, np.int64)
    profile = np.bincount(where * 256 + raw, minlength=total * 256).reshape(total, 256).astype(np.float32)
    n = np.maximum(profile.sum(1, keepdims=True), 1)
    starts, ends, firsts = find_words(raw, off, _WORDS)
    h = word_hashes(raw, starts, ends)
    again = np.zeros(len(h), np.float32)
    if len(h) > 1:
        again[1:] = h[1:] == h[:-1]
        again[firsts[:-1][firsts[:-1] < len(h)]] = 0
    at = where[starts] if len(starts) else np.zeros(0, np.int64)
    words = np.maximum(np.bincount(at, minlength=total), 1)
    extra = np.stack(
        [
            np.bincount(at, again, minlength=total) / words,
            np.bincount(at, np.minimum(ends - starts, 30), minlength=total) / words / 10,
            np.bincount(at, ends - starts == 1, minlength=total) / words,
            np.log1p(n[:, 0]) / 7,
        ],
        1,
    )
    return np.hstack([np.sqrt(profile / n), extra.astype(np.float32)]), first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def in_double(self) -> Model:
        return Model(self.mean.astype(np.float64), self.scale.astype(np.float64), {k: v.astype(np.float64) for k, v in self.w.items()})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, s = self.w, first[:-1]
        bag = np.repeat(np.arange(len(s)), np.diff(first))
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(x @ w["A"] + w["a"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (v * u) @ w["g"]
        e = np.exp(e - np.maximum.reduceat(e, s)[bag])
        att = e / np.add.reduceat(e, s)[bag]
        z = np.add.reduceat(att[:, None] * h, s, axis=0)
        logit = z @ w["c"] + w["d"]
        return {"x": x, "h": h, "v": v, "u": u, "att": att, "z": z, "bag": bag, "logit": logit, "p": 1 / (1 + np.exp(-np.clip(logit, -60, 60)))}


def gradients(model: Model, f: dict[str, np.ndarray], y: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy with respect to all parameters."""
    w, bag, h, v, u, att = model.w, f["bag"], f["h"], f["v"], f["u"], f["att"]
    d = ((f["p"] - y) / len(y)).astype(np.float32)
    dz = d[:, None] * w["c"]
    datt = (dz[bag] * h).sum(1)
    de = att * (datt - np.add.reduceat(att * datt, first[:-1])[bag])
    dv, du = de[:, None] * w["g"] * u * (1 - v * v), de[:, None] * w["g"] * v * u * (1 - u)
    dh = (att[:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
    return {"A": f["x"].T @ dh, "a": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "g": (v * u).T @ de, "c": f["z"].T @ d, "d": d.sum(keepdims=True)}


def fit(rows: list[tuple[str, int]], share: float, epochs: int = 25, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Model | None:
    """The model of a bounded sample of (text, label); ``share`` is label 1's share among all labelled rows."""
    data = [(t or "").encode() for t, _ in rows]
    y = np.array([l for _, l in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    parts = []
    for lo in range(0, len(data), 256):
        off = np.cumsum([0, *map(len, data[lo : lo + 256])])
        x, first = passages(np.frombuffer(b"".join(data[lo : lo + 256]), np.uint8), off)
        parts += [x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    every = np.concatenate(parts)
    model = Model(every.mean(0), every.std(0) + 0.02, {})
    size = every.shape[1]
    for name, shape in (("A", (size, HIDDEN)), ("a", (HIDDEN,)), ("V", (HIDDEN, GATE)), ("U", (HIDDEN, GATE)), ("g", (GATE,)), ("c", (HIDDEN,)), ("d", (1,))):
        model.w[name] = (rng.normal(0, shape[0] ** -0.5, shape) if len(shape) > 1 or name in "gc" else np.zeros(shape)).astype(np.float32)
    first_moment = {k: np.zeros_like(v) for k, v in model.w.items()}
    second_moment = {k: np.zeros_like(v) for k, v in model.w.items()}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    for epoch in range(epochs):
        order = rng.choice(len(y), len(y), p=weight / weight.sum())  # balanced
        for at in range(0, len(order), batch):
            picked = order[at : at + batch].tolist()
            first = np.cumsum([0, *[len(parts[i]) for i in picked]])
            f = model.forward(np.concatenate([parts[i] for i in picked]), first)
            step += 1
            for k, g in gradients(model, f, y[picked], first).items():
                g = g + 1e-4 * model.w[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                move = (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
                model.w[k] = (model.w[k] - rate * (1 - epoch / epochs) * move).astype(np.float32)
    share = min(max(share, 1e-3), 1 - 1e-3)
    model.w["d"] = model.w["d"] + np.float32(np.log(share / (1 - share)))
    return model


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_label: int = PER_LABEL) -> tuple[Model | None, float]:
    """The model of ``labels`` (key, label 0 or 1) over the texts of ``df``, and label 1's share of the labels.

    Labels with a text are sampled first, by a hash of the key, so that only their keys (at most twice
    ``per_label`` short rows) are broadcast to the texts. Repeated labels count once; of several texts of
    a key the one with the smallest hash is learned.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("l")).where("k is not null and l in (0, 1)").distinct()
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    texts = df.select(F.col(f"`{key}`").alias("k"), text_or_empty(text).alias("t"))
    held = known.join(texts.select("k"), "k", "left_semi")  # a label without a text takes no place of the sample
    picked = [held.where(F.col("l") == c).orderBy(F.xxhash64("k"), "k").limit(per_label) for c in (0, 1)]
    found = texts.join(F.broadcast(picked[0].unionAll(picked[1])), "k")
    one = F.min(F.struct(F.xxhash64("t").alias("h"), evenly(F.col("t"), FIT_PIECES, PASSAGE_BYTES).alias("t"))).alias("one")
    rows = found.groupBy("k", "l").agg(one).select("k", "l", "one.t").orderBy("k", "l").collect()  # a row for a key and label
    return fit([(r["t"], r["l"]) for r in rows], share), share


def score(df: DataFrame, model: Model | None, share: float, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with ``score`` (that label 1 holds) and ``predicted``."""
    if model is None:
        judged = F.lit(float(share))
    else:
        sent = df.sparkSession.sparkContext.broadcast(model.in_double())

        @F.arrow_udf("double")
        def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held = sent.value
            for batch in batches:
                found = []
                for _, _, raw, off in text_slices(batch):
                    x, first = passages(raw, off)
                    found.append(held.forward(x.astype(np.float64), first)["p"].round(DIGITS))
                yield pa.array(np.concatenate([np.zeros(0), *found]))

        judged = judge(text_or_empty(text))
    scored = pack(df, score=judged)
    return unpack(scored, df.columns, score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"))
