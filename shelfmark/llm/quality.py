"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words.  Every passage of the whole text
is encoded (character classes, repetition, hashed byte pairs); a hidden layer and gated
attention weigh the passages, and the weighted sum is scored.  Only documents have labels:
the attention learns which passages decide.

Learned on the driver from a bounded sample of labelled documents (`max_documents`, of
each at most `max_passages` passages, evenly spread); scoring reads every passage of every
document in one scan without a shuffle.

Null and empty texts are one passage of zeros.  Conflicting labels of a document count as
the lower one.  Without labels of both kinds every score is the share of label 1, 0.5 if
there are none.  Repeated rows are scored alike; a null id is never held out nor learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.workers import busy, idle, tidy

PASSAGE_WORDS = 64
_BUCKETS = 128
_CLASSES = 8
_STATS = 6
DIMENSIONS = _CLASSES + _STATS + _BUCKETS
# Characters encoded at once.
_BATCH = 300_000


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.int64)
    table[:128] = 5
    table[[9, 11, 12, 13, 32]] = 0
    table[10] = 7
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[[ord(c) for c in ".,;:'\"?!()-"]] = 4
    return table


_TABLE = _class_table()
_WEIGHTS = np.random.default_rng(5).integers(1, 1 << 31, 64, dtype=np.int64)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    begins = ends - [len(r) + 1 for r in raw]
    kind = _TABLE[data]
    space = (kind == 0) | (kind == 7)
    starts = ~space
    starts[1:] &= space[:-1]
    first = np.flatnonzero(starts)
    upto = np.concatenate(([0], np.cumsum(starts)))
    n_words = upto[ends] - upto[begins]
    passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    offset = np.cumsum(passages) - passages
    doc_of_word = np.repeat(np.arange(len(raw)), n_words)
    of_word = offset[doc_of_word] + (np.arange(len(first)) - upto[begins][doc_of_word]) // PASSAGE_WORDS
    # Bytes before a text's first word, and texts without words, belong to its first passage.
    passage = np.repeat(offset, np.diff(np.concatenate(([0], ends))))
    if len(first):
        word_at = upto[1:] - 1
        inside = word_at >= np.repeat(upto[begins], np.diff(np.concatenate(([0], ends))))
        passage = np.where(inside, of_word[np.maximum(word_at, 0)], passage)
    total = int(passages.sum())
    classes = np.bincount(passage * _CLASSES + kind, minlength=total * _CLASSES).reshape(total, _CLASSES).astype(np.float32)
    pair = (data[:-1].astype(np.uint32) * 2654435 + data[1:].astype(np.uint32) * 40503) * np.uint32(2246822519)
    own = np.delete(np.arange(len(data) - 1), ends[:-1] - 1)  # no pair reaches into the next text
    pairs = np.bincount(passage[own] * _BUCKETS + (pair[own] >> np.uint32(25)), minlength=total * _BUCKETS).reshape(total, _BUCKETS).astype(np.float32)
    out = np.zeros((total, DIMENSIONS), np.float32)
    size = np.maximum(classes.sum(1), 1)
    out[:, :_CLASSES] = classes / size[:, None]
    share = pairs / np.maximum(pairs.sum(1), 1)[:, None]
    words = np.maximum(np.bincount(of_word, minlength=total), 1) if len(first) else np.ones(total)
    out[:, _CLASSES] = (share**2).sum(1) * 10
    if len(first):
        place = np.arange(len(data)) - first[np.maximum(upto[1:] - 1, 0)]
        code = np.add.reduceat(np.where(space, 0, (data.astype(np.int64) + 1) * _WEIGHTS[place & 63]), first)
        same = np.zeros(len(first))
        same[1:] = (code[1:] == code[:-1]) & (of_word[1:] == of_word[:-1])
        out[:, _CLASSES + 1] = np.bincount(of_word, same, minlength=total) / words
        order = np.lexsort((code, of_word))
        fresh = np.ones(len(first))
        fresh[1:] = (code[order][1:] != code[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
        out[:, _CLASSES + 2] = np.bincount(of_word[order], fresh, minlength=total) / words
        out[:, _CLASSES + 3] = np.bincount(of_word, kind[first] == 2, minlength=total) / words
        out[:, _CLASSES + 4] = (size - classes[:, 0] - classes[:, 7]) / words / 10
        out[:, _CLASSES + 5] = np.log1p(np.bincount(of_word, minlength=total)) / 4
    out[:, _CLASSES + _STATS :] = np.sqrt(share)
    return out, offset


class Model:
    """Hidden layer, gated attention, weighted sum, logit."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, hidden: int, gate: int, seed: int):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.std = mean, std
        self.p = {
            "W": init(len(mean), hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate),
            "w": init(gate, 1)[:, 0], "c": init(hidden, 1)[:, 0], "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        x = (x - self.mean) / self.std
        sizes = np.diff(np.append(firsts, len(x)))
        bag = np.repeat(np.arange(len(firsts)), sizes)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, firsts)[bag])
        a = e / np.add.reduceat(e, firsts)[bag]
        z = np.add.reduceat(a[:, None] * h, firsts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, {"x": x, "bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z}

    def gradients(self, y: np.ndarray, label: np.ndarray, k: dict, firsts: np.ndarray) -> dict:
        p, bag, h, t, s, a = self.p, k["bag"], k["h"], k["t"], k["s"], k["a"]
        dl = (y - label) / len(y)
        dz = dl[:, None] * p["c"]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, firsts)[bag])
        dg = de[:, None] * p["w"]
        dv, du = dg * s * (1 - t**2), dg * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h**2)
        return {
            "W": k["x"].T @ dx, "b": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (t * s).T @ de,
            "c": k["z"].T @ dl, "d": np.array([dl.sum()]),
        }

    def score(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return self.forward(x, firsts)[0]


class Constant:
    """Where there is nothing to tell apart."""

    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return np.full(len(firsts), self.share)


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 25, seed: int = 3) -> Model | Constant:
    if len(set(labels.tolist())) < 2:
        return Constant(float(labels.mean()) if len(labels) else 0.5)
    every = np.concatenate(bags)
    model = Model(every.mean(0), every.std(0) + 1e-3, hidden, gate, seed)
    rng, step = np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for begin in range(0, len(order), 64):
            own = order[begin : begin + 64]
            x = np.concatenate([bags[i] for i in own])
            firsts = np.cumsum([0] + [len(bags[i]) for i in own[:-1]])
            y, kept = model.forward(x, firsts)
            step += 1
            for name, g in model.gradients(y, labels[own], kept, firsts).items():
                if name not in ("b", "d"):
                    g = g + 1e-4 * model.p[name]
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                model.p[name] = model.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bags(max_passages: int):
    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for text, label in zip(frame["text"], frame["_label"], strict=True):
                x, _ = encode([text])
                if len(x) > max_passages:
                    x = x[np.linspace(0, len(x) - 1, max_passages).astype(int)]
                rows.append((x.astype("<f4").tobytes(), float(label)))
            yield pd.DataFrame(rows, columns=["bag", "label"])

    return bags


def learn(docs: DataFrame, labels: DataFrame, max_documents: int = 4000, max_passages: int = 48) -> Model | Constant:
    """A model from labelled documents that are not held out; `labels`: (doc_id, quality)."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    )
    # Bounded by max_documents; a document's copies under one id count once.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    rows = sorted((bytes(r[0]), r[1]) for r in texts.mapInPandas(tidy(_bags(max_passages)), "bag binary, label double").collect())
    return fit([np.frombuffer(b, "<f4").reshape(-1, DIMENSIONS).astype(float) for b, _ in rows], np.array([y for _, y in rows]))


def score_of(text: Column, model: Model | Constant) -> Column:
    """The score of a text column; other columns of the table stay on Spark's side."""
    @F.pandas_udf("double")
    def scores(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        busy()
        for part in series:
            texts, out, begin, size = part.tolist(), [], 0, 0
            for k, text in enumerate(texts):
                size += len(text or "")
                if size >= _BATCH or k == len(texts) - 1:
                    out.append(model.score(*encode(texts[begin : k + 1])))
                    begin, size = k + 1, 0
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
        idle()

    return scores(text)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", score_of(F.col("text"), learn(docs, labels, **options)).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier accepts, as they are."""
    return docs.where(score_of(docs["text"], learn(docs, labels, **options)) >= 0.5)
