"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and cut into overlapping chunks of two ``STRIDE`` bytes over the whole text; learned filters read every
chunk, each filter's largest value over all chunks is kept, and a logistic layer makes one probability of these. The last dimension of
the embedding isn't learned: it says whether the eight bytes from here on stand just before, too, as in words said again and again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm.folds import bounded_sample, fold
from engrava.llm.workers import tidied

STRIDE, EMBED, FILTERS = 8, 8, 32
#: Furthest back that a repetition is looked for; texts lie further apart than this reaches.
LAG = 22
#: Bounds of the fit: texts for each label; passes over them; texts in a step; step size.
PER_LABEL, EPOCHS, STEP, RATE = 1200, 14, 16, 4e-3
#: Bytes embedded at once.
_PIECE = 1 << 17
THRESHOLD = 0.3


def _pieces(texts: list) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Some texts' numbers, first chunks and bytes at a time: padded with zeros to whole strides and two strides more. A text of over
    ``_PIECE`` bytes comes in parts that share a stride."""
    owner, starts, parts, at = [], [], [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        for lo in range(0, max(1, len(raw)), _PIECE):
            part = raw[lo : lo + _PIECE + STRIDE]
            pad = -len(part) % STRIDE + 2 * STRIDE
            owner.append(k)
            starts.append(at // STRIDE)
            parts.append(part + bytes(pad))
            at += len(parts[-1])
            if at >= _PIECE:
                yield owner, np.array(starts), np.frombuffer(b"".join(parts), np.uint8)
                owner, starts, parts, at = [], [], [], 0
    if owner:
        yield owner, np.array(starts), np.frombuffer(b"".join(parts), np.uint8)


def _repeats(raw: np.ndarray) -> np.ndarray:
    """Where eight bytes, none of them padding, equal those up to ``LAG`` before them."""
    found, solid = np.zeros(len(raw), bool), raw != 0
    for lag in range(2, min(LAG, len(raw) - 8) + 1):
        same = raw[lag:] == raw[:-lag]
        same &= solid[lag:]
        for n in (1, 2, 4):
            same[: len(same) - n] &= same[n:]
            same[len(same) - n :] = False
        found[lag:] |= same
    return found


class ByteNetwork:
    """Embedding (256 x EMBED), filters (two halves of a chunk), and the logistic layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.w = rng.normal(0, 0.15, (STRIDE * EMBED, 2 * FILTERS)).astype(np.float32)  # left halves, then right halves
        self.b = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def _chunks(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Repetitions by stride, and each chunk's value of each filter; the chunk that would join two texts counts as nothing."""
        x = self.embed[raw]
        x[:, -1] = again = _repeats(raw)
        both = x.reshape(-1, STRIDE * EMBED) @ self.w
        h = both[:, :FILTERS]
        h[:-1] += both[1:, FILTERS:]
        h += self.b
        h[np.append(starts[1:], len(h)) - 1] = -np.inf
        return again.reshape(-1, STRIDE), h

    def pooled(self, texts: list) -> np.ndarray:
        top = np.full((len(texts), FILTERS), -np.inf, np.float32)
        for owner, starts, raw in _pieces(texts):
            _, h = self._chunks(raw, starts)
            np.maximum.at(top, owner, np.maximum.reduceat(h, starts, axis=0))
        return np.maximum(top, 0)

    def score(self, texts: list) -> np.ndarray:
        """Probability of label 1 of each whole text; null counts as empty."""
        z = self.pooled(texts).astype(np.float64) @ self.out + self.bias[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, texts: list, labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> "ByteNetwork":
        """Logistic loss, Adam; a filter learns from the one chunk that it keeps of each text."""
        rng, y = np.random.default_rng(seed), np.array(labels, np.float32)
        params = [self.embed, self.w, self.b, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), STEP):
                part = order[lo : lo + STEP]
                grads = self._grads([texts[k] for k in part], y[part])
                t += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
                self.embed[0] = 0
        return self

    def _grads(self, texts: list, y: np.ndarray) -> list[np.ndarray]:
        top = np.full((len(texts), FILTERS), -np.inf, np.float32)
        halves, again = np.zeros((2, len(texts), FILTERS, STRIDE), np.uint8), np.zeros((2, len(texts), FILTERS, STRIDE), bool)  # of the kept chunks
        for owner, starts, raw in _pieces(texts):
            repeats, h = self._chunks(raw, starts)
            strides = raw.reshape(-1, STRIDE)
            for k, lo, hi in zip(owner, starts, [*starts[1:], len(h)]):
                at = h[lo:hi].argmax(0) + lo
                value = h[at, np.arange(FILTERS)]
                better = value > top[k]
                top[k][better] = value[better]
                for side in (0, 1):
                    halves[side, k, better], again[side, k, better] = strides[at[better] + side], repeats[at[better] + side]
        act = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-(act @ self.out + self.bias[0])))
        d = (p - y) / len(y)
        g_act = d[:, None] * self.out * (top > 0)
        g_embed, g_w = np.zeros_like(self.embed), np.zeros_like(self.w)
        for side, taken in enumerate(halves):
            x = self.embed[taken]
            x[..., -1] = again[side]
            x = x.reshape(len(y), FILTERS, -1)
            cols = slice(side * FILTERS, (side + 1) * FILTERS)
            g_w[:, cols] = np.einsum("kf,kfi->if", g_act, x)
            g_x = g_act[:, :, None] * self.w[:, cols].T[None]
            np.add.at(g_embed, taken.reshape(-1), g_x.reshape(-1, EMBED))
        return [g_embed, g_w + 1e-4 * self.w, g_act.sum(0), act.T @ d, np.array([d.sum()], np.float32)]


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> ByteNetwork | None:
    """Fit on at most ``per_label`` texts of each label, of documents outside the held-out fold; None if there are none.

    Null labels and doc_ids teach nothing; of several labels of a document the lowest counts, of several rows of a doc_id the least text. The sample is even in its
    labels; the bias is then moved to the labels' true odds, so that scores are probabilities. The driver gets the sample's texts only, ``SAMPLE_BYTES`` at most.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(fold("doc_id", 5) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    odds = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(known, "quality", "doc_id", per_label)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most per_label of each label
    rows = bounded_sample(texts, "quality", "doc_id", per_label, "text").select("doc_id", "text", "quality").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    model = ByteNetwork().fit([r.text for r in rows], [r.quality for r in rows])
    ones = sum(r.quality for r in rows)
    if 0 < ones < len(rows):
        model.bias += np.float32(np.log(odds[1] / odds[0]) - np.log(ones / (len(rows) - ones)))
    return model


def predict_quality(model: ByteNetwork | None, text: Column) -> Column:
    """Score of a text column, 0 to 1; without a model 0.5."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in tidied(batches):
            yield pd.Series(model.score(texts.tolist()) if model else np.full(len(texts), 0.5))

    return score(text)


def op2_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query, one row per row. A null doc_id counts as not held out; null and empty texts are scored alike; repeated rows get one score each; an
    empty table gives no rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, predict_quality(fit_quality(docs, labels), F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
