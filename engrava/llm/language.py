"""Language identification by string kernels: presence of blended n-grams, Nystroem landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of byte n-grams, of one to ``MAX_N`` bytes, that both hold, over the geometric mean of the numbers that
each holds; n-grams are those found in a landmark, hashed to ``SPACE`` values. A text's kernel values with all landmarks are one product
of a batch's presence matrix with the landmarks', and its scores a second one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm.folds import bounded_sample, fold
from engrava.llm.workers import tidied

MAX_N, SPACE = 3, 1 << 16
#: Bounds of the fit: texts for each language, landmarks for each language. Penalty of the ridge.
PER_LANGUAGE, LANDMARKS, RIDGE = 150, 16, 1e-3
UNKNOWN = "und"
#: Of what texts of a language share with the rest of its sample, the part that a text has to share with it to be like it.
LIKENESS = 2 / 3
#: Bytes of a text taken at once, and texts in a product.
_CHUNK, _BATCH = 1 << 20, 32


def _letter(text: str) -> bool:
    """Whether a character is of Unicode's category L; digits, fractions and circled numbers aren't."""
    return any(map(str.isalpha, text))


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a whole text with ASCII letters lower-cased, repeats included, some at a time."""
    raw = text.encode("utf-8", "replace").lower()
    for at in range(0, len(raw), _CHUNK):
        b = np.frombuffer(raw, np.uint8, min(len(raw), at + _CHUNK + MAX_N - 1) - at, at).astype(np.uint32)
        packed = b
        for n in range(1, MAX_N + 1):
            if n > 1:
                packed = (packed[:-1] << np.uint32(8)) | b[n - 1 :]
            yield ((packed + np.uint32(n * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(16)


def longest_grams(text: str) -> Iterator[np.ndarray]:
    """Those of ``MAX_N`` bytes."""
    return islice(grams(text), MAX_N - 1, None, MAX_N)


class LanguageModel:
    """``languages``, and what scoring needs: the column of each hashed n-gram, the landmarks' presences, and the weights. Besides, the longest n-grams
    ``known`` from each language's sample, and the ``least`` share of them in a text that is like it."""

    def __init__(self, texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(languages))
        y = np.array([self.languages.index(x) for x in languages])
        chosen = [k for name in self.languages for k in self._spread([k for k, x in enumerate(languages) if x == name], texts)[:landmarks]]
        held = np.zeros((len(chosen), SPACE), bool)
        for row, k in zip(held, chosen):
            for ids in grams(texts[k]):
                row[ids] = True
        columns = np.flatnonzero(held.any(0))
        self.column = np.full(SPACE, len(columns), np.int32)  # all others share a last column of weight 0
        self.column[columns] = np.arange(len(columns))
        self.points = np.zeros((len(columns) + 1, len(chosen)), np.float32)
        self.points[:-1] = held[:, columns].T
        del held
        self.points /= np.maximum(np.sqrt(self.points.sum(0)), 1)
        values, vectors = np.linalg.eigh(self.kernel([texts[k] for k in chosen]).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-9)) @ vectors.T
        z = np.concatenate([self.kernel(texts[at : at + _BATCH]) for at in range(0, len(texts), _BATCH)]) @ root
        z = np.hstack([z, np.ones((len(z), 1))])
        target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        w = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ target)
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)
        self._learn_likeness(texts, y)

    @staticmethod
    def _spread(rows: list[int], texts: list[str]) -> list[int]:
        """In an order by hash; of equal texts all but the first come last, so that copies aren't all the landmarks there are."""
        seen: dict[str, int] = {}
        rank = {}
        for k in rows:
            rank[k] = seen[texts[k]] = seen.get(texts[k], -1) + 1
        return sorted(rows, key=lambda k: (rank[k], zlib.crc32(texts[k].encode("utf-8", "replace")), k))

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of each text with each landmark."""
        held = np.zeros((len(texts), self.points.shape[0]), np.float32)
        for row, text in zip(held, texts):
            for ids in grams(text):
                row[self.column[ids]] = 1
        held[:, -1] = 0
        return held @ self.points / np.maximum(np.sqrt(held.sum(1)), 1)[:, None]

    def _learn_likeness(self, texts: list[str], y: np.ndarray) -> None:
        """A text's share is held against the other texts of its language: from one text nothing is learned, and all are like it."""
        seen = np.zeros((len(self.languages), SPACE), np.int32)
        for text, k in zip(texts, y):
            seen[k, np.unique(np.concatenate(list(longest_grams(text))))] += 1
        shares = [[] for _ in self.languages]
        for text, k in zip(texts, y):
            ids = np.concatenate(list(longest_grams(text)))
            if len(ids):
                shares[k].append((seen[k, ids] > 1).mean())
        self.known = seen > 0
        self.least = np.array([LIKENESS * np.median(x) if x else 0.0 for x in shares])

    def alike(self, texts: list) -> list[bool]:
        """Whether each text is like the language predicted for it; not if that is ``und``. A few n-grams tell less than many, so the share may fall
        short by one over the root of their number."""
        found = []
        for text, name in zip(texts, self.predict(texts)[0]):
            if name == UNKNOWN:
                found.append(False)
                continue
            k, n, held = self.languages.index(name), 0, 0
            for ids in longest_grams(text):
                n, held = n + len(ids), held + int(self.known[k, ids].sum())
            found.append(bool(held >= self.least[k] * n - np.sqrt(n)))
        return found

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Of each text the language and its score, 0 to 1; ``und`` and 0 for null and for texts without a letter."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if t is not None and _letter(t)]
        for at in range(0, len(known), _BATCH):
            part = known[at : at + _BATCH]
            value = self.kernel([texts[k] for k in part]) @ self.weights + self.bias
            best = value.argmax(1)
            for k, b, v in zip(part, best, value[np.arange(len(part)), best]):
                names[k], scores[k] = self.languages[b], min(1.0, max(0.0, (1 + float(v)) / 2))
        return names, scores


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit on at most ``per_language`` texts of each language, of documents outside the held-out fold; None if there are none.

    Rows with a null doc_id, lang or text, or without a letter, teach nothing; of several rows of a doc_id in a language the least text counts. Languages are the ``VALUES``
    commonest at most. The driver gets the sample's texts only, ``SAMPLE_BYTES`` at most.
    """
    rows = docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())
    found = [(r.text, r.lang) for r in bounded_sample(rows.select("doc_id", "lang", "text"), "lang", "doc_id", per_language, "text").collect() if _letter(r.text)]
    return LanguageModel(*map(list, zip(*sorted(found, key=lambda x: (x[1], x[0]))))) if found else None


def predict_language(model: LanguageModel | None, text: Column) -> Column:
    """``struct<lang_pred: string, score: double>`` of a text column; without a model all are ``und``."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in tidied(batches):
            names, scores = model.predict(texts.tolist()) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def like_language(model: LanguageModel, text: Column) -> Column:
    """Whether a text column's texts are like the language predicted for them."""

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in tidied(batches):
            yield pd.Series(model.alike(texts.tolist()), dtype=bool)

    return alike(text)


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query, one row per row. A null doc_id counts as not held out; repeated rows get one prediction each; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), predict_language(fit_language(docs), F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")
