"""Main text of web pages, by a linear-chain conditional random field over leaf blocks.

A page is the chain of its leaf blocks, each main text or not. What a block is told by: the tags, names and roles of all elements around it, and its text's length, links
and marks. What joins two neighbours is told by whether they lie in the same element, or in the same part of the page. Weights are fitted on labelled pages
(``labelled_pages``) by the gradient of the log-likelihood, from a forward and a backward pass; a page is labelled by Viterbi's best path.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm.html_blocks import Element, attributes, leaf_blocks
from engrava.llm.labelled_pages import labelled_pages
from engrava.llm.workers import tidied

PARTS = frozenset("article aside footer form header main nav section td".split())
_name = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_marks = {"©": "copyright", "·": "dot", "|": "bar", "»": "arrow", "›": "arrow", "@": "at"}
_cues = re.compile(r"\b(?:cookies?|javascript|privacy|newsletter|subscribe|sign up|log in|password|all rights reserved|share|tweet|reply|comments?|sponsored|advertisement|read more|terms)\b", re.I)
#: Texts longer than this hold no cue that counts.
SHORT = 200
EDGES = ("any", "same element", "same part")
RIDGE, STEPS, RATE = 0.05, 250, 0.1


def element_features(tag: str, source: str) -> list[str]:
    """Names of what an element says: its tag, the parts of its class and id, whole and by their first five letters, its role, whether it is hidden."""
    found = [f"in {tag}"]
    if source.strip(" /"):
        has = attributes(source)
        for key in ("class", "id", "role", "itemprop"):
            for part in _name.findall(has.get(key, "")[:200]):
                found += [f"named {part.lower()}", f"like {part[:5].lower()}"]
        if "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in has.get("style", "").replace(" ", ""):
            found.append("hidden")
    return found


def text_features(tag: str, text: str, linked: int) -> list[str]:
    """Names of what a block's own tag and text say. Long texts cost no more than a count of their words."""
    words = text.count(" ") + 1
    share = linked / max(len(text), 1)
    found = [f"tag {tag}", f"words {min(words.bit_length(), 7)}", f"links {0 if not linked else 1 if share < 0.35 else 2 if share < 0.8 else 3}", "sentence" if text[-1] in ".!?…。:;\"”»'" else "open end"]
    found += [_marks[c] for c in _marks if c in text[:SHORT]]
    if len(text) <= SHORT:
        found += [f"says {c.lower()}" for c in set(_cues.findall(text))]
    return found


class _Seen:
    """What is known of the elements around a block."""

    __slots__ = ("features", "part", "main")

    def __init__(self, features: frozenset, part: int, main: bool):
        self.features, self.part, self.main = features, part, main


def _reader(known: dict[str, int] | None):
    """A ``describe`` for ``leaf_blocks``; with ``known`` features only these are kept, by number, so that a block's are bounded by the model."""
    parts = 0

    def describe(tag: str, source: str, around: _Seen | None) -> _Seen:
        nonlocal parts
        if around is None:
            return _Seen(frozenset(), 0, False)
        names = element_features(tag, source)
        new = {known[f] for f in names if f in known} if known is not None else set(names)
        part = around.part
        if tag in PARTS:
            parts += 1
            part = parts
        main = around.main
        if known is None and source and "data-" in source:
            main = (main or "data-main" in source) and "data-rest" not in source
        return _Seen(around.features if new <= around.features else around.features | new, part, main)

    return describe


def _joints(blocks: list[tuple[Element, str, int]]) -> np.ndarray:
    """Rows of ``EDGES`` between neighbours."""
    found = np.ones((max(len(blocks) - 1, 0), len(EDGES)))
    for k, ((a, _, _), (b, _, _)) in enumerate(zip(blocks, blocks[1:])):
        found[k, 1:] = a.own is b.own, a.seen.part == b.seen.part
    return found


@dataclass
class Model:
    """``features`` numbers the features, ``weights`` are theirs for main text, ``joints`` those of ``EDGES`` by the labels of both neighbours."""

    features: dict[str, int]
    weights: np.ndarray
    joints: np.ndarray

    def label(self, html: str) -> list[tuple[str, bool]]:
        """Texts of a page's blocks and whether they are main text: the best path."""
        blocks = leaf_blocks(html, _reader(self.features))
        if not blocks:
            return []
        weights, around = self.weights, {}
        scores = []
        for e, text, linked in blocks:
            if id(e.seen) not in around:
                around[id(e.seen)] = float(sum(weights[f] for f in e.seen.features))
            scores.append(around[id(e.seen)] + float(sum(weights[self.features[f]] for f in text_features(e.tag, text, linked) if f in self.features)))
        steps = np.tensordot(_joints(blocks), self.joints, 1).tolist()
        no, yes, back = 0.0, scores[0], []
        for score, ((nn, ny), (yn, yy)) in zip(scores[1:], steps):
            to_no, to_yes = (no + nn, yes + yn), (no + ny, yes + yy)
            back.append((to_no[1] > to_no[0], to_yes[1] > to_yes[0]))
            no, yes = max(to_no), score + max(to_yes)
        labels = [yes > no]
        for b in reversed(back):
            labels.append(b[labels[-1]])
        return [(text, bool(main)) for (_, text, _), main in zip(blocks, reversed(labels))]

    def main_text(self, html: str | None) -> str:
        return "\n".join(text for text, main in self.label(html) if main) if html else ""


def _expected(unary: np.ndarray, joint: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each label and of each pair of neighbours' labels, of all chains at once: pages by blocks by labels."""
    pages, length, _ = unary.shape
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    forward[:, 0] = unary[:, 0]
    for t in range(1, length):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + joint[:, t - 1], axis=1) + unary[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(joint[:, t] + (unary[:, t + 1] + backward[:, t + 1])[:, None], axis=2)
        backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    one = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
    two = np.exp(forward[:, :-1, :, None] + joint + (unary[:, 1:] + backward[:, 1:])[:, :, None] - total[:, None, None, None])
    return one, two * mask[:, 1:, None, None]


def fit(pages: Iterable[str], ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """A model of pages whose main text is marked by ``data-main`` and ``data-rest``; the same pages give the same model. Pages without a block teach nothing."""
    chains = [c for page in pages if (c := leaf_blocks(page, _reader(None)))]
    rows = [[e.seen.features.union(text_features(e.tag, text, linked)) for e, text, linked in c] for c in chains]
    features = {f: k for k, f in enumerate(sorted({f for r in rows for b in r for f in b}))}
    model = Model(features, np.zeros(len(features)), np.zeros((len(EDGES), 2, 2)))
    if not chains:
        return model
    size = (len(chains), max(map(len, chains)))
    mask, gold, joints = np.zeros(size, bool), np.zeros(size, int), np.zeros((size[0], size[1] - 1, len(EDGES)))
    has = np.zeros((*size, len(features)))
    for k, (c, r) in enumerate(zip(chains, rows)):
        mask[k, : len(c)] = True
        gold[k, : len(c)] = [e.seen.main for e, _, _ in c]
        joints[k, : len(c) - 1] = _joints(c)
        for t, b in enumerate(r):
            has[k, t, [features[f] for f in b]] = 1
    has = has[mask]
    pairs = np.zeros((*joints.shape[:2], 2, 2))
    np.put_along_axis(pairs.reshape(*joints.shape[:2], 4), (2 * gold[:, :-1] + gold[:, 1:])[..., None], 1, 2)
    pairs *= mask[:, 1:, None, None]
    params = [model.weights, model.joints]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        unary = np.zeros((*size, 2))
        unary[mask, 1] = has @ model.weights
        one, two = _expected(unary, np.tensordot(joints, model.joints, 1), mask)
        slopes = [has.T @ (gold - one[:, :, 1])[mask] - ridge * model.weights, np.tensordot(joints, pairs - two, ((0, 1), (0, 1))) - ridge * model.joints]
        for p, g, m, v in zip(params, slopes, first, second):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


@functools.cache
def default_model() -> Model:
    """The model of the labelled pages; fitted once a process, in a few seconds, whatever the size of the tables."""
    return fit(labelled_pages())


def main_text(html: Column, model: Model | None = None) -> Column:
    """The main text of a column of pages; of null and empty pages, and of such as have none, the empty string."""
    model = model or default_model()

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in tidied(batches):
            yield pd.Series([model.main_text(page) for page in pages], dtype=object)

    return extract(html)


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per row, whole pages; nothing is shuffled.

    Null and empty pages give an empty text; null ids and urls stay, repeated rows fare alike, long pages are read whole; an empty table gives no rows; extra
    columns are ignored.
    """
    return pages.select("page_id", "url", main_text(F.col("html"), model).alias("text")).select("*", F.char_length("text").cast("long").alias("n_chars"))


def op11_block_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
