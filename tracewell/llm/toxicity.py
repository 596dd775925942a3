"""Toxicity: a chain of linear classifiers over hashed n-grams, one for each category, in a fixed order.

A document's features are its distinct words, beginnings of words and character n-grams
inside words, of every script and length, hashed; in scripts that put no spaces between
words, single characters and pairs too. Each category's model is a logistic
regression with an L1 penalty over these features, scaled by their naive-Bayes log odds,
and over the probabilities of all categories before it; while fitting, these are
out-of-fold, so no model learns to trust a predecessor that has seen the same row.

The labels know one flag. The categories before "toxic" are kinds of toxicity: clusters
of the labelled toxic documents by the features that mark them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import Remembered, prepare, texts
from tracewell.llm.labelled import fitted, sample_rows

CHAIN = ("kind1", "kind2", "kind3", "toxic")
WORD = re.compile(r"[^\W\d_]+")
#: Thai, Lao, Burmese, Khmer, kana, Han: letters of scripts whose words aren't set apart.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Places of hashed features; longest beginning of a word; lengths of n-grams inside a word.
PLACES, BEGINNING, GRAMS = 1 << 18, 7, (3, 4)
#: A feature takes part in a fit where it has so many documents and its shrunken log odds of toxicity are so high; documents by which odds are shrunk.
LEAST_DOCUMENTS, LEAST_ODDS, SHRINK = 3, 0.4, 5
#: Rows of each label that are fitted on at most; folds; L1 penalty; weight of a row of the category; steps of a fit, which stops before the optimum (by 1 % of the loss in the test).
TOXIC_SAMPLE, OTHER_SAMPLE, FOLDS, PENALTY, WEIGHT, STEPS = 1000, 3000, 3, 1.5e-4, 2.0, 100
#: Dimensions in which kinds are clustered, and rounds of it; entries of the rows' features that are worked on at once.
SKETCH, ROUNDS, ENTRIES = 64, 12, 1 << 20


def places(word: str) -> set[int]:
    """Places of a word's features: itself, its beginnings, and the n-grams inside it; single characters and pairs too where words aren't set apart."""
    found = [word + "$", *["^" + word[:n] for n in range(1, min(len(word), BEGINNING) + 1)], *[word[i : i + n] for n in GRAMS for i in range(1, len(word) - n + 1)]]
    if UNSPACED.search(word):
        found += [word[i : i + n] for n in (1, 2) for i in range(len(word) - n + 1)]
    return {zlib.crc32(g.encode("utf-8", "replace")) % PLACES for g in found}


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Chain:
    """Features with a weight in some category, their weights (features, categories), weights of earlier categories' probabilities, and constants."""

    columns: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constants: np.ndarray

    @cached_property
    def known(self) -> Remembered:
        number = {p: n for n, p in enumerate(self.columns.tolist())}
        return Remembered(lambda word: tuple([number[p] for p in places(word) if p in number]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def probabilities(self, many: list[str]) -> np.ndarray:
        """(texts, categories): each category's probability, given those before it, from whole texts."""
        z = np.tile(self.constants, (len(many), 1))
        known = self.known
        for i, text in enumerate(many):
            held: set[int] = set()
            for word in words_of(text):
                held.update(known(word))
            if held:
                z[i] += self.weights[sorted(held)].sum(axis=0)
        p = np.zeros_like(z)
        for k in range(z.shape[1]):
            p[:, k] = sigmoid(z[:, k] + p[:, :k] @ self.earlier[k, :k])
        return p


def hashed(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the distinct features of every text."""
    known = Remembered(lambda word: np.array(sorted(places(word)), np.int32))
    rows, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i, text in enumerate(many):
        found = [known(w) for w in words_of(text)]
        if found:
            held.append(np.unique(np.concatenate(found)))
            rows.append(np.full(len(held[-1]), i, np.int32))
    return np.concatenate(rows), np.concatenate(held)


def spans(n: int) -> list[slice]:
    """n entries in slices, which bound what is made of them at once."""
    return [slice(k, k + ENTRIES) for k in range(0, n, ENTRIES)]


def odds(row: np.ndarray, place: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Each place's shrunken log odds of y among the used rows; 0 where they are too low or the place too rare."""
    good, seen = np.zeros(PLACES), np.zeros(PLACES)
    for s in spans(len(row)):
        good += np.bincount(place[s], weights=(y * used)[row[s]], minlength=PLACES)
        seen += np.bincount(place[s], weights=used[row[s]], minlength=PLACES)
    total = y[used].sum()
    log = np.log((good + 0.5) / (total + 1)) - np.log((seen - good + 0.5) / (used.sum() - total + 1))
    log *= seen / (seen + SHRINK)
    return np.where((seen >= LEAST_DOCUMENTS) & (log >= LEAST_ODDS), log, 0.0)


def linear(row: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Sum of the weights of each row's places."""
    out = np.zeros(n)
    for s in spans(len(row)):
        out += np.bincount(row[s], weights=weight[place[s]], minlength=n)
    return out


def fit_linear(row: np.ndarray, place: np.ndarray, before: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight of every place, of every column of before, constant), fitted on the used rows by accelerated proximal gradient steps."""
    scale = odds(row, place, y, used) / 3
    active = np.flatnonzero(scale)
    number = np.full(PLACES, -1, np.int32)
    number[active] = np.arange(len(active))
    entries = [np.flatnonzero(used[row[s]] & (number[place[s]] >= 0)) + s.start for s in spans(len(row))]
    inside = np.concatenate([np.zeros(0, np.int64), *entries])
    n, dense = len(y), before.shape[1] + 1
    r = np.concatenate([row[inside], np.tile(np.arange(n, dtype=np.int32), dense)])
    c = np.concatenate([number[place[inside]], np.repeat(np.arange(len(active), len(active) + dense, dtype=np.int32), n)])
    v = np.concatenate([scale[place[inside]], *(before[:, k] * used for k in range(dense - 1)), used.astype(float)])
    size = len(active) + dense
    share = np.where(y > 0, WEIGHT, 1.0) * used / max(1, used.sum())
    penalty = np.where(np.arange(size) < len(active), PENALTY, 0.0)
    out = lambda w: np.bincount(r, weights=v * w[c], minlength=n)
    back = lambda x: np.bincount(c, weights=v * x[r], minlength=size)
    x = np.ones(size)
    for _ in range(8):
        x = back(share * out(x))
        top = float(np.linalg.norm(x)) or 1.0
        x /= top
    step, w, u, t = 3.5 / top, np.zeros(size), np.zeros(size), 1.0
    for _ in range(STEPS):
        new = u - step * back(share * (sigmoid(out(u)) - y))
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / later * (new - w), new, later
    whole = np.zeros(PLACES)
    whole[active] = w[: len(active)] * scale[active]
    return whole, w[len(active) : -1], float(w[-1])


def kinds_of(row: np.ndarray, place: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cluster 0, 1, .. of each row with y, the largest first, by spherical k-means of its marking features; -1 for others."""
    weight = odds(row, place, y, np.ones(len(y), bool))
    toxic = y[row] > 0
    row, place = row[toxic], place[toxic]
    sign = np.where(place * 40_503 >> 9 & 1, 1.0, -1.0)
    x = np.bincount(row * SKETCH + place % SKETCH, weights=weight[place] * sign, minlength=len(y) * SKETCH).reshape(-1, SKETCH)[y > 0]
    x /= np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))
    kinds = len(CHAIN) - 1
    centre = x[:1]
    while len(centre) < min(kinds, len(x)):
        centre = np.vstack([centre, x[(x @ centre.T).max(axis=1).argmin()]])
    own = np.zeros(len(x), int)
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(axis=1)
        centre = np.stack([x[own == k].sum(axis=0) if (own == k).any() else centre[k] for k in range(len(centre))])
        centre = centre / np.maximum(1e-9, np.sqrt((centre * centre).sum(axis=1, keepdims=True)))
    order = np.argsort(-np.bincount(own, minlength=kinds), kind="stable")
    out = np.full(len(y), -1)
    out[y > 0] = np.argsort(order)[own]
    return out


def fit_chain(rows: list[tuple[str, int]]) -> Chain:
    """A chain fitted on (text, toxic) rows. Without toxic rows no document is toxic to it."""
    y = np.array([t for _, t in rows], float)
    if not y.any():
        return Chain(np.zeros(0, np.int32), np.zeros((0, len(CHAIN))), np.zeros((len(CHAIN),) * 2), np.full(len(CHAIN), -5.0))
    row, place = hashed([t for t, _ in rows])
    kind = kinds_of(row, place, y)
    fold, every = np.arange(len(y)) % FOLDS, np.ones(len(y), bool)
    before, weights = np.zeros((len(y), 0)), []
    earlier, constants = np.zeros((len(CHAIN),) * 2), np.zeros(len(CHAIN))
    for k in range(len(CHAIN)):
        target = y if k == len(CHAIN) - 1 else (kind == k).astype(float)
        own = np.zeros(len(y))
        for part in range(FOLDS):
            w, e, c = fit_linear(row, place, before, target, fold != part)
            own[fold == part] = sigmoid(linear(row, place, w, len(y)) + before @ e + c)[fold == part]
        w, earlier[k, :k], constants[k] = fit_linear(row, place, before, target, every)
        weights.append(w)
        before = np.column_stack([before, own])
    full = np.stack(weights, axis=1)
    columns = np.flatnonzero(np.abs(full).max(axis=1) > 0)
    return Chain(columns.astype(np.int32), full[columns], earlier, constants)


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, other: int = OTHER_SAMPLE) -> Chain:
    """A chain fitted on `toxic` and `other` rows of the two labels at most, whole texts, held-out rows left out."""
    return fitted(sample_rows(docs, labels, "toxic", {1: toxic, 0: other}), fit_chain)


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(id, p_kind1, p_kind2, p_kind3, p_toxic double, toxic int) of every document, from its whole text.

    Null and empty texts have no features and aren't toxic. Repeated rows give repeated
    rows, null ids stay null, an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    names = ["id", *(f"p_{c}" for c in CHAIN), "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.probabilities(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in p.T), pa.array((p[:, -1] >= cut).astype(np.int32))], names=names)

    df = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, {', '.join(f'p_{c} double' for c in CHAIN)}, toxic int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose probability of "toxic" is below cut.

    Rows with null or empty texts stay. Each of repeated rows is judged alike; an empty
    table stays empty.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chain.probabilities(texts(batch, text_col))[:, -1] < cut))

    return docs.mapInArrow(run, docs.schema)
