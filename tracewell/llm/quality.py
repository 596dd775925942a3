"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters over the learned embeddings of WIDTH neighbouring bytes slide over every
byte of a document. Their outputs are max-pooled within chunks of CHUNK windows that
overlap by half and cover the whole document; the chunks' vectors are combined by their
mean, maximum and minimum, and a small layer makes one probability of them. A chunk of
few different windows has low maxima, so the network sees repetition too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import prepare, slices, utf8
from tracewell.llm.labelled import fitted, held_out, sample_rows

WIDTH, CHUNK, EMBEDDING, FILTERS, HIDDEN = 8, 128, 6, 24, 12
#: Bytes whose filter outputs are held at once.
SPAN = 1 << 18
#: Rows of each label that are fitted on at most, and how.
SAMPLE, EPOCHS, BATCH, STEP, DECAY, SEED = 1500, 12, 24, 0.01, 1e-3, 7


def laid_out(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, windows): each document's bytes with byte 0 after its end up to WIDTH bytes at least; its first place and its number of windows."""
    size = np.maximum(WIDTH, np.diff(at))
    starts = np.concatenate([[0], np.cumsum(size)])
    if (size == np.diff(at)).all():
        return data[at[0] : at[-1]], starts, size - WIDTH + 1
    out = np.zeros(starts[-1], np.uint8)
    for k in range(len(size)):
        out[starts[k] : starts[k] + at[k + 1] - at[k]] = data[at[k] : at[k + 1]]
    return out, starts, size - WIDTH + 1


class ByteNet:
    """The network. Weights are float32; scores depend on a document's bytes alone."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {"embed": init(256, EMBEDDING, scale=0.5), "filters": init(WIDTH * EMBEDDING, FILTERS, scale=0.2), "bias": np.zeros(FILTERS, np.float32), "mix": init(3 * FILTERS, HIDDEN, scale=0.2), "mix_bias": np.zeros(HIDDEN, np.float32), "out": init(HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32)}

    def filtered(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(bytes, FILTERS) outputs of the window that begins at each byte; windows over a document's end are -inf."""
        x = self.w["embed"][data].reshape(-1)
        z = np.empty((len(data), FILTERS), np.float32)
        for first in range(WIDTH):  # every WIDTH-th window from here on is one row of a plain matrix
            n = (len(data) - first) // WIDTH
            np.add(x[first * EMBEDDING : (first + n * WIDTH) * EMBEDDING].reshape(n, WIDTH * EMBEDDING) @ self.w["filters"], self.w["bias"], out=z[first : first + n * WIDTH : WIDTH])
        over = (starts[1:, None] - np.arange(1, WIDTH)).ravel()
        z[over[over < len(z)]] = -np.inf
        return z

    def half_maxima(self, data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(half chunks, FILTERS) maxima over each half chunk's windows, those of about SPAN bytes at a time."""
        out = np.empty((len(first), FILTERS), np.float32)
        end = np.append(first[1:], len(data))
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(first, first[a] + SPAN)))
            low, high = first[a], end[b - 1]
            inside = starts[(starts > low) & (starts < high + WIDTH)] - low
            z = self.filtered(data[low : high + WIDTH - 1], np.concatenate([[0], inside]))
            out[a:b] = np.maximum.reduceat(z[: high - low], first[a:b] - low, axis=0)
            a = b
        return out

    @staticmethod
    def halves(starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first window of each half chunk, document of each half chunk)."""
        n = -(-windows // (CHUNK // 2))
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return starts[owner] + step * (CHUNK // 2), owner

    @staticmethod
    def chunks(owner: np.ndarray) -> np.ndarray:
        """For each half the other half of its chunk: the next of the same document, or the one before at its end."""
        nxt = np.append(owner[1:] == owner[:-1], False)
        prev = np.append(False, owner[1:] == owner[:-1])
        k = np.arange(len(owner))
        return np.where(nxt, k + 1, np.where(prev, k - 1, k))

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each document of a slice."""
        data, starts, windows = laid_out(data, at)
        first, owner = self.halves(starts, windows)
        half = self.half_maxima(data, starts, first)
        chunk = np.maximum(0, np.maximum(half, half[self.chunks(owner)]))
        edge = np.searchsorted(owner, np.arange(len(at) - 1))
        n = np.diff(np.append(edge, len(owner)))[:, None]
        pooled = np.concatenate([np.add.reduceat(chunk, edge, axis=0) / n, np.maximum.reduceat(chunk, edge, axis=0), np.minimum.reduceat(chunk, edge, axis=0)], axis=1)
        return 1 / (1 + np.exp(-(np.tanh(pooled @ self.w["mix"] + self.w["mix_bias"]) @ self.w["out"] + self.w["out_bias"]).astype(np.float64)))

    def gradients(self, data: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over one batch of documents."""
        data, starts, windows = laid_out(data, at)
        first, owner = self.halves(starts, windows)
        z = self.filtered(data, starts)
        end = np.append(first[1:], len(data))
        best = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(first, end, strict=True)])
        half = np.take_along_axis(z, best, axis=0)
        other = self.chunks(owner)
        swap = half[other] > half
        best = np.where(swap, best[other], best)
        chunk = np.maximum(0, np.where(swap, half[other], half))
        docs = len(at) - 1
        edge = np.searchsorted(owner, np.arange(docs))
        n = np.diff(np.append(edge, len(owner)))
        top, low = (np.stack([a + pick(chunk[a : a + k]) for a, k in zip(edge, n, strict=True)]) for pick in (lambda c: c.argmax(axis=0), lambda c: c.argmin(axis=0)))
        pooled = np.concatenate([np.add.reduceat(chunk, edge, axis=0) / n[:, None], np.take_along_axis(chunk, top, axis=0), np.take_along_axis(chunk, low, axis=0)], axis=1)
        hidden = np.tanh(pooled @ self.w["mix"] + self.w["mix_bias"])
        p = 1 / (1 + np.exp(-(hidden @ self.w["out"] + self.w["out_bias"])))
        d = ((p - y) / docs).astype(np.float32)
        g = {"out": hidden.T @ d, "out_bias": d.sum(keepdims=True)}
        d = d[:, None] * self.w["out"] * (1 - hidden**2)
        g |= {"mix": pooled.T @ d, "mix_bias": d.sum(axis=0)}
        d = d @ self.w["mix"].T
        back = (d[:, :FILTERS] / n[:, None])[owner]
        for place, part in ((top, d[:, FILTERS : 2 * FILTERS]), (low, d[:, 2 * FILTERS :])):
            np.add.at(back, (place, np.arange(FILTERS)), part)
        back *= chunk > 0
        g["bias"] = back.sum(axis=0)
        used = np.flatnonzero(back.ravel())
        rows, place = np.unique(best.ravel()[used], return_inverse=True)
        dz = np.zeros((len(rows), FILTERS), np.float32)
        np.add.at(dz, (place, np.tile(np.arange(FILTERS), len(best))[used]), back.ravel()[used])
        seen = data[rows[:, None] + np.arange(WIDTH)]
        g["filters"] = self.w["embed"][seen].reshape(len(rows), -1).T @ dz
        embed = np.zeros((256, EMBEDDING), np.float32)
        np.add.at(embed, seen.ravel(), (dz @ self.w["filters"].T).reshape(-1, EMBEDDING))
        return g | {"embed": embed}

    def fit(self, rows: list[tuple[str, int]]) -> ByteNet:
        """Adam over shuffled batches; the classes weigh as they come."""
        rng, t = np.random.default_rng(SEED), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        coded = [(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), y) for text, y in rows]
        steps = max(EPOCHS * len(coded) // BATCH, 150)
        order = np.concatenate([rng.permutation(len(coded)) for _ in range(1 + steps * BATCH // max(1, len(coded)))])
        for t in range(1, steps + 1):
            some = [coded[i] for i in order[(t - 1) * BATCH : t * BATCH]]
            at = np.concatenate([[0], np.cumsum([len(b) for b, _ in some])])
            g = self.gradients(np.concatenate([b for b, _ in some]), at, np.array([y for _, y in some], np.float32))
            rate = STEP * min(1, t / 20) * (1 - 0.9 * t / steps)
            for k, w in self.w.items():
                grad = g[k] + DECAY * w
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad**2 - v[k])
                w -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
        return self


def fit_net(rows: list[tuple[str, int]]) -> ByteNet:
    """A network fitted on (text, label) rows; as initialised without rows of both labels."""
    return ByteNet().fit(rows) if len({y for _, y in rows}) == 2 else ByteNet()


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteNet:
    """A network fitted on whole texts of `sample` rows of each label at most, held-out rows left out.

    Without rows of both labels it is left as initialised, and scores say little.
    """
    return fitted(sample_rows(docs, labels, "quality", {0: sample, 1: sample}), fit_net)


def column_scores(net: ByteNet, batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    scores = [net.scores(*utf8(part.column(part.schema.get_field_index(text_col)))) for part in slices(batch, text_col)]
    return np.concatenate(scores) if scores else np.zeros(0)


def score_quality(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out boolean, score double, predicted int) of every document, from its whole text alone.

    Null and empty texts are scored as one window of byte 0. Repeated rows give repeated
    rows, null ids stay null and aren't held out, an empty table gives no rows; other
    columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = column_scores(net, batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    df = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, net: ByteNet, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that net scores 0.5 or more.

    Null and empty texts are scored as one window of byte 0. Each of repeated rows is
    judged alike; an empty table stays empty.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(column_scores(net, batch, text_col) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
