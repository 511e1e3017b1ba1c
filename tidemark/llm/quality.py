"""A quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover it to the last byte.  Learned
filters slide over each chunk, the greatest response of each filter in a chunk
is kept (max pooling), chunks are pooled once more into greatest, mean and least,
and a small layer combines these into one probability.  Training runs on the driver, on
a bounded sample of labelled documents: distinct pairs of id and text in the order of a hash, as
many as there may be and as fit a number of bytes, each of them whole.  Scoring runs in Arrow batches
over every byte of every text.

Defined cases: a null or empty text is one chunk of padding and gets a score
too; a very long text is scored and trained on in all its chunks, but is no part of the sample if it
is longer than the sample may be; equal texts of one id count as one example, and ties of the hash go by label and length; labels that are neither 0 nor 1, or null, teach nothing; several labels of one document
count by their least; without labels of both kinds every score is their share
(0.5 without any); repeated rows get one result each; an empty table gives an
empty result; columns of other names play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow

#: Bytes a chunk, bytes from one to the next, bytes a filter, filters, hidden units.
CHUNK, STRIDE, WIDTH, FILTERS, HIDDEN = 64, 48, 5, 12, 16
PAD = 256
#: The training sample: documents at most, in the order of a hash of id and text, and bytes in all at most.
TRAIN_DOCUMENTS, TRAIN_BYTES = 6000, 48_000_000
EPOCHS, BATCH, RATE = 10, 32, 0.01


def chunks(text: str | None) -> np.ndarray:
    """Rows of CHUNK + WIDTH - 1 symbols: bytes, or PAD after the end of a text."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    last = max(0, len(b) - CHUNK)
    starts = np.append(np.arange(0, last, STRIDE), last)
    padded = np.full(max(len(b), CHUNK) + WIDTH - 1, PAD, np.int16)
    padded[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[starts]


class Network:
    def __init__(self, seed: int = 3, share: float = 0.5):
        r = np.random.default_rng(seed)
        self.share, self.trained = share, False
        self.filters = r.normal(0, 0.4, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        self.filters[:, PAD] = -0.5
        self.w1 = r.normal(0, 0.25, (3 * FILTERS + 1, HIDDEN))
        self.b1 = np.zeros(HIDDEN)
        self.w2 = r.normal(0, 0.25, HIDDEN)
        self.b2 = np.zeros(1)

    def responses(self, rows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest response of each filter in each chunk, and where it is."""
        best = np.empty((len(rows), FILTERS), np.float32)
        where = np.empty((len(rows), FILTERS), np.int64) if places else None
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            out = np.take(self.filters[0], part[:, :CHUNK], axis=0)
            for k in range(1, WIDTH):
                out += np.take(self.filters[k], part[:, k : k + CHUNK], axis=0)
            best[at : at + 512] = out.max(axis=1)
            if places:
                where[at : at + 512] = out.argmax(axis=1)
        return best, where

    @staticmethod
    def pooled(best: np.ndarray, counts: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of documents with so many chunks each: greatest, mean and least response, and how full the first chunk is."""
        starts = np.cumsum(counts) - counts
        best = best.astype(np.float64)
        return np.concatenate([np.maximum.reduceat(best, starts), np.add.reduceat(best, starts) / counts[:, None], np.minimum.reduceat(best, starts), filled[:, None]], axis=1), starts

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.tanh(features @ self.w1 + self.b1) @ self.w2 + self.b2, -30, 30)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.share)
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):  # as many texts at a time as make about 4,000 chunks
            rows, to = [], at
            while to < len(texts) and sum(map(len, rows)) < 4000:
                rows.append(chunks(texts[to]))
                to += 1
            best = np.concatenate([self.responses(r)[0] for r in rows]) if len(rows) == 1 else self.responses(np.concatenate(rows))[0]
            filled = np.array([(r[0][:CHUNK] != PAD).mean() for r in rows])
            out[at:to] = self.probability(self.pooled(best, np.array(list(map(len, rows))), filled)[0])
            at = to
        return out

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Network:
        """Adam on the logistic loss; the gradient of a maximum goes to where it was."""
        r = np.random.default_rng(seed)
        names = ("filters", "w1", "b1", "w2", "b2")
        first = {n: np.zeros(getattr(self, n).shape) for n in names}
        second = {n: np.zeros(getattr(self, n).shape) for n in names}
        filled = np.array([(x[0][:CHUNK] != PAD).mean() for x in rows])
        t = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                counts = np.array([len(rows[i]) for i in pick])
                part = np.concatenate([rows[i] for i in pick])
                best, where = self.responses(part, True)
                x, starts = self.pooled(best, counts, filled[pick])
                hidden = np.tanh(x @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30)))
                error = (p - labels[pick]) / len(pick)
                back = np.outer(error, self.w2) * (1 - hidden**2)
                grad = {"w2": hidden.T @ error + 1e-5 * self.w2, "b2": error.sum(keepdims=True), "w1": x.T @ back + 1e-5 * self.w1, "b1": back.sum(axis=0)}
                dx = back @ self.w1.T
                of = np.repeat(np.arange(len(pick)), counts)
                dmax, dmean, dmin = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS : 3 * FILTERS]
                d = dmean[of] / counts[of][:, None]
                d += np.where(best == x[of, :FILTERS], dmax[of], 0) + np.where(best == x[of, 2 * FILTERS : 3 * FILTERS], dmin[of], 0)
                g = np.zeros(self.filters.shape)
                f = np.broadcast_to(np.arange(FILTERS), where.shape)
                for k in range(WIDTH):
                    np.add.at(g[k], (part[np.arange(len(part))[:, None], where + k], f), d)
                grad["filters"] = g
                t += 1
                rate = RATE * (1 - 0.9 * epoch / EPOCHS)
                for n in names:
                    first[n] += 0.1 * (grad[n] - first[n])
                    second[n] += 0.001 * (grad[n] ** 2 - second[n])
                    step = rate * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - step).astype(getattr(self, n).dtype))
        self.trained = True
        return self


def sample(docs: DataFrame, known: DataFrame, bound: int, most: int) -> list[tuple[str | None, int]]:
    """Texts with their labels: of distinct pairs of id and text, the first by hash that fit, ``bound`` at most and ``most`` bytes in all."""
    n = known.count()
    if n > 2 * bound:  # ids that can't be met all; twice as many as wanted, for some have no document
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * 2 * bound / n))
    met = docs.join(F.broadcast(known), "id")  # about 2 * bound rows at most
    hashed = met.withColumn("h", F.xxhash64("id", "text", F.lit(9)))
    sizes = hashed.groupBy("h", "label").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).orderBy("h", "label", "size").limit(2 * bound).collect()
    picked, total = [], 0
    for r in sizes:
        if len(picked) < bound and total + r["size"] <= most:
            picked.append((r["h"],))
            total += r["size"]
    if not picked:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, "h long").distinct())
    got = hashed.join(wanted, "h", "left_semi").groupBy("h", "label").agg(F.first("text").alias("text")).select("text", "label").toArrow()
    texts, marks = got["text"].to_pylist(), got["label"].to_pylist()
    return sorted(zip(texts, marks), key=lambda r: (r[0] or "", r[1]))  # whatever order the rows came in


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", bound: int = TRAIN_DOCUMENTS, most: int = TRAIN_BYTES) -> Network:
    """Fit on at most ``bound`` labelled documents of ``most`` bytes in all, ``allowed`` being a condition on labels' rows."""
    known = labels.where(allowed) if allowed is not None else labels
    known = known.select(known[id_column].cast("long").alias("id"), known[label_column].cast("int").alias("label")).where("label in (0, 1) and id is not null").groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    rows = sample(texts, known, bound, most)
    marks = np.array([m for _, m in rows], float)
    if not rows or marks.min() == marks.max():
        return Network(share=float(marks.mean()) if rows else 0.5)
    return Network().fit([chunks(t) for t, _ in rows], marks)


def scored(spark: SparkSession, docs: DataFrame, model: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: id and score."""
    held = spark.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held.value.scores(batch.column("text").to_pylist()), pa.float64())], names=["id", "score"])

    return map_arrow(docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text")), make, "id long, score double")
