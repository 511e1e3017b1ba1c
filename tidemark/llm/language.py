"""Language identification by mixture inference.

Each learned language is a distribution over hashed byte trigrams of lower-cased
letters and word edges.  A document is a mixture of languages:
expectation-maximisation estimates the proportions from the likelihoods of its
trigrams, and the set of languages grows one at a time only while the
likelihood gains more than a penalty for the further parameter.  The prediction
is the language of the largest proportion and the score is that proportion.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
rows without text or language teach nothing; with nothing to learn from, all is
``und``; ties go to the language that is first by name; the sample is uniform, so a language with few of very many
labelled documents may have none in it; very long texts count whole; repeated rows get one result each; an empty table gives an
empty result; columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, map_arrow

BUCKET_BITS = 16
#: Letters a-z and all bytes of other scripts stay; everything else is a word edge.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UND = "und"
#: Documents that are learned from, at most about: a share by hash of the labelled ones.
TRAIN_DOCUMENTS = 20_000
#: A further language must raise the log-likelihood by this times log(trigrams).
PENALTY = 8.0
ROUNDS = 12


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of the trigrams of letters and word edges."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[(b[1:-1] != 32)]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Languages:
    """names and, a trigram bucket in a row, their log-likelihoods."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + 0.5
        self.log = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T) if names else np.empty((1 << BUCKET_BITS, 0))

    def shares(self, text: str) -> np.ndarray:
        """Proportions of the languages; zero for those that are not in the chosen set."""
        share = np.zeros(len(self.names))
        bucket, weight = np.unique(trigrams(text), return_counts=True)
        if not bucket.size:
            return share
        log = self.log[bucket]
        total = weight.sum()
        likely = np.exp(log - log.max(axis=1, keepdims=True))
        chosen = [int(np.argmax(weight @ log))]
        theta = np.ones(1)
        mixed = likely[:, chosen[0]]
        score = weight @ np.log(mixed)
        while len(chosen) < len(self.names):
            best = None
            for c in range(len(self.names)):
                # the likelihood is concave in a further share, so it can only gain if its slope at 0 is positive
                if c in chosen or weight @ (likely[:, c] / mixed) <= total:
                    continue
                part = likely[:, [*chosen, c]]
                at = np.append(theta * 0.7, 0.3)
                for _ in range(ROUNDS):
                    joint = part * at
                    at = weight @ (joint / joint.sum(axis=1, keepdims=True)) / total
                now = weight @ np.log(part @ at)
                if best is None or now > best[0]:
                    best = now, c, at
            if best is None or best[0] - score <= PENALTY * np.log(total + 1.0):
                break
            score, theta = best[0], best[2]
            chosen.append(best[1])
            mixed = likely[:, chosen] @ theta
        share[chosen] = theta
        return share

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UND, 0.0
        share = self.shares(text)
        if not share.any():  # letters, but none of them in a trigram's middle
            return self.names[0], 1.0 / len(self.names)
        best = int(share.argmax())
        return self.names[best], min(1.0, float(share[best]))


def learn(spark: SparkSession, labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", bound: int = TRAIN_DOCUMENTS) -> Languages:
    """Trigram counts of at most about ``bound`` labelled documents, chosen by a hash of the id."""
    rows = labelled.select(labelled[id_column].alias("id"), labelled[text_column].alias("text"), labelled[lang_column].alias("lang")).where("text is not null and lang is not null")
    n = rows.select("id", "lang").count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            found = {k: np.nonzero(v)[0] for k, v in held.items()}
            out = pa.RecordBatch.from_arrays([pa.array([k for k in found for _ in range(len(found[k]))], pa.string()), pa.array(np.concatenate([*found.values(), np.empty(0, np.int64)]).astype(np.int32)), pa.array(np.concatenate([*(held[k][found[k]] for k in found), np.empty(0, np.int64)]).astype(np.int64))], names=["lang", "bucket", "n"])
            held.clear()
            return out

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                have = held.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                at, times = np.unique(trigrams(text.as_py()), return_counts=True)
                have[at] += times
                if len(held) > 64:
                    yield flush()
        yield flush()

    table = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table["lang"].to_pylist()) - {UND})
    counts = np.zeros((len(names), 1 << BUCKET_BITS))
    place = {name: i for i, name in enumerate(names)}
    for lang, bucket, n in zip(table["lang"].to_pylist(), table["bucket"].to_pylist(), table["n"].to_pylist()):
        if lang in place:
            counts[place[lang], bucket] = n
    return Languages(names, counts)


def identify(spark: SparkSession, docs: DataFrame, model: Languages, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: id, lang_pred, score, and languages: the chosen set with proportions, as name=share joined by commas."""
    held = spark.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = held.value
        names, scores, sets = [], [], []
        for text in batch.column("text").to_pylist():
            name, score, mixture = UND, 0.0, ""
            if model.names and has_letter(text):
                share = model.shares(text)
                if share.any():
                    best = int(share.argmax())
                    name, score = model.names[best], min(1.0, float(share[best]))
                    mixture = ",".join(f"{model.names[i]}={share[i]:.4f}" for i in np.argsort(-share, kind="stable") if share[i] > 0)
                else:
                    name, score = model.predict(text)
            names.append(name)
            scores.append(score)
            sets.append(mixture)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())], names=["id", "lang_pred", "score", "languages"])

    return map_arrow(docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text")), make, "id long, lang_pred string, score double, languages string")


def accepted(spark: SparkSession, docs: DataFrame, model: Languages, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, all columns as they were, of which one language makes up ``least`` of the text."""
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = (held.value.predict(t) for t in batch.column(at).to_pylist())
        return batch.filter(pa.array([name != UND and score >= least for name, score in found], pa.bool_()))

    return map_arrow(docs, make, docs.schema)


def in_training(by: int = 4, out: int = 2):
    return crc_mod("doc_id", by) != out
