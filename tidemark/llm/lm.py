"""Scoring by a smoothed word bigram model, run as a weighted backoff automaton.

States are contexts (the word before, or the end of the text before).  A state
has an arc for each word that followed it in training, and a failure arc to the
root, whose arcs are the add-one unigrams.  With l(h) the interpolation weight
of context h, the arc of w at h weighs log10(l c(hw)/c(h) + (1-l) P1(w)) and the
failure arc log10(1-l); a context not seen in training fails at no cost.  So the
weights of all continuations of a state sum to one.

The model is never in one place.  Texts are gathered into blocks of bounded
size.  Each block sends the keys of its own words and pairs with its training
counts to hash buckets, a bucket adds up what all blocks have of a key and
answers each block with totals in the order in which it asked, and each block
builds the part of the automaton that its own texts can reach.  Counts cover all
training documents, and every task holds one block or one bucket.  Blocks beyond
GROUP are dealt into groups, and buckets are ranges of keys: a group adds up a wide range of
keys for itself, then asks the narrow ranges in it for all groups' totals as a block
would.  So a block sends rows to as many ranges in a corpus of any size, and
a word that all blocks have is one key a group where it is added up.

Defined cases: a null text is empty and is the end token alone; repeated rows
are counted and scored as often as they occur; ties don't arise; a very long text is a block of its own, scored in
one traversal; without training documents all
tokens are unknown; an empty table gives an empty result; columns of other names play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, mix64

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text in a block and keys in a bucket, about.
BLOCK, BUCKET = 3_000_000, 500_000
#: Blocks that one group adds up, about; more groups than one write and shuffle what blocks ask a second time.
GROUP = 32_768
END = 0
END_KEY = np.uint64(0x1F83D9ABFB41BD6B)
#: The bit of a key that tells a pair from a word.
PAIR = np.uint64(1)


def weight_of(c: np.ndarray) -> np.ndarray:
    """The interpolation weight of contexts that occurred so often."""
    return np.where(c > 0, 0.55 * c / (c + 1.5), 0.0)


def blocks(docs: DataFrame) -> DataFrame:
    """Texts (id, train, text) as blocks: block, ids, train, words (how many a text has), body (all words, compressed)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, pack = TaskContext.get().partitionId(), count(), zstandard.ZstdCompressor(3)
        ids, train, words, held, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            body = pack.compress(b" ".join(b for b in held if b))
            row = [[part << 32 | next(number)], [list(ids)], [list(train)], [list(words)], [body]]
            for x in (ids, train, words, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()))], names=["block", "ids", "train", "words", "body"])

        for batch in batches:
            for name, learn, text in zip(batch.column("id").to_pylist(), batch.column("train").to_pylist(), batch.column("text")):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
                joined = b" ".join(found)
                ids.append(name)
                train.append(learn)
                words.append(len(found))
                held.append(joined)
                size += len(joined) + 1
                if size >= BLOCK:
                    yield out()
                    size = 0
        if ids:
            yield out()

    return docs.mapInArrow(gather, "block long, ids array<long>, train array<boolean>, words array<long>, body binary")


class Block:
    """The tokens of a block, its distinct words and pairs, and their keys in the order of buckets."""

    def __init__(self, body: bytes, words: np.ndarray, train: np.ndarray):
        index = defaultdict(count(1).__next__)
        found = zstandard.ZstdDecompressor().decompress(body).split()
        ids = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        del found
        self.tokens = np.insert(ids, np.cumsum(words), END)  # each text, then its end
        self.ends = np.cumsum(words + 1)
        self.size = len(index) + 1
        key = np.empty(self.size, np.uint64)
        key[END] = END_KEY
        key[1:] = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
        before = np.concatenate([[END], self.tokens[:-1]])
        self.pairs, self.pair_of = np.unique(before * self.size + self.tokens, return_inverse=True)
        learned = np.repeat(train, words + 1)
        counts = [np.bincount(self.tokens[learned], minlength=self.size), np.bincount(self.pair_of[learned], minlength=len(self.pairs))]
        h, w = np.divmod(self.pairs, self.size)
        pair = mix64(mix64(key[h] ^ np.uint64(0x5BE0CD19137E2179)) + key[w] * np.uint64(0x9FB21C651E98DF25))
        self.keys = np.concatenate([mix64(key) & ~PAIR, pair | PAIR])
        self.counts = np.concatenate(counts)
        self.order = np.argsort(self.keys)  # by bucket too, for a bucket is a range of keys


ASKED = "bucket int, block long, keys binary, counts binary"
ANSWER = "block long, bucket int, totals binary, seen long, tokens long"


def asking(block: int, keys: np.ndarray, counts: np.ndarray, buckets: range, of: int) -> pa.RecordBatch:
    """Keys in order and their counts, a row for each of these of all ``of`` buckets that has any."""
    first = np.arange(buckets.start, buckets.stop, dtype=np.uint64) << np.uint64(32)
    cuts = np.append(np.searchsorted(keys, (first + np.uint64(of - 1)) // np.uint64(of) << np.uint64(32)), len(keys)).tolist()
    pack = zstandard.ZstdCompressor(1)
    rows = [(k, block, keys[a:b].tobytes(), pack.compress(counts[a:b].tobytes())) for k, a, b in zip(buckets, cuts, cuts[1:]) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "keys", "counts"])


def count_keys(table: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    for row in table.to_pylist():
        b = Block(row["body"], np.array(row["words"], np.int64), np.array(row["train"], bool))
        yield asking(row["block"], b.keys[b.order].astype("<u8"), b.counts[b.order].astype("<u4"), range(buckets), buckets)


def added(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys by row, the distinct ones in order, which of these each is, and their counts added up."""
    unpack = zstandard.ZstdDecompressor()
    keys = [np.frombuffer(k.as_py(), "<u8") for k in table["keys"]]
    raw = [unpack.decompress(c.as_py()) for c in table["counts"]]
    counts = np.concatenate([np.frombuffer(c, f"<u{len(c) // len(k)}") for c, k in zip(raw, keys)])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, distinct, at, np.bincount(at, weights=counts).astype(np.int64)


def answers(table: pa.Table, keys: list[np.ndarray], totals: np.ndarray, seen: int = 0, tokens: int = 0) -> pa.Table:
    """For each row of the table the totals of its keys in its own order; the first row has the sums of words."""
    pack, n = zstandard.ZstdCompressor(1), len(keys)
    back = np.split(totals, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"block": table["block"], "bucket": table["bucket"], "totals": pa.array([pack.compress(b.astype("<i8").tobytes()) for b in back], pa.binary()), "seen": pa.array([seen] + [0] * (n - 1), pa.int64()), "tokens": pa.array([tokens] + [0] * (n - 1), pa.int64())})


def add_up(table: pa.Table) -> pa.Table:
    """Totals of a bucket's keys, for each that asked."""
    keys, distinct, at, total = added(table)
    single = total[distinct & PAIR == 0]
    return answers(table, keys, total[at], int((single > 0).sum()), int(single.sum()))


class Automaton:
    """arcs: state * size + word to its weight; fail: a state's weight to the root; root: a word's weight there."""

    def __init__(self, size: int, arcs: dict[int, float], fail: list[float], root: list[float]):
        self.size, self.arcs, self.fail, self.root = size, arcs, fail, root

    def traverse(self, tokens: list[int], state: int = END) -> float:
        arc, size, fail, root = self.arcs.get, self.size, self.fail, self.root
        total = 0.0
        for token in tokens:
            weight = arc(state * size + token)
            total += fail[state] + root[token] if weight is None else weight
            state = token
        return total


def score_block(row: dict, totals_of: list[bytes], train_tokens: int, distinct: int) -> dict[str, list]:
    unpack = zstandard.ZstdDecompressor()
    b = Block(row["body"], np.array(row["words"], np.int64), np.array(row["train"], bool))
    totals = np.empty(len(b.keys), np.int64)
    totals[b.order] = np.concatenate([np.frombuffer(unpack.decompress(a), "<i8") for a in totals_of])
    single, double = totals[: b.size], totals[b.size :]
    p1 = (single + 1) / (train_tokens + distinct + 1)
    root = np.log10(p1)
    weight = weight_of(single)
    has = np.nonzero(double > 0)[0]
    h, w = np.divmod(b.pairs[has], b.size)
    arc = np.log10(weight[h] * double[has] / single[h] + (1 - weight[h]) * p1[w])
    machine = Automaton(b.size, dict(zip(b.pairs[has].tolist(), arc.tolist())), np.log10(1 - weight).tolist(), root.tolist())
    starts = b.ends - np.array(row["words"], np.int64) - 1
    tokens = b.tokens.tolist()
    return {
        "n_tokens": (b.ends - starts).tolist(),
        "n_known": np.add.reduceat((single > 0)[b.tokens].astype(np.int64), starts).tolist(),
        "base_score": np.add.reduceat(root[b.tokens], starts).tolist(),
        "score": [machine.traverse(tokens[s:e]) for s, e in zip(starts.tolist(), b.ends.tolist())],
    }


def score(spark: SparkSession, docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: id, train, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    tables = Tables(spark, "lm")
    held = tables.save(blocks(docs.select(docs[id_column].cast("long").alias("id"), train.alias("train"), docs[text_column].alias("text"))), "blocks")
    made = held.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.size("ids") + F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens")).first()
    groups = max(1, -(-made.blocks // GROUP))
    buckets = max(1, int(made.tokens * 0.8) // BUCKET // groups)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield from count_keys(pa.Table.from_batches([batch.slice(at, 1)]), buckets)

    def combine(table: pa.Table) -> pa.Table:
        _, distinct, _, total = added(table)
        wide = table["bucket"][0].as_py()
        return pa.Table.from_batches([asking(table["asker"][0].as_py(), distinct, total.astype("<u8"), range(wide * groups, (wide + 1) * groups), buckets * groups)])

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, _, at, _ = added(left)
        unpack, order = zstandard.ZstdDecompressor(), np.argsort(right["bucket"].to_numpy())
        totals = right["totals"].to_pylist()
        return answers(left, keys, np.concatenate([np.frombuffer(unpack.decompress(totals[i]), "<i8") for i in order])[at])

    asked = held.select("block", "train", "words", "body").mapInArrow(ask, ASKED)
    if groups == 1:
        answer = summed = tables.save(asked.groupBy("bucket").applyInArrow(add_up, ANSWER), "answers")
    else:
        asker = F.pmod(F.xxhash64("block"), F.lit(groups)) * buckets + F.col("bucket")
        asked = tables.save(asked.withColumn("asker", asker), "asked")
        summed = tables.save(asked.groupBy("asker").applyInArrow(combine, ASKED).groupBy("bucket").applyInArrow(add_up, ANSWER), "sums")
        answer = tables.save(asked.groupBy("asker").cogroup(summed.groupBy("block")).applyInArrow(reply, ANSWER), "answers")
        tables.drop("asked")
    sums = summed.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    seen, tokens = sums.seen, sums.tokens

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        order = np.argsort(right["bucket"].to_numpy())
        totals = right["totals"].to_pylist()
        found = score_block(row, [totals[i] for i in order], tokens, seen)
        return pa.table({"id": pa.array(row["ids"], pa.int64()), "train": pa.array(row["train"], pa.bool_()), "n_tokens": pa.array(found["n_tokens"], pa.int64()), "n_known": pa.array(found["n_known"], pa.int64()), "train_tokens": pa.array([tokens] * len(row["ids"]), pa.int64()), "base_score": pa.array(found["base_score"], pa.float64()), "score": pa.array(found["score"], pa.float64())})

    return tables.result(held.groupBy("block").cogroup(answer.select("block", "bucket", "totals").groupBy("block")).applyInArrow(finish, "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
