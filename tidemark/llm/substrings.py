"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: at each byte the hash is shifted by
one bit and a random number of the byte is added, so its low bits depend on the
last few bytes only.  A chunk ends where these bits meet a pattern.  Boundaries
so follow the content: after an insertion they fall in step again within one
window.  Chunks are compared by 128-bit digests.  A chunk that an earlier
document (smaller id) has too is a repeat; consecutive repeats make a span.

Whole chunks fall short of a passage at both its ends, so passages are also
looked for word by word.  Of the seeds (a few words in a row) in each run of as
many words as a span must have, the one of least hash depends on the run alone,
whatever surrounds it.  Consecutive runs of one seed make a stretch.  Those whose
seed only one document has are done with; the others are compared whole, and one
that an earlier document has too is a repeat.  Where stretches of one seed differ,
the first of each kind is compared run by run, so what only two of them share in
part is found as well.  Spans of enough words are what the operator reports or
removes: runs of chunks and of words, united where they meet.

Digests are grouped by partial aggregation, those in one document only fall
away, and hot digests join as heavy keys; what is left of a document's chunks
is put in order by windows over its own rows.

Defined cases: a null or empty text has no chunk; rows of equal id count as one
document, so repeated rows are not repeats of each other; rows without id have
no earlier and later and are never reported, nor counted as the earlier
occurrence; of several earlier documents the least id is named; one or two words again and again are a passage as any
other; very long texts are cut and compared whole; an empty table gives an empty result; columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Tables, heavy_join, mix64

#: A boundary wherever these bits of the hash are all set: a chunk has 2**BITS bytes on average.
WINDOW, BITS = 16, 5
#: A chunk without boundary ends after so many bytes; one shorter than LEAST joins the next.
MOST, LEAST = 512, 12
#: Words that a span of repeats must have to be reported.
SPAN_WORDS = 25
#: Words of a seed at most.
SEED = 8
#: Bits of a digest, and bits within a word, that a filter of shared digests goes by.
FILTER, WORD_BITS = 21, 6
GEAR = np.random.default_rng(20_061).integers(0, 1 << WINDOW, 256).astype(np.uint16)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTER = np.random.default_rng(20_062).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Bases of the polynomial hashes of bytes and words.
BYTE, WORD, WORD_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def boundaries(b: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte string, each after its last byte."""
    if not len(b):
        return np.empty(0, np.int64)
    gear = GEAR[b]
    rolling = gear.copy()
    for k in range(1, min(WINDOW, len(b))):
        rolling[k:] += gear[:-k] << np.uint16(k)
    met = np.nonzero((rolling >> np.uint16(WINDOW - BITS)) == (1 << BITS) - 1)[0] + 1
    ends, last = [], 0
    for end in [*met.tolist(), len(b)]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or end == len(b) and end > last:
            last = end
            ends.append(end)
    return np.array(ends, np.int64)


def over(x: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each n consecutive values."""
    have = 1
    while have * 2 <= n:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


class Powers:
    """Hashes of stretches of a sequence: the sum of value times power of the base, from the stretch's own start."""

    def __init__(self, values: np.ndarray, base: int):
        up, down = (np.full(len(values) + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(up)[:-1])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def words_of(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a byte string that ends with a space."""
    blank = SPACE[body]
    change = np.nonzero(np.diff(blank, prepend=True))[0]
    start, end = change[0::2], change[1::2]
    return start, end, Powers(LETTER[body], BYTE)(start, end)


def stretches(words: np.ndarray, least: int, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last run of each stretch, its seed and its digest; ``of`` has the text that each word is of."""
    if len(words) < least:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    size, by_word = min(SEED, least), Powers(words, WORD)
    at = np.arange(len(words) - size + 1)
    seed = over(by_word(at, at + size), least - size + 1, np.minimum)
    good = of[: len(seed)] == of[least - 1 :]
    new = np.ones(len(seed), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (good[1:] != good[:-1]) | (of[1 : len(seed)] != of[: len(seed) - 1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(seed)) - 1
    first, last = first[good[first]], last[good[first]]
    return first, last, seed[first], by_word(first, last + least)


def chunks(docs: DataFrame, least: int = SPAN_WORDS, wanted: Broadcast | None = None) -> DataFrame:
    """(id, text) to chunks: id, at (start in bytes << 24 | bytes << 12 | words that begin in it), word (number of the first of these << 32 | words), d1, d2 (96 bits of digest).

    Stretches are rows with negative ``at``, -1 - (start << 31 | end), their seed in d1 and their digest in ``stretch``.
    With a filter ``wanted`` only rows that may be of its digests are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield cut(batch.slice(at, 256))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, places, firsts, digests, bodies = [], [], [], [], []
        for name, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            body = (text.as_py() or "").encode("utf-8", "surrogatepass")
            bodies.append(body)
            b = np.frombuffer(body, np.uint8)
            end = boundaries(b)
            if not end.size:
                continue
            start = np.concatenate([[0], end[:-1]])
            blank = SPACE[b]
            begins = np.cumsum(~blank & np.concatenate([[True], blank[:-1]]))
            names.append(np.full(len(end), name))
            parts = [body[s:e] for s, e in zip(start.tolist(), end.tolist())]
            words = np.diff(begins[end - 1], prepend=0)
            places.append(start << 24 | (end - start) << 12 | words)
            firsts.append(begins[end - 1] - words << 32 | words)
            digests += map(xxhash.xxh3_128_digest, parts)
        whole = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        start, end, words = words_of(np.frombuffer(b" ".join([*bodies, b""]), np.uint8))
        offset = np.cumsum([0, *(len(b) + 1 for b in bodies)])
        of = np.searchsorted(offset, start, "right") - 1
        a, z, seed, stretch = stretches(words, least, of)
        text = of[a]
        n_chunks, none = len(whole), np.zeros(len(a), np.int64)
        columns = {
            "id": [*names, batch.column("id").to_numpy()[text]],
            "at": [*places, -1 - (start[a] - offset[text] << 31 | end[z + least - 1] - offset[text])],
            "word": [*firsts, a - np.searchsorted(of, text) << 32 | z - a + least],
            "d1": [whole[:, 0], seed.view(np.int64)],
            "d2": [whole[:, 1].astype(np.int32).astype(np.int64), none],
            "stretch": [np.zeros(n_chunks, np.int64), stretch.view(np.int64)],
        }
        got = {c: np.concatenate(v).astype(np.int64) for c, v in columns.items()}
        if wanted is not None:
            keep = passes(wanted.value, got["d1"])
            got = {c: v[keep] for c, v in got.items()}
        got["d2"] = got["d2"].astype(np.int32)
        return pa.RecordBatch.from_pydict(got)

    return docs.mapInArrow(run, "id long, at long, word long, d1 long, d2 int, stretch long")


def passes(bits: np.ndarray, d1: np.ndarray) -> np.ndarray:
    d1 = d1.view(np.uint64)
    return bits[(d1 >> np.uint64(64 - FILTER)).astype(np.int64)] >> (d1 & np.uint64((1 << WORD_BITS) - 1)) & np.uint64(1) == 1


def filter_of(shared: DataFrame) -> np.ndarray:
    """Some bits of each digest in d1, a table of fixed size: what it lets through may be shared, all else is not."""
    held = shared.groupBy(F.shiftrightunsigned("d1", 64 - FILTER).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(d1 & {(1 << WORD_BITS) - 1} AS INT)))").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER, np.uint64)
    bits[held["at"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return bits


def runs(docs: DataFrame, least: int) -> DataFrame:
    """(id, text, wanted) to the runs of ``least`` words of the stretches wanted: id, word (number of the first), start, end (bytes), d1, d2 (96 bits of hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text, wanted in zip(*(batch.column(c) for c in ("id", "text", "wanted"))):
                start, end, words = words_of(np.frombuffer(text.as_py().encode("utf-8", "surrogatepass") + b" ", np.uint8))
                a, z, _, stretch = stretches(words, least, np.zeros(len(words), np.int64))
                some = np.isin(stretch, wanted.values.to_numpy().view(np.uint64))
                size = z[some] - a[some] + 1
                at = np.repeat(a[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                d1, d2 = (Powers(words, base)(at, at + least) for base in (WORD, WORD_2))
                for k in range(0, len(at), 65_536):
                    here = at[k : k + 65_536]
                    yield pa.RecordBatch.from_pydict({"id": np.full(len(here), name.as_py()), **{c: x.astype(np.int32) for c, x in (("word", here), ("start", start[here]), ("end", end[here + least - 1]))}, "d1": d1[k : k + 65_536].view(np.int64), "d2": (d2[k : k + 65_536] >> np.uint64(32)).astype(np.uint32).view(np.int32)})

    return docs.mapInArrow(run, "id long, word int, start int, end int, d1 long, d2 int")


def firsts_of(rows: DataFrame) -> DataFrame:
    """d1, d2, first (the least id that has the digest) and _w (rows that have it), of digests that several ids have."""
    return rows.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("_w")).where(F.col("first") != F.col("last")).drop("last")


def with_first(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Those rows whose digest is shared, with its ``first``."""
    total = shared.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    one = shared.groupBy("d1").agg(F.collect_list(F.struct("d2", "first")).alias("held"), F.sum("_w").alias("_w"))  # the rest of the digest is compared after the join
    met = heavy_join(rows, one, "d1", "_w", total)
    return met.withColumn("first", F.filter("held", lambda h: h["d2"] == F.col("d2"))[0]["first"]).where(F.col("first").isNotNull()).drop("held")


def repeated(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = SPAN_WORDS) -> DataFrame:
    """One row a span of repeats: id, start, end (bytes), words, chunks (whole ones in runs of enough words; none where only words tell), first_id (the earliest document that has one of its chunks, stretches or runs)."""
    tables = Tables(spark, "substrings")
    rows = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text")).where(F.col("id").isNotNull())
    shared = tables.save(firsts_of(chunks(rows, least)), "shared")
    held = spark.sparkContext.broadcast(filter_of(shared))
    met = tables.save(with_first(chunks(rows, least, held), shared).where((F.col("at") < 0) | (F.col("first") < F.col("id"))), "met")
    first_word, n_words = F.shiftright("word", 32), F.col("word").bitwiseAND((1 << 32) - 1)
    start = F.shiftright("at", 24)
    again = met.where(F.col("at") >= 0).groupBy("id", "at", "word").agg(F.min("first").alias("first")).select("id", start.alias("start"), (start + F.shiftright("at", 12) % 4096).alias("end"), first_word.alias("word"), n_words.alias("words"), "first")
    here = Window.partitionBy("id").orderBy("start", "end")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = again.withColumn("new", (F.coalesce(F.lag("end").over(here), F.lit(-1)) != F.col("start")).cast("int")).withColumn("run", F.sum("new").over(upto))
    whole = begins.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("word").alias("word"), F.sum("words").alias("words"), F.count("*").alias("chunks"), F.min("first").alias("first")).where(F.col("words") >= least)

    place = -1 - F.col("at")
    like = met.where(F.col("at") < 0).select("id", F.shiftright(place, 31).alias("start"), place.bitwiseAND((1 << 31) - 1).alias("end"), first_word.alias("word"), n_words.alias("words"), F.col("stretch").alias("d1"), F.col("d1").alias("d2"))
    by_stretch = with_first(like, tables.save(firsts_of(like), "shared_stretches")).where(F.col("first") < F.col("id"))
    kinds = tables.save(like.groupBy("d1", "d2").agg(F.min("id").alias("id")), "kinds")
    several = tables.save(kinds.groupBy("d2").agg(F.count("*").alias("_w")).where(F.col("_w") > 1), "several")
    wanted = heavy_join(kinds, several, "d2", "_w", several.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]).groupBy("id").agg(F.collect_set("d1").alias("wanted"))
    each = tables.save(runs(rows.where(F.col("text").isNotNull()).join(wanted, "id"), least), "runs")
    by_run = with_first(each.withColumn("words", F.lit(least)), tables.save(firsts_of(each), "shared_runs")).where(F.col("first") < F.col("id"))

    as_span = lambda df, n: df.select("id", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "word")), (F.col("word") + F.col("words")).cast("long").alias("stop"), n.cast("long").alias("chunks"), "first")
    both = as_span(whole, F.col("chunks")).unionByName(as_span(by_stretch, F.lit(0))).unionByName(as_span(by_run, F.lit(0)))
    united = both.withColumn("new", (F.coalesce(F.max("stop").over(before), F.lit(-1)) < F.col("word")).cast("int")).withColumn("run", F.sum("new").over(upto))
    spans = united.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("stop") - F.min("word")).alias("words"), F.sum("chunks").alias("chunks"), F.min("first").alias("first_id"))
    return tables.result(spans.drop("run"))


def removed(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = SPAN_WORDS) -> DataFrame:
    """The documents, all columns as they were, with the reported spans cut out of the text."""
    spans = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    found = repeated(spark, docs, id_column, text_column, least).groupBy(F.col("id").alias("_id")).agg(spans.alias("_spans"))
    joined = docs.join(found, docs[id_column].cast("long") == F.col("_id"), "left")

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for t, s in zip(text, spans):
            if t is not None and s:
                b, keep, at = t.encode("utf-8", "surrogatepass"), [], 0
                for a, e in (map(int, x.split(":")) for x in s.split(",")):
                    keep.append(b[at:a])
                    at = e
                t = b"".join([*keep, b[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return type(text)(out, dtype=object)

    return joined.select(*[cut(docs[c], F.col("_spans")).alias(c) if c == text_column else docs[c] for c in docs.columns])
