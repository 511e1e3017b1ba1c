"""Packing documents into sequences of fixed capacity.

Documents are tokenised once into pieces.  All that packing needs to know of
them is how many pieces there are of each length: a histogram of at most
``capacity`` entries, which the driver solves whatever the size of the corpus.
A configuration is a multiset of lengths that fit one sequence together; the
configuration linear program asks for the fewest of them that cover the
histogram.  Multiplicative weights solve it: lengths carry prices, one knapsack
dynamic program finds for each length the configuration of the greatest price in which it is the
longest, those whose price is near the greatest are taken as far as a share of each length is
left, and the prices of lengths that still lack grow.  Amounts of less than one occur only
where a length has less than one piece left to cover.  Rounding keeps whole amounts, of a
share of the solution that is as large as it can be without costing a sequence;
configurations with room keep it, and the pieces left over are placed best-fit into these rooms and
new sequences, longest first.

Executors then place pieces by rank: the r-th piece of a length goes where the
solution has the r-th place of that length.  Ranks come from counts by length
and hash bucket, so a length that very many pieces share is ranked in many tasks.

Defined cases: a null text is empty and has only the closing id; repeated rows
are packed as often as they occur; pieces of equal length, id, number and ids change places
freely; longer documents than the capacity are cut
into pieces, however long they are; the driver's tables grow with the square of the capacity (12 MB at
2,048, 200 MB at 8,192); an empty table gives an empty result; columns of other names play
no part.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections import defaultdict
from operator import concat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Tables, map_arrow

CAPACITY = 2048
#: Words whose ids a worker remembers; beyond that it keeps those that it met in several batches, half as many at most, about.
REMEMBERED = 250_000
#: Marks that the tokenizer splits from a letter or digit before them, whatever follows; no apostrophe, which may begin an ending.
MARKS = b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~\\'
#: What bytes are to the split into words: white space, marks, ASCII letters and digits, all others.
WHITE = bytes([32, *range(9, 14)])
SPACE, MARK, ALNUM = 1, 2, 3
KINDS = np.array([SPACE if b in WHITE else MARK if b in MARKS else ALNUM if bytes([b]).isalnum() else 0 for b in range(256)], np.uint8)
#: Pieces that a rank bucket holds, about.
RANKED = 20_000
#: Rounds of the linear program at most, and the share of pieces that it covers before it ends.
ROUNDS, COVERED = 160, 0.995
#: Of what a length lacks, the share that a round takes; how fast prices of what lacks grow; and how far, at first and at most, a configuration may fall short of the greatest price.
SHARE, GROWTH, SHORT, SHORT_MOST = 0.25, 0.001, 1e-6, 0.05
#: Shares of the solution that rounding tries, the largest first.
KEPT = (1.0, 0.98, 0.96, 0.94, 0.92)
#: Byte-level letters: printable Latin-1 characters stand for their bytes, those from U+0100 on for the others in turn.
OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_LETTERS = "".join(chr(256 + OTHERS.index(b) if b in OTHERS else b) for b in range(256))
_workers: dict = {}


class Words:
    """Ids of a text by a tokenizer that never joins across white space, so each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.ids: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()

    def split(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, marks after an ASCII letter or digit at the end of one apart; and where each text's begin and the last ones end."""
        raws, plain = [], True
        for raw in [(t or "").encode("utf-8", "replace") for t in texts]:
            if any(s[:2] in raw for s in self.special):  # the tokenizer lower-cases all but special tokens
                plain = False
            else:
                raw = raw.lower()
            raws.append(raw)
        begins = np.cumsum([1, *(len(raw) + 1 for raw in raws)])
        whole = b"\n".join([b"", *raws, b""])
        kind = KINDS[np.frombuffer(whole, np.uint8)]
        space = kind == SPACE
        starts, ends = (np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1)
        if plain:
            mark = kind == MARK
            first, last = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1, np.flatnonzero(mark[:-1] & ~mark[1:])
            apart = first[(kind[first - 1] == ALNUM) & (kind[last + 1] == SPACE)]
            starts, ends = (np.sort(np.concatenate([x, apart]), kind="stable") for x in (starts, ends))
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole.translate(None, WHITE))])
        return words, np.searchsorted(starts, begins)

    def _add(self, words: list[bytes]) -> None:
        slow = []
        for word in words:
            if word.isalpha() and word.islower():  # a-z alone
                self.ids[word] = array("I", [t.id for t in self.model.tokenize(word.decode("ascii"))]).tobytes()
                continue
            text = word.decode("utf-8")
            # normalised lower-case Latin letters are one unit of the model: nothing before it would change them
            if text.isalpha() and max(text) < "\u0250" and text.islower() and is_normalized("NFC", text):
                self.ids[word] = array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
            else:
                slow.append((word, text))
        for at in range(0, len(slow), 20_000):
            some = slow[at : at + 20_000]
            for (word, _), found in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)):
                self.ids[word] = array("I", found.ids).tobytes()

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, with ``end`` at the end."""
        if len(self.ids) > REMEMBERED:
            self.ids = {word: self.ids[word] for word in self.again}
            self.again = set()
        words, firsts = self.split(texts)
        coded = words.dictionary_encode()
        _, offsets, body = coded.dictionary.buffers()
        at, body = np.frombuffer(offsets, np.int64, len(coded.dictionary) + 1).tolist(), (body or pa.py_buffer(b"")).to_pybytes()
        met = [body[a:b] for a, b in zip(at, at[1:])]
        known, distinct = self.ids, set(met)
        joined, cores, ends = [], [], []
        for word in [w for w in met if w[-1] in MARKS]:
            core = word.rstrip(MARKS)
            if core and b"<|" not in word and (core[-1:].isalnum() or core.decode("utf-8").lower()[-1].isalnum()):
                joined.append(word)
                cores.append(core)
                ends.append(word[len(core) :])
        # a word that ends in marks has the ids of the word before them, then those of the marks; only these two are remembered
        distinct.difference_update(joined)
        distinct.update(cores, ends)
        new = distinct.difference(known)
        if len(self.again) < REMEMBERED // 2:
            self.again |= distinct - new
        self._add(list(new))
        of, close = known.__getitem__, int(end).to_bytes(4, "little")
        known.update(zip(joined, map(concat, map(of, cores), map(of, ends))))
        found = list(map(of, met))
        offsets = np.cumsum([0, *map(len, found)])
        found = pa.Array.from_buffers(pa.large_binary(), len(met), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(found))]).take(coded.indices)
        for word in joined:
            del known[word]
        _, offsets, body = found.buffers()
        at, ids = np.frombuffer(offsets, np.int64, len(words) + 1)[firsts].tolist(), memoryview(body or b"")
        return [bytes(ids[a:b]) + close for a, b in zip(at, at[1:])]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = _workers.get(path) or _workers.setdefault(path, Words(path))
        names, number, start, length, crc = [], [], [], [], []
        for name, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist(), end)):
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                names.append(name)
                number.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


def priced(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The greatest price of a set of items that fits, and for items up to each and each capacity the last item of the best set (-1: none)."""
    best = np.zeros(capacity + 1)
    last = np.empty((len(sizes) + 1, capacity + 1), np.int16 if len(sizes) < 1 << 15 else np.int32)
    last[0] = -1
    for k, n in enumerate(sizes.tolist()):
        new = best[:-n] + price[k]
        last[k + 1] = last[k]
        last[k + 1, n:][new > best[n:]] = k
        best[n:] = np.maximum(best[n:], new)
    return float(best[capacity]), last


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, seed: int = 1) -> dict[Config, float]:
    """Amounts of configurations that cover the demand, almost all of it, by multiplicative weights."""
    r = np.random.default_rng(seed)
    weight, lack, short = np.ones(len(lengths)), demand.astype(float), SHORT
    amount: dict[Config, float] = defaultdict(float)
    for _ in range(ROUNDS):
        if lack.sum() <= (1 - COVERED) * demand.sum():
            break
        some = np.nonzero(lack > 1e-9)[0]
        size = lengths[some]
        part = np.maximum(np.minimum(lack[some], 1.0), np.floor(lack[some] * SHARE))
        price = size / capacity * weight[some]
        price = price / weight[some].max()
        item = np.repeat(np.arange(len(size)), np.where((part >= 2) & (2 * size <= capacity), 2, 1))  # two of a length at most are priced
        top, last = priced(size[item], price[item], capacity)
        sizes, prices, have, items = size.tolist(), price.tolist(), part.tolist(), item.tolist()
        for j in range(len(items) - 1, -1, -1):
            i = items[j]
            if have[i] <= 0:
                continue
            count, room, worth = {i: 1}, capacity - sizes[i], prices[i]
            k = last[j, room]
            while k >= 0 and have[items[k]] >= count.get(items[k], 0) + (1 if part[items[k]] >= 1 else 0):
                m = items[k]
                count[m] = count.get(m, 0) + 1
                room, worth = room - sizes[m], worth + prices[m]
                k = last[k, room]
            if k >= 0 or worth < (1 - short) * top:  # something of it is used up, or there are better ones
                continue
            add = min(have[m] / n for m, n in count.items())
            add = math.floor(add) if add >= 1 else add
            if add > 0:
                amount[tuple((sizes[m], n) for m, n in sorted(count.items(), reverse=True))] += add
                for m, n in count.items():
                    have[m] -= add * n
        moved = part - np.array(have)
        lack[some] -= moved
        grow = np.zeros(len(lengths))
        grow[some] = np.array(have) / part
        weight *= np.exp(GROWTH * grow * r.uniform(0.5, 1.5, len(lengths)))
        if moved.sum() < 0.02 * lack.sum():
            short = min(SHORT_MOST, 3 * short)
    return amount


def rounded(amount: dict[Config, float], demand: dict[int, int], share: float) -> tuple[dict[Config, int], dict[int, int]]:
    """Whole amounts of about ``share`` of a fractional solution, dealt evenly over it, and what is left of the demand."""
    left, out, run, done = dict(demand), {}, 0.0, 0
    for config, x in sorted(amount.items(), key=lambda item: (-sum(n * k for n, k in item[0]), item[0])):
        run += x * share
        times = math.floor(x + 1e-9) if share == 1 else min(math.floor(run + 1e-9) - done, math.ceil(x))
        done += times
        times = min([times, *(left[n] // k for n, k in config)])
        if times > 0:
            out[config] = times
            for n, k in config:
                left[n] -= times * k
    return out, {n: k for n, k in left.items() if k > 0}


def best_fit(left: dict[int, int], capacity: int, begun: dict[Config, int] | None = None) -> dict[Config, int]:
    """Whole sequences for what is left, longest first, each into the fullest that has room, begun ones too; equal sequences move together."""
    room: dict[int, dict[Config, int]] = defaultdict(lambda: defaultdict(int))
    free = np.zeros(capacity + 1, bool)
    for config, times in (begun or {}).items():
        gap = capacity - sum(n * k for n, k in config)
        room[gap][config] += times
        free[gap] = True
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            fits = np.nonzero(free[length:])[0]
            if not fits.size:
                k = capacity // length
                full, some = divmod(n, k)
                for held, times in ((k, full), (some, 1)):
                    if held and times:
                        room[capacity - held * length][((length, held),)] += times
                        free[capacity - held * length] = True
                break
            gap = int(fits[0]) + length
            config, times = room[gap].popitem()
            used = min(n, times)
            if times > used:
                room[gap][config] = times - used
            if not room[gap]:
                free[gap] = False
            grown = (*config[:-1], (length, config[-1][1] + 1)) if config[-1][0] == length else (*config, (length, 1))
            room[gap - length][grown] += used
            free[gap - length] = True
            n -= used
    out: dict[Config, int] = defaultdict(int)
    for of_gap in room.values():
        for config, times in of_gap.items():
            out[config] += times
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[Config, int]:
    """Whole numbers of configurations that hold every piece of the histogram exactly once."""
    left = {n: k for n, k in histogram.items() if k > 0}
    out: dict[Config, int] = defaultdict(int)
    if capacity in left:
        out[((capacity, 1),)] = left.pop(capacity)
    if left:
        lengths = np.array(sorted(left))
        amount = fractional(lengths, np.array([left[int(n)] for n in lengths]), capacity)
        solutions = [best_fit(rest, capacity, begun) for begun, rest in (rounded(amount, left, share) for share in KEPT)]
        for config, times in min([*solutions, best_fit(left, capacity)], key=lambda found: sum(found.values())).items():
            out[config] += times
    return out


def places(solution: dict[Config, int]) -> tuple[np.ndarray, ...]:
    """Runs of places in the order of length and rank: key (length and first rank), sequence, offset, how many a sequence."""
    runs, used, base = [], defaultdict(int), 0
    for config, times in sorted(solution.items(), reverse=True):
        offset = 0
        for length, k in config:
            runs.append(((length << 44) | used[length], base, offset, k))
            used[length] += times * k
            offset += k * length
        base += times
    runs.sort()
    return tuple(np.array([r[i] for r in runs], np.int64) for i in range(4))


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    tables = Tables(spark, "packing")
    cut = tables.save(pieces(docs, path, capacity, end, id_column, text_column), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # ``capacity`` rows at most
    buckets = max(16, sum(histogram.values()) // RANKED)
    held = spark.sparkContext.broadcast(places(solve(histogram, capacity)))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = tables.save(offsets, "offsets")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(offsets.hint("merge"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, base, offset, times = held.value
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
        nth = rank - (key[at] & ((1 << 44) - 1))
        found = [pa.array(base[at] + nth // times[at]), pa.array(offset[at] + nth % times[at] * length)]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], *found], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return tables.result(map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
