"""Maximum inner product search with score-aware quantisation.

Vectors are split into small subspaces with sixteen centres each, so a vector is
a string of four-bit codes.  Centres and codes minimise an anisotropic loss: of
the residual, the part parallel to the vector counts more than the rest, since
that part is what moves the inner products that matter.  A query turns the
centres into tables of partial products; a scan of the codes adds up table
entries, two codes at a time, and the best few are ranked again by the exact
product of the original vectors in double precision.  The k-th of these is a
floor: by the residual of its codes each other vector has a bound of its exact
product, and all that may reach the floor are ranked again too, so the result is
that of brute force.  Equal vectors of a block are coded and ranked as one.

Centres are fitted on a bounded sample; every vector is coded once, before any query is asked.  Candidates and
queries are dealt into blocks, and a task holds one block of each; so many queries make a block that
candidates travel seldom.

Defined cases: null, empty or zero vectors and those with null or non-finite
components take no part, as query or candidate; several rows of one id with unlike vectors are each a candidate, and each
queries, under the one id that they have: the k best of all of them are its result; vectors only meet others of
their own length; rows of equal id are not each other's candidates; ties go to
the smaller id; a repeated row is a candidate as often as it occurs, and its id
queries once; an empty table gives an empty result; columns of other names play
no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Tables
from .vectors import rows_of, usable, widths

CENTRES = 16
#: Dimensions a subspace, vectors that centres are fitted on at most (by hash of the id), rounds.
SUBSPACE, SAMPLE, ROUNDS = 2, 8192, 8
#: Products below this share of the vector's norm need not be exact; sets how much more a parallel residual counts.
THRESHOLD = 0.2
#: Blocks: candidates of a task at most and at least about, queries of one at most about, and distinct vectors ranked again in each at first.
CANDIDATES, CANDIDATES_LEAST, QUERIES, AGAIN = 65_536, 16_384, 8192, 320
#: Blocks of candidates, and of queries, that are made where there are enough of them.
BLOCKS, SETS = 32, 4


class Quantiser:
    def __init__(self, sample: np.ndarray, seed: int = 11):
        n, d = sample.shape
        self.width, self.cuts = d, [(a, min(d, a + SUBSPACE)) for a in range(0, d, SUBSPACE)]
        if len(self.cuts) % 2:  # codes are read in pairs
            self.cuts.append((d, d))
        self.more = max(0.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) - 1)
        r = np.random.default_rng(seed)
        self.centres = [sample[r.integers(0, n, CENTRES), a:b] if n else np.zeros((CENTRES, b - a)) for a, b in self.cuts]
        for _ in range(ROUNDS if n else 0):
            codes = self.encode(sample, 1)
            self._move(sample, codes)

    def _parts(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and the parallel residual of each subspace."""
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return u, np.stack([((x[:, a:b] - self.centres[j][codes[:, j]]) * u[:, a:b]).sum(axis=1) for j, (a, b) in enumerate(self.cuts)], axis=1)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        codes = np.stack([((x[:, None, a:b] - self.centres[j][None]) ** 2).sum(axis=2).argmin(axis=1) for j, (a, b) in enumerate(self.cuts)], axis=1).astype(np.uint8)
        u, parallel = self._parts(x, codes)
        total = parallel.sum(axis=1)
        for _ in range(sweeps):
            for j, (a, b) in enumerate(self.cuts):
                gap = x[:, None, a:b] - self.centres[j][None]
                along = (gap * u[:, None, a:b]).sum(axis=2)
                others = (total - parallel[:, j])[:, None]
                best = ((gap**2).sum(axis=2) + self.more * (others + along) ** 2).argmin(axis=1)
                new = np.take_along_axis(along, best[:, None], axis=1)[:, 0]
                total += new - parallel[:, j]
                parallel[:, j] = new
                codes[:, j] = best
        return codes

    def _move(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centre to the least-squares optimum of its members, the other subspaces held."""
        u, parallel = self._parts(x, codes)
        total = parallel.sum(axis=1)
        for j, (a, b) in enumerate(self.cuts):
            others = total - parallel[:, j]
            along = (x[:, a:b] * u[:, a:b]).sum(axis=1)
            for k in range(CENTRES):
                own = codes[:, j] == k
                if a == b or not own.any():
                    continue
                v = u[own, a:b]
                left = own.sum() * np.eye(b - a) + self.more * v.T @ v
                right = x[own, a:b].sum(axis=0) + self.more * v.T @ (others[own] + along[own])
                self.centres[j][k] = np.linalg.solve(left, right)
            total += ((x[:, a:b] - self.centres[j][codes[:, j]]) * u[:, a:b]).sum(axis=1) - parallel[:, j]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far a table sum may be off a product for a query of norm 1: the residual, and rounding."""
        codes = self.encode(x)
        back = np.concatenate([self.centres[j][codes[:, j]] for j in range(len(self.cuts))], axis=1)
        length = np.linalg.norm(back, axis=1)
        return codes, np.linalg.norm(x - back, axis=1) + 1e-5 * (length + sum(np.linalg.norm(c, axis=1).max(initial=0.0) for c in self.centres))

    def pairs(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte, a pair of subspaces in a row."""
        return np.ascontiguousarray((codes[:, 0::2] * CENTRES + codes[:, 1::2]).T)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Sums of partial products for both codes of a byte: a pair of subspaces in a row of 256."""
        part = [self.centres[j] @ query[a:b] for j, (a, b) in enumerate(self.cuts)]
        return np.stack([(part[j][:, None] + part[j + 1][None]).ravel() for j in range(0, len(part), 2)]).astype(np.float32)


def collapse(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct vector is first, and for each from ``start`` on ``size`` of its ids in order: the k + 1 smallest, each as often as it occurs but at most k times."""
    row = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1])))[:, 0]
    _, at, of = np.unique(row, return_index=True, return_inverse=True)
    order = np.lexsort((ids, of))
    ids, of = ids[order], of[order]
    position = np.arange(len(ids))
    new_vector = np.diff(of, prepend=-1) != 0
    new_id = new_vector | (np.diff(ids, prepend=ids[:1]) != 0)
    nth_id = np.cumsum(new_id) - np.maximum.accumulate(np.where(new_vector, np.cumsum(new_id), 0))
    nth_row = position - np.maximum.accumulate(np.where(new_id, position, 0))
    keep = (nth_id <= k) & (nth_row < k)
    size = np.bincount(of[keep], minlength=len(at))
    return at, ids[keep], np.cumsum(size) - size, size


def scan(model: Quantiser, ids: np.ndarray, x: np.ndarray, found: np.ndarray, off: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, again: int) -> dict[str, np.ndarray]:
    """The k best of this block for each query: a table scan, exact products of the best ``again``, then of all that may reach the k-th of these."""
    at, ids, start, size = collapse(ids, x, k)
    x, off = x[at], off[at]
    codes = model.pairs(found[at])
    out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
    sums, room = np.empty(len(x), np.float32), np.empty(len(x), np.float32)

    def ranked(near: np.ndarray, name: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[near]
        at = np.repeat(start[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
        exact = np.repeat((x[near] * q).sum(axis=1), n)
        other = ids[at] != name
        at, exact = at[other], exact[other]
        if len(at) > 4 * k:  # only those that reach the k-th, ties included, are put in order
            high = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
            at, exact = at[high], exact[high]
        best = np.lexsort((ids[at], -exact))[:k]
        return ids[at[best]], exact[best]

    for name, q in zip(query_ids.tolist(), queries):
        near = np.arange(len(x))
        if len(x) > again:
            with np.errstate(over="ignore", invalid="ignore"):
                tables = model.tables(q)
                np.take(tables[0], codes[0], out=sums)
                for table, code in zip(tables[1:], codes[1:]):
                    np.take(table, code, out=room)
                    np.add(sums, room, out=sums)
                first = np.argpartition(-sums, again - 1)[:again]
                got = ranked(first, name, q)[1]
                if len(got) == k:
                    near = np.nonzero(~(sums + np.linalg.norm(q) * off < got[-1]))[0]  # what is no number may be anything
        best, exact = ranked(near, name, q)
        out["query_id"].append(np.full(len(best), name))
        out["vec_id"].append(best)
        out["score"].append(exact)
    return {c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()}


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", again: int = AGAIN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k nearest found among all rows of other ids."""
    tables = Tables(spark, "neighbours")
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    found = [_nearest(spark, tables, rows.where(F.size("v") == width), width, k, again) for width in widths(rows, "v")]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return tables.result(reduce(DataFrame.unionByName, found))


def _nearest(spark: SparkSession, tables: Tables, rows: DataFrame, width: int, k: int, again: int) -> DataFrame:
    n, n_query = rows.count(), rows.where("q").count()
    share = min(1.0, 2 * SAMPLE / max(1, n))
    near = rows.where(F.pmod(F.xxhash64("id", "v", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * share))
    # distinct rows, whatever their number, in the order of a hash: never more than the bound
    sample = near.groupBy(F.xxhash64("id", "v").alias("h"), "id").agg(F.first("v").alias("v")).orderBy("h", "id").limit(SAMPLE).toArrow()
    order = np.lexsort((sample["h"].to_numpy(), sample["id"].to_numpy()))
    held = spark.sparkContext.broadcast(Quantiser(rows_of(sample["v"], width)[order]))

    def code(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                codes, off = held.value.coded(rows_of(some.column("v"), width))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], names=["id", "v", "q", "codes", "off"])

    rows = tables.save(rows.mapInArrow(code, f"id long, v {dict(rows.dtypes)['v']}, q boolean, codes binary, off double"), f"coded{width}")
    n_blocks = max(1, -(-n // CANDIDATES), min(BLOCKS, n // CANDIDATES_LEAST))
    n_sets = max(1, -(-n_query // QUERIES), min(SETS, n_query // 512))
    # a stated query set against all rows, in blocks: each row goes to the tiles of its block
    tile = F.col("block") * n_sets + F.col("set")
    spread = lambda salt, m: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(m))
    left = rows.select("id", "v", "codes", "off", spread(1, n_blocks).alias("block")).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1)))).select(tile.alias("tile"), "id", "v", "codes", "off")
    ask = rows.where("q").dropDuplicates(["id", "v"]).select("id", "v", spread(2, n_sets).alias("set"))
    right = ask.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(tile.alias("tile"), "id", "v")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(a["codes"].to_pylist()), np.uint8).reshape(a.num_rows, -1)
        got = scan(held.value, a["id"].to_numpy(), rows_of(a["v"], width), codes, a["off"].to_numpy(), b["id"].to_numpy(), rows_of(b["v"], width), k, again)
        return pa.table({"query_id": pa.array(got["query_id"].astype(np.int64)), "vec_id": pa.array(got["vec_id"].astype(np.int64)), "score": pa.array(got["score"].astype(np.float64))})

    each = left.groupBy("tile").cogroup(right.groupBy("tile")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
