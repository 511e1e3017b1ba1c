"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors a cosine of at least t is a squared distance of at most
R = 2 - 2t.  Vectors are rotated by a fixed random rotation and split into
blocks of few dimensions; if two are within R, then in some block they are
within that block's share of R, in proportion to its dimensions.  So each block
is range-joined on its own: a grid over its leading coordinates, with cells four radii wide,
takes each vector to its home cell and, as a visitor, to the cells that its
radius touches.  What travels to a cell is only the block's few coordinates, rounded to half
precision: homes meet visitors under the block's squared-distance budget, widened by
the rounding, and the cell tells which of them are within it of any other.  Only these bring their
whole vector to the cell, where their pairs are verified exactly by cosine on the original vectors.

A link is counted in one place only: in the first block whose share it meets,
in the home cell of its lesser end.  So link counts add up without any list of
pairs, and a cell gives a spanning forest of its links for the components.
Equal vectors of a label collapse to one before the join and count by their
number.  Large cells are dealt into tiles of bounded size.  The number of grid
coordinates grows with the logarithm of the largest label.

Defined cases: vectors that are null, empty, zero or have null or non-finite
components link with nothing, and so do those of null label; vectors only meet
others of their own length; a repeated row is one more vector; the least id is
taken over ids that are not null; a cosine of exactly the threshold links; vectors of any length are compared
whole; an empty table gives an empty result; columns
of other names play no part.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, components, heavy_join, least_labels
from .vectors import rows_of, usable, widths

#: Dimensions a block, cell width in radii, and homes or visitors of a tile at most about.
BLOCK, WIDE, TILE = 8, 4.0, 4096
#: Blocks that a vector may have: a power of two.
MOST_BLOCKS = 1 << 16
#: Room for rounding where the grid decides who meets, and for that to half precision in a coordinate of at most 1.
SLACK, HALF = 1e-6, 2.0**-11


class Blocks:
    def __init__(self, width: int, cosine: float, coordinates: int, seed: int = 23):
        self.width, self.cosine = width, cosine
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0]
        size = max(BLOCK, -(-width // MOST_BLOCKS))
        self.cuts = [(a, min(width, a + size)) for a in range(0, width, size)]
        self.budget = [(2 - 2 * cosine) * (b - a) / width for a, b in self.cuts]
        self.coordinates = coordinates

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, cell, home) for each visit of unit vectors: a cell is a number, home is whether the row lives there."""
        y = x @ self.rotation
        out = []
        for j, (a, b) in enumerate(self.cuts):
            radius = sqrt(self.budget[j]) * (1 + SLACK) + SLACK
            side = WIDE * radius
            part = y[:, a : min(b, a + self.coordinates)]
            rows, at = np.arange(len(x)), np.zeros(len(x), np.uint64)
            own = np.floor(part / side).astype(np.int64)
            for k in range(part.shape[1]):
                mixed = lambda c, at=at, k=k: (at * np.uint64(1_000_003) + (c + 512).astype(np.uint64)) & np.uint64((1 << 60) - 1)
                low, high = np.floor((part[rows, k] - radius) / side).astype(np.int64), np.floor((part[rows, k] + radius) / side).astype(np.int64)
                both = low != high  # a cell is wider than two radii, so two cells at most
                at = np.concatenate([mixed(low), mixed(high)[both]])
                rows = np.concatenate([rows, rows[both]])
            home = np.zeros(len(x), np.uint64)
            for k in range(part.shape[1]):
                home = (home * np.uint64(1_000_003) + (own[:, k] + 512).astype(np.uint64)) & np.uint64((1 << 60) - 1)
            out.append((rows, np.full(len(rows), j), at.astype(np.int64), at == home[rows]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def first_block(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first block whose share each pair of unit vectors meets."""
        gap = (x - y) @ self.rotation
        met = np.stack([(gap[:, a:b] ** 2).sum(axis=1) <= self.budget[j] * (1 + SLACK) for j, (a, b) in enumerate(self.cuts)], axis=1)
        return met.argmax(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def meet(blocks: Blocks, block: int, home: np.ndarray, x: np.ndarray, copies_x: np.ndarray, label_x: np.ndarray, guest: np.ndarray, y: np.ndarray, copies_y: np.ndarray, label_y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links of a tile counted here: per node its links, and a spanning forest (a, b)."""
    nodes, inverse = np.unique(np.concatenate([home, guest]), return_inverse=True)
    ih, ig = inverse[: len(home)], inverse[len(home) :]
    links = np.zeros(len(nodes), np.int64)
    label = np.arange(len(nodes))
    x, y = unit(x), unit(y)
    for at in range(0, len(x) if len(y) else 0, 512):
        i, j = np.nonzero(x[at : at + 512] @ y.T >= blocks.cosine)
        i += at
        keep = (home[i] < guest[j]) & (label_x[i] == label_y[j])  # cells of two labels can share a number
        i, j = i[keep], j[keep]
        for part in range(0, len(i), 100_000):
            p, q = i[part : part + 100_000], j[part : part + 100_000]
            own = blocks.first_block(x[p], y[q]) == block
            p, q = p[own], q[own]
            np.add.at(links, ih[p], copies_y[q])
            np.add.at(links, ig[q], copies_x[p])
            label = label[least_labels(len(label), np.concatenate([ih[p], np.arange(len(label))]), np.concatenate([ig[q], label]))]
    some, linked = np.nonzero(links)[0], np.nonzero(label != np.arange(len(label)))[0]
    return nodes[some], links[some], nodes[linked], nodes[label[linked]]


def near(x: np.ndarray, home: np.ndarray, y: np.ndarray, guest: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Which homes and which guests are within a block's budget of a guest with a greater, or a home with a lesser, number."""
    room = 2 * HALF * sqrt(x.shape[1])  # what rounding both can do to their distance
    most = (sqrt(budget * (1 + SLACK)) + room) ** 2 + 1e-5
    x, y = x.astype(np.float32), y.astype(np.float32)
    yy = (y * y).sum(axis=1)
    some, other = np.zeros(len(x), bool), np.zeros(len(y), bool)
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        gap = (part * part).sum(axis=1)[:, None] + yy - 2 * (part @ y.T)
        met = (gap <= most) & (home[at : at + 512, None] < guest)
        some[at : at + 512] = met.any(axis=1)
        other |= met.any(axis=0)
    return some, other


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row a vector: id, n_links, component_id, kept."""
    tables = Tables(spark, "embeddings")
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].alias("v"), vectors[label_column].alias("label"))
    able = usable(F.col("v")) & F.col("label").isNotNull()
    salt = 0
    while True:  # a class of equal vectors is a hash of label and vector; another hash tells if it holds two kinds
        marked = rows.select("id", "v", "label", able.alias("able"), F.when(able, F.xxhash64(F.lit(salt), "label", "v")).alias("node"))
        grouped = marked.where("able").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("copies"), F.min(F.xxhash64("v", "label", F.lit(77))).alias("_low"), F.max(F.xxhash64("v", "label", F.lit(77))).alias("_high"))
        classes = tables.save(grouped, f"classes{salt}")
        if classes.where("_low <> _high").isEmpty():
            break
        salt += 1
    classes, marked = classes.drop("_low", "_high"), marked.drop("v", "label")
    counts, forests = [], []
    for width in widths(classes, "v"):
        found = tables.save(_join(tables, classes.where(F.size("v") == width), width, cosine), f"tiles{width}")
        counts.append(found.where("a is null").select("node", "links"))
        forests.append(found.where("a is not null").select("a", "b"))
    if not counts:
        return tables.result(marked.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))
    linked = reduce(DataFrame.unionByName, counts).groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(spark, reduce(DataFrame.unionByName, forests), tables)
    placed = tables.save(classes.select("node", "least", "copies").join(linked, "node", "left").join(roots, "node", "left").select("node", "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_w"))
    named = tables.save(heavy_join(placed, least, "root", "_w", placed.count()).select("node", "copies", "n_links", "component_id"), "named")
    total = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    joined = heavy_join(marked.where("able").select("id", "node"), named, "node", "copies", total).select("id", "n_links", "component_id")
    alone = marked.where("not able").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return tables.result(joined.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))


def _join(tables: Tables, classes: DataFrame, width: int, cosine: float) -> DataFrame:
    """(node, links) and (a, b) rows of all tiles."""
    largest = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks = Blocks(width, cosine, min(BLOCK, max(1, ceil(log(max(1, largest) / TILE, 3)) + 1 if largest > TILE else 1)))

    def visit(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                x = unit(rows_of(some.column("v"), width))
                row, block, cell, home = blocks.cells(x)
                took = some.take(pa.array(row))
                y = (x @ blocks.rotation).astype("<f2")
                part = [y[r, a:b].tobytes() for r, (a, b) in zip(row.tolist(), (blocks.cuts[j] for j in block.tolist()))]
                yield pa.RecordBatch.from_arrays([took.column("label"), pa.array(block.astype(np.int32)), pa.array(cell), pa.array(home), took.column("node"), pa.array(part, pa.binary())], names=["label", "block", "cell", "home", "node", "part"])

    kind = dict(classes.dtypes)
    visits = classes.select("label", "node", "v").mapInArrow(visit, f"label {kind['label']}, block int, cell long, home boolean, node long, part binary")
    # a cell's number: a hash of its label, block and place, but for its lowest bits, which are the block
    key = F.xxhash64("label", "block", "cell").bitwiseAND(-MOST_BLOCKS) + F.col("block")
    visits = visits.select(key.alias("key"), "home", "node", "part")
    # homes and visitors of a cell are dealt by hash into so many parts each; every pair of parts is a tile
    sizes = tables.save(visits.groupBy("key").agg(F.count("*").alias("_w"), F.ceil(F.count_if("home") / TILE).cast("int").alias("hosts"), F.ceil(F.count("*") / TILE).cast("int").alias("guests")).where("hosts > 0 and _w > 1"), f"sizes{width}")
    total = sizes.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    known = heavy_join(visits, sizes, "key", "_w", total)
    deal = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    # each visit is given once for every tile that it is a host in and once for every one that it is a guest in
    host, guest = F.array(deal(1, "hosts")), F.array(deal(2, "guests"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    places = lambda hosts, guests, lives: F.flatten(F.transform(hosts, lambda h: F.transform(guests, lambda g: F.struct(h.alias("host"), g.alias("guest"), F.lit(lives).alias("lives")))))
    both = F.concat(F.when(F.col("home"), places(host, every("guests"), True)).otherwise(F.array().cast("array<struct<host:int,guest:int,lives:boolean>>")), places(every("hosts"), guest, False))
    dealt = known.select("key", F.explode(both).alias("_p"), "node", "part").select("key", "_p.host", "_p.guest", "_p.lives", "node", "part")

    def look(table: pa.Table) -> pa.Table:
        lives = table["lives"].to_numpy(zero_copy_only=False)
        node = table["node"].to_numpy()
        block = table["key"][0].as_py() & (MOST_BLOCKS - 1)
        x = np.frombuffer(b"".join(table["part"].to_pylist()), "<f2").reshape(len(node), -1)
        met = np.empty(len(node), bool)
        met[lives], met[~lives] = near(x[lives], node[lives], x[~lives], node[~lives], blocks.budget[block])
        return table.select(["key", "host", "guest", "lives", "node"]).filter(pa.array(met))

    found = dealt.groupBy("key", "host", "guest").applyInArrow(look, "key long, host int, guest int, lives boolean, node long")
    needed = tables.save(found, f"needed{width}").join(classes.select("node", "copies", "v", "label"), "node")

    def tile(table: pa.Table) -> pa.Table:
        lives = table["lives"].to_numpy(zero_copy_only=False)
        node, copies, x = table["node"].to_numpy(), table["copies"].to_numpy(), rows_of(table["v"], width)
        label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        n, links, a, b = meet(blocks, table["key"][0].as_py() & (MOST_BLOCKS - 1), node[lives], x[lives], copies[lives], label[lives], node[~lives], x[~lives], copies[~lives], label[~lives])
        some, none = [None] * len(a), [None] * len(n)
        return pa.table({"node": pa.array([*n.tolist(), *some], pa.int64()), "links": pa.array([*links.tolist(), *some], pa.int64()), "a": pa.array([*none, *a.tolist()], pa.int64()), "b": pa.array([*none, *b.tolist()], pa.int64())})

    return needed.groupBy("key", "host", "guest").applyInArrow(tile, "node long, links long, a long, b long")
