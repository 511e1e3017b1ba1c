"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed once a document; equal ones collapse to one row.
Their bits are cut into bands, one more than the radius, so two fingerprints within
the radius are equal in some band.  Each fingerprint goes once a band to a tile,
which holds whole groups of one value of the band, and every group is compared whole with numpy's
exclusive-or and bit count.  A group larger than a tile is dealt into tiles of
one population count each, and every pair of these whose counts differ by no more than the
radius is compared whole.  Pairs that differ in every band cannot be links
and are never formed: with bands of 12 or 13 bits, some 6 in 8,192 of all pairs are compared.
A tile gives a spanning forest of its links, not the links, so a group of k near copies moves
O(k) rows.  Groups are then joined across tiles by connected components.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero; a very long text counts whole; texts at exactly the radius are linked; repeated rows and equal ids give one result row each; a null
id is an id that is never the least unless all of a group are null; an empty
table gives an empty result; columns of other names play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, components, heavy_join, least_labels, map_arrow

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints a tile holds, about: a 24th of all, within these bounds.
TILE_LEAST, TILE_MOST = 2048, 1 << 16
ROWS, COLUMNS = 256, 2048


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id long, th long, fp long): one row a document; th is a hash of the text as it is."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t, words, seed) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "th", "fp"])

    return map_arrow(docs.select(docs[id_column].cast("long").alias("id"), F.xxhash64(docs[text_column]).alias("th"), docs[text_column].alias("text")), make, "id long, th long, fp long")


def close(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Least index (b's after a's) reachable within these two tiles, for each of a and b."""
    same = a is b
    label = np.arange(len(a) + (0 if same else len(b)))
    room = np.empty((min(ROWS, len(a)), min(COLUMNS, len(b))), np.uint64)
    for i in range(0, len(a), ROWS):
        row = a[i : i + ROWS, None]
        heads, tails = [], []
        for j in range(i if same else 0, len(b), COLUMNS):
            column = b[None, j : j + COLUMNS]
            gap = np.bitwise_count(np.bitwise_xor(row, column, out=room[: row.shape[0], : column.shape[1]]))
            x, y = np.nonzero(gap <= radius)
            heads.append(x + i)
            tails.append(y + j + (0 if same else len(a)))
        x, y = np.concatenate(heads), np.concatenate(tails)
        if same:
            x, y = x[x < y], y[x < y]
        if x.size:
            label = label[least_labels(len(label), np.concatenate([x, np.arange(len(label))]), np.concatenate([y, label]))]
    return label[: len(a)], label[0 if same else len(a) :]


def bands(radius: int) -> list[tuple[int, int]]:
    """(first bit, mask) of the parts that a fingerprint is cut into, one more than the radius: some part of two linked ones is equal."""
    ends = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(ends, ends[1:])]


def banded(fps: np.ndarray, band: tuple[int, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a spanning forest of the links among those that agree in this band; each group of them is compared whole."""
    value = (fps >> np.uint64(band[0])) & np.uint64(band[1])
    order = np.argsort(value, kind="stable")
    fps, value = fps[order], value[order]
    starts = np.concatenate([[0], np.nonzero(value[1:] != value[:-1])[0] + 1, [len(fps)]])
    a, b = [fps[:0]], [fps[:0]]
    for at in np.nonzero(np.diff(starts) > 1)[0]:
        group = fps[starts[at] : starts[at + 1]]
        label = close(group, group, radius)[0]
        linked = np.nonzero(label != np.arange(len(label)))[0]
        if linked.size:
            a.append(group[linked])
            b.append(group[label[linked]])
    return np.concatenate(a), np.concatenate(b)


def tile_links(distinct: DataFrame, radius: int, tables: Tables) -> DataFrame:
    """(a, b): a spanning forest, tile by tile, of all fingerprints (fp) within the radius."""
    total = distinct.count()
    most = min(TILE_MOST, max(TILE_LEAST, total // 24))
    tiles = -(-total // most) or 1
    parts = bands(radius)
    values = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")) for lo, mask in parts]
    each = distinct.select("fp", F.posexplode(F.array(*values)).alias("band", "value"))
    large = None
    if total > most:  # at most total * bands / most groups
        large = tables.save(each.groupBy("band", "value").count().where(F.col("count") > most).select("band", "value"), "large")
        large = None if large.isEmpty() else large
    few = each if large is None else each.join(F.broadcast(large), ["band", "value"], "left_anti")

    def compare_groups(table: pa.Table) -> pa.Table:
        a, b = banded(table["fp"].to_numpy().view(np.uint64), parts[table["tile"][0].as_py() // tiles], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    tiled = few.select("fp", (F.col("band").cast("long") * tiles + F.pmod(F.xxhash64("band", "value"), F.lit(tiles))).alias("tile"))
    # bytes say nothing of the work in a tile: deal tiles out by their number
    links = tiled.repartition(-(-tiles * len(parts) // 4), "tile").groupBy("tile").applyInArrow(compare_groups, "a long, b long")
    if large is None:
        return links
    return links.unionByName(large_links(each.join(F.broadcast(large), ["band", "value"]), most, radius, tables))


def large_links(each: DataFrame, most: int, radius: int, tables: Tables) -> DataFrame:
    """(a, b) of groups (band, value) larger than a tile: tiles of one population count each, all pairs whose counts differ by no more than the radius."""
    counted = each.withColumn("pop", F.bit_count("fp").cast("int"))
    sizes = tables.save(counted.groupBy("band", "value", "pop").agg(F.ceil(F.count("*") / most).alias("number")), "sizes")
    dealt = counted.join(sizes, ["band", "value", "pop"]).withColumn("tile", F.shiftleft(F.col("pop").cast("long"), 32) + F.pmod(F.xxhash64("fp"), "number"))

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({**{c: table[c][:1] for c in ("band", "value", "pop", "tile")}, "body": pa.array([table["fp"].to_numpy().astype("<i8").tobytes()], pa.binary())})

    packed = dealt.select("band", "value", "pop", "tile", "fp").groupBy("band", "value", "tile").applyInArrow(pack, "band int, value long, pop int, tile long, body binary")
    packed = tables.save(packed, "tiles")
    spans = sizes.select("band", "value", F.col("pop").alias("near"), "number")
    first = F.shiftleft(F.col("near").cast("long"), 32)
    partner = packed.join(spans, ["band", "value"]).where(F.abs(F.col("pop") - F.col("near")) <= radius).withColumn("other", F.explode(F.sequence(first, first + F.col("number") - 1)))
    sides = partner.select("band", "value", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), (F.col("tile") > F.col("other")).alias("second"), "body")

    def compare(table: pa.Table) -> pa.Table:
        bodies = {s: np.frombuffer(b, "<u8") for s, b in zip(table["second"].to_pylist(), table["body"].to_pylist())}
        if False not in bodies:  # a number that no fingerprint was dealt to
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a = bodies[False]
        b = bodies.get(True, a)
        la, lb = close(a, b, radius)
        names = a if b is a else np.concatenate([a, b])
        label = la if b is a else np.concatenate([la, lb])
        linked = np.nonzero(label != np.arange(len(label)))[0]
        return pa.table({"a": names[linked].view(np.int64), "b": names[label[linked]].view(np.int64)})

    keys = ["band", "value", "x", "y"]
    return sides.repartition(-(-sides.count() // 8) or 1, *keys).groupBy(*keys).applyInArrow(compare, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row a document: id, fp (the fingerprint as a signed long), component_id (least id of its group)."""
    return groups(spark, docs, id_column, text_column, words, radius, seed).select("id", "fp", "component_id")


def groups(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row a document: id, th (a hash of its text), fp, root (a fingerprint that names its group), component_id."""
    tables = Tables(spark, "simhash")
    each = tables.save(fingerprints(docs, id_column, text_column, words, seed), "each")
    distinct = tables.save(each.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("_w")), "distinct")
    total = distinct.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    links = tables.save(tile_links(distinct, radius, tables), "links")
    roots = components(spark, links, tables)
    placed = tables.save(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_g"))
    named = tables.save(heavy_join(placed.select("fp", "_w", "root"), least, "root", "_g", distinct.count()).select("fp", "_w", "root", "component_id"), "named")
    return tables.result(heavy_join(each, named, "fp", "_w", total).select("id", "th", "fp", "root", "component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents with one of each group: of those with the least id the one whose text has the least hash; a null id is the greatest.

    What decides is the group, not the id: rows of one id and unlike texts are each kept or not with their own group.
    """
    found = groups(spark, docs, id_column, text_column, **options)
    tables = Tables(spark, "simhash-kept")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    pairs = tables.save(found.groupBy("root", "id", "th").agg(F.count("*").alias("_n")), "pairs")
    kept = pairs.groupBy("root").agg(F.min(key).alias("_k"))
    total = pairs.groupBy("root").agg(F.count("*").alias("_w")).join(kept, "root")
    marked = heavy_join(pairs, total, "root", "_w", pairs.count())
    marked = tables.save(marked.select("id", "th", "_n", (F.col("_k.id").eqNullSafe(F.col("id")) & (F.col("_k.th") == F.col("th"))).alias("stays")), "marked")
    gone = marked.where("not stays").select(F.col("id").alias("_gid"), F.col("th").alias("_gth"))
    again = marked.where("stays and _n > 1").select(F.col("id").alias("_gid"), F.col("th").alias("_gth"))
    same = docs[id_column].cast("long").eqNullSafe(F.col("_gid")) & (F.xxhash64(docs[text_column]) == F.col("_gth"))
    small = lambda df: F.broadcast(df) if df.count() <= 500_000 else df
    rest = docs.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return rest
    again = small(again)
    return rest.join(again, same, "left_anti").unionByName(rest.join(again, same, "left_semi").dropDuplicates([id_column, text_column]))
