from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.shared import Tables, components, least_labels


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def expected(rows):
    f = np.array([brute(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 4
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            break
        label = new
    out = []
    for i, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.nonzero(label == label[i])[0] if rows[j][0] is not None]
        out.append((name, int(f[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [2048, 16])
def test_equals_brute_force(spark, prose, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_LEAST", tile)
    found = sorted(((r.id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark, prose).collect()), key=repr)
    assert found == expected([(r.doc_id, r.text) for r in prose.collect()])
    assert any(c != i for i, _, c in found)


def test_odd_rows(spark, odd, none):
    found = sorted(((r.id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark, odd).collect()), key=repr)
    assert found == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(spark, none).count() == 0


def test_one_of_each(spark, odd, none, prose):
    kept = simhash.one_of_each(spark, odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 6 in ids and 7 in ids
    assert simhash.one_of_each(spark, none).count() == 0
    want = {c for _, _, c in expected([(r.doc_id, r.text) for r in prose.collect()])}
    assert {r.doc_id for r in simhash.one_of_each(spark, prose).collect()} == want


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(links, "a long, b long"), Tables(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert least_labels(4, np.array([3, 2]), np.array([2, 1])).tolist() == [0, 1, 1, 1]


def test_one_of_each_group_whatever_the_ids(spark):
    long, other, third = (" ".join(f"{c}{i}" for i in range(80)) for c in "wvu")
    docs = spark.createDataFrame([(1, long), (2, long), (2, other), (2, other), (3, other), (None, third), (None, third), (None, long)], "doc_id long, text string").withColumn("id", F.lit(0))
    got = sorted((repr(r.doc_id), r.text[0]) for r in simhash.one_of_each(spark, docs).collect())
    assert got == [("1", "w"), ("2", "v"), ("None", "u")]


def linked(fps, radius):
    """The least index reachable from each, by all pairs."""
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= radius)
    return least_labels(len(fps), a, b)


def near(seed, n, centres):
    """Distinct fingerprints around few centres, and as many anywhere."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, centres, np.uint64)[r.integers(0, centres, n)]
    for _ in range(6):
        base = base ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
    return np.unique(np.concatenate([base, r.integers(0, 2**64, n, np.uint64), np.array([0, 2**64 - 1], np.uint64)]))


def test_few_pairs_are_compared(monkeypatch):
    fps, compared, close = np.random.default_rng(3).integers(0, 2**64, 100_000, np.uint64), [], simhash.close
    fps[1::1000] = fps[::1000] ^ np.uint64(0b1000000000000100000000000001000000000001)
    monkeypatch.setattr(simhash, "close", lambda a, b, radius: compared.append(len(a) * len(b)) or close(a, b, radius))
    found = [simhash.banded(fps, band, 4) for band in simhash.bands(4)]
    assert {frozenset(x) for a, b in found for x in zip(a.tolist(), b.tolist())} >= {frozenset(x) for x in zip(fps[::1000].tolist(), fps[1::1000].tolist())}
    assert sum(compared) < len(fps) ** 2 / 1000


@pytest.mark.parametrize(("radius", "least", "most"), [(4, 2048, 1 << 16), (4, 16, 32), (4, 64, 64), (0, 16, 32), (1, 16, 32), (9, 16, 32)])
def test_tiles_and_groups_larger_than_a_tile(spark, radius, least, most, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_LEAST", least)
    monkeypatch.setattr(simhash, "TILE_MOST", most)
    fps = near(radius, 400, 3)
    links = simhash.tile_links(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long"), radius, Tables(spark, "t")).collect()
    at = {x: i for i, x in enumerate(fps.view(np.int64).tolist())}
    a, b = (np.array([at[r[c]] for r in links], np.int64) for c in ("a", "b"))
    assert (least_labels(len(fps), a, b) == linked(fps, radius)).all()
