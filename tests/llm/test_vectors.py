from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import embeddings, neighbours
from tidemark.llm.shared import least_labels

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def vectors(spark):
    """600 vectors in three labels; copies, near copies in a clump, scaled copies, and some that take no part."""
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 16)).astype(np.float32)
    for i in range(100, 220):
        x[i] = x[5] + r.normal(scale=0.06, size=16).astype(np.float32)
    x[300:330] = x[7]
    x[400:410] = 3 * x[9]
    rows = [(i, v.tolist(), None if i % 97 == 3 else i % 3) for i, v in enumerate(x)]
    odd = [(601, None, 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, [None, *[1.0] * 15], 1), (605, [], 1), (606, [1.0, 2.0], 1), (607, [1.0, 2.0], 1), (None, x[7].tolist(), 1), (7, x[7].tolist(), 1), (608, [float("inf"), *[1.0] * 15], 0), (609, [1e-200, 0.0], 1)]
    return spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS node", "4 AS q", "5 AS copies")


def good(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


@pytest.mark.parametrize("tile", [4096, 40])
def test_links_equal_brute_force(spark, vectors, tile, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v) and y is not None else None for _, v, y in rows]
    a, b = np.nonzero(np.array([[i < j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 for j in range(n)] for i in range(n)]))
    links = np.bincount(np.concatenate([a, b]), minlength=n)
    label = least_labels(n, a, b)
    least = {}
    for i in range(n):
        ids = [rows[j][0] for j in np.nonzero(label == label[i])[0] if rows[j][0] is not None]
        least[i] = min(ids) if ids else None
    want = sorted(((rows[i][0], int(links[i]), least[i], rows[i][0] == least[i]) for i in range(n)), key=repr)
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark, vectors).collect()), key=repr)
    assert got == want and links.max() > 20


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embeddings.near_duplicates(spark, none).count() == 0
    assert neighbours.nearest(spark, none, none.vec_id % 20 == 0).count() == 0


@pytest.mark.parametrize("block, again", [(16_384, 320), (100, 60)])
def test_search_against_brute_force(spark, vectors, block, again, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", block)
    monkeypatch.setattr(neighbours, "CANDIDATES_LEAST", block)
    monkeypatch.setattr(neighbours, "QUERIES", 10)
    got = {}
    for r in neighbours.nearest(spark, vectors, vectors.vec_id % 20 == 0, again=again).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect() if good(r.embedding) and r.vec_id is not None]
    hit = total = 0
    for i, q in rows:
        if i % 20:
            continue
        want = sorted(((-float(v @ q), j) for j, v in rows if j != i and len(v) == len(q)))[:20]
        found = sorted(got[i])
        assert [k for k, _, _ in found] == list(range(1, len(want) + 1))
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hit += len({j for _, j, _ in found} & {j for _, j in want})
        total += len(want)
    assert hit / total >= 0.95


@pytest.mark.parametrize("noise", [0.0, 1e-6, 0.02])
def test_search_in_a_group_larger_than_what_is_ranked_again(noise):
    """A third of a block are copies or near copies, in any row order: the result is that of brute force, ties to smaller ids."""
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 16))
    x[:1000] = x[0] + noise * r.normal(size=(1000, 16))
    ids = r.permutation(3000)
    ids[50] = ids[51]  # a repeated id
    model = neighbours.Quantiser(x[:2000])
    asked = [*range(8), *range(2000, 2008)]
    got = neighbours.scan(model, ids, x, *model.coded(x), ids[asked], x[asked], 20, 320)
    for i in asked:
        exact = (x * x[i]).sum(axis=1)
        want = sorted((-s, j) for s, j in zip(exact.tolist(), ids.tolist()) if j != ids[i])[:20]
        some = got["query_id"] == ids[i]
        assert list(zip((-got["score"][some]).tolist(), got["vec_id"][some].tolist()))[:20] == want, i


def test_anisotropic_loss_lowers_the_parallel_residual():
    x = np.random.default_rng(1).normal(size=(2000, 32))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(model):
        codes = model.encode(x)
        back = np.concatenate([model.centres[j][codes[:, j]] for j, _ in enumerate(model.cuts)], axis=1)
        return (((x - back) * u).sum(axis=1) ** 2).mean()

    aware = neighbours.Quantiser(x)
    plain = neighbours.Quantiser.__new__(neighbours.Quantiser)
    plain.__dict__ |= aware.__dict__ | {"more": 0.0}
    assert parallel(aware) < parallel(plain)


@pytest.mark.parametrize("noise", [0.0, 1e-5, 0.02, 0.2])
def test_half_precision_loses_no_pair_within_the_budget(noise):
    r = np.random.default_rng(4)
    blocks = embeddings.Blocks(64, 0.98, 1)
    x = r.normal(size=(400, 64))
    x[200:] = x[:200] + noise * r.normal(size=(200, 64))
    y = embeddings.unit(x) @ blocks.rotation
    for j, (a, b) in enumerate(blocks.cuts):
        part = y[:, a:b]
        exact = ((part[:200, None] - part[None, 200:]) ** 2).sum(axis=2) <= blocks.budget[j] * (1 + embeddings.SLACK)
        some, other = embeddings.near(part[:200].astype("<f2"), np.zeros(200), part[200:].astype("<f2"), np.ones(200), blocks.budget[j])
        assert not (exact.any(axis=1) & ~some).any() and not (exact.any(axis=0) & ~other).any()
        assert some.sum() <= exact.any(axis=1).sum() + 20
