from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm, quality
from tidemark.llm.shared import crc_mod


@pytest.fixture
def marked(spark, prose):
    """Half of the documents are spoilt: shouted, or one word again and again."""
    bad = F.when(F.col("doc_id") % 4 == 0, F.upper("text")).when(F.col("doc_id") % 4 == 1, F.repeat(F.concat(F.substring_index("text", " ", 1), F.lit(" ")), 60)).otherwise(F.col("text"))
    return prose.withColumn("text", bad), prose.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 0).otherwise(1).alias("quality"))


def test_quality_of_held_out_documents(spark, marked):
    docs, labels = marked
    model = quality.learn(spark, docs, labels, crc_mod("doc_id", 5) != 0)
    rows = quality.scored(spark, docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").where("crc32(cast(cast(id as string) as binary)) % 5 = 0").collect()
    assert len(rows) > 60 and sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows) > 0.9
    again = quality.learn(spark, docs.repartition(5), labels, crc_mod("doc_id", 5) != 0)
    assert abs(again.filters - model.filters).max() == 0


def test_scores_equal_a_loop_over_chunks_and_filters(marked, odd):
    docs, labels = marked
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.limit(60).collect()
    model = quality.Network().fit([quality.chunks(r.text) for r in rows], np.array([marks[r.doc_id] for r in rows], float))
    texts = [r.text for r in rows[:12]] + [None, "", "é語", "x" * 113] + [r.text[:3000] for r in odd.collect() if r.text]

    def plain(text):
        b = list((text or "").encode())
        last = max(0, len(b) - quality.CHUNK)
        best = []
        for start in [*range(0, last, quality.STRIDE), last]:
            row = [b[start + k] if start + k < len(b) else quality.PAD for k in range(quality.CHUNK + quality.WIDTH - 1)]
            best.append([max(sum(float(model.filters[k, row[at + k], f]) for k in range(quality.WIDTH)) for at in range(quality.CHUNK)) for f in range(quality.FILTERS)])
        columns = list(zip(*best))
        x = [*map(max, columns), *(sum(c) / len(c) for c in columns), *map(min, columns), min(len(b), quality.CHUNK) / quality.CHUNK]
        hidden = [math.tanh(sum(a * w for a, w in zip(x, model.w1[:, j])) + model.b1[j]) for j in range(quality.HIDDEN)]
        return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, model.w2)) + model.b2[0])))

    assert model.scores(texts) == pytest.approx([plain(t) for t in texts], abs=1e-4)


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i % 50, "ab " * (i % 50 + 1)) for i in range(2000)] + [(50, "z" * 90_000)], "id long, text string")
    known = spark.range(51).selectExpr("id", "cast(id % 2 as int) AS label")
    whole = quality.sample(docs, known, 100, 1_000_000)
    assert len(whole) == 51  # however often a row is repeated
    assert len(quality.sample(docs, known, 20, 1_000_000)) <= 20
    small = quality.sample(docs, known, 100, 3000)
    assert 0 < sum(len(t) for t, _ in small) <= 3000 and all(len(t) % 3 == 0 for t, _ in small)


def test_chunks_cover_every_byte():
    for n in (0, 1, quality.CHUNK, quality.CHUNK + 1, 1000):
        rows = quality.chunks("x" * n)
        covered = set()
        for at in [*range(0, max(0, n - quality.CHUNK), quality.STRIDE), max(0, n - quality.CHUNK)]:
            covered |= set(range(at, at + quality.CHUNK))
        assert set(range(n)) <= covered and rows.shape[1] == quality.CHUNK + quality.WIDTH - 1


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (6, 1), (9, 0), (9, 1), (7, 5)], "doc_id long, quality int")
    model = quality.learn(spark, odd, labels)
    rows = quality.scored(spark, odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = quality.learn(spark, odd, labels.limit(0))
    assert {r.score for r in quality.scored(spark, odd, empty).collect()} == {0.5}
    assert quality.scored(spark, none, model).count() == 0


def model_of(rows):
    uni, pair = Counter(), Counter()
    for words, train in rows:
        if train:
            uni.update(words)
            pair.update(zip([None, *words[:-1]], words))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)

    def p(h, w):
        x = float(lm.weight_of(np.array([uni[h]]))[0])
        return x * pair[h, w] / uni[h] + (1 - x) * p1(w) if uni[h] else p1(w)

    return uni, n, v, p1, p


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


@pytest.mark.parametrize("block, bucket, group", [(3_000_000, 500_000, 4096), (2000, 300, 4096), (2000, 300, 4)])
def test_scores_equal_brute_force(spark, prose, odd, block, bucket, group, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    monkeypatch.setattr(lm, "GROUP", group)
    for docs in (prose, odd):
        got = lm.score(spark, docs, crc_mod("doc_id", 7) != 2).collect()
        rows = [(r.doc_id, words_of(r.text), zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2) for r in docs.collect()]
        uni, n, v, p1, p = model_of([(w, t) for _, w, t in rows])
        want = sorted((str(i), t, len(w), sum(uni[x] > 0 for x in w), round(sum(math.log10(p1(x)) for x in w), 6), round(sum(math.log10(p(h, x)) for h, x in zip([None, *w[:-1]], w)), 6)) for i, w, t in rows)
        have = sorted((str(r.id), r.train, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
        assert len(have) == len(want)
        for a, b in zip(sorted(have, key=lambda x: (x[0], x[2], round(x[4], 3))), sorted(want, key=lambda x: (x[0], x[2], round(x[4], 3)))):
            assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 * max(1, abs(b[4])) and abs(a[5] - b[5]) < 1e-5 * max(1, abs(b[5]))
        assert {r.train_tokens for r in got} == {n}
        # the weights of all continuations of a state sum to one, a word never seen among them
        for h in [None, *list(uni)[:5]]:
            assert abs(sum(p(h, w) for w in uni) + p(h, "never seen") - 1) < 1e-9


def test_lm_empty(spark, none, odd):
    assert lm.score(spark, none, F.lit(True)).count() == 0
    assert {r.n_known for r in lm.score(spark, odd, F.lit(False)).collect()} == {0}


def test_automaton_backs_off():
    m = lm.Automaton(3, {0 * 3 + 1: -0.5}, [-0.1, -0.2, 0.0], [-1.0, -2.0, -3.0])
    assert m.traverse([1, 2, 0]) == pytest.approx(-0.5 + (-0.2 - 3.0) + (0.0 - 1.0))
