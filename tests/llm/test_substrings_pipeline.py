from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries, substrings

DOCS = "doc_id long, text string"


def test_boundaries_fall_in_step_after_an_insertion():
    r = random.Random(5)
    body = "".join(r.choice("abcdefghij klmnop") for _ in range(5000)).encode()
    ends = substrings.boundaries(np.frombuffer(body, np.uint8))
    assert ends[-1] == 5000 and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= substrings.MOST + substrings.LEAST
    moved = substrings.boundaries(np.frombuffer(body[:700] + b"xyz" + body[700:], np.uint8)) - 3
    assert len(set(ends[ends > 1000].tolist()) - set(moved.tolist())) <= 1
    flat = substrings.boundaries(np.frombuffer(b"a" * 3000, np.uint8))
    assert flat[-1] == 3000


def test_passages_are_found_and_clean_documents_left_alone(spark, prose):
    rows = {r.doc_id: r.text for r in prose.collect()}
    found = {}
    for r in substrings.repeated(spark, prose).collect():
        assert r.first_id < r.id and r.words >= 25 and 0 <= r.start < r.end <= len(rows[r.id].encode())
        found.setdefault(r.id, []).append(r)
    seen = {}
    for i in sorted(rows):
        w = rows[i].split()
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        if any(x in seen for x in windows):
            assert i in found, i
        for x in windows:
            seen.setdefault(x, i)
    short = {}
    for i in sorted(rows):  # no run of 12 words from an earlier document: nothing to report
        w = rows[i].split()
        parts = [tuple(w[k : k + 12]) for k in range(len(w) - 11)]
        if not any(x in short for x in parts):
            assert i not in found, i
        for x in parts:
            short.setdefault(x, i)


def test_every_passage_of_enough_words_is_found_whole(spark):
    """Passages of 25 to 80 words in other surroundings, wherever chunks end, some of them of several earlier documents."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    rows, want = [], {}
    for i in range(0, 1200, 3):
        n = 24 if i % 60 == 0 else 25 + i % 56
        passage = some(n)
        rows.append((i, " ".join(some(r.randint(0, 60)) + passage + some(r.randint(0, 60)))))
        rows.append((i + 1, " ".join(some(r.randint(0, 60)) + passage[: n // 2] + some(40))))  # part of it alone
        head = some(r.randint(0, 60))
        rows.append((i + 2, " ".join([*head, *passage, *some(r.randint(0, 60))])))
        if n >= 25:
            a = len(" ".join([*head, ""])) if head else 0
            want[i + 2] = (a, a + len(" ".join(passage)), i)
    found = {}
    for x in substrings.repeated(spark, spark.createDataFrame(rows, DOCS)).collect():
        found.setdefault(x.id, []).append(x)
    for i, (a, b, first) in want.items():
        assert any(x.start <= a and x.end >= b and x.first_id <= first and x.words >= 25 for x in found.get(i, [])), (i, a, b, found.get(i))
    assert all(i % 3 == 2 and i in want or i % 3 == 1 and (i - 1) % 56 >= 24 for i in found)


def test_substrings_odd_rows(spark, odd):
    text = "one two three four five six seven eight nine ten eleven twelve " * 5
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + "and more"), (None, text), (3, None), (4, "")], DOCS).withColumn("at", F.lit(1)).withColumn("id", F.lit(9))
    got = substrings.repeated(spark, docs).collect()
    assert [(r.id, r.first_id) for r in got] == [(2, 1)]
    cut = {r.doc_id: r.text for r in substrings.removed(spark, docs).collect()}
    assert cut[1] == text and cut[3] is None and len(cut[2]) < 60
    assert substrings.repeated(spark, docs.limit(0)).count() == 0
    assert {(r.id, r.first_id) for r in substrings.repeated(spark, odd).collect()} == set()
    same = spark.createDataFrame([(1, "du " * 90), (2, "x y z " + "du " * 90), (3, "la di " * 30), (4, "one " + "la di " * 31)], DOCS)
    assert {(r.id, r.first_id) for r in substrings.repeated(spark, same).collect()} == {(2, 1), (4, 3)}


def test_stages_equal_plain_python(spark, prose, odd, tmp_path):
    """Each stage on what the one before it gave, odd rows among them, against a brute-force version."""
    import duckdb
    from test_language_secrets import by_hand, plain_language
    from test_packing import check
    from test_simhash import expected

    from tidemark.llm import secrets

    docs = prose.union(odd.select(prose.columns).withColumn("doc_id", F.col("doc_id") + 1000))
    key = lambda r: repr(tuple(r)[:4])

    def apply(number):
        corpus_pipeline.STAGES[number][1](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{number}")
        return spark.read.parquet(f"{tmp_path}/stage{number}")

    before, docs = docs.collect(), apply(0)
    predict = plain_language([(r.text, r.lang) for r in before])
    want = [r for r in before if (p := predict(r.text))[0] != "und" and p[1] >= 0.5]
    assert sorted(map(key, docs.collect())) == sorted(map(key, want)) and 100 < len(want) < len(before)

    before, docs = docs.collect(), apply(1)
    least = {(i, fp): component for i, fp, component in expected([(r.doc_id, r.text) for r in before])}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == sorted({(c is None, c or 0) for c in least.values()})

    before = docs.collect()
    formats, docs = secrets.learn(spark, docs), apply(2)
    want = []
    for r in before:
        spans = secrets.base_spans(r.text)
        spans += [(kind, a, b, a) for a, b in secrets.candidates(r.text, spans) if (kind := by_hand(formats, r.text[a:b]))]
        text = r.text
        for inner, end in sorted({(i, e) for _, _, e, i in spans}, reverse=True):
            text = text[:inner] + "[secret]" + text[end:]
        want.append((r.doc_id, text, r.lang, r.source))
    assert sorted(map(key, docs.collect())) == sorted(map(key, want)) and any("[secret]" in w[1] for w in want)

    docs = apply(3)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/stage2/*.parquet')")
    times = {i: max(n, size == 0) for i, size, n in db.sql(f"SELECT doc_id, size, times FROM ({queries.ORACLES['op1_mix_sources']})").fetchall()}
    came = {}
    for r in docs.collect():
        came[r.doc_id] = came.get(r.doc_id, 0) + 1
    assert came == {i: n for i, n in times.items() if n}
    used, tokens = check(spark, docs)
    assert used <= -(-tokens // 2048) + 1


def test_pipeline(spark, prose, odd, tmp_path):
    prose.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {r.doc_id for r in rows} <= set(range(500))
    docs = prose
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        rows_out = docs.collect()
        docs = spark.createDataFrame(rows_out, prose.schema)
    assert not any("password=0" in r.text for r in rows_out)
    out = corpus_pipeline.STAGES[0][1](spark, odd.select(prose.columns), "")
    assert {3, 4, 5, 7}.isdisjoint(r.doc_id for r in out.collect())


def test_pipeline_of_nothing(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
