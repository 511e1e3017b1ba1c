from __future__ import annotations

import re
from collections import defaultdict

from tidemark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict, total=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, stopped = total * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return stopped | share
        for s in over:
            stopped[s] = most * sizes[s]
            left -= stopped[s]


def check(spark, docs):
    rows = mixing.mix(spark, docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.times * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    return rows, want, taken, largest


def test_targets_and_taken_words(spark, prose):
    rows, want, taken, largest = check(spark, prose)
    assert len(rows) == 500
    for s in want:
        assert abs(taken[s] - want[s]) <= max(2, 0.003 * want[s])
    again = {(r.id, r.taken) for r in mixing.mix(spark, prose.repartition(7)).collect()}
    assert again == {(r.id, r.taken) for r in rows}


def test_odd_rows(spark, odd, none):
    rows, _, _, _ = check(spark, odd.select("doc_id", "text", "source", "size", "h", "n", "target"))
    assert len(rows) == odd.count()
    assert mixing.mix(spark, none).count() == 0


def test_of_equal_rows_as_many_are_taken_as_the_budget_holds(spark):
    """1,000 equal rows of one source, and a source where the one more document is one of many equal ones."""
    rows = [(1, "ten words " * 5, "en", "a", 0)] * 1000 + [(i, "one two three", "en", "b", 0) for i in range(2, 900)] + [(9000, "w " * 500, "en", "c", 0)] * 7 + [(9001 + i, "w " * (300 + i), "en", "c", 0) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    found, want, taken, largest = check(spark, docs)
    for s in want:
        assert abs(taken[s] - want[s]) <= max(largest[s] / 2, 0.01 * want[s])
    assert abs(taken["a"] - want["a"]) <= 0.01 * want["a"] and {r.times for r in found if r.id == 1} <= {0, 1, 2}
    again = sorted((r.id, r.times) for r in mixing.mix(spark, docs.repartition(3)).collect())
    assert again == sorted((r.id, r.times) for r in found)
    repeated = defaultdict(int)
    for r in mixing.repeat(spark, docs).collect():
        repeated[r.doc_id] += 1
    times = defaultdict(int)
    for r in found:
        times[r.id] += r.times
    assert dict(repeated) == {i: n for i, n in times.items() if n}


def test_sql_agrees_where_rows_repeat(spark, tmp_path):
    import duckdb

    from tidemark.llm import queries

    rows = [(i % 40, "a b c d e f g"[: 1 + 2 * (i % 5)], "en", "abc"[i % 40 % 3], 0) for i in range(400)] + [(None, None, None, None, 0), (50, "x y", None, None, 0)] * 3
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    want = sorted(db.sql(queries.ORACLES["op1_mix_sources"]).fetchall(), key=key)
    got = sorted((tuple(r) for r in queries.op1_mix_sources(spark, str(tmp_path)).collect()), key=key)
    assert len(got) == 406 and got == want


def test_thresholds_are_nested(spark, prose):
    low = {(r.id, r.source): r.times for r in mixing.mix(spark, prose, total=0.4).collect()}
    high = {(r.id, r.source): r.times for r in mixing.mix(spark, prose, total=0.8).collect()}
    lost = [source for (_, source), n in low.items() if high[_, source] < n]
    assert len(lost) == len(set(lost))  # the one more of a source at most


def test_repeat_gives_the_rows_themselves(spark, prose, odd, none):
    times = {r.id: r.times for r in mixing.mix(spark, prose).collect()}
    found = mixing.repeat(spark, prose)
    assert found.columns == prose.columns
    counts = defaultdict(int)
    for r in found.collect():
        counts[r.doc_id] += 1
    assert {k: n for k, n in times.items() if n} == dict(counts)
    assert set(mixing.repeat(spark, odd).columns) == set(odd.columns)
    assert mixing.repeat(spark, none).count() == 0
