from __future__ import annotations

import pytest

pytest.importorskip("tidemark.llm")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    long = "lorem ipsum dolor sit amet consectetur " * 4000
    rows = [
        (1, "the cat sat on the mat and then the cat went home", "en", "a"),
        (1, "the cat sat on the mat and then the cat went home", "en", "a"),
        (2, "the cat sat on the mat and then the cat went home", "en", None),
        (3, None, None, "b"),
        (4, "", "en", "b"),
        (5, " \t\n ", None, "a"),
        (None, "le chat est sur la table avec les enfants", "fr", "c"),
        (None, None, None, None),
        (6, long, "la", "a"),
        (7, "!!! 123 ###", "en", "c"),
        (8, "le chat est sur la table avec les enfants", "fr", "b"),
        (9, "퟿ é ß 語 password = abc123def token: x", "de", "b"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    # names that operators use within
    return df.selectExpr("*", "1 AS id", "2 AS size", "3 AS h", "4 AS fp", "5 AS target", "6 AS n", "7 AS label", "8 AS key", "9 AS score")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def prose(spark):
    """500 documents of made-up words with copies, near copies, a shared passage and secrets."""
    import random

    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    french = [w + "é" for w in words]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for i in range(500):
        lang = "fr" if i % 3 == 0 else "en"
        body = [r.choice(french if lang == "fr" else words) for _ in range(r.randint(5, 150))]
        if i % 11 == 5 and i > 20:
            body, lang = rows[i - 7][1].split(" "), rows[i - 7][2]
        if i % 13 == 4 and i > 20:
            body, lang = rows[i - 9][1].split(" "), rows[i - 9][2]
            body[r.randrange(len(body))] = "changed"
        if i % 50 == 7:
            body[2:2] = passage.split(" ")
        if i % 25 == 3:
            body.insert(3, "password=" + "".join(r.choice("0123456789abcdef") for _ in range(18)))
        rows.append((i, " ".join(body), lang, f"s{i % 5 if i % 3 else 0}", 0))
    return spark.createDataFrame(rows, DOCS)
