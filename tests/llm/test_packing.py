from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def check(spark, docs, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packing.pack(spark, docs, PATH, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r.length for r in rows)


def test_pieces_and_places(spark, prose):
    used, tokens = check(spark, prose)
    assert used <= -(-tokens // 2048) + 1
    used, tokens = check(spark, prose, 64)
    assert used <= 1.02 * tokens / 64 + 2


def test_odd_rows(spark, odd, none):
    check(spark, odd)
    assert packing.pack(spark, none, PATH).count() == 0


def test_words_are_encoded_as_whole_texts_are():
    words, r = packing.Words(PATH), random.Random(2)
    alphabet = [*"abcXYZ019 \t\n\x0b.,!'’s<|>é́ΣσİIßÉ語𝟘½ \x85\x1c　-_%*", "<|endoftext|>", "'s ", "'ll", "<|startoftext|>", "d'", "̸", "<|EndOfText|>", "thing,", "école!!"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(words.encode([text], 0)[0], "<u4").tolist() == [*words.tokenizer.encode(text, add_special_tokens=False).ids, 0], text


def ids_of(words, text):
    return [*words.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_batches_are_encoded_as_their_texts_are(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    words, r = packing.Words(PATH), random.Random(3)
    parts = ["the", "cat", "Ab1", "a", "1", "é", "École", "ß", "語", ",", ".", "...", "$$$", "'", "'s", "!?", " ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", "<", "|", "<|endoftext|>", "\ud800"]
    for n in range(300):
        some = parts if n % 3 == 0 else parts[:-3]
        texts = ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 6))] + [None, "", "  "][: r.randint(0, 3)]
        want = [ids_of(words, t and t.encode("utf-8", "replace").decode()) for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts, 0)] == want, texts
    assert words.encode([], 0) == [] and words.encode(["", None], 5) == [b"\5\0\0\0"] * 2


def test_words_met_again_are_encoded_once(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 400)
    words, r, asked = packing.Words(PATH), random.Random(4), Counter()
    add = words._add
    monkeypatch.setattr(words, "_add", lambda some: asked.update(some) or add(some))
    often = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(100)]
    for _ in range(30):
        once = ["".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(100)]
        words.encode([" ".join(w + r.choice(["", ",", "..."]) for w in [*often, *once])], 0)
        assert len(words.ids) <= 400 + 203
    assert max(asked[w.encode()] for w in often) == 1


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {10: 7}, {6: 10, 5: 10, 4: 10}, {10: 2, 9: 3, 1: 4}])
def test_solutions_hold_everything_once(histogram):
    solution = packing.solve(histogram, 10)
    held = Counter()
    for config, times in solution.items():
        assert sum(n * k for n, k in config) <= 10
        for n, k in config:
            held[n] += k * times
    assert held == Counter(histogram)
    least = -(-sum(n * k for n, k in histogram.items()) // 10)
    assert sum(solution.values()) <= max(least + 1, sum(k for n, k in histogram.items() if n > 5))


def fewest(pieces, capacity):
    """The least number of sequences, by trying all ways to fill them."""
    best = {}

    def least(left):
        if not left:
            return 0
        if left not in best:
            fills = [((), 0)]
            for i, n in enumerate(left[1:]):
                fills += [((*f, i), size + n) for f, size in fills if size + n + left[0] <= capacity]
            best[left] = 1 + min(least(tuple(n for i, n in enumerate(left[1:]) if i not in f)) for f, _ in fills)
        return best[left]

    return least(tuple(sorted(pieces, reverse=True)))


def test_solutions_near_exact_ones():
    r = random.Random(5)
    for _ in range(60):
        pieces = [r.randint(1, 12) for _ in range(r.randint(1, 9))]
        found = sum(packing.solve(dict(Counter(pieces)), 12).values())
        exact = fewest(pieces, 12)
        assert exact <= found <= exact + 1 and found <= sum(packing.best_fit(dict(Counter(pieces)), 12).values())


@pytest.mark.parametrize("times", [1, 40, 5000])
def test_linear_program_covers_and_its_configurations_place_nearly_all(times):
    r, capacity = random.Random(6), 512
    histogram = Counter(min(capacity - 1, 1 + int(r.gammavariate(1.5, 90))) for _ in range(3000))
    histogram = {n: k * times for n, k in histogram.items()}
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in lengths.tolist()])
    amount = packing.fractional(lengths, demand, capacity)
    covered = Counter()
    for config, x in amount.items():
        assert x > 0 and sum(n * k for n, k in config) <= capacity
        for n, k in config:
            covered[n] += x * k
    assert sum(covered.values()) >= 0.99 * demand.sum() and all(covered[n] <= histogram[n] + 1e-6 for n in histogram)
    material = sum(n * x for n, x in covered.items()) / capacity
    assert sum(amount.values()) <= 1.01 * material  # no configurations can do with fewer
    begun, left = packing.rounded(amount, histogram, packing.KEPT[-1])
    assert sum(t * k for c, t in begun.items() for _, k in c) >= 0.9 * demand.sum()
    solution = packing.solve(histogram, capacity)
    alone = sum(packing.best_fit(histogram, capacity).values())
    bound = -(-int(lengths @ demand) // capacity)
    assert bound <= sum(solution.values()) <= min(alone, bound + 1 + bound // 1000)
