"""Secret scanning with inferred formats.

Three fixed patterns find the base spans.  Credentials that they match in any
document are the labelled examples; formats are inferred from a bounded number of
each kind, by hash, each example whole.  The examples of a kind become a prefix tree
with counts, and states that agree statistically are merged into a probabilistic
automaton: first states of equal depth, so that what follows a random character is
pooled while literal parts, lengths and formats of their own stay apart; then states of
different depths, where enough examples pass through both.  Two states agree if neither the
share of a next character, of a class of characters or of the end, nor the
distribution of the characters still to come differ by more than Hoeffding's bound, and so
on along common arcs.  Each state gives probabilities to all characters and to the end.

Two further automata are inferred in the same way from ordinary words that no pattern
matches, those with digits and those without apart.  Every other word of every
document, of at least the shortest length that a pattern takes, is then scored: the
log-likelihood of the best format, over that of ordinary words and over that of any
word by its classes of characters.  Those over a threshold are added as spans of kind
``like_<kind>``.

Defined cases: a null or empty text has no spans; without examples of a kind
that kind adds no spans, and with few its format allows little but these; examples
over EXAMPLE_MOST characters teach nothing, but are found and scored as others; of formats of equal
likelihood the kind listed first wins; very long texts are scanned whole, in time in
proportion to their length; repeated rows give one result each; an empty table
gives an empty result; columns of other names play no part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import inf, lgamma, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, map_arrow

KINDS = ("assign", "access", "hex")
# The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of the shortest secret that a pattern can match, so of a word that a format can be of.
LEAST = 6
WORD = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Bounds of what is learned from: documents for ordinary words (a share by hash), examples a kind, characters of an example.
SAMPLE_DOCUMENTS, EXAMPLES, EXAMPLE_MOST = 20_000, 400, 1024
#: Log-likelihood over ordinary words that a candidate must reach, in nats a character and in all.
MARGIN_EACH, MARGIN = 0.3, 6.0
#: Risk of the bound at which states differ, and examples through each of two states of different depths that may be merged.
ALPHA, LOOPS = 0.05, 24
#: Examples of a kind that look alike and have an automaton of their own, at least.
SUBFORMAT = 8
#: Characters of candidates by class, and the class of each.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_.=-")
MARKS = 3
CLASS = {c: i for i, some in enumerate(CLASSES) for c in some}
#: How many examples what is known of classes and of a kind as a whole may count for in a state.
WEIGHTS = (0.1, 0.3, 1, 3, 10, 30, 100, 300, 1000)
#: Chances that the next character of any word is of the class of the one before, and of another class.
SAME, OTHER = 0.9, 0.1 / 3


def base_spans(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), leftmost and non-overlapping in each kind."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return found


def order(spans: list[tuple]) -> list[tuple]:
    """By start, then kind as listed, those of the formats last."""
    rank = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]]))


def has_digit(word: str) -> bool:
    return any("0" <= c <= "9" for c in word)


def has_capital(word: str) -> bool:
    return any("A" <= c <= "Z" for c in word)


def candidates(text: str, taken: list[tuple]) -> list[tuple[int, int]]:
    """Words of LEAST characters or more that no base span touches."""
    found = [m.span() for m in WORD.finditer(text)]
    return [(a, b) for a, b in found if not any(s < b and a < e for _, s, e, _ in taken)] if taken else found


class Tree:
    """A prefix tree with counts, whose states can be merged.  Of a state: arcs and how often each was taken, ends, and how many characters were still to come."""

    def __init__(self, strings: list[str]):
        self.step: list[dict[str, int]] = [{}]
        self.flow, self.rest, self.ends = [Counter()], [Counter()], [0]
        self.into = [0]  # the state that a merged one is part of
        self.bound = sqrt(0.5 * log(2 / ALPHA))
        for s in strings:
            at = 0
            for i, c in enumerate(s):
                self.rest[at][len(s) - i] += 1
                self.flow[at][c] += 1
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.flow.append(Counter())
                    self.rest.append(Counter())
                    self.ends.append(0)
                    self.into.append(len(self.into))
                at = self.step[at][c]
            self.rest[at][0] += 1
            self.ends[at] += 1

    def find(self, a: int) -> int:
        while self.into[a] != a:
            self.into[a] = self.into[self.into[a]]
            a = self.into[a]
        return a

    def size(self, a: int) -> int:
        return self.ends[a] + self.flow[a].total()

    def alike(self, a: int, b: int) -> bool:
        na, nb = self.size(a), self.size(b)
        bound = self.bound * (1 / sqrt(na) + 1 / sqrt(nb))
        if bound >= 1:
            return True  # no shares differ by more than one
        ra, rb = self.rest[a], self.rest[b]
        upto = 0.0
        for k in sorted(ra.keys() | rb.keys()):
            upto += ra[k] / na - rb[k] / nb
            if abs(upto) > bound:
                return False
        fa, fb = self.flow[a], self.flow[b]
        by_class = [0.0] * len(CLASSES)
        for c in fa.keys() | fb.keys():
            gap = fa[c] / na - fb[c] / nb
            by_class[CLASS[c]] += gap
            if abs(gap) > bound:
                return False
        return abs(self.ends[a] / na - self.ends[b] / nb) <= bound and max(map(abs, by_class)) <= bound

    def agree(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = map(self.find, todo.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if not self.alike(a, b):
                return False
            todo += [(self.step[a][c], self.step[b][c]) for c in self.step[a].keys() & self.step[b].keys()]
        return True

    def merge(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = map(self.find, todo.pop())
            if a == b:
                continue
            self.into[b] = a
            self.ends[a] += self.ends[b]
            self.flow[a] += self.flow[b]
            self.rest[a] += self.rest[b]
            for c, t in self.step[b].items():
                if c in self.step[a]:
                    todo.append((self.step[a][c], t))
                else:
                    self.step[a][c] = t

    def first_like(self, kept: list[int], a: int) -> int | None:
        return next((k for k in kept if self.agree(k, a)), None)

    def infer(self) -> list[int]:
        """Merge what agrees; the states that are left, the first one first."""
        layers = [[0]]
        while layers[-1]:
            found = {self.find(t) for a in layers[-1] for t in self.step[a].values()}
            kept: list[int] = []
            for a in sorted(found, key=lambda a: (-self.size(a), a)):
                like = self.first_like(kept, a)
                if like is None:
                    kept.append(a)
                else:
                    self.merge(like, a)
            layers.append(kept)
        often = []
        for a in (a for layer in layers for a in layer):
            if self.find(a) == a and self.size(a) >= LOOPS:
                like = self.first_like(often, a)
                if like is None:
                    often.append(a)
                else:
                    self.merge(like, a)
        left, todo = [], [0]
        while todo:
            a = self.find(todo.pop())
            if a not in left:
                left.append(a)
                todo += [self.step[a][c] for c in sorted(self.step[a], reverse=True)]
        return left


class Format:
    """A probabilistic automaton: in each state, chances of each character, which leads to a state, and of the end."""

    def __init__(self, strings: list[str]):
        tree = Tree(strings)
        states = tree.infer()
        place = {a: i for i, a in enumerate(states)}
        letters = Counter(c for s in strings for c in s)
        of_class = [sum(letters[c] for c in some) for some in CLASSES]
        # within its class, how often a character occurs anywhere in the examples
        usual = {c: (letters[c] + 0.1) / (of_class[k] + 0.1 * len(CLASSES[k])) for c, k in CLASS.items()}
        self.step: list[dict[str, tuple[int, float]]] = []
        self.end: list[float] = []
        for a in states:
            flow, n = tree.flow[a], tree.size(a)
            whole = n + 0.1 * (len(CLASSES) + 1)
            share = [(sum(flow[c] for c in some) + 0.1) / whole for some in CLASSES]
            guess = {c: share[k] * usual[c] for c, k in CLASS.items()} | {"": (tree.ends[a] + 0.1) / whole}
            seen = {**flow, "": tree.ends[a]}
            # the guess weighs so much as makes what was seen the likeliest: much where characters are at random, little where they are literal
            weight = max(WEIGHTS, key=lambda w: round(lgamma(w) - lgamma(w + n) + sum(lgamma(w * guess[c] + k) - lgamma(w * guess[c]) for c, k in seen.items()), 9))
            best = sorted(flow, key=lambda c: (-flow[c], c))
            arcs = {}
            for c, k in CLASS.items():
                # a character that never followed leads where the most frequent of its class does, else where that of all does
                via = c if c in flow else next((x for x in best if CLASS[x] == k), best[0] if best else None)
                arcs[c] = (place[tree.find(tree.step[a][via])] if via else place[a], log((flow[c] + weight * guess[c]) / (n + weight)))
            self.step.append(arcs)
            self.end.append(log((tree.ends[a] + weight * guess[""]) / (n + weight)))

    def score(self, word: str, least: float = -inf) -> float:
        """The log-likelihood of the word, or minus infinity if it is under ``least``."""
        at, total, step = 0, 0.0, self.step
        for c in word:
            at, p = step[at][c]
            total += p
            if total < least:
                return -inf
        total += self.end[at]
        return total if total >= least else -inf


def any_word(word: str) -> float:
    """The log-likelihood of a word of which nothing is known but its classes of characters, which mostly stay the same."""
    total, before = 0.0, None
    for c in word:
        k = CLASS[c]
        total += ANY[k][k == before if before is not None else True]
        before = k
    return total


ANY = [(log(OTHER / len(some)), log(SAME / len(some))) for some in CLASSES]


def subformats(strings: list[str]) -> list[list[str]]:
    """The examples of a kind, dealt by what they look like: alike in length, marks and capitals where there are enough of them, else in marks and capitals, else in nothing."""
    finest = lambda s: (len(s), has_capital(s), tuple((i, c) for i, c in enumerate(s) if CLASS[c] == MARKS))
    out, left = [], list(strings)
    for look in (finest, lambda s: (has_capital(s), frozenset(c for c in s if CLASS[c] == MARKS))):
        groups: dict[object, list[str]] = defaultdict(list)
        for s in left:
            groups[look(s)].append(s)
        out += [some for some in groups.values() if len(some) >= SUBFORMAT]
        left = [s for some in groups.values() if len(some) < SUBFORMAT for s in some]
    return [*out, left] if left else out


class Formats:
    """The formats by kind, each with the logarithm of its share of the kind, and those of ordinary words."""

    def __init__(self, examples: dict[str, list[str]]):
        self.by_kind = {k: [(log(len(some) / len(examples[k])), Format(some)) for some in subformats(examples[k])] for k in KINDS if examples.get(k)}
        ordinary = examples.get("", [])
        self.words = [Format(some) for some in ([w for w in ordinary if has_digit(w)], [w for w in ordinary if not has_digit(w)]) if some]
        self.seen: dict[str, str | None] = {}

    def kind(self, word: str) -> str | None:
        """The kind whose format explains the word far better than ordinary words do."""
        if word not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[word] = self._kind(word)
        return self.seen[word]

    def _kind(self, word: str) -> str | None:
        gain = max(MARGIN, MARGIN_EACH * len(word))
        best = (any_word(word) + gain, None)
        for k, formats in self.by_kind.items():
            for share, f in formats:
                likely = share + f.score(word, best[0] - share)  # stops where it can't be the best any more
                if likely > best[0] or best[1] is None and likely == best[0]:
                    best = (likely, k)
        return best[1] if best[1] and all(best[0] - f.score(word) >= gain for f in self.words) else None

    def spans(self, text: str | None) -> tuple[list[tuple], list[tuple]]:
        """(base, all): spans in order."""
        base = base_spans(text)
        more = []
        if text and self.by_kind:
            more = [(f"like_{k}", a, b, a) for a, b in candidates(text, base) if (k := self.kind(text[a:b]))]
        return order(base), order(base + more)


def learn(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", documents: int = SAMPLE_DOCUMENTS, examples: int = EXAMPLES) -> Formats:
    """Infer the formats from at most ``examples`` distinct examples a kind, of credentials in all documents and ordinary words in about ``documents``."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    n = rows.select("id").count()
    sampled = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, documents / max(1, n)))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, values = [], []
        for text, in_sample in zip(batch.column("text").to_pylist(), batch.column("sampled").to_pylist()):
            base = base_spans(text)
            for k, _, end, inner in base:
                if end - inner <= EXAMPLE_MOST:
                    kinds.append(k)
                    values.append(text[inner:end])
            if text and in_sample:
                words = [text[a:b] for a, b in candidates(text, base) if b - a <= EXAMPLE_MOST]
                kinds += [""] * len(words)
                values += words
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    tables = Tables(spark, "secrets")
    found = tables.save(map_arrow(rows.select("text", sampled.alias("sampled")), find, "kind string, value string").distinct(), "examples")
    got: dict[str, list[str]] = {}
    for kind in (*KINDS, ""):
        of_kind = found.where(F.col("kind") == kind).withColumn("digit", F.col("value").rlike("[0-9]").cast("int"))
        some = [of_kind.where(F.col("digit") == d) for d in (1, 0)] if not kind else [of_kind]  # words with digits are what a format must be told from
        got[kind] = [r["value"] for part in some for r in part.orderBy(F.xxhash64("value"), "value").limit(examples).collect()]
    tables.drop("examples")
    return Formats(got)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def scan(spark: SparkSession, docs: DataFrame, formats: Formats, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: id, n_assign, n_access, n_hex, base, spans (kind:start:end, comma-joined)."""
    held = spark.sparkContext.broadcast(formats)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [held.value.spans(t) for t in batch.column("text").to_pylist()]
        counts = [Counter(s[0] for s in base) for base, _ in rows]
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS), pa.array([joined(b) for b, _ in rows], pa.string()), pa.array([joined(a) for _, a in rows], pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return map_arrow(docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text")), make, "id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(spark: SparkSession, docs: DataFrame, formats: Formats, text_column: str = "text", length_column: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """The documents, all columns as they were, but with each secret replaced by ``mask`` and the length in characters set anew."""
    held = spark.sparkContext.broadcast(formats)
    at = docs.columns.index(text_column)
    size = docs.columns.index(length_column) if length_column in docs.columns else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        _, spans = held.value.spans(text)
        out, done = [], 0
        for _, _, end, inner in sorted(spans, key=lambda s: s[3]):
            if end > done:
                if inner >= done:
                    out += [text[done:inner], mask]
                done = end
        return "".join([*out, text[done:]])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        new = [clean(t) for t in texts]
        columns = list(batch.columns)
        columns[at] = pa.array(new, batch.schema.field(at).type)
        if size is not None:
            old = batch.column(size).to_pylist()
            columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(old, texts, new)], batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, make, docs.schema)
