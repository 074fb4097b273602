"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

1. One scan counts surface statistics of each text; labellers turn them into votes (-1 bad, 1 good,
   0 no opinion). Only the number of documents with each pattern of votes is gathered.
2. Expectation-maximisation over those counts estimates each labeller's accuracy and how often
   documents are bad. Bad documents are bad in different ways, so there is a kind of bad document for each
   labeller to start from; a pattern's posterior of the good kind is the soft label of its documents.
3. The posteriors of a bounded seeded sample train a logistic scorer on hashed features of word shapes
   and words, and on shares like those that the labellers see.
4. A second scan scores every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices
from .spotsigs import ANCHORS

#: Documents that the linear scorer is trained on, at most.
SAMPLE_ROWS = 4_000
#: Hashed features: word shapes (with the shares that come first), then words.
DIMENSIONS, WORDS = 4_096, 2_048
#: Words whose distinct ones are counted together.
STRETCH = 2_000
#: A document is rejected if its probability of being good is below this.
THRESHOLD = 0.3
#: The statistics that labellers judge, each with the range in which it votes good, and that outside which it votes bad.
#: symbols: symbols a word; punctuation: share of bytes; capitals: share of ASCII letters; wordless: words without letter or digit;
#: lines: share of lines that occurred before; vocabulary: share of words that are new in their stretch; packing:
#: compressed size over size; entropy: bits a byte; word_length: bytes a word.
LIMITS = {
    "symbols": ((0.0, 0.05), (0.0, 0.10)),
    "punctuation": ((0.0, 0.08), (0.0, 0.15)),
    "capitals": ((0.0, 0.25), (0.0, 0.50)),
    "wordless": ((0.0, 0.05), (0.0, 0.20)),
    "lines": ((0.0, 0.20), (0.0, 0.40)),
    "vocabulary": ((0.35, 1.0), (0.25, 1.0)),
    "packing": ((0.20, 0.80), (0.10, 1.00)),
    "entropy": ((3.50, 5.50), (2.50, 6.50)),
    "word_length": ((3.0, 10.0), (2.0, 15.0)),
}
LABELLERS = tuple(LIMITS)
_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_HIGH = bytes(range(128, 256))
_ORDINARY = b".,;:'\"()-?!"
_SYMBOLS = bytes(x for x in range(33, 127) if x not in _UPPER + _LOWER + _DIGITS + _ORDINARY)
_PUNCTUATION = _SYMBOLS + _ORDINARY
_COMMON = frozenset(w.encode() for w in ANCHORS)
#: Words below which shares say nothing.
SHORT = 20
_SHAPES = re.compile(r"[^\W\d_]+")


def repetition(text: bytes, words: list[bytes]) -> tuple[float, float]:
    """The share of lines that occurred before (of more than three), and of words that echo the one before."""
    lines = [x for x in text.split(b"\n") if x]
    repeated = 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0
    return repeated, sum(map(eq, words, words[1:])) / max(1, len(words))


def distinct_share(words: list[bytes]) -> float:
    """Of the words, those that are new in their stretch of STRETCH successive ones."""
    return sum(len(set(words[i : i + STRETCH])) for i in range(0, len(words), STRETCH)) / max(1, len(words))


def packed_share(text: bytes) -> float:
    return len(zlib.compress(text, 1)) / max(1, len(text))


def statistics(text: bytes, words: list[bytes], packed: float) -> tuple[float, ...]:
    """The statistics of LIMITS, in its order, of a text with words and its packed_share()."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = lambda chars: int(counts[list(chars)].sum())
    n, upper, lower = len(text), of(_UPPER), of(_LOWER)
    part = counts[counts > 0] / n
    wordless = sum(not w.translate(None, _PUNCTUATION) for w in words)
    repeated, _ = repetition(text, words)
    return of(_SYMBOLS) / len(words), of(_PUNCTUATION) / n, upper / max(1, upper + lower), wordless / len(words), repeated, distinct_share(words), packed, float(-(part * np.log2(part)).sum()), (n - len(words)) / len(words)


def votes(text: bytes, packed: float | None = None) -> tuple[int, ...]:
    """One vote of each labeller: 1 in the statistic's good range, -1 outside its wider one, 0 between. A text
    below SHORT words gets no opinion of any, one without words an objection of each."""
    words = text.split()
    if not words:
        return (-1,) * len(LIMITS)
    if len(words) < SHORT:
        return (0,) * len(LIMITS)
    return tuple(1 if good[0] <= x <= good[1] else 0 if wide[0] <= x <= wide[1] else -1 for x, (good, wide) in zip(statistics(text, words, packed_share(text) if packed is None else packed), LIMITS.values(), strict=True))


def _pattern(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def unpack(pattern: int) -> np.ndarray:
    return np.array([pattern // 3**i % 3 - 1 for i in range(len(LABELLERS))])


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(batch, "text"):
            found = pa.array([_pattern(votes(t or b"")) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), found], names=["doc_id", "pattern"])


class WeakLabels:
    """objects[c, j]: how often labeller j, where it has an opinion, objects to documents of kind c; shares[c]: how many
    documents are of that kind. Kind 0 is good, the others are bad. Within a kind, labellers are taken as independent."""

    def __init__(self, objects: np.ndarray, shares: np.ndarray):
        self.objects, self.shares = objects, shares

    def accuracy(self) -> np.ndarray:
        """Of each labeller, the chance that an opinion of its is right."""
        bad = self.shares[1:]
        return self.shares[0] * (1 - self.objects[0]) + bad @ self.objects[1:]

    def kinds(self, patterns: np.ndarray) -> np.ndarray:
        """The posterior of each kind for each pattern of votes."""
        v = np.array([unpack(int(p)) for p in patterns], dtype=np.int64).reshape(-1, self.objects.shape[1])
        score = np.log(self.shares) + (v < 0) @ np.log(self.objects).T + (v > 0) @ np.log1p(-self.objects).T
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        return weight / weight.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self.kinds(patterns)[:, 0]


#: Where estimation starts: the share of good documents; how often a labeller objects to good ones, to the kind of bad
#: ones that is its own, and to other bad ones.
GOOD, FALSE, OWN, OTHER = 0.85, 0.02, 0.8, 0.2
#: A Beta prior on each rate: as many opinions as this, divided as above.
PRIOR_VOTES = 4.0


#: A bad kind must draw so much more objections than good documents from a second labeller: one alone, which may be
#: no better than a coin, doesn't make documents bad.
SECOND = 0.1


def _start(own: list[int]) -> WeakLabels:
    """The model where estimation starts: a bad kind for each of the labellers in own."""
    objects = np.full((len(own) + 1, len(LABELLERS)), OTHER)
    objects[0] = FALSE
    objects[np.arange(1, len(own) + 1), own] = OWN
    return WeakLabels(objects, np.array([GOOD, *[(1 - GOOD) / len(own)] * len(own)]) if own else np.ones(1))


def estimate(counts: dict[int, int], rounds: int = 200) -> WeakLabels:
    """Expectation-maximisation over the counts of vote patterns. Rates are free but for the prior; kinds that rest on
    one labeller are dropped, and the others estimated again."""
    patterns, n = np.array(sorted(counts)), np.array([counts[p] for p in sorted(counts)], float)
    own = list(range(len(LABELLERS)))
    if not len(patterns):
        return _start(own)
    v = np.array([unpack(int(p)) for p in patterns])
    while True:
        start = model = _start(own)
        for _ in range(rounds):
            weight = model.kinds(patterns) * n[:, None]
            bad, given = weight.T @ (v < 0), weight.T @ (v != 0)
            model = WeakLabels((bad + PRIOR_VOTES * start.objects) / (given + PRIOR_VOTES), (weight.sum(axis=0) + 1) / (n.sum() + len(own) + 1))
        second = np.sort(model.objects[1:] - model.objects[0], axis=1)[:, -2:-1]
        kept = [j for j, x in zip(own, second, strict=True) if x[0] >= SECOND]
        if kept == own:
            return model
        own = kept


class _Shapes(dict):
    """word -> three fields of an integer: the hashed feature of its shape (runs of capitals, small letters and
    digits shrink to A, a, 0; other characters stay, up to three of a run), that of the word, and 1 if it is common."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        shape = re.sub(r"\d+", "0", _SHAPES.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", text))
        shape = re.sub(r"(.)\1{2,}", r"\1\1\1", shape)[:12]
        plain = word.lower().translate(None, b".,;:!?#$%&*")
        code = xxhash.xxh3_64_intdigest(shape.encode()) % (DIMENSIONS - SHARES) + SHARES
        value = self[word] = code | (xxhash.xxh3_64_intdigest(plain) % WORDS + DIMENSIONS) << 16 | (plain in _COMMON) << 32
        return value


_WORD_SHAPES = _Shapes()
#: Features before the hashed ones: a constant, shares of repeated lines, echoed, distinct and common words, packing.
SHARES = 6


def features(text: bytes, packed: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): each shape's share of the words, its root taken, and each word's, as it is (roots of many
    small shares would add up in long texts); index 0 is constant, 1 to 5 are the roots of the shares of
    repeated lines, of echoed, distinct and common words, and of packed_share()."""
    words = text.split()
    codes = np.fromiter(map(_WORD_SHAPES.__getitem__, words), np.int64, len(words))
    n = max(1, len(words))
    seen = np.bincount(np.concatenate([codes & 0xFFFF, codes >> 16 & 0xFFFF]), minlength=1)
    at = np.flatnonzero(seen)
    shares = (*repetition(text, words), distinct_share(words), float((codes >> 32).sum()) / n, packed_share(text) if packed is None else packed)
    part = seen[at] / n
    return np.r_[np.arange(SHARES), at], np.r_[1.0, np.sqrt(shares), np.where(at < DIMENSIONS, np.sqrt(part), part)]


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300, rate: float = 1.0, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for the features() of documents and soft labels in 0 .. 1, by full-batch
    gradient steps (AdaGrad)."""
    weights, past = np.zeros(DIMENSIONS + WORDS), np.full(DIMENSIONS + WORDS, 1e-8)
    if not rows:
        return weights
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows])
    for _ in range(rounds):
        score = np.bincount(row, value * weights[index], len(rows))
        slope = (1 / (1 + np.exp(-score)) - labels) / len(rows)
        gradient = np.bincount(index, value * slope[row], DIMENSIONS + WORDS) + penalty * weights
        past += gradient**2
        weights -= rate * gradient / np.sqrt(past)
    return weights


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(batch, "text"):
            found = [features(t or b"") for t in texts]
            columns = [pa.array([_pattern(votes(t or b"")) for t in texts], pa.int32()), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *columns], names=["doc_id", "pattern", "indices", "shares"])


def _scorer(weights: np.ndarray, model: WeakLabels) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                packed = [packed_share(t or b"") for t in texts]
                found = [features(t or b"", x) for t, x in zip(texts, packed, strict=True)]
                scores = [1 / (1 + math.exp(-max(-50.0, min(50.0, float(x @ weights[i]))))) for i, x in found]
                patterns = np.array([_pattern(votes(t or b"", x)) for t, x in zip(texts, packed, strict=True)])
                columns = [c.slice(start, len(texts)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(model.posterior(patterns), pa.float64()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "weak_label", "score"])

    return score


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> tuple[WeakLabels, np.ndarray]:
    """The weak-label model of all documents' votes, and the scorer of a seeded sample of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_voter, "doc_id long, pattern int").groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    counts = {r.pattern: r["count"] for r in found}
    model, total = estimate(counts), sum(counts.values())
    # a slightly larger share is drawn by hash, so that the limit, not chance, sets the number
    share = min(1.0, 1.2 * sample_rows / max(1, total))
    rank = F.xxhash64("doc_id", F.lit(seed))
    drawn = rows.where(F.pmod(rank, F.lit(1_000_000)) < int(share * 1_000_000) + 1).mapInArrow(_featurer, "doc_id long, pattern int, indices binary, shares binary")
    # at most DIMENSIONS + WORDS numbers a row, which stay bytes on their way through the driver
    sample = drawn.orderBy(rank, "doc_id", "pattern", "indices", "shares").limit(sample_rows).toArrow()
    labels = model.posterior(sample.column("pattern").to_numpy().astype(np.int64)) if sample.num_rows else np.empty(0)
    read = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in sample.column(name)]
    return model, train(list(zip(read("indices", np.int32), read("shares", np.float32), strict=True)), labels)


def scored(docs: DataFrame, columns: list[str], sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs (doc_id and text among them) with weak_label, score and kept.

    weak_label: the posterior of the labellers' votes; score: the linear scorer's probability that the
    document is good; kept: score >= threshold.

    Edge cases: a null or empty text is scored by the constant feature alone; very long texts are
    read whole, in training too; repeated rows are scored
    alike; an empty table gives an empty table. Columns called weak_label, score or kept are replaced."""
    model, weights = fit(docs, sample_rows)
    rows = docs.select(*[F.col(c) for c in columns if c not in ("weak_label", "score", "kept")])
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", weak_label double, score double"
    return rows.mapInArrow(_scorer(weights, model), schema).withColumn("kept", F.col("score") >= threshold)
