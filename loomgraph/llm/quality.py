"""Quality rules judged by an isolation forest.

Each document has a vector of rule statistics: how far it breaks each of a dozen well-known rules (symbols, capitals, digits,
repetition, word lengths, sentence ends, ...). Trees split random samples of the vectors at random; a document that few
splits isolate is an anomaly: score = 2^(-mean path length / c(sample)). The threshold comes from the labelled rows: of the
scores that lose at most ``MAX_LOSS`` of the good ones it is the one that best separates good from bad.

Every tree draws its own sample of ``SAMPLE`` documents, those with the smallest seeded hashes of the whole table; that is
the method's subsampling and no other step uses fewer rows. Statistics, scores and the histogram behind the threshold cover
all rows.

Rows: a text without words (NULL, empty, blank) gets score 1 and is rejected; very long texts are read whole; scores depend on the
text alone, so repeated rows and ties are decided alike; labels without a document, or with a NULL id or quality, are ignored, repeated ones count each;
without labels, or without bad ones, the threshold is ``UNLABELLED``; an empty table gives no rows; further columns of any
name pass through ``keep_good``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import materialise

TREES, SAMPLE, SEED = 128, 256, 29
BINS, MAX_LOSS, UNLABELLED = 10_000, 0.005, 0.65

#: name, the value up to which a rule isn't broken, the excess over it that counts as wholly broken
RULES = (
    ("symbols", 0.02, 0.10),  # characters that are neither word, blank nor plain punctuation, a character
    ("capitals", 0.15, 0.40),  # upper-case letters a letter
    ("digits", 0.15, 0.40),  # digits a character
    ("exclamations", 0.02, 0.10),  # ! and ? a word over one in ten
    ("repeats", 0.05, 0.20),  # words equal to the one before
    ("few_words", 0.0, 0.50),  # missing variety: expected less distinct words
    ("long_words", 16.0, 16.0),  # mean length of a word
    ("short_words", 0.0, 1.5),  # 2.5 less the mean length of a word
    ("bars", 0.02, 0.15),  # words that are a bar, bullet or the like
    ("decorated", 0.05, 0.25),  # words with a symbol at their end
    ("longest_run", 8.0, 32.0),  # longest run of one character
    ("top_word", 0.20, 0.40),  # share of the most frequent word
)

_PLAIN = frozenset(".,;:'’\"“”()-–—!?/&%€$@+=")
_DOUBLED = frozenset("#*&%$=|~^<>_")
_DECORATION = frozenset("#*&%$=|~^<>")
_symbol = re.compile(r"[^\w\s.,;:'’\"“”()\-–—!?/&%€$@+=]|([#*&%$=|~^<>_])\1{1,}")
_odd_blank = re.compile(r"(?![ \n\t])\s")
_run = re.compile(r"(\S)\1{8,}")
_bare = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_decorated = re.compile(r"[^\W_][^\w\s]*(?:[#*&%$=|~^<>]|!!)+(?!\S)")


def statistics(text: str | None) -> list[float] | None:
    """How far each rule is broken, 0 (not) to 1 (wholly), in the order of ``RULES``; None without words."""
    tokens = text.split() if text else []
    if not tokens:
        return None
    n, size = len(tokens), len(text)
    letters = upper = digits = 0
    if text.isascii():
        counts = np.bincount(np.frombuffer(text.encode("ascii"), dtype=np.uint8), minlength=128)
        upper, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
        letters = upper + int(counts[97:123].sum())
    else:
        low = text.lower()
        code, other = (np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) for x in (text, low))
        upper = int((code != other).sum()) if len(code) == len(other) else sum(map(str.isupper, text))
        digits = int(((code >= 48) & (code < 58)).sum())
        letters = int((((code | 32) >= 97) & ((code | 32) < 123) | (code >= 0xC0)).sum())
    seen = Counter(tokens)
    marks = {c for c in set(text) if not c.isalnum() and not c.isspace()}
    # The patterns run only where a character that they need occurs.
    symbols = sum(m.end() - m.start() for m in _symbol.finditer(text)) if not marks <= _PLAIN or marks & _DOUBLED else 0
    decorated = len(_decorated.findall(text)) if marks & _DECORATION or "!!" in text else 0
    bare = len(_bare.findall(text)) if any(f"{blank}{c}" in text for c in marks for blank in (" ", "\n", "\t")) or text[0] in marks or _odd_blank.search(text) else 0
    longest = max((m.end() - m.start() for m in _run.finditer(text)), default=0) if any(c * 9 in text for c in set(text)) else 0
    again = sum(map(str.__eq__, tokens, tokens[1:]))
    variety = min(1.0, 0.35 + 3.0 / math.sqrt(n)) if n > 20 else 0.4
    mean = (size - text.count(" ") - text.count("\n")) / n
    values = (
        symbols / size,
        upper / max(letters, 1) if letters > 20 else 0.0,
        digits / size if n > 3 else 0.0,
        max(0.0, (text.count("!") + text.count("?")) / n - 0.1),
        again / n,
        max(0.0, variety / 4 - len(seen) / n) if n > 20 else 0.0,
        mean,
        max(0.0, 2.5 - mean) if n > 3 else 0.0,
        bare / n,
        decorated / n,
        longest,
        max(seen.values()) / n if n > 20 else 0.0,
    )
    return [min(1.0, max(0.0, (v - free) / full)) for v, (_, free, full) in zip(values, RULES)]


def rule_statistics(text: Column) -> Column:
    """array<double> of ``statistics``; NULL without words."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        return pa.array([statistics(x.as_py()) for x in column], pa.list_(pa.float64()))

    return run(text)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


class Forest:
    """Isolation trees as arrays: the split feature (-1: leaf), its value, the left child, and the path length of a leaf."""

    def __init__(self, samples: list[np.ndarray], seed: int = SEED) -> None:
        self.trees = [self._grow(s, np.random.default_rng([seed, k])) for k, s in enumerate(samples)]
        self.size = max((len(s) for s in samples), default=0)

    @staticmethod
    def _grow(points: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, ...]:
        deepest = max(1, math.ceil(math.log2(max(2, len(points)))))
        feature, value, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, points, 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= deepest or len(own) < 2 or not len(open_):
                path[node] = depth + expected_path(len(own))
                continue
            f = int(random.choice(open_))
            at = float(random.uniform(low[f], high[f]))
            at = at if at < high[f] else float(low[f])
            feature[node], value[node], left[node] = f, at, len(feature)
            for side in (own[own[:, f] <= at], own[own[:, f] > at]):
                todo.append((len(feature), side, depth + 1))
                feature.append(-1)
                value.append(0.0)
                left.append(0)
                path.append(0.0)
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row of ``x``."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, path in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = left[node] + (x[rows, np.maximum(f, 0)] > value[node])
                node = np.where(inner, go, node)
            total += path[node]
        return total / max(1, len(self.trees))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2^(-path / c): near 1 for anomalies, below 0.5 for the bulk."""
        if not self.trees or not len(x):
            return np.full(len(x), 0.5)
        _, first, back = np.unique(x, axis=0, return_index=True, return_inverse=True)
        return (2.0 ** (-self.paths(x[first]) / max(expected_path(self.size), 1e-9)))[back.ravel()]


def draw_sample(stats: DataFrame, size: int, seed: int = SEED) -> list[list[float]]:
    """The vectors of the ``size`` rows of (doc_id, stats) with the smallest seeded hashes.

    A hash below a share of its range a little over ``size`` of the rows is drawn, so that is all that leaves the executors,
    each distinct row once with its count. Where repeated rows leave too few the share is doubled.
    """
    rows = stats.filter("stats is not null").select("stats", F.xxhash64(F.lit(seed), "doc_id", "stats").alias("draw"))
    n = rows.count()
    share = min(1.0, (size + 6 * math.sqrt(size) + 64) / max(1, n))
    while True:
        below = rows if share >= 1 else rows.filter(F.col("draw") < F.lit(int(share * 2.0**64) - (1 << 63)))
        drawn = sorted((r["draw"], r["stats"], r["count"]) for r in below.groupBy("draw", "stats").count().collect())
        if share >= 1 or sum(c for _, _, c in drawn) >= size:
            points: list[list[float]] = []
            for _, vector, count in drawn:
                points += [vector] * min(count, size - len(points))
            return points
        share = min(1.0, share * 2)


def train(stats: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest from (doc_id, stats) rows. Brings little more than ``trees * sample`` vectors to the driver, whatever the table's size."""
    points = np.array(draw_sample(stats, trees * sample, seed), dtype=float).reshape(-1, len(RULES))
    order = np.random.default_rng(seed).permutation(len(points))
    each = min(sample, len(points))
    samples = [points[np.take(order, range(k * each, (k + 1) * each), mode="wrap")] for k in range(trees)] if each else []
    return Forest(samples, seed)


def anomaly(stats: Column, forest: Forest) -> Column:
    """The score of a vector of rule statistics; 1 of NULL."""
    shared = SparkSession.active().sparkContext.broadcast(forest)

    @F.arrow_udf(T.DoubleType())
    def run(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        out = np.ones(len(rows))
        there = [k for k, r in enumerate(rows) if r is not None]
        if there:
            out[there] = shared.value.scores(np.array([rows[k] for k in there], dtype=float))
        return pa.array(out, pa.float64())

    return run(stats)


def calibrate(scored: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """The threshold from (score, quality) rows: all of them, counted in ``BINS`` bins. Scores above it are anomalies."""
    bins = scored.filter("quality is not null").groupBy(F.floor(F.col("score") * BINS).alias("bin"), (F.col("quality") > 0).alias("good")).count().collect()
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for at, is_good, n in bins:
        (good if is_good else bad)[at] += n
    if not bad.sum() or not good.sum():
        return UNLABELLED
    lost = 1 - np.cumsum(good) / good.sum()
    caught = 1 - np.cumsum(bad) / bad.sum()
    allowed = np.flatnonzero(lost <= max_loss)
    best = allowed[np.argmax((caught - lost)[allowed])]
    same = allowed[(caught == caught[best])[allowed] & (lost == lost[best])[allowed]]
    return float((same[0] + same[-1] + 2) / 2 / BINS)


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float]:
    """The forest and the threshold from (doc_id, stats) of all rows; labels join those without the texts."""
    forest = train(stats)
    labelled = stats.join(labels.filter("doc_id is not null").select("doc_id", "quality"), "doc_id")
    return forest, calibrate(labelled.select(anomaly(F.col("stats"), forest).alias("score"), "quality"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the anomaly ``score`` and whether to ``keep`` it, of every row of ``docs``. Texts are read once."""
    stats = materialise(docs.select("doc_id", rule_statistics(F.col("text")).alias("stats")), "rule-statistics")
    forest, threshold = fit(stats, labels)
    return stats.select("doc_id", anomaly(F.col("stats"), forest).alias("score")).withColumn("keep", F.col("score") < threshold)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't anomalies, in the columns of ``docs``. The statistics are computed once, and written beside
    the rows; no shuffle of texts."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rated = materialise(docs.select(row, rule_statistics(F.col("text")).alias("stats")), "rated-rows")
    forest, threshold = fit(rated.select("row.doc_id", "stats"), labels)
    return rated.filter(anomaly(F.col("stats"), forest) < threshold).select("row.*")
