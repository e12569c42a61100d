"""Quality rules: base rules and gradient-boosted trees over document statistics.

Statistics are taken over whole texts. Trees are grown on logistic loss with histograms; on features
with a monotonic constraint a split is allowed only if its sides' values are ordered, and the bound
between them holds below it. All trees are flattened into numpy node arrays, so that a batch of
documents goes down all trees one level at a time.

The trees are fitted on the driver from the statistics of at most SAMPLE_ROWS labelled rows, those with
the smallest hashes of their ids; the statistics of all documents are taken where they are read, and
nothing is shuffled but the sample's ids.

Null texts have no words. Empty and null texts fail the base rules. Without labels of both kinds every
document that passes the base rules is kept. Repeated rows stay; only doc_id and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, freed, marked, materialise, scratch, slot_of, smaller_batches, table, text_chunks

SAMPLE_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
DIGITS, CAPITALS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+").findall
TREES = 80
LEVELS = 3
BINS = 64
RATE = 0.15
KEEP = 0.5
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "stops", "digits", "capitals", "line_words", "marks")
#: Direction in which each constrained feature may move the score.
MONOTONIC = {"symbols": -1, "dup_lines": -1, "repeats": -1}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ENDS = re.compile(r"[.!?][\"')\]]?\s*(?:\n|$)")


def repeated_words(words: list) -> int:
    """Words in windows of three that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 21:  # the number of a window of three would not fit
        _, pairs = np.unique(pairs, return_inverse=True)
    keys = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 2, bool)
    for start in (order[1:][same], order[:-1][same]):
        for k in range(3):
            twice[start + k] = True
    return int(twice.sum())


def digits_and_capitals(text: str) -> tuple[int, int]:
    """Decimal digits and capital letters of all scripts."""
    data = text.encode("utf-8", "surrogatepass")
    digits, capitals = (len(data) - len(data.translate(None, kind)) for kind in (DIGITS, CAPITALS))
    if len(data) > len(text):
        rest = "".join(BEYOND_ASCII(text))
        digits, capitals = digits + sum(map(str.isdecimal, rest)), capitals + sum(map(str.isupper, rest))
    return digits, capitals


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """(BASE, FEATURES) of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    digits, capitals = digits_and_capitals(text)
    m, c = max(n, 1), max(chars, 1)
    features = [
        np.log1p(n),
        chars / m,
        symbols / c,
        dups / max(len(lines), 1),
        repeats / m,
        len(set(words)) / m,
        len(ENDS.findall(text)) / max(len(lines), 1),
        digits / c,
        capitals / c,
        np.log1p(n / max(len(lines), 1)),
        sum(map(text.count, ".,;:!?")) / m,
    ]
    return (n, chars, symbols, dups, repeats), features


@dataclass
class Forest:
    """Nodes of all trees: leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(LEVELS):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-np.clip(self.start + self.value[node].sum(1), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, ridge: float = 2.0) -> Forest:
    """y: 0 or 1. Constraints are those of MONOTONIC."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(rate / (1 - rate)))
    nodes: list[list] = []
    roots: list[int] = []
    sign = [MONOTONIC.get(f, 0) for f in FEATURES]
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        z = np.full(len(y), start)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = gradient[rows], hessian[rows]
            total_g, total_h = g.sum(), h.sum()
            at = len(nodes)
            nodes.append([0, np.inf, at, at, RATE * float(np.clip(total_g / (total_h + ridge), low, high))])
            best = (1e-6, None)
            if level < LEVELS and len(rows) >= 20:
                for f in range(x.shape[1]):
                    gs = np.cumsum(np.bincount(binned[rows, f], g, BINS))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, f], h, BINS))[:-1]
                    a, b = np.clip(gs / (hs + ridge), low, high), np.clip((total_g - gs) / (total_h - hs + ridge), low, high)
                    gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                    gain[(hs < 1) | (total_h - hs < 1) | (sign[f] * (b - a) < 0)] = 0
                    k = int(gain[: len(cuts[f])].argmax()) if len(cuts[f]) else 0
                    if len(cuts[f]) and gain[k] > best[0]:
                        best = (gain[k], (f, k, float(a[k] + b[k]) / 2))
            if best[1]:
                f, k, middle = best[1]
                inside = binned[rows, f] <= k
                bounds = [(low, high), (low, high)]
                if sign[f] > 0:
                    bounds = [(low, middle), (middle, high)]
                elif sign[f] < 0:
                    bounds = [(middle, high), (low, middle)]
                left, right = grow(rows[inside], level + 1, *bounds[0]), grow(rows[~inside], level + 1, *bounds[1])
                nodes[at] = [f, float(cuts[f][k]), left, right, 0.0]
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            gradient, hessian = y - p, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
            one = Forest(*(np.array([n[i] for n in nodes]) for i in range(5)), np.array(roots[-1:]), 0.0)
            z += np.log(np.clip((s := one.score(x)), 1e-12, 1) / np.clip(1 - s, 1e-12, 1))
    return Forest(*(np.array([n[i] for n in nodes]) for i in range(5)), np.array(roots, np.int64), start)


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """docs: (doc_id, text); labels: (doc_id, quality), quality 0 or 1; other labels are left out."""
    with scratch(docs.sparkSession):
        x, y = labelled_statistics(docs, labels, sample_rows)
    return fit_forest(x, y)


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    own = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = materialise(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    marks = materialise(bitmap(sample.select(slot_of("doc_id").alias("slot")).distinct()))
    read = marked(docs.select("doc_id", "text"), slot_of("doc_id"), marks).join(F.broadcast(sample), "doc_id").select("text", "quality")
    smaller_batches(docs.sparkSession)

    def run(batches):
        for part, texts in text_chunks(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t)[1] for t in texts], pa.list_(pa.float64())), part.column(1).cast(pa.int32())], names=["x", "y"])

    found = read.mapInArrow(freed(run), "x array<double>, y int").toArrow()
    return np.array(found.column(0).to_pylist(), float).reshape(-1, len(FEATURES)), np.array(found.column(1).to_pylist(), float)


def judge_quality(docs: DataFrame, forest: Forest, keep: float = KEEP) -> DataFrame:
    """doc_id, the base statistics, base_failed, score and kept of every document."""
    spark = docs.sparkSession
    smaller_batches(spark)
    held = spark.sparkContext.broadcast(forest)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, texts in text_chunks(batches):
            made = [statistics(t) for t in texts]
            base = np.array([m[0] for m in made], np.int64)
            score = held.value.score(np.array([m[1] for m in made]))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            columns = [part.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "score", "kept"])

    counts = ", ".join(f"{c} bigint" for c in BASE)
    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {kind}, {counts}, base_failed boolean, score double, kept boolean")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
