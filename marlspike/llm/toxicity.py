"""Toxicity scores from class-conditional Kneser-Ney models.

Both classes have a character model of order ORDER over words with their boundaries. The highest
order has counts of its own class; everything below it is one Kneser-Ney continuation model that the
classes share, so a rare expression is smoothed alike in both and its ratio stays near zero. A word
adds log P(word | toxic) - log P(word | ordinary), which is looked up in two sorted tables: one for
the n-grams seen in training, one for the backoff weights of their contexts (the shared model cancels
in an unseen n-gram). A text's evidence is the length-normalised difference over the whole text and
over its strongest windows of words; a logistic curve, fitted on folds that the counts did not see,
maps them to a score.

The model is fitted on all labelled rows, or on about LABELLED_ROWS of them where there are more: those with the
smallest hashes of their ids. Of these every n-gram is counted and kept, however rare: words are counted where
they are read, summed by word, and turned into n-grams once for each distinct word. Characters are folded to 6
bits, so an n-gram is one integer. The driver gets one row for each distinct n-gram of these rows; that bound on rows
is what bounds its memory. CALIBRATION_ROWS bounds the sample for the logistic curve in the same way.

Null and empty texts, and texts without a letter, get the score of no evidence. Labels of a null doc_id, and labels
other than 0 and 1, are left out; a doc_id with both labels is toxic. Repeated rows are counted and scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bitmap, freed, give_back_memory, is_split, marked, materialise, scratch, slot_of, smaller_batches, table, text_chunks

ORDER = 6
BITS = 6
LABELLED_ROWS = 400_000
CALIBRATION_ROWS = 20_000
WINDOWS = (1, 8, 40)
DISCOUNT = 0.75
COUNTER_WORDS = 200_000
CACHE_WORDS = 250_000
THRESHOLD = 0.7
#: Letters of a word beyond these say nothing more; such words are strings without spaces, taken in pieces.
PIECE = 48
WORDS = re.compile(r"[^\W\d_]+").findall
COUNTS = ("t0", "t1", "o0", "o1")


def fold_table() -> np.ndarray:
    """Code of a code point below 2**16: 0 pads, 1 ends a word, a-z have their own, the rest are folded into 36 codes."""
    codes = 28 + np.arange(1 << 16) % 36
    codes[ord("a") : ord("z") + 1] = np.arange(2, 28)
    return codes.astype(np.int64)


FOLD = fold_table()


def split_words(text: str | None) -> list[str]:
    if not text:
        return []
    found = WORDS(text.lower())
    if max(map(len, found), default=0) > PIECE:
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all n-grams, number of n-grams of each word): one for each letter and for the end."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) & 0xFFFF
    sizes = lengths + ORDER  # pads in front, an end mark behind
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.int64)
    at = np.arange(len(points)) + np.repeat(starts + ORDER - 1 - (np.cumsum(lengths) - lengths), lengths)
    flat[at] = FOLD[points]
    flat[starts + sizes - 1] = 1
    codes = np.zeros(len(flat) - ORDER + 1, np.int64)
    for k in range(ORDER):
        codes = codes << BITS | flat[k : k + len(codes)]
    own = np.arange(int((lengths + 1).sum())) + np.repeat(starts - (np.cumsum(lengths + 1) - lengths - 1), lengths + 1)
    return codes[own], lengths + 1


@dataclass
class Model:
    grams: np.ndarray
    gram_llr: np.ndarray
    contexts: np.ndarray
    context_llr: np.ndarray

    def llr(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(codes), np.float32)
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        out = np.where(self.grams[at] == codes, self.gram_llr[at], np.float32(np.nan))
        rest = np.flatnonzero(np.isnan(out))
        own = codes[rest] >> BITS
        at = np.minimum(np.searchsorted(self.contexts, own), len(self.contexts) - 1)
        out[rest] = np.where(self.contexts[at] == own, self.context_llr[at], 0)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        codes, sizes = ngrams(words)
        return np.add.reduceat(self.llr(codes), np.cumsum(sizes) - sizes)


def shared_probability(codes: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of the last character of each of these distinct n-grams after its shorter contexts."""
    kinds, levels = codes, []
    for n in range(ORDER - 1, 0, -1):
        suffix = kinds & ((1 << BITS * n) - 1)
        kinds, count = np.unique(suffix, return_counts=True)
        levels.append((n, kinds, count.astype(np.float64)))
    p: np.ndarray | float = 1 / (1 << BITS)
    below: tuple[np.ndarray, np.ndarray] | None = None
    for n, kinds, count in reversed(levels):
        context, at, types = np.unique(kinds >> BITS, return_inverse=True, return_counts=True)
        total = np.bincount(at, count)
        if below is not None:
            p = below[1][np.searchsorted(below[0], kinds & ((1 << BITS * (n - 1)) - 1))]
        p = np.maximum(count - DISCOUNT, 0) / total[at] + DISCOUNT * types[at] / total[at] * p
        below = kinds, p
    return below[1][np.searchsorted(below[0], codes & ((1 << BITS * (ORDER - 1)) - 1))]


def fit_model(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """codes: sorted distinct n-grams; toxic, ordinary: their counts in the classes."""
    seen = toxic + ordinary > 0
    codes, toxic, ordinary = codes[seen], toxic[seen].astype(float), ordinary[seen].astype(float)
    if not len(codes) or not toxic.any() or not ordinary.any():
        return Model(*(np.zeros(0, t) for t in (np.int64, np.float32, np.int64, np.float32)))
    shared = shared_probability(codes)
    contexts, at = np.unique(codes >> BITS, return_inverse=True)
    logs, weights = [], []
    for count in (toxic, ordinary):
        total, kinds = np.bincount(at, count), np.bincount(at, count > 0)
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1)[at] + weight[at] * shared))
        weights.append(np.log(weight))
    return Model(codes, (logs[0] - logs[1]).astype(np.float32), contexts, (weights[0] - weights[1]).astype(np.float32))


def features(values: np.ndarray, sizes: np.ndarray) -> list[float]:
    """Length-normalised differences of a text from those of its words: over the whole, and over the strongest windows."""
    out = []
    if not len(values):
        return [0.0] * (2 + len(WINDOWS))
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    length = np.concatenate([[0], np.cumsum(sizes)])
    out.append(total[-1] / length[-1])
    for w in WINDOWS:
        w = min(w, len(values))
        out.append(float(((total[w:] - total[:-w]) / (length[w:] - length[:-w])).max()))
    # strong words against the square root of the length, so that one chance word in a long text counts little
    out.append(float(np.maximum(values - 2.0, 0).sum() / np.sqrt(len(values))))
    return out


class Scorer:
    """Remembers the differences of words."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def values(self, cut: list[list[str]]) -> list[np.ndarray]:
        cache = self.cache
        if missing := list({w for own in cut for w in own if w not in cache}):
            if len(cache) + len(missing) > CACHE_WORDS:
                cache.clear()
                missing = list({w for own in cut for w in own})
            cache.update(zip(missing, self.model.words(missing).tolist(), strict=True))
        return [np.fromiter(map(cache.__getitem__, own), np.float32, len(own)) for own in cut]

    def features(self, texts: list[str | None]) -> np.ndarray:
        cut = [split_words(t) for t in texts]
        rows = [features(v, np.fromiter(map(len, own), np.int64, len(own)) + 1) for own, v in zip(cut, self.values(cut), strict=True)]
        return np.array(rows).reshape(len(texts), 2 + len(WINDOWS))


@dataclass
class ToxicityModel:
    model: Model
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, found: np.ndarray) -> np.ndarray:
        z = np.concatenate([(found - self.mean) / self.scale, np.ones((len(found), 1))], axis=1) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps with a ridge on all weights but the last, the constant."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w, keep = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def count_ngrams(train: DataFrame) -> DataFrame:
    """code, t0, t1, o0, o1: counts of n-grams over all rows of (text, toxic, half), by class and half."""

    def words(batches):
        held: Counter = Counter()

        def rows():
            by_word: dict[str, list[int]] = {}
            for (kind, word), n in held.items():
                by_word.setdefault(word, [0, 0, 0, 0])[kind] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(by_word), pa.string()), *(pa.array([c[k] for c in by_word.values()], pa.int64()) for k in range(4))], names=["word", *COUNTS])

        for part, texts in text_chunks(batches, 0):
            for text, toxic, half in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                kind = (0 if toxic else 2) + half
                for word, n in Counter(split_words(text)).items():
                    held[kind, word] += n
            if len(held) > COUNTER_WORDS:
                yield rows()
        if held:
            yield rows()

    def grams(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 50_000):
                part = batch.slice(a, 50_000)
                codes, sizes = ngrams(part.column(0).to_pylist())
                kinds, at = np.unique(codes, return_inverse=True)
                sums = [np.bincount(at, np.repeat(part.column(1 + k).to_numpy(), sizes), len(kinds)).astype(np.int64) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, sums)], names=["code", *COUNTS])

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    sums = [F.sum(c).alias(c) for c in COUNTS]
    by_word = train.select("text", "toxic", "half").mapInArrow(freed(words), f"word string, {counts}").groupBy("word").agg(*sums)
    return by_word.mapInArrow(freed(grams), f"code bigint, {counts}").groupBy("code").agg(*sums)


def collect_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their counts, of every n-gram."""
    found = materialise(counts).select("code", *COUNTS).toArrow()
    codes = found.column(0).to_numpy()
    order = np.argsort(codes)
    return codes[order], np.stack([found.column(1 + k).to_numpy()[order].astype(np.float32) for k in range(4)])


def chosen(labels: DataFrame, rows: int) -> DataFrame:
    """All labels, or of more than `rows` about so many, those with the smallest hashes of their ids."""
    n = labels.count()
    return labels if n <= rows else labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < int(rows / n * (1 << 53)))


def train_toxicity(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS, labelled_rows: int = LABELLED_ROWS) -> ToxicityModel:
    """docs: (doc_id, text); labels: (doc_id, toxic) with toxic 0 or 1, other labels are left out.

    Texts of labelled rows alone are shuffled; the calibration sample is small enough to be broadcast.
    Without rows of both classes every score is that of the base rate, or 0.5 without any row.
    """
    with scratch(docs.sparkSession):
        model = find_toxicity_model(docs.select("doc_id", "text"), labels, calibration_rows, labelled_rows)
    give_back_memory()
    return model


def find_toxicity_model(docs: DataFrame, labels: DataFrame, calibration_rows: int, labelled_rows: int) -> ToxicityModel:
    spark = docs.sparkSession
    smaller_batches(spark)
    key = F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string")).cast("binary"))
    labels = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("half", (key % 2).cast("int"))
    labels = materialise(labels.filter("doc_id is not null"))
    labels = materialise(chosen(labels, labelled_rows))
    marks = materialise(bitmap(labels.select(slot_of("doc_id").alias("slot")).distinct()))
    codes, (t0, t1, o0, o1) = collect_counts(count_ngrams(marked(docs, slot_of("doc_id"), marks).join(labels.hint("merge"), "doc_id")))
    halves = spark.sparkContext.broadcast((fit_model(codes, t1, o1), fit_model(codes, t0, o0)))

    def calibrate(batches):
        scorers = [Scorer(m) for m in halves.value]
        for part, texts in text_chunks(batches, 0):
            half = np.array(part.column(2).to_pylist())
            found = np.where(half[:, None] == 0, scorers[0].features(texts), scorers[1].features(texts))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(found), pa.list_(pa.float64()))], names=["toxic", "x"])

    sample = F.broadcast(materialise(chosen(labels, calibration_rows)))
    found = docs.join(sample, "doc_id").select("text", "toxic", "half").mapInArrow(freed(calibrate), "toxic int, x array<double>").toArrow()
    halves.unpersist()
    x, y = np.array(found.column("x").to_pylist(), float).reshape(-1, 2 + len(WINDOWS)), np.array(found.column("toxic").to_pylist(), float)
    model = fit_model(codes, t0 + t1, o0 + o1)
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return ToxicityModel(model, np.zeros(x.shape[1]), np.ones(x.shape[1]), np.array([0.0] * x.shape[1] + [np.log(rate / (1 - rate))]))
    return ToxicityModel(model, *fit_logistic(x, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column added, which replaces one of that name; rows, their order in a partition and other columns stay."""
    spark = docs.sparkSession
    smaller_batches(spark)
    held = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != score_col]
    at = names.index(text_col)

    def run(batches):
        scorer = Scorer(held.value.model)
        for part, texts in text_chunks(batches, at):
            score = held.value.score(scorer.features(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*names, score_col])

    own = docs.select(*names)
    schema = StructType([*own.schema.fields, StructField(score_col, DoubleType())])
    return own.mapInArrow(freed(run), schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_split("doc_id", 3, 1)
    model = train_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
