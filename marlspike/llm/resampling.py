"""Importance resampling: documents are drawn by how much likelier a target makes them than the raw text.

Words and word pairs are hashed into BUCKETS; the target's and the raw text's bags of hashed n-grams are
multinomials with add-one smoothing. A document's log-weight is the sum of their log-ratios. Gumbel
noise, derived from the document's id, is added, and the largest k are a sample without replacement in
proportion to the weights.

Raw counts cover all documents; the target's come from at most TARGET_ROWS labelled rows, those with the
smallest hashes of their ids. The k-th largest key is found by counting keys by their bits, 16 at a time, in
four passes over (doc_id, key) rows, so that nothing is sorted or collected but 65,536 counts.

Null and empty texts, and texts without a word, have no key and are never drawn. Ties with the k-th key, such
as repeated rows, are all drawn. Rows of one doc_id share its noise; the noise of a null doc_id comes from its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, freed, marked, materialise, scratch, slot_of, smaller_batches, table, text_chunks
from .decontamination import bare

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
SHARE = 0.5
SEED = 17
CACHE_WORDS = 400_000


class Hashes(dict):
    """Remembers the hashes of tokens without the marks around them; 0 if nothing is left."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        word = bare(token)
        found = self[token] = (xxhash.xxh64_intdigest(word) >> 1 | 1) if word else 0
        return found


def ngram_buckets(text: str | None, hashes: Hashes) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    tokens = text.lower().split() if text else []
    own = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    own = own[own > 0]
    mix = np.uint64(0x9E3779B97F4A7C15)
    pairs = (own[:-1] * mix ^ own[1:]) * mix
    return (np.concatenate([own * mix, pairs]) >> np.uint64(50)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    def run(batches):
        hashes, total = Hashes(), np.zeros(BUCKETS, np.int64)
        for _, texts in text_chunks(batches, 0):
            for text in texts:
                total += np.bincount(ngram_buckets(text, hashes), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    smaller_batches(docs.sparkSession)
    out = np.zeros(BUCKETS)
    for bucket, n in docs.select("text").mapInArrow(freed(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weighted(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, noisy (log-weight and Gumbel noise), key (noisy as an integer of the same order)."""
    spark = docs.sparkSession
    smaller_batches(spark)
    held = spark.sparkContext.broadcast(ratios)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes = Hashes()
        for part, texts in text_chunks(batches):
            n, weight = [], []
            for text in texts:
                at = ngram_buckets(text, hashes)
                n.append(len(at))
                weight.append(float(held.value[at].sum()))
            n, weight = np.array(n), np.array(weight)
            names = [text or "" if i is None else str(i) for i, text in zip(part.column(0).to_pylist(), texts, strict=True)]
            u = np.array([(xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), seed) >> 11) + 0.5 for name in names]) / 2.0**53
            noisy = weight - np.log(-np.log(u))
            bits = noisy.view(np.int64)
            key = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(weight), pa.array(noisy, mask=n == 0), pa.array(key, mask=n == 0)], names=["doc_id", "n_grams", "log_weight", "noisy", "key"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {kind}, n_grams bigint, log_weight double, noisy double, key bigint")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest key, by counting the highest bits first; None if k is 0. keys: a stored table with at least k keys."""
    if k < 1:
        return None
    own, prefix = keys.filter("key is not null"), None
    for shift in (48, 32, 16, 0):
        high = F.shiftright("key", shift)
        at = own if prefix is None else own.filter(F.shiftright("key", shift + 16) == prefix)
        for row in sorted(at.groupBy(high.alias("h")).count().collect(), reverse=True):
            if row["count"] >= k:
                prefix = row["h"]
                break
            k -= row["count"]
    return prefix


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, noisy, selected: a share of the documents that have words is drawn.

    target: (text) rows of the wanted kind; without any, all documents are equally likely.
    """
    with scratch(docs.sparkSession):
        return materialise(find_sample(docs, target, share, seed), stays=True)


def find_sample(docs: DataFrame, target: DataFrame, share: float, seed: int) -> DataFrame:
    raw, wanted = bucket_counts(docs), bucket_counts(target)
    scored = materialise(weighted(docs, log_ratios(wanted, raw) if wanted.any() else np.zeros(BUCKETS), seed))
    least = kth_largest(scored, round(share * scored.filter("key is not null").count()))
    selected = F.coalesce(F.col("key") >= F.lit(least).cast("bigint"), F.lit(False))
    return scored.select("doc_id", "n_grams", "log_weight", "noisy", selected.alias("selected"))


def op9_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Half of all documents, drawn by how close they are to those labelled as good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1 and doc_id is not null").select("doc_id")
    with scratch(spark):
        sample = materialise(good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS))
        marks = materialise(bitmap(sample.select(slot_of("doc_id").alias("slot")).distinct()))
        target = marked(docs, slot_of("doc_id"), marks).join(F.broadcast(sample), "doc_id")
        return materialise(resample(docs, target), stays=True)
