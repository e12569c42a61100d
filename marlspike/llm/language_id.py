"""Language identification of whole and mixed-language texts.

The script of a word narrows its candidate languages; a character trigram model of each candidate
scores the word; Viterbi with a penalty for each switch labels the words, and runs of a label are the
text's spans. A text's language is the one whose spans hold the most letters, its score their share.

The models are fitted on a bounded sample: about ROWS_EACH rows of each language, those with the
smallest hashes of their ids. Counts have a fixed size, 2 ** 18 trigrams a language, and are all that
is collected and broadcast. MAX_LANGUAGES bounds the languages.

Null texts and texts without a letter are `und` with score 0. Words of scripts that no language of the
sample uses fit all languages alike; a text of such words gets the most frequent language. Without any
training row all texts are `und`. Rows are independent: repeated ids and rows stay as they are. A null doc_id is
not held out, and such rows are learnt from like others.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, is_split, smaller_batches, table, text_chunks
from .toxicity import FOLD

ROWS_EACH = 4000
MAX_LANGUAGES = 250
SWITCH = 6.0
CHUNK = 4_000_000
CACHE_WORDS = 300_000
#: A language is a candidate for words of a script that has this share of its letters.
SCRIPT_SHARE = 0.005
#: Letters with the marks on them; superscripts, fractions and circled digits are none.
LETTERS = regex.compile(r"(?:\p{L}\p{M}*)+")
# First and last code point of blocks of letters, and their script.
SCRIPTS = [
    (0x0041, 0x024F, "latin"),
    (0x0250, 0x02AF, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0750, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0A00, 0x0A7F, "gurmukhi"),
    (0x0A80, 0x0AFF, "gujarati"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0C00, 0x0C7F, "telugu"),
    (0x0C80, 0x0CFF, "kannada"),
    (0x0D00, 0x0D7F, "malayalam"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]
STARTS = [s[0] for s in SCRIPTS]
SCRIPT_NAMES = sorted({s[2] for s in SCRIPTS}) + ["other"]


def script_of(word: str) -> int:
    """Number of the script of the word's first letter."""
    return letter_script(word[0])


@lru_cache(maxsize=4096)
def letter_script(letter: str) -> int:
    i = bisect_right(STARTS, ord(letter)) - 1
    return SCRIPT_NAMES.index(SCRIPTS[i][2]) if i >= 0 and ord(letter) <= SCRIPTS[i][1] else len(SCRIPT_NAMES) - 1


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the trigrams of these words, where each word's begin): two pads in front, an end behind."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) & 0xFFFF
    starts = np.cumsum(lengths + 3) - lengths - 3
    flat = np.zeros(int((lengths + 3).sum()), np.int64)
    flat[np.arange(len(points)) + np.repeat(starts + 2 - (np.cumsum(lengths) - lengths), lengths)] = FOLD[points]
    flat[starts + lengths + 2] = 1
    codes = flat[:-2] << 12 | flat[1:-1] << 6 | flat[2:]
    begins = np.cumsum(lengths + 1) - lengths - 1
    return codes[np.arange(int((lengths + 1).sum())) + np.repeat(starts - begins, lengths + 1)], begins


def parts(token: str) -> list[str]:
    return LETTERS.findall(token)


class LanguageModel:
    """counts: languages x 2 ** 18 trigram counts; scripts: languages x scripts letter counts; rows: training rows."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, rows: np.ndarray):
        self.languages = languages
        self.prior = np.log(np.maximum(rows, 1) / max(rows.sum(), 1)).astype(np.float32)
        n = counts.reshape(len(languages), 64, 64, 64).astype(np.float64)
        uni = n.sum((1, 2)) + 0.5
        uni /= uni.sum(1, keepdims=True)
        two = n.sum(1)
        two = (two + 5 * uni[:, None, :]) / (two.sum(2, keepdims=True) + 5)
        self.logs = np.log((n + 5 * two[:, None]) / (n.sum(3, keepdims=True) + 5)).astype(np.float32).reshape(len(languages), 1 << 18).T.copy()
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)

    def words(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods of tokens in each language, relative to the best; their letters).

        Languages that do not use a word's script cannot have it, unless none does.
        """
        cut = list(map(parts, tokens))
        own = [p for c in cut for p in c]
        total = np.zeros((len(tokens), len(self.languages)), np.float32)
        letters = np.zeros(len(tokens), np.int64)
        if own:
            token = np.repeat(np.arange(len(tokens)), list(map(len, cut)))
            codes, begins = trigrams(own)
            logs = np.add.reduceat(self.logs[codes], begins, axis=0)
            may = self.uses[:, list(map(script_of, own))].T
            logs = np.where(may, logs, -1e4) * may.any(1, keepdims=True)
            np.add.at(total, token, logs.astype(np.float32))
            letters = np.bincount(token, list(map(len, own)), len(tokens)).astype(np.int64)
        return total - total.max(1, keepdims=True), letters


def viterbi(emissions: np.ndarray, lengths: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of the words of many texts; all texts take a step together, and leave when they end."""
    k = emissions.shape[1]
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    first = starts[order]
    stay = np.zeros((len(emissions), k), bool)
    best = np.zeros(len(emissions), np.int64)
    out = np.zeros(len(emissions), np.int64)
    v = np.tile(prior, (len(lengths), 1))
    final = np.zeros(len(lengths), np.int64)
    for t, m in enumerate(active.tolist()):
        own, at = v[:m], first[:m] + t
        top = own.argmax(1)
        floor = own[np.arange(m), top, None] - switch
        best[at] = top
        stay[at] = own >= floor
        v[:m] = np.maximum(own, floor) + emissions[at]
    if len(lengths):
        final = v.argmax(1)
    label = final
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = np.where(stay[at, label[:m]], label[:m], best[at])
    return out


class Labeller:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, len(self.model.languages)), np.float32)
        self.letters = np.zeros(4096, np.int64)

    def ids(self, tokens: list[str]) -> list[int]:
        get = self.index.get
        found = list(map(get, tokens))
        if None in found:
            new = list({t for t, i in zip(tokens, found, strict=True) if i is None})
            n = len(self.index)
            rows, letters = self.model.words(new)
            if n + len(new) > len(self.rows):
                more = n + 2 * len(new)
                self.rows, self.letters = (np.concatenate([x[:n], np.zeros((more - n, *x.shape[1:]), x.dtype)]) for x in (self.rows, self.letters))
            self.rows[n : n + len(new)], self.letters[n : n + len(new)] = rows, letters
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            found = list(map(get, tokens))
        return found

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, score, spans of white-space words) of each text."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        k = len(self.model.languages)
        cut = [t.lower().split() if t and k else [] for t in texts]
        ids = np.array(self.ids([t for own in cut for t in own]), np.int64)
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        if not len(ids):
            return [("und", 0.0, [])] * len(texts)
        labels = viterbi(self.rows[ids], lengths, self.model.prior)
        letters = self.letters[ids]
        doc = np.repeat(np.arange(len(cut)), lengths)
        held = np.bincount(doc * k + labels, letters, len(cut) * k).reshape(-1, k)
        change = np.flatnonzero(np.diff(doc * k + labels, prepend=-1))
        spans: list[list] = [[] for _ in cut]
        ends = np.append(change[1:], len(ids))
        base = np.cumsum(lengths) - lengths
        for a, b in zip(change.tolist(), ends.tolist(), strict=True):
            d = int(doc[a])
            spans[d].append((self.model.languages[labels[a]], a - int(base[d]), b - int(base[d])))
        top, total = held.argmax(1), held.sum(1)
        return [(self.model.languages[top[i]], float(held[i, top[i]] / total[i]), spans[i]) if total[i] else ("und", 0.0, []) for i in range(len(cut))]


def train_languages(docs: DataFrame, rows_each: int = ROWS_EACH) -> LanguageModel:
    """docs: (doc_id, text, lang); rows without a language are left out."""
    own = docs.select("doc_id", "text", "lang").filter("lang is not null")
    rows = own.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in rows]
    if not rows:
        return LanguageModel([], np.zeros((0, 1 << 18)), np.zeros((0, len(SCRIPT_NAMES))), np.zeros(0))
    hashed = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 53))
    share: Column = F.lit(0)
    for r in rows:
        share = F.when(F.col("lang") == r["lang"], F.lit(int((1 << 53) * min(1, rows_each / r["count"])))).otherwise(share)
    sample = own.filter(hashed < share).select("text", "lang")
    smaller_batches(docs.sparkSession)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for part, texts in text_chunks(batches, 0):
            for text, lang in zip(texts, part.column(1).to_pylist(), strict=True):
                held = counts.setdefault(lang, np.zeros((1 << 18) + len(SCRIPT_NAMES), np.int64))
                if words := parts((text or "").lower()):
                    held[: 1 << 18] += np.bincount(trigrams(words)[0], minlength=1 << 18)
                    np.add.at(held, (1 << 18) + np.array(list(map(script_of, words))), list(map(len, words)))
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(held[at])], names=["lang", "code", "n"])

    found = sample.mapInArrow(freed(run), "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), (1 << 18) + len(SCRIPT_NAMES)))
    row = np.array([languages.index(x) for x in found.column(0).to_pylist()], np.int64)
    counts[row, found.column(1).to_numpy().astype(np.int64)] = found.column(2).to_numpy()
    return LanguageModel(languages, counts[:, : 1 << 18], counts[:, 1 << 18 :], np.array([r["count"] for r in rows], float))


def identify_languages(docs: DataFrame, model: LanguageModel, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, n_spans and, with spans, the spans (lang, first word, word behind the last)."""
    spark = docs.sparkSession
    smaller_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        labeller = Labeller(held.value)
        for part, texts in text_chunks(batches, max_chars=CHUNK):
            made = labeller.label(texts)
            columns = [part.column(0), pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.float64()), pa.array([len(m[2]) for m in made], pa.int64())]
            if spans:
                columns.append(pa.array([[{"lang": s[0], "start": s[1], "stop": s[2]} for s in m[2]] for m in made], span))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_spans", "spans"][: len(columns)])

    schema = f"doc_id {kind}, lang_pred string, score double, n_spans bigint" + ", spans array<struct<lang:string,start:bigint,stop:bigint>>" * spans
    return docs.select("doc_id", "text").mapInArrow(freed(run), schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_split("doc_id", 4, 2)
    model = train_languages(docs.filter(~held_out))
    return identify_languages(docs, model, spans=False).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")
