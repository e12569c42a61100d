"""Toxicity, languages, quality and resampling."""

import random

import numpy as np
import pytest

from marlspike.llm import language_id, quality_rules, resampling, toxicity


@pytest.fixture(scope="module")
def labelled(spark, prose_of):
    random.seed(3)
    docs, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        words = prose_of(60, i).split()
        for _ in range(4 * toxic):
            words[random.randrange(60)] = random.choice(["blarghidiot", "morgnoth", "scumblar"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 > 0), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_rows_not_learnt_from(labelled):
    docs, labels = labelled
    model = toxicity.train_toxicity(docs, labels.filter("doc_id < 200"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(200, 300))
    assert all(0 <= s <= 1 for s in got.values())


def kneser_ney(codes):
    """The shared probability of every symbol after a context of up to ORDER - 1 symbols, by recursion on tuples."""
    grams = {tuple(int(c) >> 6 * k & 63 for k in range(toxicity.ORDER - 1, -1, -1)) for c in codes}

    def probability(symbol, context):
        n = len(context)
        before = {g for g in grams if n == 0 or g[-1 - n : -1] == context}
        # kinds of longer contexts in which the symbol, or any symbol, was seen; the longest contexts are kinds themselves
        kinds = {g[-2 - n :] for g in before}
        count = sum(g[-1] == symbol for g in kinds)
        types = len({g[-1] for g in kinds})
        below = 1 / 64 if n == 0 else probability(symbol, context[1:])
        return below if not kinds else (max(count - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * types * below) / len(kinds)

    return probability


def test_kneser_ney_sums_to_one_and_equals_brute_force():
    toxic, ordinary = ["abab", "abba", "baba", "bab"], ["abcd", "bcda", "abba"]
    every, sizes = toxicity.ngrams(toxic + ordinary)
    side = np.repeat([True] * 4 + [False] * 3, sizes)
    codes = np.unique(every)
    counts = [np.array([(every[side == s] == c).sum() for c in codes]) for s in (True, False)]
    shared, probability = toxicity.shared_probability(codes), kneser_ney(codes)
    model = toxicity.fit_model(codes, *counts)
    tuples = [tuple(int(c) >> 6 * k & 63 for k in range(5, -1, -1)) for c in codes]
    for t, p in zip(tuples, shared, strict=True):
        assert p == pytest.approx(probability(t[-1], t[1:-1]))
    for context in {t[:-1] for t in tuples}:
        values = []
        for count in counts:
            own = {t[-1]: n for t, n in zip(tuples, count, strict=True) if t[:-1] == context and n}
            total, below = sum(own.values()), [probability(x, context[1:]) for x in range(64)]
            assert sum(below) == pytest.approx(1)
            values.append([(max(own.get(x, 0) - 0.75, 0) + 0.75 * len(own) * b) / total if total else b for x, b in enumerate(below)])
            assert sum(values[-1]) == pytest.approx(1)
        asked = np.array([sum(x << 6 * k for k, x in enumerate(reversed((*context, last)))) for last in range(64)])
        assert model.llr(asked) == pytest.approx(np.log(values[0]) - np.log(values[1]), abs=1e-4)


def test_labelled_rows_are_bounded_by_hash(labelled):
    docs, labels = labelled
    few = toxicity.chosen(labels, 100).count()
    assert 60 < few < 140 and toxicity.chosen(labels, 300).count() == 300
    model = toxicity.train_toxicity(docs, labels, labelled_rows=200)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in range(300)]) > 0.95


def test_rare_ngrams_stay_however_many(spark):
    n = 3_000_001
    codes, counts = toxicity.collect_counts(spark.range(n).selectExpr("id AS code", "id % 2 AS t0", "0L AS t1", "1 - id % 2 AS o0", "0L AS o1"))
    assert len(codes) == n and counts.sum() == n


def test_toxicity_awkward(awkward, empty, labelled):
    model = toxicity.train_toxicity(*labelled)
    got = toxicity.score_toxicity(awkward, model)
    assert got.count() == 8 and set(got.columns) == set(awkward.columns)
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.train_toxicity(empty, labelled[1].limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(awkward, none).collect()} == {0.5}


def test_languages(spark):
    texts = {"en": "the cat and the dog were with this that thing of which they there", "de": "der hund und die katze nicht mit einer schule ich sich über das", "ru": "кошка и собака были вместе там где они жили"}
    random.seed(4)
    rows = [(i, " ".join(random.choices(texts[lang].split(), k=20)), lang) for i, lang in enumerate(list(texts) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train_languages(docs)
    mixed = spark.createDataFrame([(1, "the cat and the dog were with der hund und die katze nicht mit"), (2, None), (3, "123 !!"), (4, "кошка там"), (5, "日本"), (6, ""), (7, "² ½ ①"), (8, "123 ½ Ⅷ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify_languages(mixed, model).collect()}
    assert [(s["lang"], s["start"], s["stop"]) for s in got[1]["spans"]] == [("en", 0, 7), ("de", 7, 14)]
    assert [got[i]["lang_pred"] for i in (2, 3, 6, 7, 8)] == ["und"] * 5 and got[2]["score"] == 0
    assert got[4]["lang_pred"] == "ru" and got[5]["lang_pred"] in texts
    assert language_id.identify_languages(mixed, language_id.train_languages(docs.limit(0))).filter("lang_pred != 'und'").count() == 0


def test_marks_do_not_cut_words():
    assert language_id.parts("हिन्दी") == ["हिन्दी"] and language_id.parts("e\u0301te\u0301 x²") == ["e\u0301te\u0301", "x"]


def test_viterbi_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 3, 6])
    e = rng.normal(size=(14, 3)).astype(np.float32) * 3
    prior = np.zeros(3, np.float32)
    labels = language_id.viterbi(e, lengths, prior, 2.0)
    for start, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        value = lambda p: sum(e[start + i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert value(best) == pytest.approx(value(tuple(labels[start : start + n])), abs=1e-4)


def test_language_edges(awkward, empty):
    model = language_id.train_languages(awkward)
    assert language_id.identify_languages(awkward, model).count() == 8
    assert language_id.identify_languages(empty, model).count() == 0


def test_statistics_against_brute_force():
    import re
    from collections import Counter

    word = re.compile(r"[^\x20\x09-\x0D]+")
    random.seed(3)
    for _ in range(400):
        text = "".join(random.choice(["a", "B", "7", "É", "٣", " ", "\n", "é", "\x85", "\xa0", "\x1c", "# ", "c ", "\t", "x y z "]) for _ in range(random.randint(0, 60)))
        words = word.findall(text)
        counts, twice, seen, dups = Counter(zip(words, words[1:], words[2:])), set(), set(), 0
        for i in range(len(words) - 2):
            if counts[tuple(words[i : i + 3])] >= 2:
                twice |= {i, i + 1, i + 2}
        for line in text.split("\n"):
            if word.search(line):
                dups += line in seen
                seen.add(line)
        assert quality_rules.digits_and_capitals(text) == (sum(c.isdecimal() for c in text), sum(c.isupper() for c in text))
        assert quality_rules.statistics(text)[0] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(twice))


def test_forest_is_monotonic():
    rng = np.random.default_rng(2)
    k = len(quality_rules.FEATURES)
    x = rng.random((800, k))
    at = quality_rules.FEATURES.index("symbols")
    y = (x[:, 0] + np.sin(9 * x[:, at]) + rng.normal(0, 0.2, 800) > 0.8).astype(float)
    forest = quality_rules.fit_forest(x, y, 30)
    grid = np.tile(rng.random(k), (50, 1))
    grid[:, at] = np.linspace(0, 1, 50)
    assert (np.diff(forest.score(grid)) <= 1e-12).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.75


def test_quality_edges(awkward, empty, labelled):
    forest = quality_rules.train_quality(*labelled)
    got = quality_rules.judge_quality(awkward, forest).collect()
    assert len(got) == 8
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert quality_rules.judge_quality(empty, forest).count() == 0
    none = quality_rules.train_quality(labelled[0], labelled[1].limit(0))
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judge_quality(awkward, none).collect())


def test_resampling(labelled, awkward, empty, spark):
    docs, _ = labelled
    target = docs.filter("doc_id % 4 = 0")
    got = resampling.resample(docs, target, 0.25).collect()
    assert sum(r["selected"] for r in got) == 75
    assert np.mean([r["doc_id"] % 4 == 0 for r in got if r["selected"]]) > 0.9
    kept = sorted((r["noisy"] for r in got if r["selected"]))
    assert kept[0] >= max(r["noisy"] for r in got if not r["selected"])
    edges = resampling.resample(awkward, target).collect()
    assert len(edges) == 8 and not any(r["selected"] for r in edges if r["n_grams"] == 0)
    assert resampling.resample(empty, target).count() == 0


def test_kth_largest(spark):
    random.seed(7)
    keys = [random.choice([-(2**63), -5, 0, 7, random.randrange(-(2**62), 2**62)]) for _ in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 50, 137, 200):
        assert resampling.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


def test_resampling_against_brute_force(spark, prose_of):
    """Weights from plain counters, and the draw as the largest noisy weights."""
    import math
    from collections import Counter

    texts = {i: prose_of(5 + i % 40, i) for i in range(120)} | {500: "", 501: None, 502: "... !", 503: "One, two: one two"}
    buckets = {i: resampling.ngram_buckets(t, resampling.Hashes()).tolist() for i, t in texts.items()}
    words = {i: [w for t in (x or "").lower().split() if (w := resampling.bare(t))] for i, x in texts.items()}
    assert all(len(buckets[i]) == max(0, 2 * len(words[i]) - 1) for i in texts)
    wanted = [i for i in range(120) if i % 6 == 0]
    raw, target = Counter(b for own in buckets.values() for b in own), Counter(b for i in wanted for b in buckets[i])
    size = resampling.BUCKETS
    weight = {i: sum(math.log((target[b] + 1) / (target.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size)) for b in own) for i, own in buckets.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in resampling.resample(df.repartition(3), df.filter("doc_id < 120 and doc_id % 6 = 0"), 0.3).collect()}
    assert all(got[i]["log_weight"] == pytest.approx(weight[i]) and got[i]["n_grams"] == len(buckets[i]) for i in texts)
    drawn = sorted((i for i in texts if buckets[i]), key=lambda i: -got[i]["noisy"])[: round(0.3 * 121)]
    assert {i for i in texts if got[i]["selected"]} == set(drawn)


def test_noise_of_null_ids_comes_from_their_texts(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c d"), (None, "c d"), (1, "a b")], "doc_id long, text string")
    noise = [(r["doc_id"], r["noisy"] - r["log_weight"]) for r in resampling.resample(df, df, 0.5).collect()]
    assert len({round(x, 9) for i, x in noise if i is None}) == 2


def test_trees_against_plain_descent_and_exhaustive_split():
    """Flattened trees give what a walk from node to node gives, and the first split is the best of all cuts."""
    rng = np.random.default_rng(4)
    k = len(quality_rules.FEATURES)
    x = rng.random((300, k))
    y = (x[:, 2] + x[:, 5] * x[:, 0] + rng.normal(0, 0.1, 300) > 0.9).astype(float)
    forest = quality_rules.fit_forest(x, y, 12)

    def walk(row):
        total = forest.start
        for root in forest.roots:
            node = root
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert forest.score(x) == pytest.approx([walk(row) for row in x])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    g, h = y - rate, np.full(len(y), rate * (1 - rate))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)

    def allowed(f, m):
        sign = quality_rules.MONOTONIC.get(quality_rules.FEATURES[f], 0)
        left, right = (g[s].sum() / (h[s].sum() + 2.0) for s in (m, ~m))
        return sign * (right - left) >= 0

    cuts = [(gain(m) + gain(~m), f) for f in range(k) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_rules.BINS + 1)[1:-1])) if h[m := x[:, f] <= c].sum() >= 1 and h[~m].sum() >= 1 and allowed(f, m)]
    assert forest.feature[forest.roots[0]] == max(cuts)[1]


def test_languages_of_rows_not_learnt_from(spark, small):
    from pyspark.sql import functions as F

    got = language_id.op3_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    held = got.filter("held_out AND lang IS NOT NULL").filter(F.length("text") > 0)
    assert held.count() > 20 and held.filter("lang = lang_pred").count() >= 0.95 * held.count()


def test_toxicity_of_rows_not_learnt_from(spark, small):
    import os

    larger = f"{os.path.dirname(small)}/sf0.01"  # the smallest tables have too few toxic rows to learn from
    if not os.path.isdir(larger):
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{larger}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    rows = [(r["toxic"], r["predicted"]) for r in toxicity.op7_toxicity(spark, larger).filter("held_out").join(labels, "doc_id").collect()]
    assert len(rows) > 100 and np.mean([a == b for a, b in rows]) >= 0.95
