import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlspike.llm import ngram_join as m


def brute(docs):
    """doc_id: (class_id, n_copies, n_links)."""
    sets = defaultdict(list)
    for i, text in docs:
        sets[frozenset(m.shingles(text).tolist())].append(i)
    keys = [k for k in sets if k]
    links, parent = Counter(), list(range(len(keys)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(keys)):
        for b in range(a):
            if len(keys[a] & keys[b]) >= 0.8 * len(keys[a] | keys[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    classes = defaultdict(list)
    for a, k in enumerate(keys):
        classes[root(a)] += sets[k]
    return {i: (min(classes[root(a)]), len(sets[k]), links[a]) for a, k in enumerate(keys) for i in sets[k]} | {i: (i, 1, 0) for i in sets.get(frozenset(), [])}


def documents(prose_of):
    random.seed(9)
    docs = []
    for i in range(150):
        words = prose_of(random.choice([120, 200]), random.randrange(3)).split()
        for _ in range(random.choice([0, 0, 1, 1, 2, 2, 3])):
            words[random.randrange(len(words))] = f"w{random.randrange(1000)}"
        docs.append((i, " ".join(words)))
    return [*docs, (150, ""), (151, "short text"), (152, "Short  text"), (153, "a b c d")]


@pytest.mark.parametrize("block", [200, 7])
def test_against_brute_force(spark, prose_of, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    docs = documents(prose_of)
    got = {r["doc_id"]: tuple(r)[1:] for r in m.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected = brute(docs)
    assert sum(e[2] for e in expected.values()) > 500
    # candidate search is probabilistic: nearly all links are found, none is made up
    assert sum(got[i] == expected[i] for i in expected) >= 0.99 * len(expected)


def test_recall_near_the_threshold(spark):
    """Of 400 pairs with a similarity of 0.80 to 0.85, each alone with its like, at least 0.98 are linked."""
    rng = random.Random(21)
    docs, similar = [], []
    while len(similar) < 400:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([80, 150, 300]))]
        other = list(words)
        for _ in range(rng.randrange(1, 8)):
            other[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        a, b = (set(m.shingles(" ".join(x)).tolist()) for x in (words, other))
        if 0.80 <= len(a & b) / len(a | b) <= 0.85:
            similar.append((len(docs), len(docs) + 1))
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))]
    got = {r["doc_id"]: r for r in m.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    linked = [got[b]["class_id"] == a and got[a]["n_links"] == got[b]["n_links"] == 1 for a, b in similar]
    assert sum(linked) >= 0.98 * len(linked), sum(linked)


def test_depths_reach_the_recall():
    found = m.depths()
    assert found[0] == m.DEPTH and 1 - (1 - 0.8 ** found[-1]) ** m.TREES >= m.RECALL


def test_blocks_agree_with_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(12)]
    similar = m.compared(sets, sets)
    cross = m.compared(sets[:5], sets[5:])
    for a in range(12):
        for b in range(12):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert similar[a, b] == (a != b and len(x & y) >= 0.8 * len(x | y))
            if a < 5 <= b:
                assert cross[a, b - 5] == similar[a, b]


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "x long, y long")
    assert {(r["sid"], r["class"]) for r in m.components(edges).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}


def test_awkward(awkward, empty):
    got = sorted(((r["doc_id"], r["class_id"]) for r in m.near_duplicates(awkward).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 2), (None, None), (3, 3), (4, 4), (5, 1), (6, 6)], key=str)
    kept = m.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 6]
    assert m.near_duplicates(empty).count() == 0


def test_rows_of_other_nodes_are_not_shuffled(spark):
    """Of 4,000 nodes every tenth holds two classes: none of its rows is lost, and few others are kept."""
    from pyspark.sql import functions as F

    rows = spark.range(12_000).select(F.col("id").alias("sid"), (F.col("id") % 4000).alias("k"))
    rows = rows.withColumn("class", F.when((F.col("k") % 10 == 0) & (F.col("sid") >= 8000), F.col("sid")).otherwise(F.col("k")))
    kept = m.in_several(rows, "class").collect()
    assert {r["sid"] for r in rows.filter("k % 10 = 0").collect()} <= {r["sid"] for r in kept}
    assert len(kept) < 1300
    classes = m.with_classes(rows.drop("class"), spark.createDataFrame([(5, 1), (9000, 5), (70_000, 2)], "sid long, class long"))
    assert {(r["sid"], r["class"]) for r in classes.collect()} == {(i, {5: 1, 9000: 5}.get(i, i)) for i in range(12_000)}
