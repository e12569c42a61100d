import random

from marlspike.llm.line_dedup import OP2_SQL, kept_places, numbered, op2_line_dedup, posting_pairs, remove_later_lines


def brute(docs):
    """{doc_id: kept line numbers} by comparing every line with all earlier ones."""
    lines = sorted((i, n, frozenset(w for w in line.lower().split())) for i, text in docs for n, line in enumerate((text or "").split("\n")))
    lines = [x for x in lines if x[2]]
    kept = {i: [] for i, _, _ in lines}
    for k, (i, n, s) in enumerate(lines):
        if not any(len(s & t) >= 0.8 * len(s | t) for j, m, t in lines[:k] if (j, m) < (i, n)):
            kept[i].append(n)
    return kept


def test_against_brute_force(spark, prose_of):
    random.seed(5)
    base = [prose_of(n, n) for n in (4, 5, 6, 9, 12, 25, 50)] + ["one", "one two", "a b c"]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(random.randint(1, 6)):
            words = random.choice(base).split()
            for _ in range(random.randint(0, max(1, len(words) // 8))):
                words[random.randrange(len(words))] = random.choice(["new", "other", f"w{random.randrange(30)}"])
            lines.append(" ".join(words))
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in kept_places(df).collect()} == brute(docs)


def test_sql(spark, small, compare):
    compare(op2_line_dedup(spark, small), OP2_SQL, small)


def test_awkward(awkward, empty):
    got = {(r["doc_id"], r["text"]) for r in remove_later_lines(awkward).collect()}
    ids = {g[0] for g in got}
    assert {1, 2, 3, 4, 6, None} <= ids and 5 not in ids
    assert remove_later_lines(awkward).columns == awkward.columns
    assert remove_later_lines(awkward).filter("doc_id = 1").count() == 2
    assert remove_later_lines(empty).count() == 0


def test_text_without_later_lines(spark):
    df = spark.createDataFrame([(1, "a b c d e\n\nx\na b c d e"), (2, "x\ny y y")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in remove_later_lines(df).collect()} == {1: "a b c d e\n\nx", 2: "y y y"}


def test_settled_lines_meet_only_later_ones(spark):
    """A pair whose later line has gone decides nothing."""
    for level in (1, 40):
        sets = lambda ids, level=level: spark.createDataFrame([(i, 10, 0, [(level << 26) - (1 << 31) + w for w in range(3)]) for i in ids], "id long, size int, bits long, prefix array<int>")
        pairs = posting_pairs(sets([0, 5, 8]), sets([3, 7, 9])).collect()
        assert {(r["a"], r["b"]) for r in pairs} == {(0, 5), (0, 8), (5, 8), (3, 5), (3, 8), (7, 8)}


def test_numbers_follow_places(spark):
    places = [(d, n) for d in [None, *range(-3, 40)] for n in (0, 2, 10)]
    rows = random.Random(2).sample(places, len(places))
    got = numbered(spark.createDataFrame([(p,) for p in rows], "place struct<doc_id: long, line_no: int>").repartition(7)).collect()
    assert [tuple(r["place"]) for r in sorted(got, key=lambda r: r["id"])] == places


def test_settled_lines_are_met_alone(spark):
    """Before all pairs are made, unsettled lines meet settled ones only, on every word that either side posts."""
    for level in (1, 40):
        sets = lambda ids, level=level: spark.createDataFrame([(i, 10, 0, 0, [(level << 26) - (1 << 31) + w for w in range(3)]) for i in ids], "id long, size int, bits long, more long, prefix array<int>")
        pairs = posting_pairs(sets([0, 5, 8]), sets([3, 7, 9]), among=False).collect()
        assert {(r["a"], r["b"]) for r in pairs} == {(3, 5), (3, 8), (7, 8)}


def test_second_bitmap_of_long_lines(spark):
    """Unlike long lines whose bitmaps of 64 bits are close by chance are no pair; the second ones of shorter lines say nothing."""
    prefix = [-(1 << 31), 1 - (1 << 31)]
    # of 0.2 / 1.8 of 300 words at most 33 may differ: 30 bits of all words do, but 32 of the words with a mark
    sets = lambda i, size, bits, more: spark.createDataFrame([(i, size, bits, more, prefix)], "id long, size int, bits long, more long, prefix array<int>")
    far, near = (1 << 30) - 1, (1 << 32) - 1 << 20
    pairs = lambda size, more: posting_pairs(sets(0, size, 0, 0).union(sets(1, size, far, more)), sets(2, size, 0, 0)).count()
    assert pairs(150, near) == 0
    assert pairs(150, far) == 1
    assert posting_pairs(sets(0, 60, 0, 0).union(sets(1, 60, 1, near)), sets(2, 60, 0, 0)).count() == 1


def test_long_lines_against_brute_force(spark):
    random.seed(9)
    base = [[f"{k}x{n}" for n in range(size)] for k, size in enumerate((88, 95, 97, 120, 180, 300))]
    docs = []
    for i in range(80):
        words = list(random.choice(base))
        for n in random.sample(range(len(words)), int(len(words) * random.choice((0, 0.05, 0.09, 0.1, 0.11, 0.12, 0.15)))):
            words[n] = f"{random.randrange(10 ** 6)}y"
        docs.append((i, " ".join(words[random.randrange(9):])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in kept_places(df).collect()} == brute(docs)
