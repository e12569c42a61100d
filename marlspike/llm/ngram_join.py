"""Near-duplicate documents by the Jaccard similarity of their word n-grams, with an LSH forest.

A document is the set of its shingles: WORDS_EACH lower-cased words in a row (a shorter text is one
shingle, an empty one has none). Documents of equal sets are copies and are joined once.

1. TREES prefix tries hold a signature of DEPTH minimum hashes each; a node is a prefix, its members are the sets
   below it. Two sets share a prefix of length d with probability J ** d, so they meet in some trie with
   1 - (1 - J ** d) ** TREES. The tries are climbed from whole signatures to ever shorter prefixes until that estimate
   for SIMILARITY reaches the target recall. Only nodes whose members are still in several candidate classes are
   climbed to, so a set stops where shorter prefixes show it nothing new. Such nodes are found by the smallest and largest
   class of each, and a bitmap of them keeps all other rows out of the joins.
2. Sets that share a prefix and whose one-bit sketches agree within four to five standard deviations
   fall into one candidate class. Of whole signatures every set is compared with the first one of its node; above,
   the members outside a node's largest class are compared with one member of it, and at the last length, where classes
   still differ, with the others. No group is expanded into all of its pairs.
3. Candidate classes are verified exactly on whole texts, in blocks of at most BLOCK members: a task
   compares one block, or two blocks of a class, and returns for every member its number of links and one
   chain of links. Members lie in blocks by their distance to the class's pivot; blocks so close to it
   that all their pairs must be similar are counted without being compared.
4. Classes are the connected components of the verified links.

Every table that is reused lies in the shared checkpoint folder. Nothing is collected but counts.

Null and empty texts have no links and are classes of their own. Rows of one doc_id are one document
if their sets are equal; else each of them takes part. Null ids stay, in no particular order.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, freed, marked, materialise, scratch, slot_of, smaller_batches, table, text_chunks, without

SIMILARITY = 0.8
WORDS_EACH = 5
TREES = 16
DEPTH = 8
RECALL = 0.995
BLOCK = 200
#: Bits of the bitmap of nodes, at most.
MOST_BITS = 1 << 26
#: Agreeing bits, of TREES * DEPTH, below which a pair is not verified: at SIMILARITY 0.9 of them are expected.
SKETCH_LEAST = 100
WORDS = re.compile(r"\S+").findall
MIX = np.uint64(0x9E3779B97F4A7C15)


def depths(similarity: float = SIMILARITY, target: float = RECALL) -> list[int]:
    """Prefix lengths in turn: whole signatures, then shorter ones until the estimated recall is the target."""
    out = [DEPTH]
    while out[-1] > 1 and 1 - (1 - similarity ** out[-1]) ** TREES < target:
        out.append(out[-1] - 1)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=200_000)
def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = WORDS(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hash, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS_EACH + 1)
    out = np.full(n, len(h) if len(h) < WORDS_EACH else 0, np.uint64)
    for k in range(min(WORDS_EACH, len(h))):
        out = mixed(out * MIX + h[k : k + n])
    return np.unique(out)


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250101)
    a = rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)[:, None]


def signature(own: np.ndarray) -> np.ndarray:
    """Minimum hashes, high 32 bits, of TREES * DEPTH functions."""
    a, b = permutations()
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 4096):
        np.minimum(low, (own[i : i + 4096] * a + b).min(1), out=low)
    return low >> np.uint64(32)


def described(own: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(number of the set, one-bit sketches of both halves of the signature, the signature)."""
    sig = signature(own)
    bits = np.packbits((mixed(sig) & np.uint64(1)).astype(np.uint8).ravel()).view(np.int64)
    return int(np.int64(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))), int(bits[0]), int(bits[1]), sig.astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, sid, n, b0, b1, sig of every document; sid is null without words."""
    smaller_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "sid", "n", "b0", "b1", "sig"]

    def run(batches):
        for part, texts in text_chunks(batches):
            rows = []
            for text in texts:
                own = shingles(text)
                sid, b0, b1, sig = described(own) if len(own) else (None,) * 4
                rows.append((sid, len(own), b0, b1, sig))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {kind}, sid bigint, n bigint, b0 bigint, b1 bigint, sig array<int>")


def sketch_agrees(a: str, b: str) -> str:
    return f"{TREES * DEPTH} - bit_count({a}.b0 ^ {b}.b0) - bit_count({a}.b1 ^ {b}.b1) >= {SKETCH_LEAST} AND {a}.n >= {SIMILARITY} * {b}.n AND {b}.n >= {SIMILARITY} * {a}.n"


def texts_of(sids: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """sid, text for these sids, from the document that stands for the set."""
    own = materialise(sets.join(sids.distinct(), "sid", "left_semi").select("sid", "doc_id"))
    marks = materialise(bitmap(own.select(slot_of("doc_id").alias("slot")).distinct()))
    found = marked(docs.select("doc_id", "text"), slot_of("doc_id"), marks)
    smaller_batches(docs.sparkSession)

    def run(batches):
        for part, texts in text_chunks(batches):
            made = [shingles(t) for t in texts]
            sid = [int(np.int64(xxhash.xxh64_intdigest(o.tobytes()) - (1 << 63))) if len(o) else None for o in made]
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), part.column(0), part.column(1)], names=["sid", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = found.mapInArrow(freed(run), f"sid bigint, doc_id {kind}, text string").alias("t").join(own.alias("o"), (F.col("t.sid") == F.col("o.sid")) & F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")))
    return read.select("t.sid", "t.text").groupBy("sid").agg(F.min("text").alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """sid, class: the smallest number that a chain of edges (x, y) reaches, for every number with an edge.

    Each round sends every node to its smallest neighbour, follows that once more, and goes on with the edges
    between what is left: they become fewer each time.
    """
    edges = materialise(edges.filter("x != y").select("x", "y").union(edges.filter("x != y").select("y", "x")).distinct())
    classes = None
    while classes is None or not edges.isEmpty():
        low = materialise(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("to")))
        onward = low.select(F.col("x").alias("at"), F.col("to").alias("next"))
        low = materialise(low.join(onward, low["to"] == onward["at"]).select("x", F.col("next").alias("to")))
        if classes is None:
            classes = low.select(F.col("x").alias("sid"), F.col("to").alias("class"))
        else:
            classes = classes.join(low, classes["class"] == low["x"], "left").select("sid", F.coalesce("to", "class").alias("class"))
        classes = materialise(classes)
        left = edges.join(low.withColumnRenamed("to", "p"), "x").select("y", "p")
        edges = left.join(low.select(F.col("x").alias("y"), F.col("to").alias("q")), "y").filter("p != q").select(F.col("p").alias("x"), F.col("q").alias("y")).distinct()
        edges = materialise(edges)
    return classes


def merged(classes: DataFrame, found: DataFrame) -> DataFrame:
    """classes (sid, class) after the links (x, y) between classes; a set without a class is its own."""
    groups = materialise(components(found))
    alone = groups.select("sid").join(classes.select("class").distinct(), groups["sid"] == F.col("class"), "left_anti").select("sid", F.col("sid").alias("class"))
    moved = groups.select(F.col("sid").alias("at"), F.col("class").alias("to"))
    every = classes.union(alone)
    return every.join(moved, every["class"] == moved["at"], "left").select("sid", F.coalesce("to", "class").alias("class"))


def nodes(depth: int) -> Column:
    """The node of every trie that holds the prefix of this length of a set's signature."""
    return F.array(*[F.xxhash64(F.lit(tree), F.slice("sig", tree * DEPTH + 1, depth)) for tree in range(TREES)])


def in_several(members: DataFrame, of: str) -> DataFrame:
    """Rows of members whose node k holds several values of a column, and a few others: a bitmap keeps the rest out of later shuffles."""
    shared = materialise(members.groupBy("k").agg(F.min(of).alias("low"), F.max(of).alias("high")).filter("low != high").select("k"))
    bits = min(MOST_BITS, 1 << max(20, (8 * shared.count()).bit_length()))
    slot = slot_of("k", bits)
    return marked(members, slot, materialise(bitmap(shared.select(slot.alias("slot")).distinct())))


def with_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members and a column class, their own sid without one; only those that may have one are shuffled."""
    marks = materialise(bitmap(classes.select(slot_of("sid").alias("slot")).distinct()))
    maybe, other = (marked(members, slot_of("sid"), marks, hit) for hit in (True, False))
    return maybe.join(classes, "sid", "left").select(*members.columns, F.coalesce("class", "sid").alias("class")).unionByName(other.withColumn("class", F.col("sid")))


def candidate_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sid, class) of sets that have candidates, and pairs (x, y) of sets with the first of their whole signatures."""
    whole, *shorter = depths()
    deep = materialise(in_several(sets.select("sid", "n", "b0", "b1", F.explode(nodes(whole)).alias("k")), "sid"))
    first = deep.groupBy("k").agg(F.min(F.struct("sid", "n", "b0", "b1")).alias("f"), F.count("*").alias("m")).filter("m > 1").select("k", "f.*")
    pair = [F.col("a.sid").alias("x"), F.col("b.sid").alias("y")]
    stars = deep.alias("a").join(first.alias("b"), F.expr(f"a.k = b.k AND a.sid != b.sid AND {sketch_agrees('a', 'b')}")).select(*pair).distinct()
    pairs = materialise(stars)
    classes = materialise(components(pairs))
    for depth, step in [(d, "main") for d in shorter] + [(d, "all") for d in shorter[-1:]]:
        if step == "main":
            kept = own = materialise(in_several(with_classes(sets, classes).select("sid", "n", "b0", "b1", "class", F.explode(nodes(depth)).alias("k")), "class"))
        else:  # classes have only grown since: no other node holds several
            own = with_classes(kept.drop("class"), classes)
        sizes = own.groupBy("k", "class").agg(F.count("*").alias("m"))
        several = sizes.groupBy("k").agg(F.count("*").alias("classes"), F.max_by("class", F.struct("m", "class")).alias("main")).filter("classes > 1").select("k", "main")
        own = materialise(own.join(several, "k"))
        others = own.filter("class != main").alias("a")
        if step == "main":
            members = own.filter("class = main").groupBy("k").agg(F.min(F.struct("sid", "class", "main", "n", "b0", "b1")).alias("f")).select("k", "f.*").alias("b")
        else:
            members = own.alias("b")
        once = "(b.class = b.main OR a.sid < b.sid)"
        found = others.join(members, F.expr(f"a.k = b.k AND a.class != b.class AND {once} AND {sketch_agrees('a', 'b')}"))
        found = materialise(found.select(F.col("a.class").alias("x"), F.col("b.class").alias("y")).distinct())
        if not found.isEmpty():
            classes = materialise(merged(classes, found))
    return classes, pairs


def distances(members: DataFrame) -> DataFrame:
    """members: sid, class, text, pivot_text. sid, class, text, and how far the set is from the pivot, as a share of the pivot's size.

    With u shingles of the pivot missing and v others added, two sets are similar for certain if
    u + SIMILARITY * v of both add up to (1 - SIMILARITY) of the pivot's size or less.
    """

    def run(batches):
        held = {}
        for part, texts in text_chunks(batches, 2):
            far = []
            for c, text, pivot_text in zip(part.column(1).to_pylist(), texts, part.column(3).to_pylist(), strict=True):
                if c not in held:
                    if len(held) > 100:
                        held.clear()
                    held[c] = shingles(pivot_text)
                own, pivot = shingles(text), held[c]
                shared = len(np.intersect1d(own, pivot, assume_unique=True))
                far.append((len(pivot) - shared + SIMILARITY * (len(own) - shared)) / len(pivot))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(far, pa.float64())], names=["sid", "class", "text", "far"])

    return members.select("sid", "class", "text", "pivot_text").mapInArrow(freed(run), "sid bigint, class bigint, text string, far double")


def compared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of left are similar to which of right; a set is not similar to itself where right is left."""
    every = left if right is left else left + right
    kinds, at = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    sizes = np.array([len(s) for s in every])
    m, other = len(left), slice(None) if right is left else slice(len(left), None)
    shared = np.zeros((m, len(right)), np.float32)
    # columns of one set alone add nothing
    often = np.flatnonzero(np.bincount(at) > 1)
    new = np.full(len(kinds), -1)
    new[often] = np.arange(len(often))
    at = new[at]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for a in range(0, len(often), 8192):
        i, j = np.searchsorted(at, [a, a + 8192])
        dense = np.zeros((len(every), min(8192, len(often) - a)), np.float32)
        dense[row[i:j], at[i:j] - a] = 1
        shared += dense[:m] @ dense[other].T
    similar = shared >= SIMILARITY * (sizes[:m, None] + sizes[other][None, :] - shared) - 1e-6
    if right is left:
        np.fill_diagonal(similar, False)
    return similar


def linked(sids: np.ndarray, similar: np.ndarray) -> np.ndarray:
    """For each member the smallest sid that its links lead to. similar: symmetric."""
    label = sids.copy()
    while True:
        low = np.where(similar, label[None, :], label[:, None]).min(1)
        low = np.minimum(low, label)
        if (low == label).all():
            return label
        label = low


VERIFIED = "sid bigint, links bigint, root bigint"


def compare_classes(classes: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """sid, links (similar sets), root (a similar set, or one that links lead to): one row or more for each set."""
    size = classes.groupBy("class").agg(F.count("*").alias("m"))
    members = classes.join(size, "class").join(texts, "sid")

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        own = [shingles(t) for t in frame["text"]]
        similar, sids = compared(own, own), frame["sid"].to_numpy()
        return pd.DataFrame({"sid": sids, "links": similar.sum(1), "root": linked(sids, similar)})

    small = members.filter(F.col("m") <= BLOCK).select("sid", "class", "text").groupBy("class").applyInPandas(whole, VERIFIED)
    large = classes.join(size.filter(F.col("m") > BLOCK), "class")
    if large.isEmpty():
        return small
    # the pivot is the member that most candidate pairs name
    degree = pairs.groupBy("y").agg(F.count("*").alias("degree"))
    pivots = large.join(degree, large["sid"] == degree["y"], "left").groupBy("class").agg(F.max_by("sid", F.struct(F.coalesce("degree", F.lit(0)), "sid")).alias("pivot"))
    pivots = materialise(pivots.join(texts, pivots["pivot"] == texts["sid"]).select("class", "pivot", F.col("text").alias("pivot_text")))
    own = materialise(distances(large.join(texts, "sid").join(pivots, "class")))
    own = own.withColumn("ring", F.floor(F.col("far") * 50).cast("int"))
    rings = materialise(own.groupBy("class", "ring").agg(F.count("*").alias("m"), F.max("far").alias("most")).withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")))
    sure = 1 - SIMILARITY - 1e-9
    own = own.join(rings.select("class", "ring", "parts"), ["class", "ring"]).withColumn("block", F.struct("ring", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part")))
    own = materialise(own.select("sid", "class", "ring", "far", "block", "text"))
    # rings whose members must all be similar to each other are counted, and linked through the pivot
    near = rings.alias("a").join(rings.alias("b"), F.expr(f"a.class = b.class AND a.most + b.most <= {sure!r}"))
    near = near.groupBy(F.col("a.class").alias("class"), F.col("a.ring").alias("ring")).agg((F.sum("b.m") - F.max(F.when(F.col("a.most") * 2 <= sure, 1).otherwise(0))).alias("links"))
    certain = own.join(near, ["class", "ring"]).join(pivots.select("class", "pivot"), "class").select("sid", "links", F.when(F.col("far") <= sure, F.col("pivot")).otherwise(F.col("sid")).alias("root"))
    blocks = own.groupBy("class", "block").agg(F.first("ring").alias("ring")).join(rings.select("class", "ring", "most"), ["class", "ring"])
    tasks = blocks.alias("a").join(blocks.alias("b"), F.expr(f"a.class = b.class AND a.block <= b.block AND a.most + b.most > {sure!r}"))
    tasks = materialise(tasks.select(F.col("a.class").alias("class"), F.col("a.block").alias("p"), F.col("b.block").alias("q")))
    rows = own.select("class", "block", "sid", "text")
    left = rows.join(tasks.withColumn("block", F.col("p")), ["class", "block"]).withColumn("side", F.lit(0))
    right = rows.join(tasks.filter("p != q").withColumn("block", F.col("q")), ["class", "block"]).withColumn("side", F.lit(1))

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["side"] == 0], frame[frame["side"] == 1]
        left = [shingles(t) for t in a["text"]]
        if not len(b):
            similar, sids = compared(left, left), a["sid"].to_numpy()
        else:
            cross = compared(left, [shingles(t) for t in b["text"]])
            sids = np.concatenate([a["sid"].to_numpy(), b["sid"].to_numpy()])
            similar = np.zeros((len(sids), len(sids)), bool)
            similar[: len(a), len(a) :], similar[len(a) :, : len(a)] = cross, cross.T
        return pd.DataFrame({"sid": sids, "links": similar.sum(1), "root": linked(sids, similar)})

    blockwise = left.unionByName(right).select("class", "p", "q", "sid", "text", "side").groupBy("class", "p", "q").applyInPandas(pair, VERIFIED)
    return small.unionByName(blockwise).unionByName(certain)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), n_copies (documents of
    an equal set, itself included; 1 without words) and n_links (other sets that are similar)."""
    with scratch(docs.sparkSession):
        return materialise(find_duplicates(docs.select("doc_id", "text")), stays=True)


def find_duplicates(docs: DataFrame) -> DataFrame:
    every = materialise(signatures(docs))
    worded = every.filter(F.col("sid").isNotNull())
    sets = worded.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), *[F.first(c).alias(c) for c in ("n", "b0", "b1", "sig")])
    sets = materialise(sets)
    candidates, pairs = candidate_classes(sets)
    texts = materialise(texts_of(candidates.select("sid"), docs, sets))
    found = materialise(compare_classes(candidates, pairs, texts))
    classes = components(found.filter("sid != root").select(F.col("sid").alias("x"), F.col("root").alias("y")))
    own = sets.select("sid", "doc_id", "n_copies").join(classes, "sid", "left").withColumn("class", F.coalesce("class", "sid"))
    ids = own.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    links = found.groupBy("sid").agg(F.sum("links").alias("n_links"))
    own = own.join(ids, "class").join(links, "sid", "left").select("sid", "class_id", "n_copies", "n_links")
    out = every.select("doc_id", "sid").join(own, "sid", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those of a class but its smallest doc_id; all columns stay. Rows with a null id stay."""
    return without(docs, near_duplicates(docs).filter("doc_id != class_id"))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
