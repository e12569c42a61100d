"""Benchmark decontamination by latent semantic retrieval and subsequence checks.

1. The hashed words of every document and how often it has them (TERMS buckets) are written once; document
   frequencies are counted over all of them.
2. A distributed randomised SVD (power iterations of A'A on a random basis, partial products summed by
   Spark) of the TF-IDF rows of all documents gives their strongest directions. The latent space of a block
   is spanned by the same iterations over its benchmark items and these directions. It then grows by what it
   lacks of items, until each keeps KEEP of its length in it.
3. Documents are read once for PASS_BLOCKS blocks of ITEM_BLOCK items. A window holds an item's number of words
   and one or two steps more; windows begin at every step of a document, and a step is a third to a fifth of the
   item, at most STEP words. Windows are compared with items by cosine in the space (the window's length is that of
   its full TF-IDF vector). GROUP items together have, word by word, an upper bound of their products; only where
   it reaches COSINE are they looked at one by one, which loses nothing.
4. A candidate is checked on its window with half an item more on both sides. An item is contained if the longest
   common subsequence of words covers VERBATIM of it, or covers PARAPHRASE of it and the answer, its last
   quarter, is covered to ANSWER.

Broadcast are document frequencies, and products of TERMS buckets with the items of a pass. Documents are not
shuffled. What is found in a document depends on that document alone. Null and empty texts, and items without words,
match nothing; repeated rows are one document: (doc_id, item_id) has the best passage of either. Null ids are
kept as ids.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, give_back_memory, materialise, scratch, smaller_batches, table, text_chunks, without

TERMS = 1 << 14
RANK = 128
EXTRA = 16
POWERS = 3
#: Words between the starts of two windows of a document, at most.
STEP = 8
ITEM_BLOCK = 500
PASS_BLOCKS = 4
GROUP = 16
#: Words that are looked at together, besides those of a window.
SPAN = 1 << 16
#: Share of its TF-IDF length that each item keeps in the space.
KEEP = 0.95
#: Weight of a document beside an item; more documents than DOCUMENTS together weigh as much as so many.
DOCUMENT_WEIGHT = 0.05
DOCUMENTS = 2000
#: Buckets whose partial products are summed together.
RANGE = 256
#: Rows of a matrix that the driver has in double precision at once.
ROWS = 1 << 10
#: Buckets of documents, and numbers of a dense block, that a task multiplies at once.
ENTRIES = 1 << 20
BLOCK = 1 << 21
#: Share of documents from which a bucket's column is multiplied as a dense one: at about 80 GFlop/s that takes less time.
DENSE = 0.01
COSINE = 0.4
VERBATIM = 0.7
PARAPHRASE = 0.5
ANSWER = 0.8
#: Characters that are hashed at once, at about 100 bytes each.
CHUNK = 500_000
#: Marks at an end of a token that are passed one by one.
MARKS = 8
MIX = 0x9E3779B97F4A7C15
SPACE = re.compile(r"\s")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(token: str) -> str:
    return token if token.isalnum() else EDGE.sub("", token)


@lru_cache(maxsize=1)
def kinds_of_points() -> np.ndarray:
    """For each code point 0 if it is white space, 1 if a word can begin and end with it, else 2."""
    return np.fromiter((0 if c.isspace() else 1 if c.isalnum() else 2 for c in map(chr, range(0x110000))), np.uint8, 0x110000)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MIX and of its inverse, modulo 2 ** 64."""
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n - 1, base, np.uint64)])) for base in (MIX, pow(MIX, -1, 1 << 64)))


def pieces(text: str):
    """text in pieces of about CHUNK, cut at white space."""
    start = 0
    while len(text) - start > CHUNK and (cut := SPACE.search(text, start + CHUNK)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def token_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each lower-cased token without the marks around it, TERMS if nothing else is left; tokens of each text).

    Tokens are those of str.split(). Their hashes are differences of one running sum over all characters.
    """
    if len(texts) == 1 and texts[0] and len(texts[0]) > 2 * CHUNK:
        parts = [token_terms([x])[0] for x in pieces(texts[0])]
        return np.concatenate(parts), np.array([sum(map(len, parts))])
    lowered = [t.lower() if t else "" for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds_of_points()[points]
    word = kind != 0
    # white space ends the last text, so borders come in pairs
    borders = np.flatnonzero(np.diff(word, prepend=False))
    begins, first, last = borders[::2], borders[::2].copy(), borders[1::2] - 1
    for at, mark in ((first, 1), (last, -1)):
        left = np.flatnonzero(kind[at] == 2)
        for _ in range(MARKS):
            at[left] += mark
            left = left[(kind[at[left]] == 2) & (first[left] <= last[left])]
            if not len(left):
                break
        else:  # long runs of marks
            own = np.flatnonzero(kind == 1)
            near = np.searchsorted(own, at[left], "left" if mark > 0 else "right") - (mark < 0)
            at[left] = np.append(own, len(kind) if mark > 0 else -1)[near]
    known = np.flatnonzero(first <= last)
    up, down = powers(1 << max(12, len(points).bit_length()))
    total = np.zeros(len(points) + 1, np.uint64)
    total[1:] = points
    total[1:] += np.uint64(1)
    total[1:] *= up[: len(points)]
    np.cumsum(total, out=total)
    first, last = first[known], last[known]
    hashes = (total[last + 1] - total[first]) * down[first]
    hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(MIX)
    ids = np.full(len(begins), TERMS, np.int64)
    ids[known] = (hashes >> np.uint64(40)) % np.uint64(TERMS)
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    return ids, np.diff(np.searchsorted(begins, ends), prepend=0).astype(np.int64)


def known_terms(text: str | None) -> np.ndarray:
    """The buckets of a text's tokens, without those that hold no word."""
    ids = token_terms([text])[0]
    return ids[ids < TERMS]


def words_of(text: str | None) -> list[str]:
    return [w for t in (text or "").lower().split() if (w := bare(t))]


def term_rows(docs: DataFrame) -> DataFrame:
    """terms (distinct buckets, 16 bits each) and often (how often they occur, 32 bits each) of every row of docs."""

    def run(batches):
        for _, texts in text_chunks(batches, 0, CHUNK):
            ids, counts = token_terms(texts)
            known = ids < TERMS
            pairs, often = np.unique((np.repeat(np.arange(len(texts)), counts) * TERMS + ids)[known], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // TERMS, minlength=len(texts)))])
            columns = [(pairs % TERMS).astype(np.uint16), often.astype(np.int32)]
            own = [pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(c)]) for c in columns]
            yield pa.RecordBatch.from_arrays(own, names=["terms", "often"])

    return materialise(docs.select("text").mapInArrow(freed(run), "terms binary, often binary"))


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each bucket, documents) of term_rows()."""

    def run(batches):
        df = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16), minlength=TERMS + 1)
            df[TERMS] += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for term, n in rows.select("terms").mapInArrow(freed(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[term] = n
    return out[:TERMS], int(out[TERMS])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequencies; the bucket of no word weighs nothing."""
    return np.append(np.log((1 + n) / (1 + df)) + 0.1, 0).astype(np.float32)


def add_product(total: np.ndarray, basis: np.ndarray, idf: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
    """Add a'a times the basis, for the TF-IDF row a of length 1 that has these buckets so often."""
    row = count * idf[at]
    row /= np.linalg.norm(row)
    total[at] += row[:, None] * (row @ basis[at])


def entries(batches, idf: np.ndarray):
    """(buckets, their weights in TF-IDF rows of length 1, ends of the rows) of about ENTRIES buckets of term_rows() at a time."""
    terms, often, held = [], [], 0

    def rows():
        ends = np.cumsum([0, *map(len, terms)]) // 2
        at = np.frombuffer(b"".join(terms), np.uint16)
        row = np.frombuffer(b"".join(often), np.int32) * idf[at]
        size = np.diff(ends)
        norms = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), row * row, len(size)))
        return at, row / np.repeat(norms, size).astype(np.float32), ends

    for batch in batches:
        for t, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t:
                terms.append(t)
                often.append(o)
                held += len(t) // 2
            if held >= ENTRIES:
                yield rows()
                terms, often, held = [], [], 0
    if held:
        yield rows()


class Projector:
    """Projects TF-IDF rows on a basis: buckets of many documents by dense blocks, the others one by one, which gives the same sums."""

    def __init__(self, basis: np.ndarray, frequent: np.ndarray):
        self.basis, self.frequent, self.dense = basis, frequent, basis[frequent]
        self.place = np.full(TERMS, -1, np.int32)
        self.place[frequent] = np.arange(len(frequent))
        self.block = np.zeros((max(1, BLOCK // max(1, len(frequent))), len(frequent)), np.float32)
        self.sums = np.empty_like(self.dense)

    def project(self, at: np.ndarray, row: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
        """The rows times the basis, which, times the rows' transpose, is added to total."""
        n = len(ends) - 1
        of, place = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends)), self.place[at]
        rare = np.flatnonzero(place < 0)
        rare_at, rare_row, rare_of = at[rare], row[rare], of[rare]
        rare_ends, index = np.searchsorted(rare_of, np.arange(n + 1)).tolist(), rare_at.astype(np.intp)
        out = np.zeros((n, self.basis.shape[1]), np.float32)
        for k in range(n):
            a, b = rare_ends[k], rare_ends[k + 1]
            if a < b:
                out[k] = rare_row[a:b] @ self.basis.take(index[a:b], 0)
        own = np.flatnonzero(place >= 0)
        own_of, own_place, own_row = of[own], place[own], row[own]
        sums = np.zeros_like(self.dense) if total is not None else None
        for a in range(0, n, len(self.block)):
            b = min(n, a + len(self.block))
            x, y = np.searchsorted(own_of, (a, b))
            set_at, block = (own_of[x:y] - a, own_place[x:y]), self.block[: b - a]
            block[set_at] = own_row[x:y]
            out[a:b] += block @ self.dense
            if total is not None:
                sums += np.matmul(block.T, out[a:b], out=self.sums)
            block[set_at] = 0
        if total is not None:
            total[self.frequent] += sums
            order = np.argsort(rare_at, kind="stable")
            found, firsts = np.unique(rare_at[order], return_index=True)
            by_row, by_of = rare_row[order], rare_of[order].astype(np.intp)
            bounds = [*firsts.tolist(), len(order)]
            for k, t in enumerate(found.tolist()):
                a, b = bounds[k], bounds[k + 1]
                total[t] += by_row[a:b] @ out.take(by_of[a:b], 0)
        return out


def summed_parts(rows: DataFrame, run, height: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices of this shape that run makes of partitions, sent and summed by so many rows; the driver gets sums only."""

    def parts(batches):
        total = run(batches)
        for a in range(0, shape[0], height):
            if total[a : a + height].any():
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([total[a : a + height].astype(np.float32).tobytes()], pa.binary())], names=["first", "part"])

    def summed(own: pa.Table) -> pa.Table:
        total = np.zeros(height * shape[1])
        for part in own.column("part").to_pylist():
            total += np.frombuffer(part, np.float32)
        return pa.table({"first": own.column("first")[:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = np.zeros(shape, np.float32)
    sums = rows.mapInArrow(freed(parts), "first bigint, part binary").groupBy("first").applyInArrow(summed, "first bigint, part binary")
    for batch in sums.toArrow().to_batches():
        for first, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out[first : first + height] = np.frombuffer(part, np.float32).reshape(height, shape[1])
    return out


def products(rows: DataFrame, idf: np.ndarray, frequent: np.ndarray, basis: np.ndarray, whole: bool = True) -> np.ndarray:
    """A'A times the basis, for the TF-IDF rows A of all of term_rows(); or else the basis' transpose times that, for which A'
    need not be multiplied."""
    held = rows.sparkSession.sparkContext.broadcast((basis, idf, frequent))
    width = basis.shape[1]

    def run(batches):
        basis, idf, frequent = held.value
        projector = Projector(basis, frequent)
        total = np.zeros_like(basis) if whole else np.zeros((width, width))
        for own in entries(batches, idf):
            if whole:
                projector.project(*own, total)
            else:
                projected = projector.project(*own)
                total += projected.T @ projected
        return total

    try:
        return summed_parts(rows, run, RANGE if whole else 1, basis.shape if whole else (width, width))
    finally:
        held.destroy()


def blocks_of(n: int):
    return (slice(a, a + ROWS) for a in range(0, n, ROWS))


def orthonormal(a: np.ndarray) -> np.ndarray:
    """The left singular vectors of a tall matrix, the strongest first, in its own memory; 0 for those that it lacks.

    By the matrix of products of its columns, since a decomposition of a itself takes several copies in double precision.
    """
    for straight in (False, True):  # the second time for what the first one rounds; it leaves their order
        gram = np.zeros((a.shape[1], a.shape[1]))
        for own in blocks_of(len(a)):
            block = a[own].astype(np.float64)
            gram += block.T @ block
        values, turned = np.linalg.eigh(gram)
        kept = values > 1e-12 * max(values[-1], 1e-30)
        scaled = turned * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0)
        scaled = scaled @ turned.T if straight else scaled[:, ::-1]
        for own in blocks_of(len(a)):
            a[own] = a[own] @ scaled
    return a


def random_basis(rank: int) -> np.ndarray:
    return orthonormal(np.random.default_rng(7).standard_normal((TERMS, rank + EXTRA), np.float32))


def strongest_directions(rows: DataFrame, idf: np.ndarray, n: int, rank: int = RANK) -> np.ndarray:
    """Rows that stand for the n documents of term_rows() in the space of an item block: their strongest directions, as long as their weight."""
    # the weights say how many documents have a bucket
    frequent = np.flatnonzero(idf[:TERMS] <= weights(np.array([DENSE * n]), n)[0])
    basis = random_basis(rank)
    for _ in range(POWERS - 1):
        basis = orthonormal(products(rows, idf, frequent, basis))
        give_back_memory()
    both = products(rows, idf, frequent, basis, whole=False).astype(np.float64)
    values, turned = np.linalg.eigh((both + both.T) / 2)
    weight = DOCUMENT_WEIGHT * np.sqrt(min(1.0, DOCUMENTS / max(n, 1)))
    return (basis @ (turned * np.sqrt(np.maximum(values, 0)) * weight).astype(np.float32)).T


def latent_space(texts: list[str], directions: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """TERMS x rank orthonormal basis of the strongest directions of these items and of the documents."""
    items = [np.unique(known, return_counts=True) for text in texts if len(known := known_terms(text))]
    basis = random_basis(rank)
    for _ in range(POWERS):
        out = directions.T @ (directions @ basis)
        for at, count in items:
            add_product(out, basis, idf, at, count.astype(np.float32))
        basis = orthonormal(out)
        del out
    space = np.zeros((TERMS + 1, rank), np.float32)
    space[:TERMS] = basis[:, :rank]
    return space


def covering(space: np.ndarray, idf: np.ndarray, texts: list[str]) -> np.ndarray:
    """The space with more directions, so that each of the texts keeps KEEP of its length."""
    lacking = []
    for text in texts:
        at, count = np.unique(known_terms(text), return_counts=True)
        row = (count * idf[at]).astype(np.float32)
        row /= max(np.linalg.norm(row), 1e-9)
        rest = -(space @ (row @ space[at]))
        rest[at] += row
        if np.linalg.norm(rest) > np.sqrt(1 - KEEP**2):
            lacking.append(rest)
    if not lacking:
        return space
    gram = np.zeros((len(lacking), len(lacking)))
    for own in blocks_of(len(space)):
        block = np.stack([x[own] for x in lacking]).astype(np.float64)
        gram += block @ block.T
    values, turned = np.linalg.eigh(gram)
    # what is left of copies of an item has no direction of its own
    kept = values > 1e-6 * values[-1]
    scaled = (turned[:, kept] / np.sqrt(values[kept])).astype(np.float32)[:, ::-1]
    out = np.empty((len(space), space.shape[1] + scaled.shape[1]), np.float32)
    out[:, : space.shape[1]] = space
    for own in blocks_of(len(space)):
        out[own, space.shape[1] :] = np.stack([x[own] for x in lacking], axis=1) @ scaled
    return out


def lcs(masks: dict[str, int], n: int, words: list[str]) -> int:
    """Length of the longest common subsequence of words and the n words whose positions masks has, by bit-parallel rows."""
    full = (1 << n) - 1
    row = full
    for w in words:
        if m := masks.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return n - row.bit_count()


def masks_of(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Item:
    def __init__(self, item_id, text: str | None):
        self.id, self.words = item_id, words_of(text)
        self.masks = masks_of(self.words)
        self.answer = self.words[-max(3, len(self.words) // 4) :]
        self.answer_masks = masks_of(self.answer)
        self.often = {w: m.bit_count() for w, m in self.masks.items()}
        self.more, self.least = len(self.words) // 2, PARAPHRASE * len(self.words)

    def check(self, words: list[str]) -> tuple[float, float]:
        """Shares of the item and of its answer that a passage covers."""
        return lcs(self.masks, len(self.words), words) / len(self.words), lcs(self.answer_masks, len(self.answer), words) / len(self.answer)


def contained(covered: float, answered: float) -> bool:
    return covered >= VERBATIM or covered >= PARAPHRASE and answered >= ANSWER


def step_of(n: int) -> int:
    """Words between the starts of windows for an item of n words: a power of two."""
    return min(STEP, 1 << max(0, (n // 3).bit_length() - 1))


def width_of(n: int) -> int:
    """Steps of a window for an item of n words, wherever the item begins."""
    return -(-n // step_of(n)) + 1


def compared(rows: list[tuple], idf: np.ndarray, space: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """(the items with words, those of equal windows one behind the other; what each bucket adds to the product with each)."""
    worded = [(len(words), k) for k, (_, text) in enumerate(rows) if (words := words_of(text))]
    rows = [rows[k] for _, k in sorted(worded)]
    vectors = np.zeros((len(rows), space.shape[1]), np.float32)
    for vector, (_, text) in zip(vectors, rows, strict=True):
        known = known_terms(text)
        vector += idf[known] @ space[known]
        vector /= max(np.linalg.norm(vector), 1e-9)  # the item as the space has it
    near = space @ vectors.T
    near *= idf[:, None]
    return rows, near


class Searcher:
    """Finds passages of documents that contain one of the items; near is what compared() returns."""

    def __init__(self, rows: list[tuple], near: np.ndarray, idf: np.ndarray):
        self.square = idf.astype(np.float64) ** 2
        self.items = [Item(*x) for x in rows]
        #: For each step and width the groups of items, and the upper bounds of the step's groups.
        self.groups: dict[int, dict[int, list[tuple[int, int, np.ndarray]]]] = {}
        sizes = [(step_of(n), width_of(n)) for n in (len(i.words) for i in self.items)]
        at = 0
        while at < len(sizes):
            end = at + 1
            while end < len(sizes) and end < at + GROUP and sizes[end] == sizes[at]:
                end += 1
            step, width = sizes[at]
            own = self.groups.setdefault(step, {}).setdefault(width, [])
            own.append((at, end, np.ascontiguousarray(near[:, at:end])))
            at = end
        self.upper = {step: np.stack([g[2].max(1) for own in widths.values() for g in own], axis=1) for step, widths in self.groups.items()}

    def scan(self, texts: list[str | None], cosine: float | None = None):
        """(text number, item number, cosine, first word, words) of candidates in these texts."""
        cosine = COSINE if cosine is None else cosine
        # every text begins at a multiple of STEP
        terms, counts = token_terms(texts)
        lengths = -(-counts // STEP) * STEP
        begins = np.cumsum(lengths) - lengths
        ids = np.full(int(lengths.sum()), TERMS, np.int64)
        ids[np.arange(len(terms)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)] = terms
        of = np.repeat(np.arange(len(texts)), lengths // STEP)
        for step, widths in self.groups.items():
            most = max(widths) * step
            for first in range(0, len(ids), SPAN):
                held = ids[first : first + SPAN + most]
                norms = np.concatenate([[0], np.cumsum(self.square[held].reshape(-1, step).sum(1))])
                upper = self.upper[step][held].reshape(-1, step, self.upper[step].shape[1]).sum(1)
                sums = np.zeros((len(upper) + 1, upper.shape[1]))
                np.cumsum(upper, axis=0, out=sums[1:])
                starts = np.arange(min(SPAN, len(ids) - first) // step)
                doc = of[(first + starts * step) // STEP]
                ends = (begins + lengths)[doc] - first
                k = 0
                for width, groups in widths.items():
                    stops = np.minimum(starts + width, ends // step)
                    stops_held = np.minimum(stops, len(upper))
                    size = np.sqrt(np.maximum(norms[stops_held] - norms[starts], 1e-9)) * cosine
                    bound = sums[stops_held, k : k + len(groups)] - sums[starts, k : k + len(groups)]
                    for g, (item, _, near) in enumerate(groups):
                        hits = np.flatnonzero(bound[:, g] >= size * 0.9999)
                        for a in range(0, len(hits), 2048):
                            own = hits[a : a + 2048]
                            at = starts[own, None] * step + np.arange(width * step)
                            tokens = held[np.minimum(at, len(held) - 1)]
                            tokens[at >= stops_held[own, None] * step] = TERMS
                            value = near[tokens].sum(1, dtype=np.float64) / size[own, None]
                            for x, i in zip(*(found.tolist() for found in np.nonzero(value >= 1)), strict=True):
                                d = int(doc[own[x]])
                                yield d, item + i, float(value[x, i]) * cosine, int(first + starts[own[x]] * step - begins[d]), width * step
                    k += len(groups)

    def search(self, texts: list[str | None]):
        """(text number, item, cosine, covered, answered) of the best passage of every item that a text contains."""
        best: dict[tuple[int, int], tuple] = {}
        plain: dict[int, list[str]] = {}
        for d, i, cosine, at, n in self.scan(texts):
            if (known := best.get((d, i))) and known[1] == 1.0:
                continue
            if d not in plain:
                plain[d] = list(map(bare, texts[d].lower().split()))
            item = self.items[i]
            words = plain[d][max(0, at - item.more) : at + n + item.more]
            # no more words than these can be common, in whatever order
            if sum([item.often[x] for x in item.often.keys() & words]) < item.least:
                continue
            covered, answered = item.check(words)
            if contained(covered, answered) and (not known or (covered, answered, cosine) > known):
                best[d, i] = covered, answered, cosine
        for (d, i), (covered, answered, cosine) in best.items():
            yield d, self.items[i].id, cosine, covered, answered


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, covered, answered, kind ('verbatim' or 'paraphrase') for every document that contains an item."""
    spark = docs.sparkSession
    smaller_batches(spark)
    docs = docs.select("doc_id", "text")
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, covered double, answered double, kind string"
    with scratch(spark):
        items = benchmark.select("item_id", "text").filter(F.length("text") > 0)
        blocks = max(1, -(-items.count() // ITEM_BLOCK))
        items = materialise(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
        rows = term_rows(docs)
        df, n = document_frequencies(rows)
        idf = weights(df, n)
        directions = strongest_directions(rows, idf, n)
        give_back_memory()
        passes: list[list] = []
        for block in range(blocks):
            own = [tuple(r) for r in items.filter(F.col("block") == block).select("item_id", "text").collect()]
            space = latent_space([text for _, text in own], directions, idf)
            give_back_memory()
            space = covering(space, idf, [text for _, text in own])
            give_back_memory()
            if block % PASS_BLOCKS == 0:
                passes.append([])
            passes[-1].append(compared(own, idf, space))
            del space
            give_back_memory()
    results = None
    for parts in passes:
        held = spark.sparkContext.broadcast((parts, idf))
        parts.clear()

        def run(batches, held=held):
            parts, idf = held.value
            searchers = [Searcher(rows, near, idf) for rows, near in parts]
            for part, texts in text_chunks(batches, max_chars=CHUNK):
                found = [f for searcher in searchers for f in searcher.search(texts)]
                if found:
                    at = [f[0] for f in found]
                    columns = list(zip(*found, strict=True))
                    verbatim = ["verbatim" if f[3] >= VERBATIM else "paraphrase" for f in found]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *(pa.array(c) for c in columns[1:]), pa.array(verbatim)], names=["doc_id", "item_id", "cosine", "covered", "answered", "kind"])

        found = docs.mapInArrow(freed(run), schema)
        results = found if results is None else results.union(found)
    give_back_memory()
    best = results.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "answered", "cosine", "kind")).alias("b"))
    return best.select("doc_id", "item_id", *[f"b.{c}" for c in ("cosine", "covered", "answered", "kind")])


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that contain an item; all columns stay."""
    return without(docs, contaminated(docs, benchmark))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
