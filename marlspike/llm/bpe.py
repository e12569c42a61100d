"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut by the vocabulary's added tokens, then by the byte-level pre-tokeniser, and every
piece is merged on its own. Leaves of the tree hold the rank of the pair that starts at a symbol;
the root therefore names the leftmost pair of lowest rank. A merge rewrites at most three leaves,
each in a logarithmic number of steps, until the root holds no pair.

Rows are independent: there is no shuffle, and a worker's memory is bounded by the size of a chunk
of texts and of the piece cache. A null text counts as an empty one and gives no tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from .common import freed, smaller_batches, text_chunks

NONE = 1 << 62
NO_RANK = 1 << 20
#: Pieces that a worker remembers; when full, the cache is emptied and filled again.
CACHE_PIECES = 500_000
#: Of more than these a worker keeps none when a task ends.
KEPT_PIECES = 150_000
#: Bytes of the longest piece that is merged together with others.
WIDEST = 64
Piece = tuple[int, str, bytes]


def latin_pattern() -> str:
    """The byte-level pre-tokeniser's pattern with its classes spelt out below U+0250."""

    def ranges(kind: str) -> str:
        own = [i for i in range(0x250) if unicodedata.category(chr(i))[0] == kind]
        starts = [i for i in own if i - 1 not in own]
        return "".join(f"{chr(i)}-{chr(next(j for j in range(i, 0x251) if j not in own) - 1)}" for i in starts)

    space, letter, number = r"\t-\r \x85\xa0", ranges("L"), ranges("N")
    return f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


LATIN_PIECES = re.compile(latin_pattern()).findall
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]").search
OUTPUTS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
SQL_TYPES = {"ids": "array<int>", "n_tokens": "bigint", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for the bytes: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTree:
    """Minimum tree over (rank, position) of adjacent pairs; position breaks ties to the left."""

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        tree = [NONE] * size + keys + [NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def root(self) -> int:
        return self.tree[1]

    def put(self, at: int, key: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1


class BpeCodec:
    """Encodes and decodes as the vocabulary file says, without adding special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("a byte-level BPE vocabulary without normaliser is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take context with them are not supported")
        vocab = model["vocab"]
        self.letters = byte_alphabet()
        self.byte_ids = np.zeros(256, np.int64)
        for c, byte in self.letters.items():
            self.byte_ids[byte] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged_ids = np.fromiter((v[1] for v in self.merges.values()), np.int64, len(keys))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.bytes_of = {i: bytes(self.letters[c] for c in t) if all(c in self.letters for c in t) else t.encode() for t, i in (vocab | self.added).items()}
        self.pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.cache: dict[str, Piece] = {}

    def pieces(self, text: str) -> list[str]:
        """What the byte-level pre-tokeniser makes of a text; the library's own cuts texts beyond Latin letters."""
        if not BEYOND_LATIN(text):
            return LATIN_PIECES(text)
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NO_RANK where they do not merge."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge_one(self, symbols: list[int]) -> list[int]:
        n, get = len(symbols), self.merges.get
        if n < 2:
            return symbols
        tree = PairTree([NONE if (m := get(symbols[i] << 32 | symbols[i + 1])) is None else m[0] << 32 | i for i in range(n - 1)])
        after, before, sym = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)

        def pair_at(i: int) -> int:
            j = after[i]
            m = get(sym[i] << 32 | sym[j]) if j < n else None
            return NONE if m is None else m[0] << 32 | i

        while (top := tree.root()) != NONE:
            i = top & 0xFFFFFFFF
            j = after[i]
            sym[i] = get(sym[i] << 32 | sym[j])[1]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            if j < n - 1:
                tree.put(j, NONE)
            if i < n - 1:
                tree.put(i, pair_at(i))
            if (p := before[i]) >= 0:
                tree.put(p, pair_at(p))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    def merge_many(self, words: list[bytes], width: int) -> list[list[int]]:
        """merge_one for words of at most width bytes, a power of two: one tree a row, all rows step together."""
        n, shift = len(words), width.bit_length() - 1
        none = NO_RANK << shift
        lengths = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        sym = np.full((n, width + 1), -1, np.int64)
        sym[:, :width][inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        after[np.arange(n), lengths - 1] = width
        tree = np.full((n, 2 * width), none, np.int64)
        pairs = sym[:, 1:] >= 0
        keys = self.ranks(sym[:, :-1][pairs], sym[:, 1:][pairs]) << shift
        tree[:, width:][pairs] = keys | np.broadcast_to(np.arange(width), (n, width))[pairs]
        np.putmask(tree, tree >= none, none)
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])

        def put(rows: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = key
            for _ in range(shift):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            top = tree[rows, 1]
            i = top & (width - 1)
            new = self.merged_ids[top >> shift]
            j = after[rows, i]
            k = after[rows, j]
            sym[rows, i], after[rows, i], before[rows, k] = new, k, i
            sym[rows, j] = -1
            put(rows, j, np.full(len(rows), none))
            rank = self.ranks(new, np.where(k < width, sym[rows, k], 1 << 31))
            put(rows, i, np.where(rank < NO_RANK, rank << shift | i, none))
            p = before[rows, i]
            has = p >= 0
            left = rows[has]
            rank = self.ranks(sym[left, p[has]], new[has])
            put(left, p[has], np.where(rank < NO_RANK, rank << shift | p[has], none))
            rows = rows[tree[rows, 1] < none]
        kept = sym[:, :width] >= 0
        flat, ends = sym[:, :width][kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: set[str]) -> dict[str, Piece]:
        """Merges pieces that the cache does not have; it keeps those that are not too long."""
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache.clear()
        by_width: dict[int, list[str]] = {}
        long: dict[str, Piece] = {}
        new: dict[str, Piece] = {}
        for p in pieces:
            if (n := len(raw := p.encode())) > WIDEST:
                long[p] = self.made(self.merge_one(self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()))
            else:
                by_width.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(p)
        for width, own in by_width.items():
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                new |= zip(part, map(self.made, self.merge_many([p.encode() for p in part], width)), strict=True)
        self.cache |= new
        return new | long

    def made(self, ids: list[int]) -> Piece:
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def parts(self, texts: list[str | None]) -> Iterator[list[Piece]]:
        """The encoded pieces of each text."""
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif self.added_pattern and self.added_pattern.search(text):
                cut.append([x for i, part in enumerate(self.added_pattern.split(text)) if part for x in ([self.added[part]] if i % 2 else self.pieces(part))])
            else:
                cut.append(self.pieces(text))
        get = self.cache.get
        found = [list(map(get, own)) for own in cut]
        lacks = [i for i, own in enumerate(found) if None in own]
        missing = {p for i in lacks for p, x in zip(cut[i], found[i], strict=True) if x is None and isinstance(p, str)}
        if lacks:
            new = self.learn(missing)
            for i in lacks:
                found[i] = [x or new.get(p) or (1, str(p), self.bytes_of[p]) for p, x in zip(cut[i], found[i], strict=True)]
        yield from found

    def encode(self, text: str) -> list[int]:
        return next(self.outputs([text], ("ids",)))[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def outputs(self, texts: list[str | None], names: tuple[str, ...]) -> Iterator[tuple]:
        for parts in self.parts(texts):
            made = []
            for name in names:
                if name == "n_tokens":
                    made.append(sum([p[0] for p in parts]))
                elif name in ("ids", "ids_sha256"):
                    ids = ",".join([p[1] for p in parts])
                    made.append(hashlib.sha256(ids.encode()).hexdigest() if name == "ids_sha256" else [int(x) for x in ids.split(",")] if ids else [])
                else:
                    decoded = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
                    made.append(decoded if name == "decoded" else hashlib.sha256(decoded.encode()).hexdigest())
            yield tuple(made)


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def bpe_encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens", "decoded")) -> DataFrame:
    """One row per document: id_col and the outputs asked for, of ids, n_tokens, decoded, ids_sha256, decoded_sha256.

    path: a byte-level BPE file that every executor can open. Null and empty texts give no ids, 0
    tokens and an empty decoded text. Repeated ids stay repeated; other columns of docs are ignored;
    an empty table gives an empty result.
    """
    smaller_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [pa.field(n, OUTPUTS[n]) for n in outputs]

    def run(batches):
        own = codec(path)
        for rows, texts in text_chunks(batches):
            made = list(zip(*own.outputs(texts, outputs), strict=True))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, f.type) for x, f in zip(made, fields, strict=True))], names=[id_col, *outputs])
        if len(own.cache) > KEPT_PIECES:
            own.cache.clear()

    schema = ", ".join([f"`{id_col}` {id_type}", *(f"{n} {SQL_TYPES[n]}" for n in outputs)])
    return docs.select(id_col, text_col).mapInArrow(freed(run), schema)


def op4_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
