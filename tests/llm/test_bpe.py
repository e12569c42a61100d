import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlspike.llm.bpe import NONE, BpeCodec, PairTree, bpe_encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return BpeCodec(PATH)


def test_tree_gives_leftmost_lowest():
    random.seed(1)
    keys = [random.randrange(50) << 32 | i for i in range(13)]
    tree = PairTree(list(keys))
    while min(keys) != NONE:
        assert tree.root() == min(keys)
        i = keys.index(min(keys))
        keys[i] = NONE
        tree.put(i, NONE)
    assert tree.root() == NONE


def test_as_the_library(codec, library):
    random.seed(2)
    parts = ["a", "b", "é", "ß", " ", "\n", "\t", "'s", "'LL", "1", "²", "ª", "!", "Ə", "\xa0", "\x85", "\x1c", "\x00", "th", "ing", "日本", "🙂", "<|endoftext|>", "　", "aaaa", "antidisestablishment"]
    texts = ["", "a" * 3000, "x" * 65, "xyz" * 50] + ["".join(random.choices(parts, k=random.randint(1, 80))) for _ in range(600)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_cache_overflow(codec, library, monkeypatch):
    monkeypatch.setattr("marlspike.llm.bpe.CACHE_PIECES", 5)
    text = "one two three four five six seven eight nine ten one two"
    own = BpeCodec(PATH)
    for _ in range(3):
        assert own.encode(text) == library.encode(text).ids
    assert len(own.cache) <= 12


def test_rows(awkward, empty, library):
    got = bpe_encode_decode(awkward, PATH, outputs=("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == 8
    texts = [r["text"] or "" for r in awkward.collect()]
    for row, text in zip(got, texts, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["decoded"] == text
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_encode_decode(empty, PATH).collect() == []
