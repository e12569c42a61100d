"""One text of more than a million characters beside short ones, through every operator: whole texts are used."""

import random

import public_tokenizers
import pytest

from marlspike.llm import bpe, decontamination, language_id, license_scan, line_dedup, ngram_join, quality_rules, quotations, resampling, toxicity

ITEM = "which seven lanterns did the keeper of the northern lighthouse carry down before the winter storm"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(20_000)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(14_000)]
    lines[7_000] = f"{lines[7_000]} {ITEM} all rights reserved"
    lines.append(lines[3])
    return "\n".join(lines)


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, long_text), (2, "a short text of a few words"), (3, None), (4, long_text + "\nand one line more"), (5, long_text.replace("\n", " "))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_lines(docs, long_text):
    got = by_id(line_dedup.kept_places(docs.filter("doc_id < 4")))
    assert got[1]["n_lines"] == 14_001 and got[1]["n_kept"] == 14_000 and 14_000 not in got[1]["kept"]


def test_near_copies(docs):
    got = by_id(ngram_join.near_duplicates(docs))
    assert {i: r["class_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1} and got[1]["n_copies"] == 2


def test_items_in_the_middle(spark, docs):
    benchmark = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["covered"]) for r in decontamination.contaminated(docs, benchmark).collect()} == {(i, 7, 1.0) for i in (1, 4, 5)}


def test_places_and_statistics(docs, long_text):
    n = len(long_text.split())
    at = long_text.split().index("reserved") - 2
    scanned, stated = by_id(license_scan.scan_licenses(docs)), by_id(quality_rules.judge_quality(docs, quality_rules.train_quality(docs, docs.selectExpr("doc_id", "1 AS quality").limit(0))))
    assert scanned[1]["n_words"] == stated[1]["n_words"] == n and (scanned[1]["first_word"], scanned[1]["last_word"]) == (at, at)
    assert stated[1]["n_dup_lines"] == 1 and stated[5]["n_dup_lines"] == 0


def test_scores(spark, docs, long_text):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    scored = by_id(toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)))
    assert all(0 <= r["score"] <= 1 for r in scored.values())
    lettered = docs.selectExpr("doc_id", "text", "'xx' AS lang")
    spoken = by_id(language_id.identify_languages(docs, language_id.train_languages(lettered)))
    assert spoken[1]["lang_pred"] == "xx" and spoken[1]["n_spans"] == 1 and spoken[3]["lang_pred"] == "und"
    drawn = by_id(resampling.resample(docs, docs.filter("doc_id = 1")))
    assert drawn[1]["n_grams"] == 2 * len(long_text.split()) - 1 and sum(r["selected"] for r in drawn.values()) >= 2


def test_quotation_of_a_long_message(spark, long_text):
    quoted = "\n".join(f"> {x}" for x in long_text.split("\n")) + "\nyes"
    df = spark.createDataFrame([(1, 0, "a", long_text), (1, 1, "b", quoted)], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["reply_to"], r["clean"]) for r in quotations.link_quotations(df).collect()}
    assert got == {0: (None, long_text), 1: (0, "yes")}


def test_encoding_of_a_long_text(docs, long_text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(bpe.bpe_encode_decode(docs.filter("doc_id in (1, 3)"), public_tokenizers.path("byte_bpe_50k.json"), outputs=("n_tokens",)))
    assert got[1]["n_tokens"] == len(library.encode(long_text, add_special_tokens=False).ids) and got[3]["n_tokens"] == 0
