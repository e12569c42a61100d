import corpus_pipeline
from marlspike.llm.bpe import BpeCodec
from marlspike.llm.ngram_join import shingles


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = corpus_pipeline.materialise(stage(spark, kept, small))
        after = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before), name
        assert kept.columns == docs.columns
    # no two documents that remain resemble each other
    sets = [set(shingles(r["text"]).tolist()) for r in kept.collect()]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) if a for b in sets[:i] if b)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    import public_tokenizers

    codec = BpeCodec(public_tokenizers.path("byte_bpe_50k.json"))
    last = corpus_pipeline.STAGES[-1][1](spark, kept, small).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in last} == {i: len(codec.encode(t)) for i, t in texts.items()}


def test_stages_on_awkward_input(spark, small, awkward):
    """Nulls, empty and repeated rows and clashing columns: every stage keeps the columns and the rows that it has no reason to drop.

    Empty tables are in the tests of the operators.
    """
    docs = awkward.drop("n_tokens")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = corpus_pipeline.materialise(stage(spark, docs, small))
        assert got.columns == docs.columns, name
        ids = [r["doc_id"] for r in got.collect()]
        assert {1, 2, 3, 4, 6, None} <= set(ids) and len(ids) >= 6, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.count() == 8 and {r["n_tokens"] for r in last.filter("doc_id in (2, 3)").collect()} == {0}


def test_run_leaves_one_table(spark, small):
    import os
    from urllib.parse import urlparse

    from marlspike.llm.common import checkpoint_dir

    folder = urlparse(checkpoint_dir(spark)).path
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, small)
    assert rows.count() > 100 and len(set(os.listdir(folder)) - before) == 1
