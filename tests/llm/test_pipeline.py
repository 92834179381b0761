"""The corpus pipeline: each stage keeps the columns and does what its operator says."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return out


def test_stages_in_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_dedup", "mix_sources", "byte_bpe"]
    counts = [d.count() for d in stages]
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0
    for d in stages[1:5]:
        assert d.columns == stages[0].columns


def test_rows_come_from_the_stage_before(stages):
    texts = [Counter((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()) for d in stages[:5]]
    for before, after in zip(texts[:3], texts[1:4]):
        assert all(before[k] >= n for k, n in after.items())
    assert all(n <= 3 and k in texts[3] for k, n in texts[4].items())


def test_last_stage_encodes_what_it_gets(spark, stages):
    import tiktoken
    from gridloom.llm.bpe import public_vocabulary

    ranks, pattern = public_vocabulary()
    encode = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter()
    for r in stages[4].collect():
        ids = encode(r["text"])
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in stages[5].collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_classifier_stage_learns_from_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline.mil, "fit", lambda docs, labels, **k: seen.append(docs.count()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.quality_classifier(spark, docs.limit(3), SF)
    assert seen == [docs.count()]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables_and_nulls(spark, k):
    _, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and (k == 4 or none.columns == docs.columns)
    good = docs.where("length(text) > 2000").limit(6).collect()
    rows = [tuple(r) for r in good] + [(None, good[0]["text"], None, None, None), (None, None, "en", "a", 0), (-1, "", None, None, None), (-2, None, "de", None, 3), tuple(good[1]), (-3, "one two", "en", "a", 7)]
    odd = spark.createDataFrame(rows, docs.schema).selectExpr("*", "'x' as fp", "'y' as score", "1 as `a.b`")
    got = stage(spark, odd, SF)
    assert got.count() <= 3 * len(rows) and (k == 4 or got.columns == odd.columns)
    if k == 4:
        by = [r for r in got.collect() if r["doc_id"] in (-1, -2)]
        assert len(by) == 2 and all(r["n_tokens"] == 0 and r["ids_sha256"] == hashlib.sha256(b"").hexdigest() for r in by)
    else:
        ids = {r["doc_id"] for r in got.collect()}
        assert ids <= {r[0] for r in rows} and (k not in (0, 3) or not ids & {-1, -2})


def test_stages_bound_the_batches_of_texts(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 300, 1, 1).selectExpr("id as doc_id", "concat(repeat('some words ', 10000), id) as text", "'en' as lang", "'a' as source", "0 as n_chars")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    try:
        for k in (0, 1, 2, 4):
            spark.conf.set(key, "64m")
            corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF)
            assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 5 << 20
        spark.conf.set(key, "1m")
        corpus_pipeline.encode_bpe(spark, docs, SF)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_texts_go_to_the_workers_once(spark):
    from gridloom.llm import mil, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (quality.quality_filter(docs), mil.score(docs, None, "text", tuple(docs.columns))):
        assert "__text" not in rows._jdf.queryExecution().analyzed().toString()


def test_long_chunks_are_not_remembered():
    import tracemalloc

    from gridloom.llm.bpe import encoder, public_vocabulary

    make = encoder(*public_vocabulary())
    want = [make(f"a {'x' * 5_000}{i} b".encode()) for i in range(20)]
    tracemalloc.start()
    got = [make(f"a {'x' * 5_000}{i} b".encode())[-8:] for i in range(300)]
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert got[:20] == [w[-8:] for w in want]
    assert kept < 500_000
