"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from granula.llm import chat_format, decontamination, fingerprints, license_scan, line_dedup, mixing, quality, sharding, simhash_dedup, toxicity

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "all rights reserved here", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "a null id", "en", "a", 1),
    (None, None, None, None, None),
    (4, LONG, "en", "b", 9),
    (5, LONG, "en", "b", 9),
    (6, "same row", "en", "c", 2),
    (6, "same row", "en", "c", 2),
    (6, "same id, other text", "en", None, 2),
    (7, " \t\n ", "en", "a", 4),
    (8, "Émile ÀÉ naïve 漢字 🙂 text", "fr", "a", 5),
]


def clashing(df):
    for c in ("score", "fp", "h", "shard", "size", "bucket", "hits", "spans", "taken", "rank", "symbol", "key", "words", "copies", "alone", "__score", "__hits", "__shard", "__SHARD_", "__region", "__rack", "__doc", "__hash", "__first", "__source", "__size", "__place"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (6, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")


TURNS = [(1, 0, "user", "hi?"), (1, 1, "assistant", "hello " * 60), (1, 1, "assistant", "hello " * 60), (None, 0, "user", "x"), (2, None, None, None), (3, 0, "robot", "Assistant: ok")]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")


def cases(docs, labels, benchmark, conversations):
    return {
        1: lambda d: line_dedup.op1_line_winnowing(d),
        2: lambda d: license_scan.op2_license_set_join(d),
        3: lambda d: decontamination.op3_window_simhash_decontamination(d, benchmark),
        4: lambda d: mixing.op4_splitting_tree_mix(d),
        5: lambda d: fingerprints.op5_one_permutation_minhash(d),
        6: lambda d: quality.op6_attention_quality(d, labels),
        7: lambda d: toxicity.op7_compression_toxicity(d, labels),
        8: lambda d: sharding.op8_hash_tree_sharding(d),
        10: lambda d: simhash_dedup.op10_simhash_pigeonring(d),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 10])
def test_one_row_a_document(docs, labels, benchmark, conversations, n):
    run = cases(docs, labels, benchmark, conversations)[n]
    got = run(clashing(docs)).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert run(docs.where("false")).collect() == []


@pytest.mark.parametrize("n", [6, 7])
def test_no_labels(docs, labels, benchmark, conversations, n):
    empty = labels.where("false")
    run = quality.op6_attention_quality if n == 6 else toxicity.op7_compression_toxicity
    assert all(0 <= r.score <= 1 for r in run(docs, empty).collect())


def test_conversations(conversations):
    got = chat_format.op9_hmm_transcripts(clashing(conversations)).collect()
    assert len(got) == len(TURNS) and all(r.parsed_role in chat_format.ROLES for r in got)
    assert chat_format.op9_hmm_transcripts(conversations.where("false")).collect() == []


def test_empty_benchmark(docs, benchmark):
    assert not any(r.contaminated for r in decontamination.op3_window_simhash_decontamination(docs, benchmark.where("false")).collect())


def test_values(docs):
    by = {r.doc_id: r for r in license_scan.op2_license_set_join(docs.where("doc_id in (1, 2, 3)")).collect()}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].labels) == (4, 1, 0, "reserved")
    assert (by[2].n_words, by[2].first_word, by[2].labels, by[2].score) == (0, None, "", 0.0)
    simhash = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_dedup.op10_simhash_pigeonring(docs).collect()}
    assert simhash[(2, "0" * 16)] == simhash[(3, "0" * 16)] == simhash[(7, "0" * 16)] == 2
    shard = sharding.op8_hash_tree_sharding(docs).collect()
    assert {r.size for r in shard if r.doc_id == 2} == {1} and {r.text_crc32 for r in shard if r.doc_id == 3} == {0}


@pytest.fixture(scope="module")
def folder(tmp_path_factory, docs, labels, benchmark):
    root = tmp_path_factory.mktemp("sf")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, folder, name, stage):
    """Columns stay, whatever they are called, and the rows are those that come of plain columns."""
    wide = clashing(docs)
    out, plain = stage(spark, wide, folder), stage(spark, docs, folder)
    if name != "sharding":
        assert out.columns == wide.columns
    else:
        assert set(out.columns) == set(wide.columns)
    key = lambda r: (repr(r["doc_id"]), r["text"] or "")
    narrow = out.select(*plain.columns).collect()
    assert sorted(map(tuple, narrow), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert {key(r) for r in narrow} <= {key({"doc_id": r[0], "text": r[1]}) for r in ROWS}
    assert stage(spark, docs.where("false"), folder).collect() == []


def test_stage_rows(spark, docs, folder):
    """Which rows each stage keeps."""
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    run = dict(corpus_pipeline.STAGES)
    # 5 copies 4, 7 and 2 and a null id without words are copies of each other, a repeated row goes but once
    kept = ids(run["near_duplicates"](spark, docs, folder))
    assert [x[1] for x in kept if not x[0]] == [1, 2, 4, 6, 6, 8] and [x for x in kept if x[0]] == [(True, 0, "a null id")]
    mixed = run["mixing"](spark, docs, folder).collect()
    assert all((r.text or "").split() for r in mixed) and max(sum(x == r for x in mixed) for r in mixed) <= 4
    item = "well the quick brown fox jumps over the lazy dog again and again they say"
    more = docs.limit(0).union(spark.createDataFrame([(50, item, "en", "a", 1), (51, "clean text", "en", "a", 1)], DOC))
    assert ids(run["decontamination"](spark, more, folder)) == [(False, 51, "clean text")]
    sharded = run["sharding"](spark, docs, folder).collect()
    assert len(sharded) == len(ROWS) and len({r.shard for r in sharded if r.doc_id is None}) == 1


def test_toxic_documents_go(spark):
    """With labels enough, the stage drops just the rows whose score is 0.7 or more."""
    from granula.llm.common import table

    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    toxic = {r.doc_id for r in toxicity.op7_compression_toxicity(docs, table(spark, d, "labels")).collect() if r.predicted}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, d).collect()}
    assert toxic and kept == {r.doc_id for r in docs.collect()} - toxic


def test_pipeline_runs(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard"} == set(out.columns)
    assert all(0 <= r.shard < 16 for r in out.collect())
