"""Bytes that aren't UTF-8, ids of several types, and the columns of every operator's query."""

import os

import pytest
from pyspark.sql import functions as F

from weftline.llm import fingerprints, jaccard, packing, quality, queries, tokens, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def broken(spark):
    rows = spark.createDataFrame([(k, f"some words and more of them {k} " * 4, "en", "s", 0) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    bad = F.expr("cast(concat(cast('ab ' as binary), unhex('ff'), cast(concat(' cd ', text) as binary)) as string)")
    return rows.withColumn("text", F.when(F.col("doc_id") < 3, bad).otherwise(F.col("text"))), rows.withColumn("text", F.when(F.col("doc_id") < 3, F.concat(F.lit("ab � cd "), "text")).otherwise(F.col("text")))


def same(a, b):
    return sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


def test_invalid_bytes_are_read_as_the_replacement(spark, broken):
    word, byte = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")
    labels = spark.range(6).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    for run in (
        fingerprints.fingerprint_edits, lambda d: tokens.token_counts(d, word), jaccard.jaccard_classes, lambda d: jaccard.one_per_class(d).select("doc_id"),
        lambda d: quality.score_quality(d, quality.train(d, labels)).select("doc_id", "predicted"), lambda d: toxicity.score_toxicity(d, toxicity.train(d, labels)).select("doc_id", "predicted"),
        lambda d: packing.pack_documents(d, byte).select("doc_id", "length", "ids_crc32", "doc_tokens"),
    ):
        assert same(run(broken[0]), run(broken[1]))


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint"])
def test_ids_keep_their_type(broken, kind):
    rows = broken[1].withColumn("doc_id", F.col("doc_id").cast(kind))
    made = [fingerprints.fingerprint_edits(rows), packing.pack_documents(rows, queries.tokenizer_path("byte_bpe_50k.json"))]
    for df in made:
        assert dict(df.dtypes)["doc_id"] == kind and {r.doc_id for r in df.collect()} == set(range(6))


def test_edits_by_the_next_id_need_integers(broken):
    with pytest.raises(TypeError, match="integer"):
        fingerprints.fingerprint_edits(broken[1].withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))


COLUMNS = {
    "op1_merkle_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", "op2_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", "op4_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean", "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_lexical_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", "op7_slot_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint", "op9_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int", "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", COLUMNS)
def test_queries_return_the_columns_asked_for(spark, name):
    kinds = dict(queries.queries()[name](spark, SF).dtypes)
    assert {c: kinds[c] for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
