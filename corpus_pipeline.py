"""The corpus pipeline: toxicity, quality, near copies, mixing, packing. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import jaccard, mixing, packing, quality, toxicity
from weftline.llm.common import DOCUMENT_COLUMNS, cut, table
from weftline.llm.queries import tokenizer_path


def _kept(docs: DataFrame, score, bad: int) -> DataFrame:
    """docs without the rows whose text the model rejects. The model's UDF passes the columns on, so that no join is needed."""
    scored = score(docs)
    return scored.where(F.col("predicted") != bad).select(*DOCUMENT_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger finds toxic go."""
    labels = table(spark, sf_dir, "labels").where(quality.fold("doc_id", 3) != 1)
    tagger = toxicity.train(docs, labels)
    return _kept(docs, lambda d: toxicity.with_toxicity(d, tagger, threshold=0.7, spans=False), 1)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of poor quality go."""
    labels = table(spark, sf_dir, "labels").where(quality.fold("doc_id", 5) != 0)
    model = quality.train(docs, labels)
    return _kept(docs, lambda d: quality.with_quality(d, model, threshold=0.3), 0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays."""
    return jaccard.one_per_class(docs).select(*DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in the shards' shuffled order."""
    return mixing.mixed_rows(mixing.mix_documents(docs)).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed rows' pieces in sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("mix", mix), ("pack", pack)]

#: SQL cannot express the trained stages; the tests hold each stage against a plain computation, given the trained models (toxicity against its operator's scores).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
