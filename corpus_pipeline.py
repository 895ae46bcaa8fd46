"""From raw documents to packed training sequences: five stages, each one of the operators of ``syllabase.llm``.

Every stage gets what the one before has left, as a table read from Parquet. All but the last return the columns of the documents.
"""
from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabase.llm import decontam, linededup, packing, resample, setjoin
from syllabase.llm.common import settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return resample.resampled(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document that was nothing else goes with them. ``n_chars`` follows the text."""
    done = linededup.line_deduplicated(docs).filter("_n_removed = 0 or trim(text) <> ''")
    return done.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else f"`{c}`" for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return setjoin.representatives(docs, share=80, size=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, packed."""
    return packing.packed(docs, tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark), ("best-fit packing", sequences),
]

#: SQL can express neither the trained classifier nor the packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
