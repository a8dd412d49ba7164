"""The corpus pipeline: toxic documents go, repeated lines go, one of each near-duplicate group stays,
sources are mixed to their weights, and the mix is packed into token windows.

Each stage is an operator of ``arraymill.llm`` on all that the stage before it kept; stages pass
Parquet tables on. The last returns the pieces of the packed sequences, all others documents. A document
all of whose lines repeat earlier ones is a copy and goes with them.

Defined results: null texts are empty ones, and empty texts stay until packing, where they are a lone
end token; rows with the same id and text are copies, of which one stays; ties fall to the smaller id;
texts of any length pass whole; columns that documents have besides go along, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arraymill.llm import line_dedup, mixing, ngram_join, packing, toxicity
from arraymill.llm.queries import vocabulary
from arraymill.llm.shared import written


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs, keep_emptied=False)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.ids_crc32(packing.pack(docs, vocabulary()))


STAGES = [
    ("toxicity", keep_civil),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Learnt scores, sampling and token ids are beyond SQL; tests/llm compare run() with the stages' own references.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
