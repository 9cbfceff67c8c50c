"""A corpus pipeline of five stages, each one operator of ``tallyway.llm``.

Each stage takes the rows its predecessor kept as a DataFrame with the columns of ``documents`` and decides over all of them:

- quality rules: rows that the weakly supervised rules reject go;
- near-duplicates: one row of each class stays, that with the smallest doc_id; texts without words stay;
- secrets: every base span and every owner-specific live-looking value is masked in the text;
- mixing: each source is repeated as its temperature weight asks, at most REPETITION times, none less than once;
- packing: the texts become pieces of sequences of at most 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyway.llm import dart_minhash, mixing, packing, secret_scan, weak_rules
from tallyway.llm.tables import load, shared_path

#: Epochs of any source at most.
REPETITION = 1.5
TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realised(docs, mixing.Target(repetition=REPETITION)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: The genetic packing and the sketches can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again for the next."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
