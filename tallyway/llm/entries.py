"""The queries of this subpackage, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyway.llm import align, ann, dart_minhash, host_bayes, html_text, lm_scoring, mixing, oracle, packing, secret_scan, spelling, token_files, warc, weak_rules
from tallyway.llm.tables import load


#: The vocabulary that the token queries use; operators take any path.
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.vectors_of(load(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op2_host_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's site is its source and its path there its language: the tables have no other address of a document."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return host_bayes.classify(docs, labels, F.col("source"), F.col("lang"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(load(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(load(spark, sf_dir, "documents"))


#: Near equal shares, no source more than three times, and every document at least once.
MIX = mixing.Target(entropy=0.98, repetition=3.0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(load(spark, sf_dir, "documents"), MIX)


def op7_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return weak_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, load(spark, sf_dir, "pages"))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(load(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(load(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spellings(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multiprobe": op1_multiprobe,
    "op2_host_bayes": op2_host_bayes,
    "op3_packing": op3_packing,
    "op4_stupid_backoff": op4_stupid_backoff,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_weak_rules": op7_weak_rules,
    "op8_warc": op8_warc,
    "op9_dart_minhash": op9_dart_minhash,
    "op10_token_files": op10_token_files,
    "op11_ratio_text": op11_ratio_text,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}

#: The others pack, sketch, search, learn or tokenise, which SQL can't say; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
