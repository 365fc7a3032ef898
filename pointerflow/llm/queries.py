"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, collocations, fingerprints, html, mixing, oracle, packing, pieces, quality, rules, secrets, simhash, urls, wavelet
from .common import documents, labels, pages, shared_root
from .tokens import default_vocabulary


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), default_vocabulary(), seq_len=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_quality_rules(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(pages(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(pages(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_root(spark)}/token-shards-{uuid.uuid4().hex}"
    wavelet.write_token_shards(documents(spark, sf_dir), path, default_vocabulary(), end_id=2)
    return wavelet.document_digests(wavelet.read_token_shards(spark, path))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(documents(spark, sf_dir), threshold=100, most=2000)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return centroids.cluster_vectors(vectors, k=40, rounds=5, seed=2)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.default_model()
    tokens = pieces.decode_pieces(pieces.encode_pieces(documents(spark, sf_dir), model), model)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


_ALL = (
    op1_packing, op2_quality_rules, op3_fingerprints, op4_mixing, op5_secrets, op6_html_extraction, op7_quality_classifier,
    op8_url_filters, op9_token_files, op10_simhash, op11_collocations, op12_centroids, op13_sentencepiece,
)
QUERIES = {f.__name__: f for f in _ALL}

#: The others can't be written in SQL as a whole (tokenizer ids, sketches,
#: trained models, iterations); tests/llm holds each to a brute-force version.
ORACLE_SQL: dict[str, str] = {"op11_collocations": oracle.COLLOCATIONS, "op12_centroids": oracle.CENTROIDS}
