"""Registered queries of the subpackage: production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketripple.llm import (byte_bpe, chunk_fingerprints, columnar_topk, cover_dedup, lattice_neardup, periodic_runs, quality_mil, secret_markov, setm_phrases,
                              simhash_pivots, source_mixing, token_counts, url_markov)
from marketripple.llm.common import table
from marketripple.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ["doc_id"])


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op3_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), RULES)


@query
def op4_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    return quality_mil.score(docs, model, ["doc_id"]).select("doc_id", quality_mil.held_out().alias("held_out"), "score", "predicted")


@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


SQL["op5_source_mixing"] = source_mixing.MIX_SQL


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so a run's work never depends on earlier runs."""
    cache = f"{scratch_dir(spark)}/token_counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), cache)


@query
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprints.compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secret_markov.scan(docs, secret_markov.train(docs), ["doc_id"])


@query
def op10_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_neardup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query
def op8_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents", "doc_id", "text")).drop("runs", "collapsed")


@query
def op12_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnar_topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


SQL["op12_columnar_topk"] = columnar_topk.TOP_SQL


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setm_phrases.collocations(table(spark, sf_dir, "documents", "text", "lang"))


SQL["op13_phrase_collocations"] = setm_phrases.COLLOCATION_SQL
