"""Registered queries of the subpackage: every operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.llm import centroids, decontaminate, jaccard, language_model, lexical, licences, lines, neighbours, pieces, quality, reputation
from lyceum.llm import setsketch, suffixes
from lyceum.llm.tables import documents, read

#: Folder and name of the tokenizer's file; the name of an installed package's file unless a path is set.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model(path: str | None = None) -> pieces.Model:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECE_MODEL)
    return pieces.load(path)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), piece_model())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(neighbours.usable(read(spark, sf_dir, "embeddings")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels name documents by number; a page's outcome is the quality label with its page_id."""
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return reputation.judge(read(spark, sf_dir, "pages"), outcomes)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op11_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(documents(spark, sf_dir))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sentencepiece, op2_suffix_dedup, op3_nearest_neighbours, op4_decontamination, op5_language_model, op6_host_reputation,
        op7_line_dedup, op8_licence_scan, op9_jaccard_join, op10_quality, op11_setsketch_dedup, op12_centroid_clustering,
        op13_lexical_search,
    )
}
