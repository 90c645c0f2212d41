"""The queries opN_<name>, each on its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, circulant_minhash, collocations, hidden_markov, jaccard_join, line_crf, minimax_shards, mtree_search, poisson_mix, pruned_graph, secret_spans, va_clusters, warc_archive
from .common import fold, table


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_archive.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree_search.mtree_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.find_secrets(table(spark, sf_dir, "documents"))


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_crf.train(docs, labels.filter(fold("doc_id", 3) != 1))
    held_out = (fold("doc_id", 3) == 1).alias("held_out")
    return line_crf.score_documents(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards.shard_documents(table(spark, sf_dir, "documents"))


def op8_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned_graph.graph_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.poisson_mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_copy", "mix_count", "mix_key")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_clusters.va_clusters(table(spark, sf_dir, "embeddings"))


def op13_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.circulant_minhash(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hidden_markov": op1_hidden_markov,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_warc_archive": op3_warc_archive,
        "op4_mtree_search": op4_mtree_search,
        "op5_secret_spans": op5_secret_spans,
        "op6_line_crf": op6_line_crf,
        "op7_minimax_shards": op7_minimax_shards,
        "op8_pruned_graph": op8_pruned_graph,
        "op9_poisson_mix": op9_poisson_mix,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_collocations": op11_collocations,
        "op12_va_clusters": op12_va_clusters,
        "op13_circulant_minhash": op13_circulant_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_archive": warc_archive.ORACLE_SQL,
        "op4_mtree_search": mtree_search.ORACLE_SQL,
        "op9_poisson_mix": poisson_mix.ORACLE_SQL,
        "op11_collocations": collocations.ORACLE_SQL,
        "op12_va_clusters": va_clusters.oracle_sql(),
    }
