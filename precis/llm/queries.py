"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.token_counts import read_vocabulary, token_counts
    return token_counts(_table(spark, sf_dir, "documents"), read_vocabulary(tokenizer("piece_bpe_32k.model")))


def op2_itq_hamming_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.itq import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.page_diff import extract
    return extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.splitters import shard
    return shard(_table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.probminhash import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.packing import ids_crc32, pack
    return ids_crc32(pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op7_weak_label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.weak_labels import classify
    return classify(_table(spark, sf_dir, "documents")).select("doc_id", "score", "accepted")


def op8_url_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.url_trees import judge
    return judge(_table(spark, sf_dir, "pages"))


def op9_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.norm_topk import top_k
    return top_k(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op10_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.mixing import mix
    m = mix(_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


def op11_walsh_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.hadamard import cluster, with_inertia
    return with_inertia(*cluster(_table(spark, sf_dir, "embeddings"))).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_transducer_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.divergence import audit
    return audit(_table(spark, sf_dir, "documents"))


def op13_line_hash_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precis.llm.line_dedup import without_common_lines
    return without_common_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_viterbi_token_counts, op2_itq_hamming_tables, op3_page_differencing, op4_sampled_splitters, op5_probminhash, op6_sum_of_squares_packing,
        op7_weak_label_classifier, op8_url_boosted_trees, op9_norm_bucket_topk,
        op10_water_filling_mix, op11_walsh_hadamard_clusters, op12_transducer_divergence, op13_line_hash_arrays)
}
