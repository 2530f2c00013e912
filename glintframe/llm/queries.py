"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_derivatives

    return page_derivatives(_read(spark, sf_dir, "pages"))


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated_documents

    return contaminated_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imi import nearest_of_twentieth

    return nearest_of_twentieth(_read(spark, sf_dir, "embeddings"))


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pst import language_model_scores

    return language_model_scores(_read(spark, sf_dir, "documents"))


def op5_byte_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_of_documents

    return language_of_documents(_read(spark, sf_dir, "documents"))


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .partenum import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import byte_bpe_digests

    return byte_bpe_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_digests

    return suffix_digests(_read(spark, sf_dir, "documents"))


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gam import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rlz import rlz_digests

    return rlz_digests(_read(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import alignment_digests

    return alignment_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_read(spark, sf_dir, "documents"))


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import forest_duplicates

    return forest_duplicates(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .collocations import COLLOCATION_SQL
    from .decontaminate import CONTAMINATION_SQL
    from .rlz import RLZ_SQL
    from .warc import PAGE_DERIVATIVES_SQL

    return {"op1_warc_derivatives": PAGE_DERIVATIVES_SQL, "op2_simhash_decontamination": CONTAMINATION_SQL, "op10_rlz_dedup": RLZ_SQL, "op12_phrase_collocations": COLLOCATION_SQL}
