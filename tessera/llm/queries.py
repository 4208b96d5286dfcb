"""The eleven queries of this subpackage, as ``__spark_entry__`` registers them, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import measure

    return measure(_table(spark, sf_dir, "documents"))


def op4_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sstable import encode_to_shards

    return encode_to_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """``ledger`` is the folder of a ledger from earlier runs; what it holds is not scanned again."""
    from .secrets import scan_documents

    return scan_documents(_table(spark, sf_dir, "documents"), ledger)


def op5_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages"))


def op10_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import cut_documents

    return cut_documents(_table(spark, sf_dir, "documents"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_tag")


def op8_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_documents

    return scan_documents(_table(spark, sf_dir, "documents"))


def op9_aho_corasick_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_ac import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bin_completion_packing": op1_bin_completion_packing,
    "op2_secret_ledger": op2_secret_ledger,
    "op3_repetition_coverage": op3_repetition_coverage,
    "op4_sstable_shards": op4_sstable_shards,
    "op5_path_template_tree": op5_path_template_tree,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_license_classifier": op8_license_classifier,
    "op9_aho_corasick_viterbi": op9_aho_corasick_viterbi,
    "op10_relative_lz": op10_relative_lz,
}

ORACLE: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h, length(coalesce(text, '')) AS n FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
}
