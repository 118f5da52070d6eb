"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_lists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_token_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bitplanes import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .prefix_bpe import bpe_digests

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .baseline_jpeg import media_features, media_of_texts, stored

    return media_features(stored(media_of_texts(table(spark, sf_dir, "documents"))))


def op10_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_store import archive

    return archive(table(spark, sf_dir, "pages"))


def op5_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covering_simhash import hexed, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").withColumn("day", url_lists.fetched_on(F.col("page_id")))
    found = url_lists.evaluate(captures, url_lists.entries(spark))
    return found.withColumn("fetched_on", F.col("fetched_on").cast("string"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compact_windows import repeats

    return repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: DuckDB SQL of the operators that SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_url_lists": url_lists.sql()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
