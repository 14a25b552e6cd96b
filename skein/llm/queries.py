"""The registered queries of the corpus operators: thin views of each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import oracles
from skein.llm.ann import nearest_neighbours
from skein.llm.bpe import encode_decode
from skein.llm.decontamination import find_contamination
from skein.llm.fim import restore, transform
from skein.llm.html import extract_main_text
from skein.llm.language import identify
from skein.llm.minhash import near_duplicates
from skein.llm.pii import KINDS, pseudonymise
from skein.llm.secrets import digest, find_secrets
from skein.llm.sharding import SHARDS, shard_by_bytes
from skein.llm.spelling import spelling_variants
from skein.llm.token_files import write_token_files
from skein.llm.urls import judge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("pii.kind", F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", "text", *counts)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=100, count=10)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("text", "restored"))]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return write_token_files(docs).fetch(docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_url_filters": op4_url_filters,
    "op5_pii": op5_pii,
    "op6_minhash": op6_minhash,
    "op7_ann": op7_ann,
    "op8_language": op8_language,
    "op9_html": op9_html,
    "op10_bpe": op10_bpe,
    "op11_fim": op11_fim,
    "op12_token_files": op12_token_files,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
