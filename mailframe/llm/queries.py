"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, langid, lines, mixing, periods, pii, secrets, sharding, simhash, sql, substring, token_files, topk
from .common import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, out)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("whole_copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(40)
    return sharding.place(_table(spark, sf_dir, "documents"), tree, sharding.grown(tree))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (the source as host) and pages in one, so that priors count both; only pages declare a language, since documents' labels are what is fitted on."""
    docs = _table(spark, sf_dir, "documents")
    of_docs = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    of_pages = langid.page_evidence(_table(spark, sf_dir, "pages")).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "host")
    return langid.identify(of_docs.unionByName(of_pages), langid.fit(docs), ["doc_id", "page_id"])


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that one scan has begun, of English documents, is brought up to all documents by a second one; findings cover all rows."""
    docs, ledger = _table(spark, sf_dir, "documents"), new_path(spark, "ledger")
    secrets.update(docs.where("lang = 'en'"), ledger)
    return secrets.report(secrets.findings(docs, secrets.update(docs, ledger)))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in batches by id; what their runs have closed in the end is removed from all."""
    return lines.dedup(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.find(_table(spark, sf_dir, "documents"), rewrite=periods.planted)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    own = (op1_token_files, op2_mixing, op3_simhash, op4_sharding, op5_decontamination, op6_language_id, op7_top_k, op8_pii, op9_substring_dedup, op10_secrets)
    own += (op11_line_dedup, op12_periodic_runs, op13_filter_audit)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: tokenizers, fingerprints, language models and disguises are held against brute force in tests."""
    return {
        "op2_mixing": sql.MIXING,
        "op4_sharding": sql.SHARDING,
        "op5_decontamination": sql.DECONTAMINATION,
        "op7_top_k": sql.TOP_K,
        "op9_substring_dedup": sql.SUBSTRING,
        "op10_secrets": sql.SECRETS,
        "op11_line_dedup": sql.LINES,
        "op12_periodic_runs": sql.PERIODS,
        "op13_filter_audit": sql.AUDIT,
    }
