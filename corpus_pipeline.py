"""From raw documents to token files: each stage is written as Parquet and read again as the next one's documents.

1. Language: documents whose language isn't known go (no letters, unlike all languages, or no clear posterior).
2. Near-duplicates: of each component of texts with a 5-word Jaccard similarity of 0.8 or more, the document with the least id stays.
   Links within SimHash's radius come from its tree and are compared on words; an exact search finds those beyond it.
3. Decontamination: documents that hold a benchmark item go.
4. Mixing: each document appears as often as the blocks that its source's quota takes hold its first word, 0 to 2 times.
5. Token files: ids of all that is left, in ascending doc_id, in files; a row a document from the files.

All stages but the last keep the columns of ``documents``. A table may be empty at any stage.
Stages that go through Python bound the session's batches (``common.small_batches``), since what they return is read after they end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailframe.llm import decontaminate, langid, mixing, near, token_files
from mailframe.llm.common import new_path, small_batches, stash, unstash

#: SQL has no near-duplicate, language or tokenizer functions; tests hold run() against a brute-force version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near.first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    taken = mixing.mix(rows, keep=("_row",)).where("whole_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "whole_copies"))).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    out = new_path(spark, "tokens")
    token_files.write_token_files(docs, out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, out)


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("token files", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # what a stage has read goes when its result is written
        unstash(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
