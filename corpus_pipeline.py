"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All
but the last return the columns of the documents, whatever other columns there are; names that
a stage needs itself give way. Null texts are empty ones, texts of any length are read whole,
rows with a null id stay what they are, an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolens.llm import lineage, minhash, mixing, packing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy of the quality ledger keeps; empty and null texts fail it. Repeated rows fare alike."""
    return quality.filter_docs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: similarity 0.8 on five-word shingles.

    Texts without words are no duplicates of anything; of repeated rows of one id one stays,
    rows without an id all stay.
    """
    return minhash.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; a null text stays null or empty as it is read."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix to target weights; a null source is one of its own."""
    return mixing.mixed(docs, mixing.TARGET)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; documents of a length class are ranked in the order of the mix. An empty text is one token."""
    return packing.pack_in_order(docs, packing.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]
#: Pfair scheduling and column generation are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's table is deleted when the next one's is there; the last one is read by the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = lineage.scratch(spark)
        docs = lineage.stored(stage(spark, docs, sf_dir), path)
        if before is not None:
            lineage.discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
