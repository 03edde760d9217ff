"""From raw documents to packed sequences: five stages, each over all rows that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``; decisions take effect at once.
Rows without an id are never merged with others. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.decontaminate import remove
from plumbline.llm.jaccard import jaccard_components
from plumbline.llm.langid import fit, keep_identified
from plumbline.llm.pack import pack
from plumbline.llm.surrogates import pseudonymise
from plumbline.plans.registry import table
from plumbline.session import scratch_path

#: Near copies share this percentage of their shingles of so many words; op9_jaccard_join has a rule of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: The key of the surrogates: of these synthetic tables only; with real documents it is a secret that is not in the code.
SURROGATE_KEY = b"synthetic documents"
#: A text whose best language has less than even odds against all others is rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language for sure, go."""
    return keep_identified(docs, fit(docs), LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (at least 80 percent of their five-word shingles in common) the one with the smallest id stays; of rows that repeat an id, one."""
    found = jaccard_components(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)
    leaders = found.where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(leaders, "doc_id", "left_semi").select(*docs.columns)
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *[c for c in docs.columns if c != "doc_id"]))
    return kept.withColumn("row in id", row).where("`row in id` = 1").select(*docs.columns).unionAll(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage in at least a twentieth of their words go."""
    return remove(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become surrogates; ``n_chars`` follows the text."""
    return pseudonymise(docs, SURROGATE_KEY, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of the window."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("surrogates", replace_personal_data),
    ("packing", pack_sequences),
]
#: Tokenizer and fitted model are outside SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
