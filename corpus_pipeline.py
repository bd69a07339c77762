"""The corpus pipeline: documents become packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; `run` writes each stage's rows as
Parquet in the shared folder and reads them again, so a lost executor costs one stage at most. What a stage wrote besides its
rows goes when these are there, and its input when the next one's are; the last table stays.

Defined results: documents with a null or empty text have no language and go in the first stage; where no document has a
label, all that have a letter stay. Of rows that are equal or linked, one stays; null or repeated ids of unlike texts lose
nothing. Ties go to the smallest doc_id, then to the smallest hash of the row. An empty table gives no rows, an empty
benchmark removes none. Further columns stay until the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import decontaminate, language, near_dedup, pack, secrets
from dossier.llm.common import configure, delete_tables, read, tables_of, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a null lang becomes the language found."""
    return language.drop_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced by a mark."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return pack.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Language models, random fields and tokenizers can't be written in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with tables_of() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        delete_tables(spark, before + made[:-1])
        before = made[-1:]
    return docs
