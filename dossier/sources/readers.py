"""Readers and writers of logs, records and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.chem import safe_csv


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name without its ending) and the whole text of each file."""
    df = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return df.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def keyed_csv(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """CSV rows by key, a byte order mark left out; of a key that stands there twice, the last row (by place in the file)."""
    own = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)  # the reader drops the mark with the header
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rest = [c for c in own.columns if c != key]
    return own.withColumn("_at", at).groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("r")).select(key, "r.*")


def predictions(spark: SparkSession, path: str, schema: str, mock: DataFrame | None = None) -> DataFrame:
    """doc_id and fields of saved predictions (one JSON file a document); documents of `mock` that have none get its rows."""
    from pyspark.errors import AnalysisException

    try:
        own = text_files(spark, path)
    except AnalysisException as e:
        if mock is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return mock
    saved = own.select("doc_id", F.from_json("text", schema).alias("r")).select("doc_id", "r.*")
    return saved if mock is None else saved.unionByName(mock.join(saved.select("doc_id"), "doc_id", "left_anti"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert by key group: the partitions that df has take the place of those there; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text values no spreadsheet takes for formulas; fails where the path exists."""
    text = [c for c, k in df.dtypes if k == "string"]
    df.withColumns({c: safe_csv(F.col(c)) for c in text}).write.mode("errorifexists").csv(path, header=True)


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """The table, or an error that names a key which is blank or stands there twice."""
    bad = df.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 or {key} is null or trim(cast({key} as string)) = ''")
    row = bad.limit(1).collect()
    if row:
        raise ValueError(f"{key} {row[0][key]!r} is blank or stands in {row[0]['n']} rows")
    return df


def last_record(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines with the last one of each key (by file name and place in the file)."""
    own = spark.read.json(path, schema=schema)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    own = own.withColumn("_at", at)
    rest = [c for c in own.columns if c not in (key, "_at")]
    return own.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("r")).select(key, "r.*")


def header_and_rows(spark: SparkSession, path: str, header: str, rows: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of two kinds: those without a doc_id are headers."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    is_row = F.get_json_object("value", "$.doc_id").isNotNull()
    parse = lambda df, schema: df.select(F.from_json("value", schema).alias("r")).select("r.*")
    return parse(lines.where(~is_row), header), parse(lines.where(is_row), rows)


def phrase_table(spark: SparkSession, path: str) -> DataFrame:
    """row_no, code, phrase of a CSV of codes (h_code, phrase_ko, accepted_variants with `|` between): one row a phrase."""
    own = spark.read.csv(path, header=True, schema="h_code string, phrase string, variants string").withColumn("line", F.monotonically_increasing_id())
    every = F.concat(F.array("phrase"), F.split(F.coalesce("variants", F.lit("")), r"\|"))
    rows = own.select("line", F.col("h_code").alias("code"), F.posexplode(F.array_distinct(F.filter(F.transform(every, F.trim), lambda p: p != ""))).alias("n", "phrase"))
    return rows.select((F.col("line") * 1000 + F.col("n")).alias("row_no"), "code", "phrase")


def class_table(spark: SparkSession, path: str) -> DataFrame:
    """hazard_class, category, signal_word, codes (with `|` between) of a CSV of classifications."""
    own = spark.read.csv(path, header=True, schema="hazard_class string, category string, signal_word string, codes string, source string, note string")
    return own.select("hazard_class", "category", F.nullif(F.trim("signal_word"), F.lit("")).alias("signal_word"), F.coalesce("codes", F.lit("")).alias("codes"))
