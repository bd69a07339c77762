"""Sinks: several tables as one commit, write-once records, one JSON document a row, failure logs, training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def commit_tables(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """All tables under run=<id>, then one commit row; readers take committed runs alone, so a run that failed half-way is
    never seen. A run id is written once."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/run={run_id}")
    counts = [(run_id, name, spark.read.parquet(f"{root}/{name}/run={run_id}").count()) for name in tables]
    row = spark.createDataFrame(counts, "run string, table string, n long").coalesce(1)
    row.write.mode("errorifexists").parquet(f"{root}/_commits/run={run_id}")


def committed(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """The rows of all committed runs, with their run."""
    runs = spark.read.schema("run string").parquet(f"{root}/_commits").select("run").distinct()
    own = spark.read.schema(f"{schema}, run string").option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    return own.join(runs, "run", "left_semi")


def write_once(df: DataFrame, path: str) -> bool:
    """Whether this call wrote the record; a first record is never replaced."""
    from pyspark.errors import AnalysisException

    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            return False
        raise
    return True


def export_json(docs: DataFrame, path: str, names: list[str], columns: list[str]) -> None:
    """Each row's columns as a JSON text in a folder by the row's names (file stem, model, revision)."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = docs.select(*names, body.alias("value"))  # documents of earlier exports stay
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).text(path)


def append_failures(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def split_cut(df: DataFrame, path: str, ok: str = "OK") -> None:
    """Cut texts that succeeded and those to be reviewed, each in its own folder; refuses to overwrite either."""
    for name, rows in (("success", df.where(F.col("status") == ok)), ("review_required", df.where(~F.col("status").eqNullSafe(ok)))):
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")


def training_lines(examples: DataFrame, path: str, most_tokens: int, tokens: str = "n_tokens") -> DataFrame:
    """JSON lines (doc_id, split, variant, messages) of the examples that aren't too long; those that are come back whole
    (doc_id, variant, tokens), for none is ever cut."""
    fits = examples.where(F.col(tokens) <= most_tokens)
    line = F.to_json(F.struct("doc_id", "split", "variant", "messages"), {"ignoreNullFields": "false"})
    fits.select("split", line.alias("value")).write.mode("errorifexists").partitionBy("split").text(path)
    return examples.where(F.col(tokens) > most_tokens).select("doc_id", "variant", tokens)


def stamped(df: DataFrame, key: str, body: str) -> DataFrame:
    """Each document's JSON with the first 16 hex digits of its hash, by which a change is seen."""
    return df.select(key, body, F.substring(F.sha2(body, 256), 1, 16).alias("stamp"))


def append_reviews(events: DataFrame, path: str) -> None:
    """Add to the review history, which is never rewritten; values that aren't text are stored as JSON."""
    kinds = dict(events.dtypes)
    value = F.col("confirmed_value") if kinds["confirmed_value"] == "string" else F.to_json("confirmed_value")
    events.withColumn("confirmed_value", value).write.mode("append").parquet(path)


def training_digest(spark: SparkSession, path: str) -> DataFrame:
    """split, n, set_sha256 of written training lines."""
    from dossier.operators.records import manifest

    lines = spark.read.schema("value string, split string").option("basePath", path).text(path)
    return manifest(lines, "split", "value")


def tracked(stream: DataFrame, put, checkpoint: str) -> None:
    """Give each new batch of a stream's rows to `put` (rows, batch number), once a batch, and stop at the end of what is
    there; for sinks such as experiment trackers."""
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
