r"""Corpus-wide line deduplication over levelled, sorted runs of line hashes.

A line's key is the line without the white space `[\x20\x09-\x0D]` at both ends and with A-Z lower-cased; lines whose key has
fewer than `least_chars` code points are never touched. A key is known by 128 bits of a hash.

1. Documents come in batches. A batch's keys are counted first: one row for each key, with its number of documents and the
   largest doc_id that holds it.
2. `LineRuns` keeps such rows as runs: Parquet tables bucketed and sorted by the hash. A new batch is merge-anti-joined with
   each run: a key that a run already holds for `least_docs` documents, the largest of them above all of the batch's, has
   nothing to add. The rest becomes a run of its own. Only the batch is shuffled, the runs are read in place.
3. Runs of a level are merged into one of the next as soon as there are `fanout` of them, so a batch meets few runs and a row
   is rewritten once a level. A merged run is named by the batches that it holds; runs within it count no more, so a merge
   that stops half way leaves what was there before.
4. Keys that the runs together hold for `least_docs` documents lose their lines in all documents but the one of largest doc_id.

Batches of one table go from large doc_ids to small ones, so a very frequent key is settled by the first and then sends
nothing. The number of batches changes no result.

Defined results: a null or empty text is one empty line; rows that share a doc_id are one document, so they keep or lose a line
together; null doc_ids count as one document below all others; a line that occurs several times in the document that keeps it
stays there several times; repeated rows give repeated rows; an empty table gives no rows; further columns are ignored, or kept
by `drop_common_lines`.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import delete_tables, fresh, shared_dir, written

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FANOUT = 4, 3
WHITE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
RUN_NAME = re.compile(r"run-(\d+)-(\d+)-(\d+)-(\d+)$")


def line_key(line: str, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The key's hash (16 bytes); None for lines that are too short."""
    key = line.strip(WHITE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= least_chars else None  # bytes.lower() is A-Z alone


def with_text_key(docs: DataFrame, name: str) -> DataFrame:
    """doc_id may be null or repeated with other texts; with this hash of the text a row's lines find it again."""
    return docs.withColumn(name, F.xxhash64("text"))


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS, *keep: str) -> DataFrame:
    """doc_id, further columns to keep, h1, h2: each row's distinct keys."""
    columns = ["doc_id", *keep]

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = {line_key(line, least_chars) for line in (text or "").split("\n") if len(line) >= least_chars} - {None}
                rows += [k] * len(own)
                found += own
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int32())
            arrays = [*(batch.column(c).take(at) for c in columns), *(pa.array(h) for h in halves.T)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *KEY])

    types = dict(docs.dtypes)
    return docs.select(*columns, "text").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns) + ", h1 long, h2 long")


class LineRuns:
    """Runs of (h1, h2, n_docs, top) in a shared folder; n_docs is exact below `least_docs`, top is the largest doc_id."""

    def __init__(self, spark: SparkSession, folder: str, least_docs: int = LEAST_DOCS, fanout: int = FANOUT, doc_type: str = "long"):
        self.spark, self.folder, self.least_docs, self.fanout = spark, folder, least_docs, fanout
        self.schema = f"h1 long, h2 long, n_docs long, top {doc_type}"
        self.tables: dict[str, str] = {}

    def runs(self) -> list[tuple[int, int, int, int, str]]:
        """(level, first batch, last batch, buckets, path) of the finished runs that no larger one holds."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for status in fs.listStatus(path) if fs.exists(path) else []:
            name = RUN_NAME.match(status.getPath().getName())
            if name and fs.exists(status.getPath().suffix("/_SUCCESS")):
                found.append((*map(int, name.groups()), f"{self.folder}/{name.group()}"))
        return sorted(r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found))

    def read(self, run: tuple[int, int, int, int, str]) -> DataFrame:
        """A run as a bucketed table of this session's catalogue, so that joins on its key need no shuffle of it."""
        path, buckets = run[4], run[3]
        if path not in self.tables:
            self.tables[path] = name = f"run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(self.tables[path])

    def _write(self, rows: DataFrame, level: int, first: int, last: int, buckets: int) -> None:
        path, name = f"{self.folder}/run-{level}-{first}-{last}-{buckets}", f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).mode("overwrite").saveAsTable(name)
        self.tables[path] = name

    def add(self, lines: DataFrame) -> None:
        """A batch of (doc_id, h1, h2) becomes a run; rows of one doc_id must come in one batch."""
        runs = self.runs()
        docs = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
        own = lines.groupBy(*KEY).agg(docs.cast("long").alias("n_docs"), F.max("doc_id").alias("top"))
        for run in runs:
            settled = self.read(run).where(F.col("n_docs") >= self.least_docs).alias("settled")
            covered = F.col("own.top").isNull() | (F.col("settled.top") >= F.col("own.top"))
            same = [F.col(f"own.{k}") == F.col(f"settled.{k}") for k in KEY]
            own = own.alias("own").join(settled, [*same, covered], "left_anti")
        batch = max((r[2] for r in runs), default=-1) + 1
        buckets = runs[0][3] if runs else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._write(own.repartition(buckets, *KEY), 0, batch, batch, buckets)
        self.compact()

    def merged(self, runs: list) -> DataFrame:
        """One row a key. Read as plain files: Spark 4.1 gives wrong sums where it groups a union of bucketed tables in place."""
        paths = [r[4] for r in runs]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))

    def compact(self) -> None:
        """Merge the runs of each level that is full, lowest first."""
        level = 0
        while full := [r for r in self.runs() if r[0] == level]:
            if len(full) >= self.fanout:
                self._write(self.merged(full).repartition(full[0][3], *KEY), level + 1, min(r[1] for r in full), max(r[2] for r in full), full[0][3])
                self._forget(full)
            level += 1

    def common(self) -> DataFrame:
        """h1, h2, top of the keys that `least_docs` documents hold."""
        return self.merged(self.runs()).where(F.col("n_docs") >= self.least_docs).select(*KEY, "top")

    def _forget(self, runs: list) -> None:
        for run in runs:
            if name := self.tables.pop(run[4], None):
                self.spark.sql(f"DROP TABLE {name}")
        delete_tables(self.spark, [r[4] for r in runs])

    def delete(self) -> None:
        self._forget(self.runs())
        delete_tables(self.spark, [self.folder])


def descending_batches(docs: DataFrame, batches: int):
    """A column: the batch of a doc_id, 0 for the largest ones; about equal numbers of rows, null ids last."""
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares).alias("cuts")).first().cuts if shares else None
    batch = F.lit(batches - 1)
    for k, cut in enumerate(sorted(set(cuts or []))):
        batch = F.when(F.col("doc_id") > cut, F.lit(batches - 2 - k)).otherwise(batch)
    return batch


def dropped_lines(docs: DataFrame, name: str, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """doc_id, the text's key `name`, lost: the hashes of the lines that go, for documents that lose some."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    batch = fresh("batch", docs.columns)
    keyed = line_keys(docs.select("doc_id", "text", name), least_chars, name)
    keyed.withColumn(batch, descending_batches(docs, batches)).write.partitionBy(batch).parquet(path)
    lines = spark.read.schema(keyed.schema.add(batch, IntegerType())).parquet(path)
    runs = LineRuns(spark, f"{path}-runs", least_docs, fanout, dict(docs.dtypes)["doc_id"])
    for k in range(batches):
        runs.add(lines.where(F.col(batch) == k).select("doc_id", *KEY))
    common = written(runs.common(), "common")
    runs.delete()
    lost = lines.join(common, KEY).where(~F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", name, *KEY).distinct()
    lost = written(lost.groupBy("doc_id", name).agg(F.collect_list(F.struct(*KEY)).alias("lost")), "lost")
    delete_tables(spark, [path])
    return lost


def without_lines(text: str | None, lost: list[dict] | None, least_chars: int) -> tuple[str, int, int]:
    """The text without the lines of the given hashes, its number of lines, and how many went."""
    text = text or ""
    if not lost:
        return text, text.count("\n") + 1, 0
    gone = {x["h1"].to_bytes(8, "little", signed=True) + x["h2"].to_bytes(8, "little", signed=True) for x in lost}
    lines = text.split("\n")
    kept = [x for x in lines if len(x) < least_chars or line_key(x, least_chars) not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _joined(docs: DataFrame, least_chars: int, least_docs: int, batches: int, fanout: int) -> tuple[DataFrame, str, str]:
    key = fresh("text_key", docs.columns)
    lost_ = fresh("lost", docs.columns)
    keyed = with_text_key(docs, key)
    lost = dropped_lines(keyed, key, least_chars, least_docs, batches, fanout)
    doc, its_key = fresh("doc", docs.columns), fresh("key", docs.columns)
    lost = lost.select(F.col("doc_id").alias(doc), F.col(key).alias(its_key), F.col("lost").alias(lost_))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(its_key))
    return keyed.join(lost, same, "left").drop(doc, its_key), key, lost_


def drop_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES,
                      fanout: int = FANOUT) -> DataFrame:
    """The documents, all columns, with texts that have lost their common lines; a null text stays null."""
    joined, key, lost = _joined(docs, least_chars, least_docs, batches, fanout)
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column(lost).to_pylist(), strict=True)
            texts = [None if t is None else without_lines(t, gone, least_chars)[0] for t, gone in pairs]
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.drop(key).mapInArrow(run, docs.schema)


def digest(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES,
           fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept, of every row."""
    joined, key, lost = _joined(docs.select("doc_id", "text"), least_chars, least_docs, batches, fanout)

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column(lost).to_pylist(), strict=True)
            out = [without_lines(t, gone, least_chars) for t, gone in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for _, n, _ in out], pa.int64()),
                    pa.array([n for _, _, n in out], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _, _ in out], pa.string()),
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return joined.drop(key).mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id
"""
