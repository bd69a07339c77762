"""Session settings, shared storage and byte-level word scanning used by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch handed to Python ends at either bound, so one worker never holds many long texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths of tables written since each open `tables_of`.
_MADE: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _MADE:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)  # no part file may have been written


@contextmanager
def tables_of() -> Iterator[list[str]]:
    """The paths of all tables that `written` makes within, in order."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)


def delete_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that nothing will read any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        table.getFileSystem(conf).delete(table, True)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(base: str, taken: Iterable[str]) -> str:
    """A column name that no given column has."""
    taken = {c.lower() for c in taken}
    while base.lower() in taken:
        base = "_" + base
    return base


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Words `[^\x20\x09-\x0D]+` of lower-cased (A-Z) texts: hashes of the distinct ones, each word's place among those,
    and each text's number of words. Null is as empty."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words = split.flatten().dictionary_encode()
    places, sizes = words.indices.to_numpy(), np.diff(split.offsets.to_numpy())
    distinct = words.dictionary.cast(pa.binary()).to_pylist()
    if b"" in distinct:  # a wordless text is split into one empty string
        empty = places == distinct.index(b"")
        sizes = sizes - np.add.reduceat(empty, split.offsets.to_numpy()[:-1] - split.offsets[0].as_py(), dtype=np.int32)
        places = places[~empty]
    return np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64), places, sizes


def chunks(rows: Iterable, size, limit: int) -> Iterator[list]:
    """Runs of rows whose sizes add up to about `limit`."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held
