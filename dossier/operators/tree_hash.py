"""Hashes of folder trees, level by level: a file has that of its bytes, a folder that of its entries.

An entry is a line of kind, name and hash, so renaming, moving, emptying or changing a file changes the hashes of its folders
and no others. A folder's entries are hashed in two levels (4096 prefixes of the names' hashes, then the folder), so no task
holds all entries of a large folder. Levels are few; each is one grouping of the entries of that depth.

Defined results: folders without files are not there, as in object stores; an empty tree has no rows; paths are relative and parted
by `/`; two files of one path are an error that the hash would hide, so they raise.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path (relative), length, sha256 of every file below a folder; contents stay within the scan's tasks."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    # A scan passes over files without a byte; the listing, which Spark keeps in the driver anyway, has them.
    listed = spark.createDataFrame([(unquote(urlparse(f).path),) for f in rows.inputFiles()], "at string")
    found = rows.select(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "").alias("at"), "length", F.sha2("content", 256).alias("sha256"))
    bare = unquote(urlparse(root).path)
    return listed.join(found, "at", "left").select(
        F.substr("at", F.lit(len(bare) + 1)).alias("path"), F.coalesce("length", F.lit(0)).alias("length"),
        F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("sha256"),
    )


def lines(of: str | Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(of)), "\n"), 256)


def folders(tree: DataFrame) -> DataFrame:
    """path ('' is the root), n_files, sha256 of every folder of a table of files (path, sha256)."""
    repeated = F.raise_error(F.concat(F.lit("two files of one path: "), F.col("path"))).cast("boolean")
    checked = tree.groupBy("path").agg(F.min("sha256").alias("sha256"), F.count("*").alias("n"))
    checked = checked.where(F.when(F.col("n") > 1, repeated).otherwise(True))
    parts = F.split("path", "/")
    entries = checked.select(
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"),
        F.size(parts).alias("depth"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("n_files"), "sha256",
    )
    deepest = entries.agg(F.max("depth")).first()[0] or 0
    out, below = None, None
    for depth in range(deepest, 0, -1):
        own = entries.where(F.col("depth") == depth).drop("depth")
        own = own if below is None else own.unionByName(below)
        line = F.concat_ws(" ", "kind", "name", "sha256")
        prefix = F.substring(F.sha2("name", 256), 1, 3)
        grouped = own.groupBy("folder", prefix.alias("prefix")).agg(lines(line).alias("part"), F.sum("n_files").alias("n_files"))
        made = grouped.groupBy("folder").agg(lines(F.concat_ws(":", "prefix", "part")).alias("sha256"), F.sum("n_files").alias("n_files"))
        made = made.select(F.col("folder").alias("path"), "n_files", "sha256")
        out = made if out is None else out.unionByName(made)
        up = F.split("path", "/")
        below = made.where("path <> ''").select(
            F.array_join(F.slice(up, 1, F.size(up) - 1), "/").alias("folder"), F.element_at(up, -1).alias("name"),
            F.lit("folder").alias("kind"), "n_files", "sha256",
        )
    return out if out is not None else tree.select("path", F.lit(0).cast("long").alias("n_files"), "sha256").limit(0)
