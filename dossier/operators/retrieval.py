"""Retrieval over a table of chunks: index building, filters, several targets, matching of product names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .headings import sections
from .text import recursive_chunks

MOST_CONTEXT, CHUNK, OVERLAP = 12_000, 1200, 150


def index(docs: DataFrame, splits: list[str], sealed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (doc_id, section, section_title, chunk, text) of the documents (doc_id, split, text and, if there is one, product)
    that may be indexed, and (doc_id, reason) of the others. Sections are cut recursively, each chunk under a line that names
    its product (the doc_id where there is none) and section."""
    flagged = docs.join(sealed.select("doc_id").distinct().withColumn("is_sealed", F.lit(True)), "doc_id", "left")
    reason = (
        F.when(F.col("is_sealed"), "sealed").when(~F.coalesce(F.col("split").isin(splits), F.lit(False)), "other_split")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "no_text")
    )
    flagged = flagged.withColumn("reason", reason)
    kept = flagged.where("reason is null")
    # The product's name goes through the cutting within the document's key.
    product = F.coalesce("product", F.col("doc_id").cast("string")) if "product" in docs.columns else F.col("doc_id").cast("string")
    own = sections(kept.select(F.struct("doc_id", product.alias("product")).alias("doc_id"), "text"))
    own = own.select("doc_id.doc_id", "doc_id.product", "section", "title", "body")
    return recursive_chunks(own, CHUNK, OVERLAP), flagged.where("reason is not null").select("doc_id", "reason")


def chunks_wanted(n_targets: Column, named: Column) -> Column:
    """Chunks per target: two for several, four for one that is named, else eight, within the context's length."""
    wanted = F.when(n_targets > 1, 2).when(named, 4).otherwise(8)
    return F.greatest(F.lit(1), F.least(wanted, F.floor(F.lit(MOST_CONTEXT) / (F.greatest(n_targets, F.lit(1)) * CHUNK)).cast("int")))


def nearest(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest chunks (product, section, vec_id, embedding) of each query row (query_id, product, sections, q): of its
    product, and of its sections where it names some. Queries are joined on their product, so each chunk meets only those
    that may want it; the rank limit is applied before the shuffle as well."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = chunks.join(queries, "product").where(F.col("sections").isNull() | F.array_contains("sections", F.col("section")))
    score = F.round(dot(e, F.col("q")) / F.sqrt(dot(e, e) * dot(F.col("q"), F.col("q"))), 6)
    scored = met.select("query_id", "product", "section", "vec_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest_or_any_section(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As `nearest`; a query whose sections give nothing is asked again without them."""
    first = nearest(chunks, queries, k)
    empty = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.union(nearest(chunks, empty.withColumn("sections", F.lit(None).cast("array<int>")), k))


def distinct_evidence(found: DataFrame, most: int = CHUNK) -> DataFrame:
    """One row of each (doc_id, product, section, chunk), without the header line, cut to `most` characters."""
    return found.dropDuplicates(["doc_id", "product", "section", "chunk"]).withColumn(
        "text", F.substring(F.regexp_replace("text", r"^\[[^\n]*\]\n", ""), 1, most)
    )
