"""Registered queries on indexes, pattern tables, file trees and chains of provenance, and the SQL that each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.operators import automaton, governance, provenance, records, tree_hash
from dossier.operators.vector_index import VectorIndex, recall_at
from dossier.sources.shared import shared_dir

from .catalog import query, table

NEAREST, PROBES, RECALL = 10, 8, 0.95
#: Queries that the number of cells is fitted to, at most; recall is then measured on all of them.
FITTED = 1_000


def vector_index(s, d) -> VectorIndex:
    rows = table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("product"), (F.col("vec_id") % 16 + 1).cast("int").alias("section"))
    return VectorIndex.build(rows, f"{shared_dir(s)}/index-{uuid.uuid4().hex}")


def asked(s, d):
    """Every row whose id is divisible by 50 asks for its neighbours among all rows."""
    return table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("product"))


SCORED = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, ROUND(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS score, {w} FROM v q JOIN v ON {w} WHERE q.vec_id % 50 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


@query(f"WITH {SCORED.format(w='TRUE')} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= {NEAREST}")
def vector_index_search(s, d):
    return vector_index(s, d).search(asked(s, d).drop("product"), NEAREST, PROBES, exact=True)


@query(f"WITH {SCORED.format(w='q.label = v.label')} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= {NEAREST}")
def vector_index_of_product(s, d):
    return vector_index(s, d).search(asked(s, d), NEAREST, PROBES, exact=True)


@query(f"""SELECT COUNT(*) AS n_vectors, CAST(COUNT(*) FILTER (vec_id % 50 = 0) AS BIGINT) AS n_queries, TRUE AS recall_reached FROM embeddings""")
def vector_index_recall(s, d):
    """Cells enough for a recall of 0.95 on a sample of the queries reach it on all of them, within a hundredth."""
    index, queries = vector_index(s, d), asked(s, d).drop("product")
    drawn = queries.where("query_id % 100 = 0").orderBy(F.xxhash64("query_id")).limit(FITTED)
    probes = index.probes_for(drawn, NEAREST, RECALL)
    found = recall_at(index.search(queries, NEAREST, probes), index.search(queries, NEAREST, PROBES, exact=True), "vec_id")
    ids = index.vectors().select(F.lit(1).alias("v"), F.lit(0).alias("q")).union(queries.select(F.lit(0), F.lit(1)))
    sums = ids.agg(F.sum("v").cast("long").alias("n_vectors"), F.sum("q").cast("long").alias("n_queries"))
    return sums.withColumn("recall_reached", F.lit(found >= RECALL - 0.01))


NAMES_SQL = """SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_name || ' ' || p_type || ' x' WHEN 2 THEN p_type || ' ' || upper(p_name)
 WHEN 3 THEN substring(p_name, 2, 6) ELSE p_name || CAST(p_partkey AS VARCHAR) END AS name FROM part"""


@query(f"""WITH n AS ({NAMES_SQL}), k AS (SELECT DISTINCT p_name || ' ' || p_type AS item FROM part)
SELECT name FROM n WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE contains(item, name) OR contains(name, item)
 OR len(list_filter(string_split(lower(name), ' '), lambda w: NOT contains(lower(item), w))) = 0)""")
def registered_match(s, d):
    part, k = table(s, d, "part"), F.col("p_partkey") % 5
    name = (
        F.when(k == 0, F.col("p_type")).when(k == 1, F.concat_ws(" ", "p_name", "p_type", F.lit("x"))).when(k == 2, F.concat_ws(" ", "p_type", F.upper("p_name")))
        .when(k == 3, F.substring("p_name", 2, 6)).otherwise(F.concat("p_name", F.col("p_partkey").cast("string")))
    )
    return automaton.unknown_names(part.select(name.alias("name")).distinct(), part.select(F.concat_ws(" ", "p_name", "p_type").alias("item")))


@query("""WITH p AS (SELECT DISTINCT substring(text, 1, 24) AS pattern FROM benchmark UNION SELECT DISTINCT substring(text, 40, 9) FROM documents WHERE doc_id % 9 = 0)
SELECT doc_id, pattern, CAST(instr(text, pattern) - 1 AS BIGINT) AS first FROM documents JOIN p ON pattern <> '' AND contains(text, pattern)""")
def pattern_hits(s, d):
    """Opening words of benchmark items and fragments of a ninth of the documents, sought in all documents."""
    docs = table(s, d, "documents")
    patterns = table(s, d, "benchmark").select(F.substring("text", 1, 24).alias("pattern"))
    patterns = patterns.union(docs.where("doc_id % 9 = 0").select(F.substring("text", 40, 9)))
    return automaton.matches(docs, patterns).drop("n")


def _level(below: str) -> str:
    """Folders of a level, from (folder, kind, name, h) of its entries."""
    return f"""(SELECT folder AS path, sha256(string_agg(prefix || ':' || part, chr(10) ORDER BY prefix || ':' || part)) AS h, CAST(SUM(n) AS BIGINT) AS n FROM
 (SELECT folder, substring(sha256(name), 1, 3) AS prefix, SUM(n) AS n, sha256(string_agg(kind || ' ' || name || ' ' || h, chr(10) ORDER BY kind || ' ' || name || ' ' || h)) AS part
 FROM ({below}) GROUP BY 1, 2) GROUP BY folder)"""


@query(f"""WITH f AS (SELECT lang || '/' || coalesce(source, 'none') AS folder, 'file' AS kind, CAST(doc_id AS VARCHAR) || '.txt' AS name, sha256(text) AS h, 1 AS n FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
b AS {_level("SELECT * FROM f")},
c AS {_level("SELECT string_split(path, '/')[1] AS folder, 'folder' AS kind, string_split(path, '/')[2] AS name, h, n FROM b")},
r AS {_level("SELECT '' AS folder, 'folder' AS kind, path AS name, h, n FROM c")}
SELECT path, n AS n_files, h AS sha256 FROM b UNION ALL SELECT path, n, h FROM c UNION ALL SELECT path, n, h FROM r""")
def folder_hashes(s, d):
    docs = table(s, d, "documents").where("lang is not null and text is not null")
    path = F.concat_ws("/", "lang", F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return tree_hash.folders(docs.select(path.alias("path"), F.sha2("text", 256).alias("sha256")))


#: Orders are results of customers, these of nations, these of regions; some parents are gone, some have changed.
CHAIN_NODES = """SELECT 'o' || CAST(o_orderkey AS STRING) AS id, 'result' AS kind, CAST(NULL AS STRING) AS digest FROM orders
 UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'adapter', CAST(c_nationkey AS STRING) FROM customer WHERE c_custkey % 41 <> 0
 UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'base', n_name FROM nation WHERE n_nationkey <> 7
 UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), 'inputs', r_name FROM region UNION ALL SELECT 'p', 'prompt', 'v2' FROM region WHERE r_regionkey = 0"""
CHAIN_EDGES = """SELECT 'o' || CAST(o_orderkey AS STRING) AS child, 'c' || CAST(o_custkey AS STRING) AS parent, CAST(CASE WHEN o_orderkey % 37 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS STRING) AS expected
 FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'p', CASE WHEN o_orderkey % 53 = 0 THEN 'v1' ELSE 'v2' END FROM orders
 UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), CASE WHEN n_nationkey = 3 THEN 'elsewhere' ELSE r_name END FROM nation JOIN region ON n_regionkey = r_regionkey"""


def chain_tables(s, d):
    from .fixtures import NAMED, TABLES

    for name in TABLES:
        if name in ("orders", "customer", "nation", "region"):
            table(s, d, name).createOrReplaceTempView(f"dossier_{name}")
    return [s.sql(NAMED.sub(lambda m: m[0].replace(m[1], f"dossier_{m[1]}"), sql)) for sql in (CHAIN_NODES, CHAIN_EDGES)]


@query(f"""WITH RECURSIVE nodes AS ({CHAIN_NODES}), edges AS ({CHAIN_EDGES}), w(result, node, depth, child, broken) AS (SELECT id, id, 0, NULL::VARCHAR, NULL::VARCHAR FROM nodes WHERE kind = 'result'
 UNION ALL SELECT w.result, e.parent, w.depth + 1, e.child, CASE WHEN n.id IS NULL THEN 'missing' WHEN n.digest IS DISTINCT FROM e.expected THEN 'changed' END
 FROM w JOIN edges e ON e.child = w.node LEFT JOIN nodes n ON n.id = e.parent WHERE w.broken IS NULL),
b AS (SELECT result, depth, child, node AS parent, broken AS reason, ROW_NUMBER() OVER (PARTITION BY result ORDER BY depth, child, node) AS k FROM w WHERE broken IS NOT NULL),
c AS (SELECT result, COUNT(*) FILTER (depth > 0) AS n_links FROM w GROUP BY result)
SELECT c.result, n_links, depth, child, parent, reason FROM c LEFT JOIN b ON b.result = c.result AND k = 1""")
def broken_provenance(s, d):
    return provenance.first_broken(*chain_tables(s, d))


@query("""SELECT COALESCE(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'b' ELSE 'a' END AS side FROM (SELECT doc_id FROM labels) a
FULL JOIN (SELECT DISTINCT conv_id AS doc_id FROM conversations) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def ids_of_one_side(s, d):
    return governance.same_ids(table(s, d, "labels"), table(s, d, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id")


@query("SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) > 1")
def repeated_ids(s, d):
    return records.duplicates(table(s, d, "events"), "user_id")
