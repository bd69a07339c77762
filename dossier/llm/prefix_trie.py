r"""Prefix trie of conversations by fixed-length block hashing.

1. Turns are numbered within their conversations by places in a sorted table, so a conversation of any length is numbered by many
   tasks. `rebuilt` puts the shared opening turns in front.
2. A turn is known by 128 bits of a hash of its place, role and text; a prefix by the XOR of its turns' hashes, which many tasks
   can add up in any order. BLOCK turns are a block. Prefixes before each block are exclusive XORs in levels of FAN blocks.
3. Conversations are grouped by whole blocks first: all that share the prefix before a block and the block are one class, so
   copies leave one row, whatever their number, and BLOCK turns cost one row.
4. Where a prefix has one class of next blocks, nothing diverges in it: its turns are nodes with the class's members. Only
   where siblings diverge are the classes' turns grouped again, one by one.
5. Sums over subtrees need no walk up the tree. A node is owned by its smallest member, so a conversation owns the end of its
   path from some depth on. Over the members of a node, the words they own add up to the words of the subtree's nodes (the
   smallest member's own words count from the node on), and the childless nodes they own to its leaves. So a second grouping,
   of owners alone, gives both.
6. The hash of those who end at a node runs over their sorted numbers as a stream: a range shuffle sorts them, each task joins its
   runs to texts of PIECE numbers, and a node's texts are hashed one after the other, never held together.

Defined results: rows with a null conv_id are in no conversation and are left out; null role or text is as empty; turns of one
number follow by the MD5 of the role's length, a colon, role and text; repeated rows are further turns; a conversation without
turns of its own and of its base's is a member of the root alone; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.ranks import positions

from .common import configure, written

BLOCK, FAN, PIECE = 8, 1024, 2048
FAMILY, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (hashes of role and text), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("tie"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = positions(own, "conv_id", F.col("turn").asc_nulls_first(), "tie").drop("turn", "tie")
    starts = placed.groupBy("conv_id").agg(F.min("position").alias("start"))
    return placed.join(starts, "conv_id").withColumn("pos", F.col("position") - F.col("start") + 1).drop("position", "start")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation begins with the first h turns of its family's base and goes on after its own first h turns:
    the turns (conv_id, pos, t1, t2, words) and all conv_ids, also of those left without turns."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    after = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h"))
    after = after.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select("conv_id", "pos", "t1", "t2", "words")
    opening = turns.where(F.col("pos") < SHARED).withColumnRenamed("conv_id", "base")
    before = opening.join(convs.select("base", "conv_id", "taken"), "base").where(F.col("pos") <= F.col("taken"))
    return after.unionByName(before.select("conv_id", "pos", "t1", "t2", "words")), convs.select("conv_id")


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, x1, x2 (XOR of its turns' hashes), words, turns: (pos, x1, x2, w, upto), XORs and words up to each turn."""
    hashed = turns.select(
        "conv_id", "pos", F.expr(f"(pos - 1) div {BLOCK}").alias("block"), F.xxhash64("pos", "t1").alias("h1"),
        F.xxhash64("t2", "pos").alias("h2"), F.col("words").alias("w"),
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    xors = [F.bit_xor(h).over(upto).alias(x) for h, x in (("h1", "x1"), ("h2", "x2"))]
    own = hashed.select("conv_id", "block", "pos", *xors, "w", F.sum("w").over(upto).alias("upto"))
    turn = F.struct("pos", "x1", "x2", "w", "upto")
    last = F.max(turn)
    return own.groupBy("conv_id", "block").agg(last.alias("last"), F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "conv_id", "block", "last.x1", "last.x2", F.col("last.upto").alias("words"), "turns"
    )


def before_blocks(table: DataFrame, fan: int = FAN) -> DataFrame:
    """The rows with p1, p2, before: XOR and words of the conversation's earlier blocks; no window holds more than `fan` rows."""
    within = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    spans = table.withColumn("span", F.expr(f"block div {fan}"))
    earlier = lambda f, c: F.coalesce(f(c).over(within), F.lit(0))
    out = spans.select("*", earlier(F.bit_xor, "x1").alias("p1"), earlier(F.bit_xor, "x2").alias("p2"), earlier(F.sum, "words").alias("before"))
    if (table.agg(F.max("block")).first()[0] or 0) >= fan:
        sums = spans.groupBy("conv_id", F.col("span").alias("block")).agg(
            F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("words").alias("words")
        )
        whole = before_blocks(written(sums, "spans"), fan).select(
            "conv_id", F.col("block").alias("span"), F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.col("before").alias("sb")
        )
        out = out.join(whole, ["conv_id", "span"]).withColumns(
            {"p1": F.expr("p1 ^ s1"), "p2": F.expr("p2 ^ s2"), "before": F.col("before") + F.col("sb")}
        ).drop("s1", "s2", "sb")
    return out.drop("span")


def turn_nodes(classes: DataFrame, sums: list[str], least: str) -> DataFrame:
    """A row for each turn of each class: depth, d1, d2 (the prefix with it), q1, q2 (the prefix before it), w, words before it
    (`pre`), and the class's sums and least members."""
    turns = classes.select("p1", "p2", "before", "diverges", *sums, least, "turns", F.posexplode("turns").alias("k", "t"))
    earlier = lambda x: F.when(F.col("k") == 0, 0).otherwise(F.col("turns")[F.greatest(F.col("k") - 1, F.lit(0))][x]).cast("long")
    return turns.select(
        F.col("t.pos").alias("depth"), (F.col("p1").bitwiseXOR(F.col("t.x1"))).alias("d1"), F.col("p2").bitwiseXOR(F.col("t.x2")).alias("d2"),
        F.col("p1").bitwiseXOR(earlier("x1")).alias("q1"), F.col("p2").bitwiseXOR(earlier("x2")).alias("q2"),
        F.col("t.w").alias("w"), (F.col("before") + F.col("t.upto") - F.col("t.w")).alias("pre"), *sums, least, "diverges",
    )


def grouped(classes: DataFrame, sums: list[str], least: str) -> DataFrame:
    """Nodes of classes: turns of classes without siblings are nodes as they are, the others are grouped."""
    turns = turn_nodes(classes, sums, least)
    same = turns.where("diverges").groupBy("depth", "d1", "d2").agg(
        *(F.first(c).alias(c) for c in ("q1", "q2", "w", "pre")), *(F.sum(c).alias(c) for c in sums), F.min(least).alias(least)
    )
    return turns.where("not diverges").drop("diverges").unionByName(same)


def ends_hashes(ends: DataFrame) -> DataFrame:
    """d1, d2, ends_sha256 of (d1, d2, conv_id): SHA-256 of the comma-joined, ascending conv_ids of each prefix."""
    ordered = ends.repartitionByRange(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), "d1", "d2", "conv_id")
    ordered = ordered.sortWithinPartitions("d1", "d2", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, last = [], None
            columns = [batch.column(c).to_pylist() for c in ("d1", "d2", "conv_id")]
            for d1, d2, conv in zip(*columns, strict=True):
                if (d1, d2) != last or len(rows[-1][3]) >= PIECE:
                    rows.append((d1, d2, conv, []))
                    last = (d1, d2)
                rows[-1][3].append(str(conv))
            cells = [*([r[k] for r in rows] for k in range(3)), [",".join(r[3]) for r in rows]]
            types = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["d1", "d2", "first", "ids"])

    pieces = written(ordered.mapInArrow(joined, "d1 long, d2 long, first long, ids string"), "ends")
    dealt = pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")

    def hashed(batches: Iterator[pa.RecordBatch]):
        last, state = None, None
        for batch in batches:
            rows = []
            for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True):
                if (d1, d2) != last:
                    if last is not None:
                        rows.append((*last, state.hexdigest()))
                    last, state = (d1, d2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield as_batch(rows)
        if last is not None:
            yield as_batch([(*last, state.hexdigest())])

    def as_batch(rows):
        cells = zip(*rows, strict=True) if rows else ([], [], [])
        types = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, types, strict=True)], names=["d1", "d2", "ends_sha256"])

    return dealt.mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations given by turns (conv_id, pos from 1 without gaps, t1, t2, words) and all conv_ids."""
    table = before_blocks(written(blocks(turns), "blocks"))
    ends = turns.groupBy("conv_id").agg(
        F.bit_xor(F.xxhash64("pos", "t1")).alias("d1"), F.bit_xor(F.xxhash64("t2", "pos")).alias("d2"), F.sum("words").alias("total")
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("d1", "d2", "total")}
    ends = written(convs.join(ends, "conv_id", "left").withColumns(zero), "wholes")
    table = written(table.join(ends.select("conv_id", "total"), "conv_id"), "placed")

    # Blocks first, turns only where the blocks after a prefix differ.
    key = ["p1", "p2", "x1", "x2"]
    classes = table.groupBy(*key).agg(
        F.first("before").alias("before"), F.first("turns").alias("turns"), F.count("*").alias("n_convs"),
        F.sum("total").alias("totals"), F.min("conv_id").alias("conv_id"),
    )
    classes = written(classes, "classes")
    siblings = classes.groupBy("p1", "p2").agg((F.count("*") > 1).alias("diverges"))
    classes = written(classes.join(siblings, ["p1", "p2"]), "siblings")
    nodes = written(grouped(classes, ["n_convs", "totals"], "conv_id"), "nodes")

    # What a conversation owns, and the sums of that over the members of every node.
    children = nodes.groupBy(F.col("q1").alias("d1"), F.col("q2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, ["d1", "d2"], "left").fillna(0, ["n_children"]), "children")
    owned = nodes.groupBy("conv_id").agg(F.sum("w").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    owned = written(owned.join(ends.select("conv_id", "total"), "conv_id"), "owned")
    weights = table.select("conv_id", *key).join(owned, "conv_id").groupBy(*key).agg(
        F.sum("owned").alias("owned"), F.sum("leaves").alias("n_leaves"), F.min(F.struct("conv_id", "owned", "total")).alias("owner")
    )
    weighed = grouped(classes.drop("n_convs", "totals", "conv_id").join(weights, key), ["owned", "n_leaves"], "owner")
    weighed = weighed.select("d1", "d2", "owned", "n_leaves", F.col("owner.owned").alias("own"), F.col("owner.total").alias("own_total"))

    hashes = written(ends_hashes(ends.select("d1", "d2", "conv_id")), "hashes")
    parents = nodes.select(F.col("d1").alias("q1"), F.col("d2").alias("q2"), F.col("conv_id").alias("parent"))
    top = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum("total").alias("total")).first()
    distinct = owned.agg(F.sum("owned").alias("words"), F.sum("leaves").alias("leaves")).first()
    first = children.where("d1 = 0 and d2 = 0").first()
    root = (0, 0, top.conv_id, 0, None, top.n, first.n_children if first else 0, max(1, distinct.leaves or 0), (top.total or 0) - (distinct.words or 0))
    columns = "d1 long, d2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    root = nodes.sparkSession.createDataFrame([root] if top.n else [], columns)
    smallest = F.lit(top.conv_id).cast("long")
    below = F.col("totals") - F.col("n_convs") * F.col("pre")
    distinct_below = F.col("owned") - F.col("own") + F.col("own_total") - F.col("pre")
    full = nodes.join(weighed, ["d1", "d2"]).join(parents, ["q1", "q2"], "left").select(
        "d1", "d2", "conv_id", "depth", F.coalesce("parent", smallest).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (below - distinct_below).alias("saved_tokens"),
    )
    return full.unionByName(root).join(hashes, ["d1", "d2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the rebuilt conversations."""
    configure(conversations.sparkSession)
    turns, convs = rebuilt(written(numbered(conversations), "turns"))
    return trie(written(turns, "rebuilt"), written(convs, "convs"))


#: crc32 is a fold over a digit's code (a number) and eight shifts (-1) for each digit.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos
 FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, max(pos) AS n_own,
 xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
  lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END),
  CAST(4294967295 AS BIGINT)) % 4 AS h FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n_own, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.pos, t.role, t.text FROM k JOIN t ON t.conv_id = k.base AND t.pos <= k.taken
 UNION ALL SELECT k.conv_id, t.pos - k.h + k.taken, t.role, t.text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > k.h),
p AS (SELECT conv_id, pos AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
 sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM r),
q AS (SELECT conv_id, depth, w, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS above,
 depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
 UNION ALL SELECT k.conv_id, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = k.conv_id) FROM k),
n AS (SELECT node, any_value(depth) AS depth, any_value(w) AS w, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY node),
d AS (SELECT above AS node, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
s AS (SELECT q.node, sum((u.n_convs - 1) * u.w) AS saved, count(*) FILTER (d.node IS NULL) AS n_leaves
 FROM n u JOIN q ON q.conv_id = u.conv_id AND q.depth <= u.depth LEFT JOIN d ON d.node = u.node GROUP BY q.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(d.n_children, 0) AS n_children,
 s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN d ON d.node = n.node LEFT JOIN n a ON a.node = n.above
"""
