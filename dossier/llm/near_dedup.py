r"""Near-duplicate documents by one-permutation MinHash with densification, bands, and star-shaped candidates.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a 128-bit digest of that set, and 28 bands of 5
   from a one-permutation signature whose empty bins are filled from a fixed random order of the other bins.
2. Equal sets are one class, whose smallest doc_id stands for it from here on: copies cost one row of the signatures.
3. The smallest class of each band bucket is its centre; a centre and all that share a bucket with it are a group. Every
   candidate pair (two classes in one bucket) lies in that bucket's group, and a bucket gives rows in its size.
4. Groups, cut by a hash of the member into parts of about PART members and PART_SHINGLES shingles, fetch whole texts; in a part, links are confirmed on full
   sets, the centre's first; then each member not in the centre's component is compared with all others. Only links that
   join two components are returned. A group of several parts whose members still have several components is finished
   in a second pass: its members outside the largest component against all its members.
5. Links are joined into components.

A pair at similarity 0.85 shares no bucket with probability (1 - 0.85**5)**28 = 7e-8.

Defined results: null and wordless texts have empty sets and are alone; equal texts are linked; rows that share a doc_id
are one node; a null doc_id gets its class's component, or null; an empty table gives no rows; further columns stay where
whole documents are returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, hashed_words, written
from .components import components

SHINGLE, NUMERATOR, DENOMINATOR = 3, 85, 100
BANDS, ROWS = 28, 5
BINS = BANDS * ROWS
#: Texts of a group that one task holds at once, about, and their shingles; a group with more of either has several parts.
PART, PART_SHINGLES = 512, 1 << 20
#: Candidate documents up to which their ids are broadcast (8 bytes each); beyond it, they are joined by a shuffle.
BROADCAST_IDS = 500_000
CHUNK_BYTES = 1 << 22

#: Row i: the order in which other bins are tried to fill bin i.
FILL_ORDER = np.argsort(np.random.default_rng(20).random((BINS, BINS)), axis=1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted sets of shingle hashes."""
    hashes, places, sizes = hashed_words(pa.array(texts, pa.string()))
    flat = hashes[places] if len(places) else np.empty(0, np.uint64)
    out, at = [], 0
    rolled = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for k in range(n):
        rolled = mixed(rolled ^ flat[k : len(flat) - n + 1 + k]) if len(rolled) else rolled
    for size in sizes.tolist():
        if size >= n:
            out.append(np.unique(rolled[at : at + size - n + 1]))
        elif size:
            x = np.full(1, size, np.uint64)
            for h in flat[at : at + size]:
                x = mixed(x ^ h)
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin; a bin is a range of hashes, so in a sorted set it is the first one there."""
    bins = (((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], filled[bins[first]] = shingles[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = FILL_ORDER[empty]
        source = order[np.arange(len(empty)), filled[order].argmax(axis=1)]
        out[empty] = out[source]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """For each row, a key for each band that also tells the band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        out = mixed(out ^ parts[:, :, k])
    return out.view(np.int64)


def features(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and its bands (null if empty)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [s for part in chunks(texts, lambda t: len(t or "") + 64, CHUNK_BYTES) for s in shingle_sets(part, shingle)]
            full = [k for k, s in enumerate(found) if len(s)]
            keys = band_keys(np.array([signature(found[k]) for k in full], np.uint64)) if full else []
            bands = [None] * len(found)
            for k, own in zip(full, keys, strict=True):
                bands[k] = own
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
                             , pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    schema = "doc_id long, n_shingles long, digest binary, bands array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Part:
    """Sets of some documents, and the links among them that join components."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids = ids
        self.size = np.array([len(s) for s in sets])
        _, self.dense = np.unique(np.concatenate(sets), return_inverse=True)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.mark = np.zeros(int(self.dense.max()) + 1, bool)
        self.component = np.arange(len(ids))

    def linked(self, k: int) -> np.ndarray:
        """The rows whose sets are similar enough to row k's."""
        own = self.dense[self.offsets[k] : self.offsets[k] + self.size[k]]
        self.mark[own] = True
        common = np.add.reduceat(self.mark[self.dense], self.offsets, dtype=np.int64)
        self.mark[own] = False
        return np.flatnonzero(DENOMINATOR * common >= NUMERATOR * (self.size + self.size[k] - common))

    def join(self, k: int):
        for other in self.linked(k):
            if self.component[other] != self.component[k]:
                yield self.ids[k], self.ids[int(other)]
                self.component[self.component == self.component[other]] = self.component[k]

    def links(self, first: int):
        """Every pair is compared that isn't within the first row's component once that row has been compared."""
        yield from self.join(first)
        for k in np.flatnonzero(self.component != self.component[first]):
            yield from self.join(int(k))


def confirm(roles: DataFrame, docs: DataFrame, count: int, shingle: int) -> DataFrame:
    """(a, b) links within each (centre, part) of roles(centre, part, id, side); side 0 rows are compared with all."""
    roles = F.broadcast(roles) if count <= BROADCAST_IDS else roles
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(roles, "id")

    def run(table: pa.Table) -> pa.Table:
        rows = {}
        for i, side, text in zip(*(table.column(c).to_pylist() for c in ("id", "side", "text")), strict=True):
            old = rows.get(i)
            rows[i] = (min(side, old[0]) if old else side, text)
        ids = sorted(rows, key=lambda i: (rows[i][0], i))
        part = Part(ids, [s for c in chunks([rows[i][1] for i in ids], len, CHUNK_BYTES) for s in shingle_sets(c, shingle)])
        if rows[ids[0]][0] == 0 and rows[ids[-1]][0] == 1 and table.column("centre")[0].as_py() == ids[0]:
            found = list(part.links(0))
        else:
            found = [x for k, i in enumerate(ids) if rows[i][0] == 0 for x in part.join(k)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return texts.groupBy("centre", "part").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, part: int = PART, part_shingles: int = PART_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    parts_of = F.ceil(F.greatest(F.count("*") / part, F.sum("n") / part_shingles)).cast("int")
    rows = written(features(docs, shingle), "features")
    classes = (
        rows.where("digest is not null").groupBy("digest").agg(
            F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")
        )
    )
    classes = written(classes, "classes")
    buckets = classes.where("id is not null").select("id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last")
    members = buckets.join(shared.select("key", "centre"), "key").where("id > centre").select("centre", "id").distinct()
    members = written(members.join(classes.select("id", "n"), "id"), "members")
    sizes = members.groupBy("centre").agg(parts_of.alias("parts"))
    sizes = written(sizes, "sizes")
    count = members.count()

    role = members.join(sizes, "centre").select(
        "centre", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", F.lit(1).alias("side")
    )
    centres = sizes.select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("id"),
        F.lit(0).alias("side"),
    )
    links = written(confirm(role.union(centres), docs, count, shingle), "links")

    if sizes.where("parts > 1").limit(1).count():  # groups whose parts haven't all met
        found = components(links)
        large = members.join(sizes.where("parts > 1"), "centre").select("centre", "id", "parts", "n")
        heads = sizes.where("parts > 1").withColumn("id", F.col("centre")).join(classes.select("id", "n"), "id")
        large = large.union(heads.select("centre", "id", "parts", "n"))
        large = large.join(found, "id", "left").withColumn("c", F.coalesce("component_id", "id"))
        by = large.groupBy("centre", "c").agg(F.count("*").alias("members"))
        main = by.groupBy("centre").agg(F.max_by("c", F.struct("members", "c")).alias("main"), F.count("*").alias("cs"))
        open_ = large.join(main.where("cs > 1"), "centre")
        open_ = written(open_.select("centre", "id", "parts", "n", (F.col("c") != F.col("main")).alias("odd")), "open")
        # Odd members, in runs of PART, meet every part of the group.
        runs = open_.where("odd").groupBy("centre").agg(parts_of.alias("runs"))
        odd = open_.where("odd").join(runs, "centre").select(
            "centre", "id", "parts", F.pmod(F.xxhash64("id", F.lit(1)), F.col("runs")).cast("int").alias("run")
        ).select("centre", "id", "parts", "run", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
        odd = odd.select("centre", (F.col("run") * F.col("parts") + F.col("p")).alias("part"), "id", F.lit(0).alias("side"))
        every = open_.join(runs, "centre").select(
            "centre", "id", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("p"),
            F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"),
        )
        every = every.select("centre", (F.col("run") * F.col("parts") + F.col("p")).alias("part"), "id", F.lit(1).alias("side"))
        roles = written(odd.union(every), "roles")
        links = links.union(written(confirm(roles, docs, roles.count(), shingle), "links"))

    found = components(links).withColumnRenamed("id", "class_id")
    classed = classes.select("digest", F.col("id").alias("class_id")).join(found, "class_id", "left")
    classed = classed.select("digest", F.coalesce("component_id", "class_id").alias("class_component"))
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_component"))
    return rows.join(classed, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, as it was: that of smallest doc_id, null ids last, then of smallest hash of its columns.

    Rows are told apart by a number of their own, so that rows with a null or repeated doc_id go only if they are linked or
    equal to the one that stays; of wordless rows, those that share both doc_id and text are equal."""
    row, plain = fresh("row", docs.columns), [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    docs_ = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(docs_.select(F.col(row).alias("doc_id"), "text"), **options)
    ids = docs_.select(
        F.col(row).alias("row"), F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        F.xxhash64(*plain).alias("hash"),
    )
    wordless = F.col("n_shingles") == 0
    rows = found.select(F.col("doc_id").alias("row"), "n_shingles", "component_id").join(ids, "row").groupBy(
        F.when(~wordless, F.col("component_id")).alias("c"), F.when(wordless, F.struct("id", "sha")).alias("w")
    )
    kept = rows.agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "hash", "row"))["row"].alias(row))
    return docs_.join(kept, row, "left_semi").select(docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) AS component_id,
 d.doc_id = least(d.doc_id, coalesce(m.v, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.u = d.doc_id
"""
