"""Benchmark decontamination by a broadcast set of benchmark word windows.

A window is 13 consecutive words of a benchmark item (all its words, if it has fewer). The benchmark is broadcast in
blocks of a checked number of bytes; with one block the documents are scanned once and nothing is shuffled, with more
each block is a further scan over the rows that the one before wrote to the shared folder.

Defined results: null and wordless texts have no words and no hits; null and wordless items have no window; repeated
document rows are judged row by row; repeated items of one item_id count as one item; documents may have any further
columns, which stay.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, written

WINDOW = 13
#: Bytes of benchmark text in one broadcast; its windows take about twenty times that while they are made.
BLOCK_BYTES = 16 << 20
#: Bytes of text that one vectorised scan takes at once.
SCAN_BYTES = 2 << 20

#: Letters, digits and every byte of a non-ASCII character stay; A-Z become a-z; the rest separates words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Table:
    """The distinct windows of one length: sorted hashes, where each window lies among the items' words, and its items."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, owners: np.ndarray, size: int):
        self.flat, self.size = flat, size
        for seed in count():  # until different windows have different hashes
            hashed = self.hashed(flat, starts, seed)
            order = np.argsort(hashed, kind="stable")
            twin = np.append(False, hashed[order][1:] == hashed[order][:-1])
            k = np.flatnonzero(twin)
            if self.same(flat, starts[order[k]], starts[order[k - 1]]).all():
                break
        self.seed, first = seed, order[~twin]
        self.hashes, self.starts = hashed[first], starts[first]
        n = int(owners.max()) + 1
        window, self.owners = np.divmod(np.unique((np.cumsum(~twin) - 1) * n + owners[order]), n)
        self.ends = np.cumsum(np.bincount(window))

    def hashed(self, ids: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
        out = np.full(len(at), seed, np.uint64)
        for k in range(self.size):
            out = (out ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def same(self, ids: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether the windows of `ids` at each place equal the items' windows at `starts`."""
        out = np.ones(len(at), bool)
        for k in range(self.size):
            out &= ids[at + k] == self.flat[starts + k]
        return out

    def found(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that hold one of the windows, and its number."""
        hashed = self.hashed(ids, at, self.seed)
        near = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[near] == hashed)
        hit = hit[self.same(ids, at[hit], self.starts[near[hit]])]
        return at[hit], near[hit]

    def owners_of(self, window: int) -> np.ndarray:
        return self.owners[self.ends[window - 1] if window else 0 : self.ends[window]]


class Windows:
    """The windows of some items in arrays, about 40 bytes each: word ids and a table for each window length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        number: dict[str, int] = {}
        flat, starts, owners, at = [], defaultdict(list), defaultdict(list), 0
        for item, text in items:
            found = np.array([self.ids.setdefault(w, len(self.ids)) for w in words(text)], np.int32)
            size = min(window, len(found))
            if size:
                flat.append(found)
                starts[size].append(at + np.arange(len(found) - size + 1))
                owners[size].append(np.full(len(found) - size + 1, number.setdefault(item, len(number))))
                at += len(found)
        self.items = list(number)
        joined = np.concatenate(flat) if flat else np.empty(0, np.int32)
        self.tables = {k: Table(joined, np.concatenate(starts[k]), np.concatenate(owners[k]), k) for k in starts}

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text: number of words, merged word ranges that are hit, items with an occurring window."""
        flat: list[bytes | None] = []
        starts, counts = [], []
        for text in texts:
            own = words(text)
            starts.append(len(flat))
            counts.append(len(own))
            flat += own
            flat.append(None)  # no window runs from one text into the next
        get = self.ids.get
        ids = np.array([get(w, -1) for w in flat], np.int32)
        out = [(n, [], set()) for n in counts]
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        marks: dict[int, list[tuple[int, int]]] = defaultdict(list)
        met: dict[tuple[int, int], set[int]] = defaultdict(set)
        starts_at = np.array(starts)
        for size, table in self.tables.items():
            if len(ids) < size:
                continue
            at, window = table.found(ids, np.flatnonzero(unknown[size:] == unknown[:-size]))
            docs = np.searchsorted(starts_at, at, "right") - 1
            for doc, begin, w in zip(docs.tolist(), (at - starts_at[docs]).tolist(), window.tolist(), strict=True):
                marks[doc].append((begin, begin + size))
                met[doc, size].add(w)
        for (doc, size), found in met.items():
            table = self.tables[size]
            out[doc][2].update(self.items[k] for w in found for k in table.owners_of(w))
        for doc, ranges in marks.items():
            out[doc][1].extend(merged(ranges))
        return out


@lru_cache(1)
def windows_of(shared: Broadcast, window: int) -> Windows:
    """One set of windows for all tasks of a worker."""
    return Windows(shared.value, window)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of about block_bytes, fetched one after another; the size is summed before any is fetched."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    items = items.where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.toLocalIterator()]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs with n_words, hit_spans (ranges of word numbers, end exclusive) and hit_items (sorted strings)."""
    own = docs.columns
    n_words, spans, items = (fresh(c, own) for c in ("n_words", "hit_spans", "hit_items"))
    schema = T.StructType(
        [*docs.schema.fields]
        + [T.StructField(n_words, T.LongType()), T.StructField(spans, SPANS)]
        + [T.StructField(items, T.ArrayType(T.StringType()))]
    )
    out = docs
    for k, part in enumerate(blocks(benchmark, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        if k:
            out = written(out, "contamination")

        def run(batches, first=not k, shared=shared):
            table = windows_of(shared, window)
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                found = [x for c in chunks(texts, lambda t: len(t or b""), SCAN_BYTES) for x in table.scan(c)]
                if not first:
                    before = zip(batch.column(spans).to_pylist(), batch.column(items).to_pylist(), strict=True)
                    found = [
                        (n, merged(r + [(s["start"], s["end"]) for s in old]), i | set(held))
                        for (n, r, i), (old, held) in zip(found, before, strict=True)
                    ]
                base = [batch.column(c) for c in own]
                more = [
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r] for _, r, _ in found],
                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(base + more, names=[*own, n_words, spans, items])

        out = out.mapInArrow(run, schema)
    return out


def hit_words(spans: str = "hit_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The contract's row of every document."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **options).drop("text")
    n_hit = hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that the rule does not call contaminated, as they were."""
    own = docs.columns
    n_words, spans = fresh("n_words", own), fresh("hit_spans", own)
    found = find_contamination(docs, benchmark, **options)
    return found.where(~contaminated(hit_words(spans), F.col(n_words))).select(*own)


def remove_hit_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every document with its hit words cut out of the text (from the first to the last byte of each hit range)."""
    own = docs.columns
    spans = fresh("hit_spans", own)
    found = find_contamination(docs, benchmark, **options)

    def run(batches):
        import re

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for k, ranges in enumerate(batch.column(spans).to_pylist()):
                if ranges:
                    at = [m.span() for m in re.finditer(rb"[^ ]+", texts[k].translate(WORD_BYTES))]
                    for r in reversed(ranges):
                        texts[k] = texts[k][: at[r["start"]][0]] + texts[k][at[r["end"] - 1][1] :]
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in own], names=own)

    return found.mapInArrow(run, docs.schema)


#: The same rows by joins of whole window strings.
ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b1 AS (SELECT item, w, least(13, len(w)) AS l FROM bw WHERE len(w) > 0),
b2 AS (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM b1),
bwin AS (SELECT DISTINCT item, l, array_to_string(w[p:p + l - 1], ' ') AS win FROM b2),
ls AS (SELECT DISTINCT l FROM b1),
d1 AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM dw, ls WHERE len(w) >= l),
dwin AS (SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS win FROM d1),
m AS (SELECT d.doc_id, d.l, d.p, b.item FROM dwin d JOIN bwin b ON d.l = b.l AND d.win = b.win),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS x FROM (SELECT DISTINCT doc_id, l, p FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
