r"""Language-model scores from an Elias-Fano trie of words, pairs and triples, kept as files per range of contexts.

Every word of the training documents, and every pair and triple that occurs LEAST times there, is in the model, at any
corpus size. Words are known by 64-bit hashes, contexts by 56 bits (of a pair: of a hash of its words'), successors by 40
bits. Each level is dealt by ranges of its contexts' hashes, meant for about RANGE_BYTES of text each; a context of more
than SPLIT occurrences (bounded by those of its rarest word) is dealt by its successors too, in parts. A range is one file
in the shared folder: contexts as a monotone Elias-Fano sequence, monotone Elias-Fano pointers to each context's successors,
which are sorted, 8-bit codes of what each context leaves and of each successor's discounted probability. A look-up finds
the context, follows its pointers, and searches the successor between them alone.

Map tasks count the n-grams of some FLUSH tokens and send them as one array a range; the task of a range adds them up and
writes its file. To score, a worker looks up the distinct n-grams of some FLUSH tokens in one file after the other, each
mapped only meanwhile, so no process holds the model; it visits every file for them, so look-ups cost some time a file.

Smoothing is interpolated absolute discounting down to the add-one unigram of the base score, so that

    p(w|uv) = max(c(uvw) - D, 0) / c(uv) + g(uv) p(w|v),  p(w|v) = max(c(vw) - D, 0) / c(v) + g(v) p(w)

with g what the kept successors leave.

Defined results: null and empty texts are the end alone; null ids hash as the empty string; with no training rows N and V
are 0; repeated rows are scored one by one; an empty table gives no rows; further columns are ignored; a model file that is
lost after training stops the scoring with its path (it is never taken for a range without n-grams), as does a shared folder
that isn't mounted.
"""

from __future__ import annotations

import math
import mmap
import os
import pickle
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, shared_dir
from .elias_fano import EliasFano
from .near_dedup import mixed

#: Occurrences from which pairs and triples are kept, alike at every size.
LEAST, DISCOUNT = 2, 0.75
FOLDS, HELD = 7, 2
#: The token after the last word; no word holds a line end. What stands before the first word.
END, BEGIN = b"\n", np.uint64(0x5DEECE66D1234567)
#: Tokens whose n-grams are counted or looked up at once, about.
FLUSH = 1 << 19
#: Bytes of text for whose n-grams a file is meant, and occurrences of a context that one part of it is meant for.
RANGE_BYTES, SPLIT = 1 << 23, 1 << 20
#: Bits of a word's hash by which it is known as a successor.
SUCCESSOR = 40
#: Bits of a context's hash that are left out.
DROPPED = np.uint64(8)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) + second)


class Tokens:
    """The tokens of some texts: distinct hashes (sorted), each token's place among them, and each text's number of tokens."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        hashes, codes, sizes = zip(*parts, strict=True)
        self.distinct, back = np.unique(np.concatenate([*hashes, [BEGIN]]), return_inverse=True)
        self.begin = back[-1]
        shift = np.cumsum([0, *map(len, hashes[:-1])])
        self.codes = back[np.concatenate([c + s for c, s in zip(codes, shift, strict=True)])]
        self.sizes = np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.begins = np.zeros(len(self.codes), bool)
        self.begins[self.starts] = True

    @staticmethod
    def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of distinct tokens of some texts, each token's place among them, and each text's number of them."""
        hashes, places, sizes = hashed_words(texts)
        hashes = np.append(hashes, np.uint64(word_hash(END)))
        sizes = sizes + 1
        codes = np.full(int(sizes.sum()), len(hashes) - 1, np.int64)
        words_at = np.ones(len(codes), bool)
        words_at[np.cumsum(sizes) - 1] = False
        codes[words_at] = places
        return hashes, codes, sizes

    def counts(self, model: Model) -> np.ndarray:
        """Of each distinct token; of what stands before the first, the number of texts."""
        (c,) = model.words.get(self.distinct, "n")
        c[self.begin] = model.n_docs
        return c

    def before(self) -> np.ndarray:
        return np.where(self.begins, self.begin, np.concatenate([[0], self.codes[:-1]]))

    def pairs(self, c: np.ndarray):
        """(tokens that have a context, their Grams or None); c are the counts of distinct tokens."""
        before = self.before()
        bound = c[before]
        at = np.flatnonzero(bound >= LEAST)
        return at, Grams(self.distinct, before[at], self.distinct[self.codes[at]], bound[at]) if len(at) else None

    def triples(self, c: np.ndarray, some: np.ndarray | None = None):
        """As `pairs`; `some` leaves out tokens whose context can't be in the model."""
        before, own = self.before(), self.distinct[self.codes]
        bound = np.where(self.begins, 0, np.minimum(np.concatenate([[0], c[before[:-1]]]), c[before]))
        at = np.flatnonzero(bound >= LEAST if some is None else (bound >= LEAST) & some)
        keys = pair_key(self.distinct[before[at - 1]], own[at - 1])
        return at, Grams(keys, None, own[at], bound[at]) if len(at) else None


def flushes(batches, *columns: str):
    """(rows of `columns`, Tokens) of some FLUSH tokens each."""
    held, kept, size = [], [[] for _ in columns], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(Tokens.of(batch.column("text")))
        for own, name in zip(kept, columns, strict=True):
            own += batch.column(name).to_pylist()
        size += len(held[-1][1])
        if size > FLUSH:
            yield kept, Tokens(held)
            held, kept, size = [], [[] for _ in columns], 0
    if held:
        yield kept, Tokens(held)
    pa.default_memory_pool().release_unused()  # the worker lives on


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and one row that has each."""
    order = np.argsort(keys)
    placed = keys[order]
    new = np.diff(placed, prepend=placed[:1] + np.uint64(1)) != 0
    own = np.empty(len(keys), np.int64)
    own[order] = np.cumsum(new) - 1
    return placed[new], own, order[new]


class Grams:
    """Distinct (context, successor) rows in order of both; contexts of several parts have a key of their own for each part.

    Contexts are given as they are, or as places in a sorted table."""

    def __init__(self, context: np.ndarray, places: np.ndarray | None, successor: np.ndarray, bound: np.ndarray):
        parts = -(-bound // SPLIT)
        s = np.flatnonzero(parts > 1)
        if places is not None and not len(s):  # the table's order is that of the keys
            used = np.zeros(len(context), bool)
            used[places] = True
            self.keys, own = context[used], (np.cumsum(used) - 1)[places]
            self.real, self.split = self.keys, np.zeros(len(self.keys), bool)
        else:
            context = context if places is None else context[places]
            key = context
            if len(s):
                key = context.copy()
                key[s] = pair_key(context[s], mixed(successor[s]) % parts[s].astype(np.uint64))
            self.keys, own, first = ranked(key)
            self.real, self.split = context[first], parts[first] > 1
        self.keys = self.keys >> DROPPED << DROPPED
        low = 64 - max(1, len(self.keys).bit_length())
        small = successor >> np.uint64(64 - SUCCESSOR)
        packed = own.astype(np.uint64) << np.uint64(low) | small >> np.uint64(max(0, SUCCESSOR - low))
        _, self.back, self.first = ranked(packed)
        self.own, self.small = own[self.first], small[self.first]

    def runs(self) -> np.ndarray:
        return np.bincount(self.own, minlength=len(self.keys))


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of integers, all first bytes first, so that those much alike stand together; compressed."""
    data = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def joined(table: pa.Table, name: str, width: int) -> np.ndarray:
    """The integers of all rows' planes."""
    parts = []
    for data in table.column(name).to_pylist():
        size = int.from_bytes(data[:4], "little")
        out = np.zeros((size // width, 8), np.uint8)
        if size:
            out[:, :width] = np.frombuffer(pa.decompress(data[4:], size, "zstd", asbytes=True), np.uint8).reshape(width, -1).T
        parts.append(out.reshape(-1).view("<u8"))
    return np.concatenate(parts)


def quantised(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their values: means of 256 runs of equal size of the sorted logarithms."""
    if not len(logs):
        return np.zeros(0, np.uint8), np.zeros(256)
    order = np.argsort(logs, kind="stable")
    codes = np.empty(len(logs), np.uint8)
    codes[order] = (np.arange(len(logs)) * 256 // len(logs)).astype(np.uint8)
    sums = np.bincount(codes, logs, 256)
    return codes, sums / np.maximum(np.bincount(codes, minlength=256), 1)


class Level:
    """Files of one level; the top `bits` bits of a key name its file."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.there: bytes | None = None

    def seal(self):
        """Training is over: from now on, a file that is there now must be there. One bit a range."""
        there = np.zeros(1 << self.bits, bool)
        there[[int(name) for name in os.listdir(self.folder) if name.isdigit()]] = True
        self.there = np.packbits(there).tobytes()

    def has(self, shard: int) -> bool:
        """Whether some key of the model lies in this range."""
        if self.there is None:
            return os.path.exists(self.path(shard))
        return bool(self.there[shard >> 3] >> (7 - (shard & 7)) & 1)

    def path(self, shard: int) -> str:
        return f"{self.folder}/{shard:08d}"

    def shards(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(file, first, last) runs of sorted keys."""
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        edges = np.flatnonzero(np.diff(shard, prepend=-1))
        return list(zip(shard[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True))

    def within(self, keys: np.ndarray) -> np.ndarray:
        """What tells keys of one file apart, below 2**62."""
        return (keys << np.uint64(self.bits)) >> np.uint64(max(self.bits, 2))

    def put(self, shard: int, keys: np.ndarray, values: dict[str, np.ndarray], pointers: np.ndarray | None = None):
        """Write a file of sorted keys; a task that runs again replaces it by an equal one."""
        sequences, arrays = {"key": EliasFano.of(self.within(keys))}, dict(values)
        if pointers is not None:
            sequences["pointer"] = EliasFano.of(pointers)
        for name, coded in sequences.items():
            arrays |= {f"{name}.{f}": getattr(coded, f) for f in EliasFano.FIELDS}
        entries, data, at = [], [], 0
        for name, x in arrays.items():
            raw = np.ascontiguousarray(x).tobytes()
            entries.append((name, x.dtype.str, at, len(x)))
            raw += bytes(-len(raw) % 8)
            data.append(raw)
            at += len(raw)
        head = pickle.dumps(({k: (s.n, s.width) for k, s in sequences.items()}, entries))
        head = len(head).to_bytes(8, "little") + head
        temporary = f"{self.path(shard)}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            f.write(head + bytes(-len(head) % 8) + b"".join(data))
        os.replace(temporary, self.path(shard))

    def visit(self, keys: np.ndarray, look):
        """Call look(first, last, arrays, sequences) for each file that some of the sorted keys lie in, mapped meanwhile."""
        for shard, a, b in self.shards(keys):
            if not self.has(shard):
                continue
            with open(self.path(shard), "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as view:
                size = int.from_bytes(view[:8], "little")
                sequences, entries = pickle.loads(view[8 : 8 + size])
                start = -(-(8 + size) // 8) * 8
                arrays = {name: np.frombuffer(view, np.dtype(kind), length, start + at) for name, kind, at, length in entries}
                coded = {k: EliasFano(*of, *(arrays[f"{k}.{x}"] for x in EliasFano.FIELDS)) for k, of in sequences.items()}
                look(a, b, arrays, coded)
                del arrays, coded

    def get(self, keys: np.ndarray, *names: str) -> list[np.ndarray]:
        """The values of each of some sorted keys under each name; 0 for keys that aren't there."""
        out = [np.zeros(len(keys)) for _ in names]

        def look(a, b, arrays, coded):
            found = coded["key"].find(self.within(keys[a:b]).astype(np.int64))
            there = np.flatnonzero(found >= 0)
            for to, name in zip(out, names, strict=True):
                to[a + there] = arrays[name][found[there]]

        self.visit(keys, look)
        return out

    def successors(self, grams: Grams, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Discounted probabilities of the rows (0 where not kept; only likely ones are looked up); of the contexts, counts and
        what their successors leave."""
        share, count, left = np.zeros(len(grams.own)), np.zeros(len(grams.keys)), np.ones(len(grams.keys))
        ends = np.concatenate([[0], np.cumsum(grams.runs())])

        def look(a, b, arrays, coded):
            found = coded["key"].find(self.within(grams.keys[a:b]).astype(np.int64))
            there = np.flatnonzero(found >= 0)
            found = found[there]
            left[a + there] = np.power(10.0, arrays["lefts"])[arrays["left"][found]]
            if len(arrays["count"]):
                count[a + there] = arrays["count"][found]
            of = np.full(b - a, -1)
            of[there] = np.arange(len(there))
            at, end = np.split(coded["pointer"].access(np.concatenate([found, found + 1])), 2)
            rows = slice(ends[a], ends[b])
            own = np.where(likely[rows], of[grams.own[rows] - a], -1)
            rows, own = ends[a] + np.flatnonzero(own >= 0), own[own >= 0]
            place = between(arrays["high"], arrays["low"], at[own], end[own], grams.small[rows])
            hit = place >= 0
            share[rows[hit]] = np.power(10.0, arrays["table"])[arrays["code"][place[hit]]]

        self.visit(grams.keys, look)
        return share, count, left


def between(high: np.ndarray, low: np.ndarray, at: np.ndarray, end: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The index of each target between its own pair of pointers, or -1, by binary search of them all."""
    out = np.full(len(target), -1, np.int64)
    left = np.arange(len(target))
    while len(left):
        middle = (at + end) >> 1
        own = high[middle].astype(np.uint64) << np.uint64(8) | low[middle]
        same, below = own == target, own < target
        out[left[same]] = middle[same]
        at, end = np.where(below, middle + 1, at), np.where(below, end, middle)
        go = ~same & (at < end)
        left, at, end, target = left[go], at[go], end[go], target[go]
    return out


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


class Model:
    """Levels in the shared folder; every level is there once `train` is done."""

    def __init__(self, folder: str, bits: int):
        for name in ("words", "pairs", "triples", "split_pairs", "split_triples"):
            os.makedirs(f"{folder}/{name}")
            setattr(self, name, Level(f"{folder}/{name}", bits))
        self.total = self.n_docs = 0
        self.norm = 1

    def step(self, level: Level, split: Level, grams: Grams, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all tokens that have a context: what the kept n-grams give, and what they leave to the shorter context. Tokens
        that aren't likely have no kept n-gram."""
        share, count, left = level.successors(grams, likely[grams.first])
        s = np.flatnonzero(grams.split)
        if len(s):  # a part knows its own count; the context's are kept apart
            real, back = np.unique(grams.real[s], return_inverse=True)
            whole, taken = (x[back] for x in split.get(real, "count", "taken"))
            scale = np.ones(len(grams.keys))
            scale[s] = count[s] / np.maximum(whole, 1)
            share *= scale[grams.own]
            left[s] = np.where(whole > 0, np.maximum(1 - taken / np.maximum(whole, 1), 1e-9), 1)
        return share[grams.back], left[grams.own][grams.back]

    def logs(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, its count and the logarithm of its smoothed probability."""
        c = tokens.counts(self)
        own = c[tokens.codes]
        p, pair = (own + 1) / self.norm, np.zeros(len(own), bool)
        at, grams = tokens.pairs(c)
        if len(at):
            share, left = self.step(self.pairs, self.split_pairs, grams, own[at] >= LEAST)
            p[at], pair[at] = share + left * p[at], share > 0
        # A triple is kept only if both of its pairs are.
        at, grams = tokens.triples(c, np.concatenate([[False], pair[:-1]]))
        if len(at):
            share, left = self.step(self.triples, self.split_triples, grams, pair[at])
            p[at] = share + left * p[at]
        return own, np.log10(p)


def sent(level: Level, keys: np.ndarray, columns) -> pa.RecordBatch:
    """One row for each file: columns(first, last) gives what is sent of its part of the sorted keys; arrays go as bytes."""
    rows = [(shard, *columns(a, b)) for shard, a, b in level.shards(keys)]
    whole = [x for x in rows[0] if isinstance(x, int)]
    names = [*["shard", "level"][: len(whole)], *(f"x{k}" for k in range(len(rows[0]) - len(whole)))]
    kinds = [*[pa.int32()] * len(whole), *[pa.binary()] * (len(names) - len(whole))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def count_words(train: DataFrame, model: Model):
    level = model.words

    def count(batches):
        for _, tokens in flushes(batches):
            n = np.bincount(tokens.codes, minlength=len(tokens.distinct))
            keys, n = tokens.distinct[n > 0], n[n > 0]
            yield sent(level, keys, lambda a, b: (planes(keys[a:b], 8), planes(n[a:b], 4)))  # noqa: B023

    def add(table: pa.Table) -> pa.Table:
        keys, back = np.unique(joined(table, "x0", 8), return_inverse=True)
        n = np.bincount(back, joined(table, "x1", 4)).astype(np.int64)
        level.put(table.column("shard")[0].as_py(), keys, {"n": n.astype(np.min_scalar_type(n.max()))})
        return pa.table({"distinct": [len(keys)], "total": [int(n.sum())]})

    rows = train.select("text").mapInArrow(count, "shard int, x0 binary, x1 binary")
    rows = rows.repartition(1 << level.bits, "shard").groupBy("shard").applyInArrow(add, "distinct long, total long")
    found = rows.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    model.total = found["n"] or 0
    model.norm = model.total + (found["v"] or 0) + 1
    model.n_docs = int(model.words.get(np.array([word_hash(END)], np.uint64), "n")[0][0])


def count_grams(train: DataFrame, model: Model):
    """Pairs and triples. Rows sent: contexts, their counts, numbers of successors, those, their counts, split contexts."""
    levels, splits = (model.pairs, model.triples), (model.split_pairs, model.split_triples)

    def count(batches):
        for _, tokens in flushes(batches):
            c = tokens.counts(model)
            for order, (at, grams) in enumerate((tokens.pairs(c), tokens.triples(c))):
                if len(at):
                    yield counted(order, grams, c[tokens.codes[at]])

    def counted(order: int, grams: Grams, c: np.ndarray) -> pa.RecordBatch:
        n = np.bincount(grams.back, minlength=len(grams.own))
        totals = np.bincount(grams.own, n, len(grams.keys)).astype(np.int64)
        often = c[grams.first] >= LEAST  # others can't be kept, and count for their context alone
        own, small, n = grams.own[often], grams.small[often], n[often]
        runs = np.bincount(own, minlength=len(grams.keys))
        ends = np.concatenate([[0], np.cumsum(runs)])
        real = np.where(grams.split, grams.real, 0).astype("<u8")

        def columns(a, b):
            s = slice(ends[a], ends[b])
            return (order, planes(grams.keys[a:b] >> DROPPED, 7), planes(totals[a:b], 4), planes(runs[a:b], 4), planes(small[s], SUCCESSOR // 8),
                    planes(n[s], 4), real[a:b].tobytes() if grams.split[a:b].any() else b"")

        return sent(levels[order], grams.keys, columns)

    def add(table: pa.Table) -> pa.Table:
        level = table.column("level")[0].as_py()
        keys, back = np.unique(joined(table, "x0", 7) << DROPPED, return_inverse=True)
        count = np.bincount(back, joined(table, "x1", 4)).astype(np.int64)
        low = 64 - max(1, len(keys).bit_length())
        own = np.repeat(back, joined(table, "x2", 4).astype(np.int64))
        small = joined(table, "x3", SUCCESSOR // 8)
        packed = own.astype(np.uint64) << np.uint64(low) | small >> np.uint64(max(0, SUCCESSOR - low))
        order = np.argsort(packed)
        first = np.flatnonzero(np.diff(packed[order], prepend=packed[order][:1] + np.uint64(1)))
        n = np.add.reduceat(joined(table, "x4", 4)[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        kept = n >= LEAST
        own, small, n = own[order[first[kept]]], small[order[first[kept]]], n[kept] - DISCOUNT
        taken = np.bincount(own, n, len(keys)).astype(float)
        some = np.flatnonzero(taken)  # contexts that have kept successors
        pointers = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(keys))[some])])
        real = np.concatenate([np.frombuffer(x or bytes(8 * (int.from_bytes(k[:4], "little") // 7)), "<u8") for x, k in zip(
            table.column("x5").to_pylist(), table.column("x0").to_pylist(), strict=True)])
        of = np.zeros(len(keys), np.uint64)
        of[back] = real
        s = np.flatnonzero(of)
        code, values = quantised(np.log10(n / count[own]))
        left, lefts = quantised(np.log10(np.maximum(1 - taken[some] / count[some], 1e-9)))
        if len(some):
            counts = count[some] if len(s) else count[:0]  # of parts alone
            levels[level].put(table.column("shard")[0].as_py(), keys[some], {
                "count": counts.astype("<u4"), "left": left, "lefts": lefts, "code": code, "table": values,
                "high": (small >> np.uint64(8)).astype(np.uint32), "low": small.astype(np.uint8),
            }, pointers)
        return pa.table({"level": np.full(len(s), level, np.int32), "real": of[s].view(np.int64), "count": count[s], "taken": taken[s]})

    def keep(table: pa.Table) -> pa.Table:
        keys = table.column("real").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        values = {k: table.column(k).to_numpy()[order] for k in ("count", "taken")}
        splits[table.column("level")[0].as_py()].put(table.column("shard")[0].as_py(), keys[order], values)
        return pa.table({"n": [len(keys)]})

    schema = "shard int, level int, " + ", ".join(f"x{k} binary" for k in range(6))
    rows = train.select("text").mapInArrow(count, schema)
    rows = rows.repartition(2 << model.pairs.bits, "level", "shard").groupBy("level", "shard")
    rows = rows.applyInArrow(add, "level int, real long, count long, taken double")
    # Contexts of several parts, of which there are few: their whole counts.
    whole = rows.groupBy("level", "real").agg(F.sum("count").alias("count"), F.sum("taken").alias("taken"))
    bits = model.pairs.bits
    shard = F.shiftrightunsigned("real", 64 - bits).cast("int") if bits else F.lit(0)
    whole.withColumn("shard", shard).groupBy("level", "shard").applyInArrow(keep, "n long").agg(F.sum("n")).collect()


def train(docs: DataFrame) -> Model:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size) / RANGE_BYTES)))
    folder = f"{shared_dir(docs.sparkSession)}/lm-{uuid.uuid4().hex}".removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"model files are mapped into memory: spark.checkpoint.dir must be a mounted folder, not {folder}")
    model = Model(folder, bits)
    count_words(docs, model)
    model.words.seal()
    count_grams(docs, model)
    for level in (model.pairs, model.triples, model.split_pairs, model.split_triples):
        level.seal()
    return model


def score(docs: DataFrame) -> DataFrame:
    """The contract's row of every document."""
    model = train(docs.where(~held_out()))

    def run(batches):
        for (ids,), tokens in flushes(batches, "doc_id"):
            n, logs = model.logs(tokens)
            sums = [np.add.reduceat(x, tokens.starts) for x in ((n > 0).astype(np.int64), np.log10((n + 1) / model.norm), logs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(tokens.sizes.astype(np.int64)), *map(pa.array, sums)],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
