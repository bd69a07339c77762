"""Many patterns in many texts: an automaton over a table of patterns, one pass over each text.

Patterns are dealt to blocks by a hash; a block's size is summed before it is collected, so at most about BLOCK bytes of patterns
go through the driver at once and are broadcast. A worker builds the block's Aho-Corasick automaton once and runs every text
through it; only pairs of a text and a pattern that do match become rows. Several blocks read the texts several times.

Defined results: null and empty patterns and texts match nothing; matches are exact, by code points, and may overlap; a
pattern that is there twice counts once; repeated rows of texts give repeated rows; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, ENTRY = 16 << 20, 64
#: What a worker built last: of one block alone.
_BUILT: dict[int, object] = {}


def blocks(patterns: DataFrame, pattern: str, most: int = BLOCK) -> Iterator[list[str]]:
    """The distinct patterns, in lists of about `most` bytes, ENTRY for each pattern's place in an automaton included."""
    own = patterns.select(F.col(pattern).alias("p")).where("p <> ''").distinct()
    total = own.agg(F.sum(F.octet_length("p") + ENTRY)).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        yield [r.p for r in own.where(F.pmod(F.xxhash64("p"), F.lit(n)) == k).toLocalIterator()]


def automaton(words):
    import ahocorasick

    built = ahocorasick.Automaton()
    for word in words:
        built.add_word(word, word)
    built.make_automaton()
    return built


def built_once(shared, make: Callable):
    """What `make` makes of a broadcast block; kept until the worker sees another block."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = make(shared.value)
    return _BUILT[shared.id]


class Block:
    """A broadcast block with an id that workers know it by."""

    def __init__(self, spark, patterns: list[str]):
        self.shared = spark.sparkContext.broadcast(patterns)
        self.id = uuid.uuid4().int

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}

    @property
    def value(self):
        return self.shared.value


def matches(texts: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = "pattern", most: int = BLOCK) -> DataFrame:
    """key, pattern, n (occurrences) and first (the first one's place, from 0) of every pattern that a text has."""
    own = texts.select(key, F.col(text).alias("text"))
    kind = dict(own.dtypes)[key]

    def scan(block: Block):
        def run(batches: Iterator[pa.RecordBatch]):
            machine = built_once(block, automaton)
            for batch in batches:
                rows, found, counts, firsts = [], [], [], []
                for k, t in enumerate(batch.column("text").to_pylist()):
                    hits: dict[str, list[int]] = defaultdict(list)
                    for end, word in machine.iter(t or ""):
                        hits[word].append(end - len(word) + 1)
                    for word, places in hits.items():
                        rows.append(k)
                        found.append(word)
                        counts.append(len(places))
                        firsts.append(places[0])
                at = pa.array(rows, pa.int32())
                cells = [batch.column(key).take(at), pa.array(found, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())]
                yield pa.RecordBatch.from_arrays(cells, names=[key, "pattern", "n", "first"])

        return own.mapInArrow(run, f"`{key}` {kind}, pattern string, n long, first long")

    parts = [scan(Block(texts.sparkSession, block)) for block in blocks(patterns, pattern, most)]
    if not parts:
        return own.select(key, F.lit("").alias("pattern"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("first")).limit(0)
    return reduce(DataFrame.union, parts)


def _name_index(names: list[str]):
    """What finds names in an item: an automaton of names, one of their words, each name's words, and names by their rarest word."""
    words = {n: frozenset(n.lower().split()) for n in names}
    often: dict[str, int] = defaultdict(int)
    for own in words.values():
        for w in own:
            often[w] += 1
    by_rarest: dict[str, list[str]] = defaultdict(list)
    for n, own in words.items():
        if own:
            by_rarest[min(own, key=lambda w: (often[w], w))].append(n)
    return automaton(names), automaton(often) if often else None, words, by_rarest


def known_names(names: DataFrame, items: DataFrame, name: str = "name", item: str = "item", most: int = BLOCK) -> DataFrame:
    """name: those names that an item holds, that hold an item, or all of whose words (in lower case) an item holds."""
    own = items.select(F.col(item).alias("item")).where("item is not null").distinct()
    wanted = names.select(F.col(name).alias("name")).where("name <> ''").distinct()

    def scan(block: Block):
        def run(batches: Iterator[pa.RecordBatch]):
            machine, of_words, words, by_rarest = built_once(block, _name_index)
            left = set(words)
            for batch in batches:
                found = set()
                for text in batch.column("item").to_pylist():
                    found.update(n for _, n in machine.iter(text) if n in left)
                    held = {w for _, w in of_words.iter(text.lower())} if of_words else ()
                    for w in held:
                        found.update(n for n in by_rarest.get(w, ()) if n in left and words[n] <= held)
                found.update(n for n in left if not words[n] and batch.num_rows)  # white space alone: no word is missing
                left -= found
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["name"])

        return own.mapInArrow(run, "name string")

    inside = matches(wanted, own, "name", "name", "item", most).select("name")
    every = wanted.where(F.lit(not own.where("item = ''").isEmpty()))  # an empty item is in every name
    parts = [scan(Block(names.sparkSession, block)) for block in blocks(wanted, "name", most)]
    return reduce(DataFrame.union, [inside, every, *parts]).distinct()


def unknown_names(names: DataFrame, items: DataFrame, name: str = "name", item: str = "item", most: int = BLOCK) -> DataFrame:
    """The rows of `names` that no item matches; null and empty names are left out."""
    return names.where(F.col(name) != "").join(known_names(names, items, name, item, most).withColumnRenamed("name", name), name, "left_anti")
