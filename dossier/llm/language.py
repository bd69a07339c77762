"""Language identification by prediction by partial matching over bytes.

For each language, byte contexts of 0 to ORDER bytes hold the counts of the byte that follows, learned once from a sample
(at most SAMPLE_DOCS whole documents of each of the LANGUAGES most frequent ones: the smallest hashes of doc_id among
labelled training rows, up to the one that makes SAMPLE_BYTES full) and then frozen. A byte's exact code length is that of its longest context in which it was seen, plus an escape (method C:
distinct / (total + distinct)) for each longer known context, down to 8 bits for a byte never seen. A text gets the
language of least total code length; the score is that language's posterior under equal priors.

Lengths of all (ORDER + 1)-byte strings seen in any language are worked out once and looked up by hash; others go down
the contexts one by one, to the same result.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the first language in order;
null languages are no training rows; with no training rows all is `und`; repeated rows are predicted one by one; further
columns stay in `predict`'s input and are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks

ORDER, SAMPLE_DOCS, FOLDS = 4, 400, 5
#: Bounds of what is learned from: languages, and bytes of a language's texts.
LANGUAGES, SAMPLE_BYTES = 512, 8 << 20
#: Values of the sampling hash: far more than any table's rows, so that a share of them is met at every size.
HASHES = 1 << 40
CHUNK_BYTES = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def codes(texts: list[bytes], order: int) -> np.ndarray:
    """For every byte, it and the `order` bytes before it as one number; texts begin after line ends."""
    data = np.frombuffer(b"".join(b"\n" * ORDER + t for t in texts), np.uint8)
    keep = np.ones(len(data), bool)
    at = 0
    for t in texts:
        keep[at : at + ORDER] = False
        at += ORDER + len(t)
    places = np.flatnonzero(keep)
    out = np.zeros(len(places), np.uint64)
    for back in range(order, -1, -1):
        out = (out << np.uint64(8)) | data[places - back]
    return out


class Model:
    """Frozen statistics of some languages: for each order, byte strings with their counts in each language."""

    def __init__(self, languages: list[str], grams: dict[int, tuple[np.ndarray, np.ndarray]]):
        """grams[k]: sorted strings of k + 1 bytes, and an array (strings, languages) of counts."""
        self.languages = languages
        self.levels = []
        for k in range(ORDER + 1):
            strings, counts = grams[k]
            contexts, at = np.unique(strings >> np.uint64(8), return_inverse=True)
            total = np.zeros((len(contexts), len(languages)))
            distinct = np.zeros_like(total)
            np.add.at(total, at, counts)
            np.add.at(distinct, at, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                length = -np.log2(counts / (total + distinct)[at])  # inf where not seen
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
            self.levels.append((strings, length, contexts, escape))
        self.strings = self.levels[ORDER][0]
        self.lengths = self.walk(self.strings).astype(np.float32)
        self.slots, self.probes = self._hashed()

    def walk(self, strings: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of (ORDER + 1)-byte strings, (strings, languages), from context to context."""
        out = np.zeros((len(strings), len(self.languages)))
        open_ = np.ones_like(out, bool)
        for k in range(ORDER, -1, -1):
            known, length, contexts, escape = self.levels[k]
            own = strings & np.uint64((1 << (8 * (k + 1))) - 1)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            found = np.where((known[at] == own)[:, None], length[at], np.inf)
            to = np.minimum(np.searchsorted(contexts, own >> np.uint64(8)), len(contexts) - 1)
            skip = np.where((contexts[to] == own >> np.uint64(8))[:, None], escape[to], 0)
            seen = open_ & np.isfinite(found)
            out[seen] += found[seen]
            open_ &= ~seen
            out[open_] += skip[open_]
        out[open_] += 8
        return out

    def _hash(self, strings: np.ndarray) -> np.ndarray:
        return ((strings * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hashed(self):
        self.bits = max(4, int(4 * len(self.strings) + 1).bit_length())
        slots = np.full(1 << self.bits, -1, np.int32)
        left, probe = np.arange(len(self.strings), dtype=np.int32), 0
        while len(left):
            at = (self._hash(self.strings[left]) + probe) & ((1 << self.bits) - 1)
            free = slots[at] < 0
            slots[at[free]] = left[free]
            left, probe = left[slots[at] != left], probe + 1
        return slots, probe

    def bits_of(self, texts: list[bytes]) -> np.ndarray:
        """Total code lengths, (texts, languages); texts aren't empty."""
        own = codes(texts, ORDER)
        row = np.full(len(own), -1, np.int32)
        left, start = np.arange(len(own)), self._hash(own)
        for probe in range(self.probes):
            at = self.slots[(start[left] + probe) & ((1 << self.bits) - 1)]
            hit = (at >= 0) & (self.strings[at] == own[left])
            row[left[hit]] = at[hit]
            left = left[~hit & (at >= 0)]
            if not len(left):
                break
        lengths = self.lengths[row]
        unknown = np.flatnonzero(row < 0)
        if len(unknown):
            distinct, back = np.unique(own[unknown], return_inverse=True)
            lengths[unknown] = self.walk(distinct).astype(np.float32)[back]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
        return np.add.reduceat(lengths, starts, axis=0, dtype=np.float64)

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        rows = [k for k, t in enumerate(texts) if t and self.languages and LETTER.search(t.decode("utf-8", "replace"))]
        for part in chunks(rows, lambda k: len(texts[k]), CHUNK_BYTES):
            bits = self.bits_of([texts[k] for k in part])
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            for k, b, p in zip(part, best, share, strict=True):
                out[k] = (self.languages[b], float(p))
        return out


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, text of at most per_language rows of each language; rows that can't be among them are left before the sort."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))
    named = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text", order.alias("order"))
    most = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return named.select("lang", "text")
    share = F.create_map(
        *(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_language / n + 40 / n)))
    )
    few = named.where((F.pmod("order", F.lit(HASHES)) / float(HASHES)) < F.try_element_at(share, "lang"))
    placed = Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(HASHES)), "order", "doc_id", "text")
    first = few.withColumn("place", F.row_number().over(placed)).where(F.col("place") <= per_language)
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < SAMPLE_BYTES).select("lang", "text")


def train(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    """A model from labelled rows. What is fetched is counts of strings of the bounded sample."""

    def count(batches):
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            for lang in set(langs):
                own = [t for k, t in zip(langs, texts, strict=True) if k == lang and t]
                for k in range(ORDER + 1) if own else ():
                    strings, n = np.unique(codes(own, k), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n)), pa.array([k] * len(n), pa.int32()),
                         pa.array(strings.astype(np.int64)), pa.array(n)], names=["lang", "k", "string", "n"],
                    )

    rows = sample(docs, per_language).mapInArrow(count, "lang string, k int, string long, n long")
    table = rows.groupBy("lang", "k", "string").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").unique().to_pylist()))
    lang = np.array([languages.index(x) for x in table.column("lang").dictionary_encode().combine_chunks().dictionary.to_pylist()], int) if languages else np.empty(0, int)
    lang = lang[table.column("lang").dictionary_encode().combine_chunks().indices.to_numpy()] if languages else lang
    k, string, n = (table.column(c).to_numpy() for c in ("k", "string", "n"))
    grams = {}
    for order in range(ORDER + 1):
        mine = k == order
        strings, at = np.unique(string[mine].astype(np.uint64), return_inverse=True)
        counts = np.zeros((len(strings), len(languages)))
        counts[at, lang[mine]] = n[mine]
        grams[order] = (strings, counts)
    return Model(languages, grams)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score; nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = shared.value.predict(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([x for x, _ in found], pa.string()),
                 pa.array([p for _, p in found], pa.float64())], names=[*keep, "lang_pred", "score"],
            )

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows held out teach nothing."""
    model = train(docs.where(~held_out()), per_language)
    found = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that have a language; where no row teaches one, all that have a letter. A null lang becomes the
    language found, if lang is a string; all else is as it was."""
    model = train(docs.where(~held_out()), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("lang") if dict(docs.dtypes).get("lang") == "string" else -1

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            if shared.value.languages:
                found = [x for x, _ in shared.value.predict(texts)]
                keep = [x != "und" for x in found]
                if at >= 0 and batch.column(at).null_count:
                    lang = pc.coalesce(batch.column(at), pa.array(found, batch.schema.field(at).type))
                    batch = batch.set_column(at, batch.schema.field(at), lang)
            else:
                keep = [bool(t and LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
