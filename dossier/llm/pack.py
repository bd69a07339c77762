r"""Packing by lexical retrieval: sharded BM25 indexes give each seed document its unused neighbours.

Documents become token ids plus an end id. Whole windows of a long document are sequences of their own; what remains of
each document (always shorter than a window) goes to an index shard of about SHARD_TOKENS tokens by content: each id has a
fixed random rank, drawn so that rarer ids (those merged later into the vocabulary) come first more often, and the id of
least rank is a document's key. Two documents share a key with a probability near their weighted overlap, so near copies
and documents of one subject meet in one shard at any corpus size. Keys are laid side by side by their token counts (a row
for each vocabulary entry at most) and cut into shards; a key with more tokens than a shard is spread over several by a
hash of text and place in the table.

In each shard an inverted index over token ids, with document frequencies and mean length of the whole corpus, ranks all
unused documents by all terms of each seed (the longest unused one first); they fill its window in that order, the best
one left is cut where none fits, and the shard's last window is cut into power-of-two sequences. So no sequence is padded.

Defined results: null and empty texts are the end id alone; repeated rows are packed one by one; a null doc_id stays
null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW, END = 4096, 2
#: Ids of a shard, about; the tokenizer's vocabulary, all of whose ids fit 16 bits.
SHARD_TOKENS, VOCABULARY = 1 << 20, 49_408
#: Okapi constants.
K1, B = 1.2, 0.75
#: Distinct words of one generation of a worker's cache; it keeps two.
CACHE_WORDS = 1 << 18
#: Words that are encoded as one text.
JOINED = 512
#: A special token of the vocabulary, put between words that are encoded as one text; what each special token holds.
MARK, SPECIAL = "<|endoftext|>", "<|"
#: ASCII signs that form one pre-token after a word of letters; an apostrophe may belong to a contraction.
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
TAIL = r"\A(?s:.*?)([" + re.escape(SIGNS) + r"]*)\z"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def key_ranks() -> np.ndarray:
    """The rank of each id: exponential draws, of which that of a rare id ends sooner; the end id comes last."""
    draws = np.random.default_rng(41).exponential(size=VOCABULARY) / np.square(np.arange(1, VOCABULARY + 1))
    draws[END] = np.inf
    return np.argsort(np.argsort(draws)).astype(np.uint16)


def normalised(text: str) -> str:
    """As the tokenizer does it, letter by letter: a capital sigma has one lower case, wherever it stands."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


class Words:
    """Ids of words in two generations: those looked up lately, and those before them."""

    def __init__(self):
        self.keys = [pa.array([], pa.string())] * 2
        self.ids = [pa.array([], pa.binary())] * 2

    def get(self, words: pa.Array) -> pa.Array:
        """Ids of each word, null where they aren't known."""
        out = None
        for keys, ids in zip(self.keys, self.ids, strict=True):
            own = ids.take(pc.index_in(words, value_set=keys))
            out = own if out is None else pc.coalesce(out, own)
        return out

    def put(self, words: pa.Array, ids: pa.Array):
        """All words of a batch; the older generation goes when the newer one is full."""
        if len(self.keys[0]) + len(words) > CACHE_WORDS:
            self.keys, self.ids = [words, self.keys[0]], [ids, self.ids[0]]
            return
        new = pc.invert(pc.is_in(words, value_set=self.keys[0]))
        self.keys[0] = pa.concat_arrays([self.keys[0], words.filter(new)])
        self.ids[0] = pa.concat_arrays([self.ids[0], ids.filter(new)])


class Ids:
    """Little-endian 16-bit token ids of a text, with a cache by word.

    The tokenizer lower-cases and drops white space, and no token but a special one crosses it, so ids of a text are those
    of its words in turn. A word of letters alone is one pre-token, whose last token is marked as a word's end; so new
    words of that kind are encoded many at a time and cut apart at those marks. Signs after such a word are one pre-token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.model = Tokenizer.from_file(path)
        self.mark = self.model.token_to_id(MARK)
        self.steps = self.model.normalizer, self.model.pre_tokenizer
        # For words of letters, already normalised: the same without looking for pre-tokens in them.
        self.split = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.last = np.zeros(VOCABULARY, bool)
        self.last[[i for w, i in self.model.get_vocab().items() if w.endswith("</w>")]] = True
        self.cores, self.words = Words(), Words()

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def plain(word: str) -> bool:
        """Whether the word is one pre-token, all letters even when normalised."""
        word = normalised(word)
        return word.isalpha() and max(word) < "\U00010000"

    def letter_ids(self, words: list[str]):
        """Ids of words that are each one pre-token."""
        self.model.normalizer, self.model.pre_tokenizer = None, self.split
        for at in range(0, len(words), JOINED):
            text = normalised(" ".join(words[at : at + JOINED]))
            (ids,) = self.encoded([text])
            ends = (2 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            yield from map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends))
        self.model.normalizer, self.model.pre_tokenizer = self.steps

    def word_ids(self, words: list[str]):
        """Ids of any words; those in which a special token may lie are encoded one by one."""
        for at in range(0, len(words), JOINED):
            own = words[at : at + JOINED]
            (ids,) = self.encoded([MARK.join("" if SPECIAL in w else w for w in own)])
            ends = (2 * np.flatnonzero(ids == self.mark)).tolist()
            data = ids.tobytes()
            cuts = map(slice, [0, *(e + 2 for e in ends)], [*ends, len(data)])
            for w, cut in zip(own, cuts, strict=True):
                yield self.encoded([w])[0].tobytes() if SPECIAL in w else data[cut]

    def of_cores(self, cores: pa.Array) -> pa.Array:
        """Ids of words of letters, null of others."""
        out = self.cores.get(cores)
        left = cores.filter(out.is_null())
        letters, left = pc.ascii_is_alpha(left).to_pylist(), left.to_pylist()
        plain = [a or self.plain(w) for a, w in zip(letters, left, strict=True)]
        found = iter(list(self.letter_ids([w for w, p in zip(left, plain, strict=True) if p])))
        out = pc.replace_with_mask(out, out.is_null(), pa.array((next(found) if p else None for p in plain), pa.binary()))
        known = out.is_valid()
        self.cores.put(cores.filter(known), out.filter(known))
        return out

    def of_words(self, words: pa.Array) -> pa.Array:
        out = self.words.get(words)
        new = self.word_ids(words.filter(out.is_null()).to_pylist())
        out = pc.replace_with_mask(out, out.is_null(), pa.array(new, pa.binary()))
        self.words.put(words, out)
        return out

    def __call__(self, texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        # Lower case joins words; a special token is one in lower case alone, so texts that may hold one stay as they are.
        texts = pc.if_else(pc.match_substring(texts, SPECIAL), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        cores = pc.ascii_rtrim(words, SIGNS)
        tailed = pc.not_equal(pc.binary_length(cores), pc.binary_length(words))
        cores = cores.dictionary_encode()
        ids = self.of_cores(cores.dictionary).take(cores.indices)
        tails = pc.replace_substring_regex(words.filter(tailed), TAIL, r"\1").dictionary_encode()
        ends = pa.array((x.tobytes() for x in self.encoded(tails.dictionary.to_pylist())), pa.binary()).take(tails.indices)
        ids = pc.replace_with_mask(ids, tailed, pc.binary_join_element_wise(ids.filter(tailed), ends, b""))
        if ids.null_count:  # words of other cores
            ids = pc.replace_with_mask(ids, ids.is_null(), self.of_words(words.filter(ids.is_null())))
        joined = pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids.take(coded.indices)), b"")
        return pc.binary_join_element_wise(joined, np.array([END], "<u2").tobytes(), b"")


@lru_cache(1)
def ids_of(path: str) -> Ids:
    """One tokenizer and cache for all tasks of a worker."""
    return Ids(path)


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column, and where each row's begin, with the end of the last."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, "<u2", offsets[-1] // 2) if data is not None else np.zeros(0, "<u2")
    return flat, offsets // 2


def tokenised(docs: DataFrame, path: str | None) -> DataFrame:
    """doc_id, mixed (a hash of ids and place), key (the least rank of its ids) and ids of every row."""

    def run(batches):
        ids, ranks, place = ids_of(path or default_tokenizer()), key_ranks(), count()
        for batch in batches:
            if not len(batch):
                continue
            out = ids(batch.column("text"))
            # A row's place in its task tells repeated rows apart.
            mixed = [xxhash.xxh64_intdigest(x.as_buffer(), seed=next(place)) >> 1 for x in out]
            flat, at = flat_ids(out)
            keys = np.minimum.reduceat(ranks[flat], at[:-1])  # every row has an id
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(mixed, pa.int64()), pa.array(keys.astype(np.int32)), out],
                names=["doc_id", "mixed", "key", "ids"],
            )
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, mixed long, key int, ids binary")


def as_ids(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Shard:
    """An inverted index of some documents' ids, and the greedy filling of windows from it."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int | None = None):
        self.ids, self.query_terms = ids, query_terms
        self.left = np.array([len(x) for x in ids])  # ids not yet placed
        self.start = np.zeros(len(ids), np.int64)  # of those
        kind = np.uint32 if len(ids) <= 1 << 16 else np.uint64  # narrow numbers sort faster
        pairs, tf = np.unique(np.repeat(np.arange(len(ids), dtype=kind), self.left) << kind(16) | np.concatenate(ids), return_counts=True)
        self.docs, self.terms = (pairs >> kind(16)).astype(np.int64), pairs.astype(np.uint16)
        norm = K1 * (1 - B + B * self.left[self.docs] / mean_length)
        self.weight = (idf[self.terms] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        self._index()

    def _index(self):
        """The documents that are left: rows of (term, weight), each document's together."""
        keep = self.left[self.docs] > 0
        self.docs, self.terms, self.weight = self.docs[keep], self.terms[keep], self.weight[keep]
        self.at = np.flatnonzero(np.diff(self.docs, prepend=-1))
        self.indexed = self.docs[self.at]

    def ranked(self, seed: int) -> np.ndarray:
        """The unused documents, best first."""
        row = int(np.searchsorted(self.indexed, seed))
        own = slice(self.at[row], self.at[row + 1] if row + 1 < len(self.at) else len(self.docs))
        terms = self.terms[own]
        if self.query_terms and len(terms) > self.query_terms:
            terms = terms[np.argsort(-self.weight[own], kind="stable")[: self.query_terms]]
        asked = np.zeros(VOCABULARY, np.float32)
        asked[terms] = 1
        score = np.add.reduceat(asked[self.terms] * self.weight, self.at)
        unused = np.flatnonzero(self.left[self.indexed] > 0)
        order = unused[np.argsort(-score[unused], kind="stable")]
        return self.indexed[order[order != row]]

    def take(self, doc: int, n: int) -> tuple[int, int, int]:
        piece = (doc, int(self.start[doc]), n)
        self.start[doc] += n
        self.left[doc] -= n
        return piece

    def sequences(self):
        """Lists of (document, start, length) that fill a window each; those after the last full one fill powers of two."""
        left = len(self.ids)
        while left:
            if 2 * left < len(self.indexed):
                self._index()
            seed = int(np.argmax(self.left))
            neighbours = self.ranked(seed)
            pieces = [self.take(seed, int(self.left[seed]))]
            room, at = WINDOW - pieces[0][2], 0
            while room:  # those that fit, in order
                size = self.left[neighbours[at:]]
                fits = np.flatnonzero(size <= room)
                sums = np.cumsum(size[fits])
                n = int(np.searchsorted(sums, room, "right"))
                if not n:
                    break
                pieces += [self.take(int(d), int(self.left[d])) for d in neighbours[at + fits[:n]]]
                room -= int(sums[n - 1])
                at += int(fits[n - 1]) + 1
            left -= len(pieces)
            if room:
                rest = neighbours[self.left[neighbours] > 0]
                if len(rest):
                    pieces.append(self.take(int(rest[0]), room))
                    room = 0
            yield from [pieces] if not room else powers_of_two(pieces)


def powers_of_two(pieces: list[tuple[int, int, int]]):
    """The same ids in order, as sequences whose lengths are the powers of two that their number is made of."""
    pieces = pieces[::-1]
    total = sum(n for _, _, n in pieces)
    for bit in reversed(range(total.bit_length())):
        room, out = total & (1 << bit), []
        while room:
            doc, start, n = pieces.pop()
            out.append((doc, start, min(n, room)))
            if n > room:
                pieces.append((doc, start + room, n - room))
            room -= out[-1][2]
        if out:
            yield out


OUT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"  # of a piece
)


def shards_of(sizes: np.ndarray, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each key and its number of them: keys of about shard_tokens in all share one, a fuller key has several."""
    first, number, shard, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for key in np.flatnonzero(sizes):
        if held and held + sizes[key] > shard_tokens:
            shard, held = shard + 1, 0
        first[key], number[key] = shard, max(1, round(sizes[key] / shard_tokens))
        held += sizes[key]
        if number[key] > 1:
            shard, held = shard + number[key], 0
    return first, number


def pack(
    docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, query_terms: int | None = None
) -> DataFrame:
    """The pieces of all documents; query_terms makes a seed's query of its heaviest terms alone, not of all."""
    tokens = written(tokenised(docs, tokenizer), "tokens")  # texts are tokenised once

    def measure(batches):
        df, sizes, docs_n = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.int64), 0
        for batch in batches:
            flat, at = flat_ids(batch.column("ids"))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.sort(flat[a:b])
                df[own[np.flatnonzero(np.diff(own, prepend=own[0] ^ 1))]] += 1
            np.add.at(sizes, batch.column("key").to_numpy(), np.diff(at) % WINDOW)
            docs_n += len(batch)
        terms, keys = np.flatnonzero(df), np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], terms, VOCABULARY + keys]).astype(np.int32)),
             pa.array(np.concatenate([[docs_n], df[terms], sizes[keys]]).astype(np.int64))], names=["term", "n"],
        )

    # Two rows for each vocabulary entry at most: documents that hold it, and tokens whose key it is.
    stats = dict(tokens.select("key", "ids").mapInArrow(measure, "term int, n long").groupBy("term").agg(F.sum("n")).collect())
    docs_n, counts = stats.pop(-1, 0), np.zeros(2 * VOCABULARY, np.int64)
    counts[list(stats)] = list(stats.values())
    df, sizes = counts[:VOCABULARY], counts[VOCABULARY:]
    idf = np.log(1 + (docs_n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length, (first, number) = max(1.0, sizes.sum() / max(1, docs_n)), shards_of(sizes, shard_tokens)

    def cut(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            to = (first[keys] + batch.column("mixed").to_numpy() % number[keys]).tolist()
            rows = []
            for shard, doc_id, x in zip(to, batch.column("doc_id").to_pylist(), as_ids(batch), strict=True):
                for at in range(0, len(x), WINDOW):
                    own = x[at : at + WINDOW]
                    whole = len(own) == WINDOW
                    rows.append((shard, doc_id, at, len(own), len(x), crc(own) if whole else None, None if whole else own.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), CUT_TYPES, strict=True)]
                if rows else [pa.array([], k) for k in CUT_TYPES], names=CUT_NAMES,
            )

    def fill(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = sorted(
            zip(*(table.column(c).to_pylist() for c in CUT_NAMES[1:]), strict=True),
            key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]),
        )
        whole, parts = [r for r in rows if r[5] is None], [r for r in rows if r[5] is not None]
        out, number = [], shard << 32
        for doc_id, at, n, total, check, _ in whole:
            out.append((doc_id, at, n, check, total, number, 0))
            number += 1
        if parts:
            ids = [np.frombuffer(r[5], "<u2") for r in parts]
            for pieces in Shard(ids, idf, mean_length, query_terms).sequences():
                offset = 0
                for k, start, n in pieces:
                    doc_id, at, _, total, _, _ = parts[k]
                    out.append((doc_id, at + start, n, crc(ids[k][start : start + n]), total, number, offset))
                    offset += n
                number += 1
        return pa.Table.from_arrays(
            [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in OUT.split(", ")]
        )

    cut_schema = "shard int, doc_id long, at long, n long, total long, crc long, ids binary"
    return tokens.mapInArrow(cut, cut_schema).groupBy("shard").applyInArrow(fill, OUT)


CUT_NAMES = ["shard", "doc_id", "at", "n", "total", "crc", "ids"]
CUT_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
