r"""Secret scan by a linear-chain conditional random field over the tokens of secret-like fields.

Three base patterns give base spans. The field adds spans: a field is a run of `[A-Za-z0-9+/_.=-]` of 20 characters or
more, or of 8 with a digit; its tokens (runs of letters and digits, single signs) are tagged begin, inside or outside from
shape, neighbouring tokens and words, and file features, and decoded by Viterbi. Tags other than outside are possible in
fields alone, and a field begins afresh, so decoding each field decodes the whole text's chain. Decoded spans that touch
no base span are of kind `crf`.

Weights are fitted to two sets: at most EXAMPLES fields of about SAMPLE_DOCS whole documents (the smallest hashes) with the
tags that the base patterns give, each with and without its context; and PLANTED generated fields, half of them secrets of
kinds that the patterns don't know (issuers' prefixes, signed tokens, random values after words like `pwd`), half of them
harmless (versions, dates, paths, identifiers, UUIDs), with and without their context too.

Defined results: null and empty texts have no spans; spans of two base kinds may overlap and all stay; repeated rows are
scanned one by one; an empty table gives no rows, an empty sample a field that knows the generated examples alone; further
columns stay where whole documents are returned. Features see the first 12 characters of words, 6 of shapes and three words
of the 40 characters before a field.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

SAMPLE_DOCS, EPOCHS, RATE, DECAY = 20_000, 8, 0.3, 1e-4
#: Generated fields that are learned from.
PLANTED = 1600
#: Distinct fields of the sample that are learned from, at most (the smallest hashes), and values of the sampling hash.
EXAMPLES, HASHES = 40_000, 1 << 40
KINDS = ["assign", "access", "hex", "crf"]


def any_case(s: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)


#: Fixed patterns of the base kinds: name, pattern, whether a match counts.
ASSIGN = re.compile(
    "(" + "|".join(map(any_case, ["password", "passwd", "secret", "token", "api_?key"])) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and more: the same spans as all runs, short ones dropped
FIELD = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
LONG, DIGIT, TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{20}"), re.compile("[0-9]"), re.compile(r"[A-Za-z0-9]+|[+/_.=-]")
KEYWORDS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start and end of the secret itself), by start and kind."""
    found = [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def likely(text: str) -> bool:
    """False only if the text has neither a base match nor a field."""
    if DIGIT.search(text) or LONG.search(text):
        return True
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def fields(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in FIELD.finditer(text) if m.end() - m.start() >= 20 or DIGIT.search(text, *m.span())]


def shape(token: str) -> str:
    kinds = [("0" if c.isdigit() else "A" if c.isupper() else "a") if c.isalnum() else c for c in token]
    return "".join(k for n, k in enumerate(kinds) if n == 0 or k != kinds[n - 1])[:6]


def bucket(n: float) -> int:
    return int(math.log2(n + 1))


CONSONANTS = re.compile("[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+")
CASES = re.compile(r"(?<=[a-z])[A-Z](?![a-z]{2})|(?<=[A-Z])[a-z](?=[A-Z0-9])")


def randomness(token: str) -> list[str]:
    """How unlike a word a token is: its longest run of consonants, share of vowels, and odd changes of case."""
    run = max((len(m) for m in CONSONANTS.findall(token)), default=0)
    letters = sum(c.isalpha() for c in token)
    vowels = sum(c in "aeiouAEIOU" for c in token)
    return [f"r{min(run, 6)}", f"v{4 * vowels // max(letters, 1)}{bucket(letters)}", f"u{bucket(len(CASES.findall(token)))}"]


def token_features(text: str, start: int, end: int, file: list[str]) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Token spans of a field, and the features of each; those of context have a capital letter."""
    spans = [m.span() for m in TOKEN.finditer(text, start, end)]
    tokens = [text[a:b] for a, b in spans]
    before = re.findall(r"\w+|[^\w\s]", text[max(0, start - 40) : start].lower())[-3:]
    after = text[end : end + 1]
    outer = ["L" + (text[start - 1] if start and not text[start - 1].isalnum() else "-"), "R" + ("-" if after.isalnum() else after)]
    outer += ["W" + w[:12] for w in before] + ["N" + str(bucket(len(tokens)))] + file
    out = []
    for k, t in enumerate(tokens):
        digits, changes = sum(c.isdigit() for c in t), len(re.findall(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]", t))
        own = ["s" + shape(t), f"l{bucket(len(t))}", f"d{round(4 * digits / len(t))}", f"c{bucket(changes)}"]
        own += randomness(t)
        own += [f"h{not t.strip('0123456789abcdef')}{bucket(len(t))}", f"x{len(set(t)) * 4 // len(t)}{bucket(len(t))}"]
        own += ["p" + (shape(tokens[k - 1]) if k else "^"), "n" + (shape(tokens[k + 1]) if k + 1 < len(tokens) else "$")]
        own += ["q" + (tokens[k - 1].lower()[:12] if k else "^"), f"f{k == 0}"]
        out.append(own + outer)
    return spans, out


def file_features(text: str, n_fields: int) -> list[str]:
    signs = sum(map(text.count, "={};"))
    return [f"F{bucket(n_fields)}", f"G{bucket(signs)}", f"H{bucket(1000 * signs / len(text))}"]


class Field:
    """Weights of the random field; tags: 0 outside, 1 begin, 2 inside."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.unary, self.pairs = np.zeros((1, 3)), np.zeros((3, 3))

    def _start(self, scores: np.ndarray) -> np.ndarray:
        return scores + np.array([0, 0, -np.inf])

    def _pairs(self) -> np.ndarray:
        allowed = self.pairs.copy()
        allowed[0, 2] = -np.inf  # inside follows begin or inside
        return allowed

    def scores(self, features: list[list[str]]) -> np.ndarray:
        get = self.names.get
        return np.array([self.unary[[get(f, 0) for f in own]].sum(axis=0) for own in features])

    def decode(self, features: list[list[str]]) -> list[int]:
        scores, pairs = self.scores(features), self._pairs()
        best, back = self._start(scores[0]), []
        for own in scores[1:]:
            through = best[:, None] + pairs
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + own
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def fit(self, examples: list[tuple[list[list[str]], list[int]]]) -> Field:
        """Adaptive gradient ascent on the examples' log-likelihood, in a fixed order."""
        for features, _ in examples:
            for own in features:
                for f in own:
                    self.names.setdefault(f, len(self.names) + 1)
        self.unary = np.zeros((len(self.names) + 1, 3))
        size, pair_size = np.full_like(self.unary, 1e-6), np.full((3, 3), 1e-6)
        rows = [([np.array([self.names[f] for f in own]) for own in fs], tags) for fs, tags in examples]
        order = np.random.default_rng(8)
        with np.errstate(divide="ignore"):
            for _ in range(EPOCHS if rows else 0):
                for k in order.permutation(len(rows)):
                    features, tags = rows[k]
                    scores = np.array([self.unary[own].sum(axis=0) for own in features])
                    pairs = self._pairs()
                    ahead, behind = [self._start(scores[0])], [np.zeros(3)]
                    for own in scores[1:]:
                        ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + pairs, axis=0) + own)
                    for own in scores[:0:-1]:
                        behind.append(np.logaddexp.reduce(pairs + own + behind[-1], axis=1))
                    behind = behind[::-1]
                    total = np.logaddexp.reduce(ahead[-1])
                    for n, own in enumerate(features):
                        step = -np.exp(ahead[n] + behind[n] - total)
                        step[tags[n]] += 1
                        step = step - DECAY * self.unary[own]
                        size[own] += step**2
                        self.unary[own] += RATE * step / np.sqrt(size[own])
                        if n:
                            step = -np.exp(ahead[n - 1][:, None] + pairs + scores[n] + behind[n] - total)
                            step[tags[n - 1], tags[n]] += 1
                            pair_size += step**2
                            self.pairs += RATE * step / np.sqrt(pair_size)
        return self


def examples(text: str, secret: list[tuple[int, int]] | None = None) -> list[tuple[list[list[str]], list[int]]]:
    """Each field of a text with the tags that the secrets (base spans if none are given) give, and once more without
    features of context."""
    own = fields(text)
    if secret is None:
        secret = [(a, b) for _, _, _, a, b in base_spans(text)]
    file, out = file_features(text, len(own)) if own else [], []
    for start, end in own:
        spans, features = token_features(text, start, end, file)
        tags, last = [], None
        for a, b in spans:
            inside = next((s for s in secret if s[0] < b and a < s[1]), None)
            tags.append(0 if inside is None else 2 if inside == last else 1)
            last = inside
        out += [(features, tags), ([[f for f in fs if not f[0].isupper()] for fs in features], tags)]
    return out


#: Prefixes of issuers' keys, the signs that follow them, and their number.
ISSUERS = [
    ("ghp_", "a", 36), ("gho_", "a", 36), ("ghs_", "a", 36), ("github_pat_", "a", 60), ("sk_live_", "a", 24), ("rk_live_", "a", 24),
    ("pk_live_", "a", 24), ("xoxb-", "a", 40), ("xoxp-", "a", 48), ("AIza", "u", 35), ("ya29.", "u", 68), ("npm_", "a", 36),
    ("hf_", "a", 34), ("sk-", "a", 48), ("dckr_pat_", "u", 27), ("SK", "h", 32), ("EAAC", "a", 64), ("ATATT3x", "u", 60),
]
#: What stands before a secret, and before a harmless field.
SECRET_LEADS = [
    "pwd=", "pwd: ", "PWD=", "passphrase: ", "passphrase=", "credentials: ", "credential=", "Authorization: Bearer ", "bearer ",
    "auth=", "auth: ", "private key: ", "private_key=", "client_key=", "access key: ", "access_key=", "account_key=", "login with ",
    "signing key ", "key=", "encryption key: ", "pass: ", "pass=", "DB_PASS=", "session: ", "cookie: sid=", "-----\n",
]
PLAIN_LEADS = [
    "see ", "version ", "the ", "release ", "file ", "at ", "id=", "order ", "in ", "on ", "call ", "path: ", "url: ", "name=", "a ",
    "and ", "de ", "la ", "der ", "und ", "of ", "page ", "isbn ", "build ", "model ", "date: ", "\n", "(", "- ",
]
CLUSTERS = "schaft ngth tsch rch str lls ght fahrt pfl ywrn dd".split()
SYLLABLES = "an ber con der el fi gra ho in ka lo mer na or pa ris so ta un ver".split()


def planted(n: int = PLANTED, seed: int = 8) -> list[tuple[str, int, int]]:
    """Generated texts with the place of their secret (0, 0 for harmless ones), two harmless ones for each secret."""
    r = random.Random(seed)
    signs = {"a": ascii_letters + digits, "u": ascii_letters + digits + "-_", "h": "0123456789abcdef", "b": ascii_letters + digits + "+/"}

    def draw(kind, k):
        return "".join(r.choices(signs.get(kind, kind), k=k))

    def word():
        return "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))

    def secret():
        kind = r.randrange(4)
        if kind == 0:
            prefix, of, k = r.choice(ISSUERS)
            return prefix + draw(of, k + r.randint(-2, 4))
        if kind == 1:
            return "eyJ" + draw("u", r.randint(17, 40)) + ".eyJ" + draw("u", r.randint(20, 80)) + "." + draw("u", 43)
        if kind == 2:
            return draw(r.choice("aub"), r.randint(16, 64)) + r.choice(["", "", "=", "=="])
        return r.choice([str.title, str.lower])(word() + word()) + draw(digits, r.randint(2, 4)) + draw("a", r.randint(0, 4))

    def harmless():
        kind = r.randrange(13)
        if kind == 0:
            return "v" * r.randrange(2) + ".".join(str(r.randrange(30)) for _ in range(3)) + r.choice(["", "-beta.2", "-rc1", "-alpha", ".dev0"])
        if kind == 1:
            return f"20{r.randrange(10, 30)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}" + r.choice(["", f"T{r.randrange(24):02}"])
        if kind == 2:
            return "/".join(["", *(word() for _ in range(r.randint(2, 5)))]) + r.choice([".html", ".py", "", "/2", ".tar.gz", "3.11"])
        if kind == 3:
            return r.choice(["_", "-", ".", "_"]).join(word() for _ in range(r.randint(3, 6))) + r.choice(["", "_2", "10", "-2024"])
        if kind == 4:
            return "".join(word().title() for _ in range(r.randint(3, 5))) + draw(digits, r.randint(0, 2))
        if kind == 5:
            return "-".join(draw("h", k) for k in (8, 4, 4, 4, 12))
        if kind == 6:
            return draw(digits, r.randint(8, 14))
        if kind == 7:
            return "-".join(draw(r.choice([digits, ascii_uppercase]), r.randint(2, 5)) for _ in range(r.randint(3, 4)))
        if kind == 8:
            return r.choice(["www.", "mail.", ""]) + word() + "." + r.choice(["com", "org", "net"]) + "/" + word() + "/" + draw(digits, 5)
        if kind == 9:
            return "-" * r.randint(20, 60) if r.random() < 0.5 else "=" * r.randint(20, 60)
        if kind == 10:
            return "".join(r.choices([*SYLLABLES, *CLUSTERS], k=r.randint(6, 14))) + draw(digits, r.randint(0, 1))
        if kind == 11:
            return word() + "".join(word().title() for _ in range(r.randint(2, 6))) + draw(digits, r.randint(0, 1))
        return word() + draw(digits, r.randint(1, 4)) + draw(ascii_lowercase, r.randint(0, 3)) + word()

    out = []
    for k in range(n):
        around = " ".join(word() for _ in range(r.randint(0, 8)))
        if k % 3 == 0:
            own = secret()  # long ones are known wherever they stand
            lead = r.choice(PLAIN_LEADS if len(own) >= 30 and r.random() < 0.5 else SECRET_LEADS)
        else:  # words like `key` stand before harmless fields too
            lead, own = r.choice(PLAIN_LEADS if r.random() < 0.9 else ["key ", "pass ", "session ", "auth "]), harmless()
        text = f"{around} {lead}{r.choice(['', '', chr(34)])}"
        out.append((text + own + r.choice(["", " ", ".", ",\n", chr(34), ")"]) + around, *((len(text), len(text) + len(own)) if k % 3 == 0 else (0, 0))))
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field from a sample of at most sample_docs documents; only its secret-like fields' features are fetched."""
    n = docs.count()
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("secret")), F.lit(HASHES))
    few = docs.select("doc_id", "text").where(order < int(min(1.0, sample_docs / max(n, 1)) * HASHES))

    def run(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and likely(text):
                    for fs, tags in examples(text):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([["\n".join(own) for own in fs]]), pa.array([tags], pa.list_(pa.int32()))],
                            names=["features", "tags"],
                        )

    rows = few.mapInArrow(run, "features array<string>, tags array<int>").distinct()
    rows = rows.orderBy(F.xxhash64("features", "tags"), "features", "tags").limit(EXAMPLES).collect()
    rows = sorted(((list(r["features"]), list(r["tags"])) for r in rows), key=str)
    made = [x for text, a, b in planted() for x in examples(text, [(a, b)] if b else [])]
    return Field().fit([([own.split("\n") for own in fs], tags) for fs, tags in rows] + made)


def scan_text(text: str | None, field: Field) -> list[tuple[str, int, int, int, int]]:
    if not text or not likely(text):
        return []
    base, own = base_spans(text), fields(text)
    file, more = file_features(text, len(own)) if own else [], []
    for start, end in own:
        spans, features = token_features(text, start, end, file)
        at = None
        for (a, b), tag in [*zip(spans, field.decode(features), strict=True), ((end, end), 0)]:
            if at is not None and tag != 2:
                if not any(x < at[1] and at[0] < y for _, x, y, _, _ in base):
                    more.append(("crf", *at, *at))
                at = None
            if tag == 1:
                at = (a, b)
            elif tag == 2 and at is not None:
                at = (at[0], b)
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in spans)


def digest(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The contract's row of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample_docs))

    def run(batches):
        for batch in batches:
            found = [scan_text(t, shared.value) for t in batch.column("text").to_pylist()]
            counts = [[sum(k == kind for k, *_ in f) for f in found] for kind in KINDS[:3]]
            base = [joined(x for x in f if x[0] != "crf") for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([joined(f) for f in found])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, mark: str = "[SECRET]") -> DataFrame:
    """All documents, each secret (of an assignment, the value alone) replaced by a mark; n_chars follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample_docs))
    own, flag = docs.columns, fresh("was_redacted", docs.columns)

    def run(batches):
        from .decontaminate import merged

        for batch in batches:
            texts = batch.column("text").to_pylist()
            changed = [False] * len(texts)
            for k, text in enumerate(texts):
                for a, b in reversed(merged([(a, b) for _, _, _, a, b in scan_text(text, shared.value)])):
                    texts[k], changed[k] = texts[k][:a] + mark + texts[k][b:], True
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(changed, pa.bool_())], names=[*own, flag])

    out = docs.mapInArrow(run, _with_flag(docs, flag))
    if "n_chars" in own:
        new = F.when(F.col(flag), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", new)
    return out.select(*own)


def _with_flag(docs: DataFrame, flag: str):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])
