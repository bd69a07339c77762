"""The prefix trie against a plain walk, on odd rows, and at every depth of its prefix sums."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from dossier.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, pos int, words string"


def plain(rows):
    """Rows of the contract, from (conv_id, turn, role, text), by walking every path."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20 if abs(c) < 2**50 else c % 20
        path = own.get(c - base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def given(spark, rows):
    return spark.createDataFrame([(*r, 7, "w") for r in rows], SCHEMA)


def odd():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c // 7}") for c in range(45) for t in range(c % 11)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(12)]  # copies
    rows += [(c, t, "user", f"same {t}" if t < 9 else f"own {c % 3} {t}") for c in range(200, 230) for t in range(20)]
    rows += [(60, None, None, None), (60, None, "user", ""), (60, 5, "a:", "b"), (60, 5, "a", ":b"), (61, 1, "", " \t"), (62, 1, "u", "é  ñ\x00 x")]
    rows += [(-3, 1, "u", "x"), (-23, 1, "u", "x"), (-20, 1, "u", "y z"), (-20, 2, "u", "w")]
    rows += [(81, 1, "u", "x")] * 5 + [(None, 1, "u", "x")] * 3  # repeated rows; no conversation
    rows += [(305, t, "user", "word " * 50_000 if t == 3 else f"t{t % 5}") for t in range(400)]
    return rows


def test_odd_rows(spark):
    assert rows_of(prefix_trie.prefix_trie(given(spark, odd()))) == plain(odd())


def test_empty_and_turnless(spark):
    assert prefix_trie.prefix_trie(given(spark, odd()).limit(0)).count() == 0
    lone = [c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4 >= 1]
    rows = [(c, 1, "u", "x") for c in lone]  # no base, and their only turn is replaced
    assert rows_of(prefix_trie.prefix_trie(given(spark, rows))) == plain(rows) == Counter(
        [(lone[0], 0, None, len(lone), 0, 1, 0, hashlib.sha256(",".join(map(str, lone)).encode()).hexdigest())]
    )


@pytest.mark.parametrize("fan", [2, 3])
def test_prefixes_of_many_blocks(spark, fan):
    rows = [(1, b, b * 7 + 1, b * 5 + 2, b, []) for b in range(23)] + [(2, b, b + 1, b + 2, 1, []) for b in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, block long, x1 long, x2 long, words long, turns array<int>")
    want, state = {}, {}
    for conv, block, x1, x2, words, _ in rows:
        p = state.get(conv, (0, 0, 0))
        want[conv, block] = p
        state[conv] = (p[0] ^ x1, p[1] ^ x2, p[2] + words)
    assert {(r.conv_id, r.block): (r.p1, r.p2, r.before) for r in prefix_trie.before_blocks(table, fan).collect()} == want


def test_one_conversation_of_most_rows(spark):
    rows = [(20, t, "user", f"t {t % 3}") for t in range(9000)] + [(c, t, "user", f"t {t}") for c in range(20, 60, 7) for t in range(3)]
    got = prefix_trie.prefix_trie(given(spark, rows))
    deep = got.where("depth = 9000").collect()
    assert [(r.conv_id, r.n_convs, r.n_leaves, r.saved_tokens) for r in deep] == [(20, 1, 1, 0)]
    assert got.count() == len(plain([r for r in rows if r[1] < 40])) + 9000 - 40


def test_ends_of_many_members_are_hashed_as_a_stream(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ids = [*range(0, 400, 3), 10**12]
    ends = spark.createDataFrame([(5, 6, c) for c in ids] + [(5, 7, 1)], "d1 long, d2 long, conv_id long").orderBy(F.rand(3))
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    got = {(r.d1, r.d2): r.ends_sha256 for r in prefix_trie.ends_hashes(ends).collect()}
    assert got == {(5, 6): want, (5, 7): hashlib.sha256(b"1").hexdigest()}


def test_registered_query_equals_sql_and_walk(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = rows_of(queries.queries()["op13_prefix_trie"](spark, sf_dir))
    assert got == Counter(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.ORACLE})").fetchall())
    assert got == plain(con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
