"""Line deduplication against a plain version, batch by batch, and on odd rows."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from dossier.llm import line_dedup, queries

WHITE = " \t\n\x0b\x0c\r"
LINE = "This line of forty characters and more is on every page"


def plain(rows, least_chars=40, least_docs=5):
    """(doc_id, n_lines, n_dropped, sha256) of (doc_id, text) rows; None is one document below all others."""
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(WHITE))
    rank = lambda d: -(10**9) if d is None else d
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(rank(doc))
    common = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if common.get(key(x), rank(doc)) == rank(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def rows_of(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def odd():
    rows = [(k, f"{LINE}\nown line {k} that is long enough to be looked at by it") for k in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, f"  {LINE.upper()}\t\n{LINE}\n{LINE}"), (24, "É" + "é" * 39), (25, "short\n" * 5)]
    rows += [(k, "x" * 39 + "\n" + "y" * 40 + "\n" + "É" * 40) for k in range(30, 35)]
    rows += [(40, "é" * 40), (None, LINE), (None, LINE + "\nof its own"), (None, None)]  # é and É are other keys
    rows += [(7, LINE), (7, "another text of a repeated id\n" + LINE), rows[3], rows[3]]
    rows += [(50, "\n".join(["word " * 20, LINE] * 20_000))]
    return rows


@pytest.mark.parametrize("batches, fanout", [(1, 3), (4, 3), (7, 2)])
def test_odd_rows(spark, batches, fanout):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in odd()], "doc_id long, text string, h1 int, lost string")
    got = line_dedup.digest(df, batches=batches, fanout=fanout)
    assert rows_of(got) == plain(odd())


def test_a_line_of_most_documents(spark):
    rows = [(k, LINE if k % 3 else f"{LINE}\n{k}") for k in range(600)] + [(k, f"line {k % 130} " + "z" * 40) for k in range(600, 1200)]
    assert rows_of(line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_documents_keep_their_columns(spark):
    rows = [(k, f"{LINE}\n{k}", k) for k in range(6)] + [(9, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_key int")
    names = ["lost", "doc", "_doc", "key", "_key", "batch", "h1", "h2", "top"]  # of the operator's own columns
    got = line_dedup.drop_common_lines(df.withColumns({n: F.lit(n) for n in names}))
    assert got.columns == [*df.columns, *names] and all(r[n] == n for r in got.collect() for n in names)
    assert {(r.doc_id, r.text, r.text_key) for r in got.collect()} == {(k, f"{k}", k) for k in range(5)} | {(5, f"{LINE}\n5", 5), (9, None, 9)}
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0
    assert line_dedup.digest(df.limit(0)).count() == 0


def test_runs_outlive_a_session_object(spark, tmp_path):
    """Batches added by two objects on one folder; levels fill and merge; a merge that stopped half way counts not twice."""
    batches = [[(b * 10 + k, f"{LINE} {k % 4}") for k in range(6)] for b in (5, 3, 4, 1, 0, 2, 6, 7)]
    folder = str(tmp_path / "runs")
    for k, rows in enumerate(batches):
        if k % 3 == 0:
            runs = line_dedup.LineRuns(spark, folder, fanout=2)
        runs.add(line_dedup.line_keys(spark.createDataFrame(rows, "doc_id long, text string")))
        assert [r[0] for r in runs.runs()] == [lv for lv in range(3, -1, -1) if (k + 1) >> lv & 1][::-1]
    held = defaultdict(set)
    for doc, text in sum(batches, []):
        held[line_dedup.line_key(text)].add(doc)
    got = {r.h1.to_bytes(8, "little", signed=True) + r.h2.to_bytes(8, "little", signed=True): r.top for r in runs.common().collect()}
    assert got == {k: max(v) for k, v in held.items() if len(v) >= 5}
    last = runs.runs()[0]
    half = f"{folder}/run-{last[0] - 1}-{last[1]}-{last[1]}-{last[3]}"  # as if its deletion had not been reached
    spark.read.parquet(last[4]).write.parquet(half)
    assert [r[4] for r in line_dedup.LineRuns(spark, folder).runs()] == [last[4]]


def test_settled_keys_are_not_added_again(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), fanout=9)
    for first in (100, 50, 0):  # from large to small ids
        runs.add(line_dedup.line_keys(spark.createDataFrame([(first + k, LINE) for k in range(9)], "doc_id long, text string")))
    assert [runs.read(r).count() for r in runs.runs()] == [1, 0, 0]
    runs.add(line_dedup.line_keys(spark.createDataFrame([(500, LINE)], "doc_id long, text string")))
    assert [r.top for r in runs.common().collect()] == [500]


def test_batch_of_runs_needs_no_shuffle_of_them(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"))
    runs.add(line_dedup.line_keys(spark.createDataFrame([(k, LINE) for k in range(9)], "doc_id long, text string")))
    run = runs.read(runs.runs()[0])
    own = spark.range(1000).select(F.col("id").alias("h1"), F.col("id").alias("h2")).repartition(4, "h1", "h2")
    plan = own.join(run.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_registered_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = Counter(con.sql(line_dedup.ORACLE).fetchall())
    assert rows_of(queries.queries()["op11_line_dedup"](spark, sf_dir)) == want
