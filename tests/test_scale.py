"""Rules and plans that show only in larger tables: lines that are alike but not equal, partitions that grow with a table."""

import json

import duckdb
import pytest

from pyspark.sql import functions as F

from dossier.functions import chem
from dossier.operators import augment
from dossier.plans import catalog, catalog_documents, fixtures


@pytest.fixture
def alike(spark, sf_dir, tmp_path):
    """A document whose first two identifiers, 6661-34-… and 6611-34-…, differ only in how often a digit is repeated."""
    lines = spark.createDataFrame([(1, 5661, 24, 1, 1.0), (1, 5611, 24, 2, 1.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double")
    lines.toPandas().to_parquet(tmp_path / "lineitem.parquet")
    return str(tmp_path)


def test_page_of_lines_that_are_alike(spark, alike):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{alike}/lineitem.parquet'")
    got = [tuple(r) for r in catalog.queries()["evidence_page"](spark, alike).select("doc_id", "page").collect()]
    assert got == con.sql(f"SELECT doc_id, page FROM ({catalog.oracle_sql()['evidence_page']})").fetchall() == [(1, 1)]


def test_partitions_grow_with_the_table(spark):
    n = lambda rows: fixtures.partitions(spark.range(rows), 1000)
    assert n(5) == n(0) == 1 and n(4_000) == 4 and n(64_000) == 64 and n(65_000) == 128


def test_lines_are_shuffled_once(spark, sf_dir):
    """Counts of lines and what is gathered by document share one shuffle, whose partitions come from the table's size."""
    own = fixtures.fixture(spark, sf_dir, "fx_gold_ing")
    assert own.rdd.getNumPartitions() == fixtures.partitions(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), 200_000)
    plan = own.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_audit_reads_its_rows_once(spark, sf_dir):
    plan = catalog.queries()["cas_checksum_audit"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_checksum_of_all_lengths(spark):
    good = ["64-17-5", "7732-18-5", "1234567-89-5", "0000000-00-0", "10-00-4"]
    bad = ["64-17-4", "7732-18-0", "1234567-89-4"]
    rows = spark.createDataFrame([(x,) for x in [*good, *bad, "64-17-5x", "", None]], "cas string")
    got = {r.cas: r.ok for r in rows.select("cas", chem.cas_checksum_ok(rows["cas"]).alias("ok")).collect()}
    weighted = lambda x: sum(k * int(c) for k, c in enumerate(reversed(x.replace("-", "")[:-1]), 1)) % 10 == int(x[-1])
    assert got == {**{x: weighted(x) for x in [*good, *bad]}, "64-17-5x": None, "": None, None: None}


def test_findings_are_made_where_documents_were_dealt(spark, sf_dir):
    """No join by document, and one shuffle after rows and records have met: into partitions that grow with the table."""
    plan = catalog.queries()["findings_in_order"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    union = plan.index("Union")
    assert "FullOuter" not in plan and plan[:union].count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan[:union]


def test_shape_of_records_hides_no_item(spark):
    """Lists whose schema as a whole looks right: a lacking key, a null beside an item, a null where a text must be."""
    from dossier.operators import schema

    field = lambda v: {"value": v, "source_status": "기재"}
    record = {
        **{n: field("위험") for n in schema.VALUE_FIELDS}, "supplier": dict.fromkeys(schema.SUPPLIER), "ingredients": [], "hazard_statements": [],
        "list_status": {"ingredients": "자료없음", "ghs_classification": "기재", "hazard_statements": "자료없음"},
    }
    good, lacking, bad, empty = {"hazard_class": "x", "category": "구분 2"}, {"hazard_class": "x"}, {"hazard_class": "x", "category": "2"}, {"hazard_class": None, "category": None}
    lists = [[good], [good, lacking], [None], [good, None], [good, empty], [bad], [bad, good], []]
    rows = spark.createDataFrame([(k, json.dumps({**record, "ghs_classification": x})) for k, x in enumerate(lists)], "doc_id int, json string")
    got = sorted((r.doc_id, r.loc, r.type) for r in schema.validate(rows).collect())
    at = "ghs_classification."
    assert got == [
        (1, at + "1.category", "missing"), (2, at + "0", "object_type"), (3, at + "1", "object_type"), (4, at + "1.hazard_class", "string_type"),
        (5, at + "0.category", "value_error"), (6, at + "0.category", "value_error"), (7, "", "value_error"),
    ]
    plan = schema.problems(rows, ["doc_id"], "json").where("size(problems) > 0")
    assert plan.count() == len(lists)


def test_scores_come_from_one_scan_of_the_lines(spark, sf_dir):
    plan = catalog.queries()["score_report"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len([line for line in scans if "l_orderkey" in line]) == 1 and not any("lines-" in line for line in scans)


def test_counts_of_both_sides_of_a_row(spark):
    """A value twice in a document, one side alone, rows without a value, sums of rows without entries."""
    from pyspark.sql import functions as F

    from dossier.operators import scoring

    rows = spark.createDataFrame(
        [(1, "a", "a", True, "x", "x", 1), (1, "a", "b", True, "y", "y", 1), (1, None, None, True, "x", "z", 1), (2, None, "c", True, "x", "x", 1), (3, "d", None, False, "x", None, 1)],
        "k int, g string, p string, there boolean, x string, y string, n int",
    )
    one = F.lit(True)
    made = scoring.entries("ing", F.col("g"), F.col("p"), (one, F.col("there")), content=(F.col("x"), F.col("y")), lacking=(one, one))
    made = F.when(F.col("k") > 0, F.concat(made, scoring.entries("ghs", F.col("g"), F.col("p")), scoring.listed("hcode", F.array("p"), False)))
    both = rows.select("k", made.alias("entries"), "n").union(rows.limit(1).select(F.lit(4), F.lit(None), F.lit(7)))
    got = {r.k: r for r in scoring.row_counts(both, "k", ["n"]).collect()}
    counts = lambda r, f: tuple(r[f"{f}_{c}"] for c in ("tp", "fp", "fn"))
    assert [counts(got[1], f) for f in ("cas", "pair", "nocas", "ghs")] == [(1, 1, 0), (1, 1, 1), (0, 1, 1), (1, 1, 0)]
    assert [counts(got[k], "cas") for k in (2, 3)] == [(0, 1, 0), (0, 0, 1)] and counts(got[2], "nocas") == (0, 0, 1)
    assert (got[1].cas_paired, got[1].fab_cas, got[3].fab_cas, got[1].fab_hcode, got[3].fab_hcode) == (1, 2, 0, 2, 0) and [got[k].n for k in (1, 2, 3, 4)] == [3, 1, 1, 7]


def test_values_are_sought_where_documents_were_dealt(spark, sf_dir):
    plan = catalog.queries()["not_found_findings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_documents_of_one_row_group_are_dealt(spark, sf_dir):
    """A file of one row group was one task's work, whatever its size."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert catalog_documents.korean(spark, sf_dir).rdd.getNumPartitions() == fixtures.partitions(rows, 1_000) > rows.rdd.getNumPartitions()


def test_tokens_are_sought_in_lines_that_may_have_some(spark):
    """Lines without any part of a token are left out, and no token with them."""
    tokens = ["위 험", "경고", "Danger", "WARNING", "구 분 2A", "category 1", "압축 가스", "liquefied Gas", "Compressed gas", "자료 없음", "분류되지 않음", "not applicable", "<=", "≥", "이상", "초과"]
    texts = [f"stranger dangers\nx {t} y\nz" for t in tokens] + ["\n".join(tokens), "plain\nwarnings gory", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.array_sort(F.flatten(F.array(*(augment._found(k, p, F.col("text")) for k, p in augment.PROTECTED.items()))))
    got = df.select(augment.tokens_of(F.col("text")).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in got) and all(r.a for r in got[: len(tokens)]) and len(got[len(tokens)].a) == len(tokens)


def test_token_changes_of_rows(spark):
    """Both texts in one row give what two tables give, without a join."""
    rows = spark.createDataFrame([(1, "이상 < <", "< x"), (2, "경고", "경고 경고"), (3, "위험", "위험"), (4, None, "미만"), (5, "초과", None)], "doc_id int, old string, new string")
    before, after = (rows.select("doc_id", F.col(c).alias("text")) for c in ("old", "new"))
    for more in (True, False):
        got = augment.token_changes_in_rows(rows, "old", "new", more)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, augment.token_changes(before, after, more).collect()))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_lists_of_lines_count_as_their_rows(spark):
    """Lines gathered by document give the counts of `row_counts`, without its rows of values: nulls, repeated values, lines that
    one side lacks, amounts written in two ways, a document without source lines."""
    import random

    from dossier.operators import scoring

    draw = random.Random(7)
    some = lambda *xs: draw.choice([None, *xs])
    line = lambda: (some("a", "b"), some("x", "y"), [draw.choice("HK")] * draw.randint(0, 2), some("1-2-3", "1-2-4", "55-6"), some("10~20", "20 ~ 10", "<1", "z"), draw.random() < 0.5)
    rows = []
    for k in range(300):
        for seq in range(draw.choice([1, 2, 5, 40])):
            gold, there = line(), draw.random() < 0.8
            pred = (gold if draw.random() < 0.5 else line()) if there else (None, None, [], None, None, None)
            rows.append((k, seq, *gold, *pred, there, some("1-2", "-3 55-6") if k % 3 else None, 1))
    names = "ghs htext hcode cas content is_sub".split()
    types = dict(zip(names, "string string array<string> string string boolean".split()))
    schema = ", ".join(["doc_id int", "seq int", *(f"{p}{c} {types[c]}" for p in ("", "p_") for c in names), "p_there boolean", "source string", "n int"])
    df, c = spark.createDataFrame(rows, schema), F.col
    flat = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "source")))["source"].alias("all"))
    flat = flat.select("doc_id", F.when(F.exists("all", lambda x: x.isNotNull()), F.regexp_replace(F.array_join("all", ""), " ", "")).alias("flat"))
    flags = [F.when(c(f"{p}cas").isNull(), c(f"{p}is_sub")) for p in ("", "p_")]
    made = F.concat(
        scoring.entries("ghs", c("ghs"), c("p_ghs")), scoring.entries("htext", c("htext"), c("p_htext")), scoring.listed("hcode", c("hcode"), True), scoring.listed("hcode", c("p_hcode"), False),
        scoring.entries("ing", c("cas"), c("p_cas"), (F.lit(True), c("p_there")), flag=flags, content=[chem.content_key(c(f"{p}content")) for p in ("", "p_")], lacking=[scoring.lacks(c("flat"), c(f"{p}cas")) for p in ("", "p_")]),
    )
    want = scoring.row_counts(df.join(flat, "doc_id").select("doc_id", made.alias("entries"), "n"), "doc_id", ["n"])
    got = scoring.line_counts(df, "doc_id", "seq", ["n"])
    assert set(got.columns) == set(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert want.where("fab_cas > 0").count() and want.where("nocas_tp > 1").count() and want.where("pair_tp > 1").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1


def test_scores_are_not_rows_of_values(spark, sf_dir):
    """No row for each value of a line: one sort to number lines, one gathering by document."""
    plan = catalog.queries()["score_report"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Window [") == 1


def test_white_space_is_that_of_unicode(spark):
    """Of all characters, 4096 a row."""
    texts = [("".join(chr(k) for k in range(at, at + 4096) if not 0xD800 <= k <= 0xDFFF),) for at in range(0, 0x110000, 4096)]
    every = spark.createDataFrame(texts, "c string").select("c", chem.squash(F.col("c")).alias("got"), F.regexp_replace("c", r"(?U)\s+", "").alias("want"))
    assert every.where("got <> want").count() == 0 and every.agg(F.sum(F.length("c") - F.length("got"))).first()[0] == 25


def test_keys_of_amounts(spark):
    """Six digits as %.6f has them, whatever the size; marks and numbers after percent signs are gone."""
    texts = ["10~20", "20%~10", "<1", "1미%만", "≥90", "0.0000005", "0.00000049", "1.0000015", "123456789.123456789", "9" * 40, "1" + "0" * 25 + ".5", "a b", "", "1 2 3", None]
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "c string").select(chem.content_key(F.col("c")).alias("k")).collect()]
    one = lambda a, b: spark.range(1).select(F.format_string("P:%.6f:%.6f", F.lit(a).cast("double"), F.lit(b).cast("double"))).first()[0]
    same = lambda t: one(t, t)
    assert got == [one("10", "20"), one("10", "20"), one("0", "1"), one("0", "1"), one("90", "100"), *map(same, texts[5:11]), "S:ab", "S:", "S:123", "null"]


def test_values_and_lines_are_gathered_together(spark, sf_dir):
    plan = catalog.queries()["evidence_locate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and plan.count("Window [") == 1 and "Join" not in plan


def test_values_in_gathered_lines(spark):
    """As `locate` has them: several lines with a value, last tokens, labels, white space within values, no value, no text."""
    from dossier.operators import evidence

    docs = [
        ["a 64-17-5 b", "x: 64-17-5.", "64-17-5 64-17-5", "67- 64-1", None, "in two\nlines 7"], [" 신호어 : 위험", "위험", "신호어", "경고", "제품명", "", "x 위험"], ["  ", ""], [None], ["1～2", "　 5 \xa0"],
    ]
    values = ["64-17-5", "67-64-1", "위험", "경고", "x", "", " ", None, "lines", "1~2", "5", "two\nlines", "7"]
    fields = ["ingredients.1", "signal_word", "product_name", "other", None]
    rows = [(k, n, line, f, v) for k, lines in enumerate(docs) for n, line in enumerate(lines) for f in fields for v in values]
    once = [(k, n, line if not j else None, f, v) for (k, n, line), group in _grouped(rows) for j, (f, v) in enumerate(group)]
    df = spark.createDataFrame(once, "doc_id int, seq int, line string, field string, value string")
    got = evidence.evidence_in_lines(df, "doc_id", "seq").distinct().collect()
    texts = spark.createDataFrame([(k, "\n".join(x for x in lines if x is not None)) for k, lines in enumerate(docs)], "doc_id int, text string")
    c = F.col
    labels = F.when(c("field") == "signal_word", F.array(F.lit("신호어"))).when(c("field") == "product_name", F.array(F.lit("제품명"), F.lit("상품명"))).otherwise(F.array().cast("array<string>"))
    want = df.select("doc_id", "field", "value").distinct().join(texts, "doc_id").withColumn("at", evidence.locate(c("text"), c("value"), labels)).select("doc_id", "field", "value", "at.*")
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect())) and len(got) == len(docs) * len(fields) * len(values)
    assert {r.match_type for r in got} == {"exact", "normalized", "not_found"} and len({r.snippet for r in got}) > 8


def _grouped(rows):
    from itertools import groupby

    return [(at, [(f, v) for *_, f, v in group]) for at, group in groupby(rows, key=lambda r: r[:3])]
