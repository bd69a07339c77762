from pyspark.sql import functions as F

from dossier.functions import chem
from dossier.operators import records, rules, scoring, text
from dossier.sources import readers, writers
from dossier.streaming import tail


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


def test_cas_checksum(spark):
    ok = lambda s: one(spark, chem.cas_checksum_ok(F.col("c")), c=s)
    assert ok("64-17-5") is True and ok("64-17-6") is False and ok("x") is None and ok(None) is None


def test_contents(spark):
    b = lambda s: one(spark, chem.content_bounds(F.col("c")), c=s)
    assert tuple(b("10~20")) == (10, 20) and tuple(b("<1")) == (0, 1) and tuple(b("90 이상")) == (90, 100) and b("n/a") is None
    key = lambda s: one(spark, chem.content_key(F.col("c")), c=s)
    assert key("10 ~ 20") == key("10~20%") != key("10") and key(None) == "null"


def test_gold_as_prediction_is_perfect(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b")], "doc_id int, v string")
    for counts in (scoring.set_counts(df, df, "doc_id", "v"), scoring.bag_counts(df, df, "doc_id", F.col("v").isNull())):
        assert all(r.fp == r.fn == 0 and r.tp > 0 for r in counts.collect())


def test_bootstrap_constant_and_single_group(spark):
    g = spark.createDataFrame([("x", "a", 2, 1), ("x", "b", 4, 2), ("y", "a", 3, 1)], "s string, g string, t int, n int")
    got = {r.s: (r.ci_low, r.ci_high) for r in scoring.bootstrap_interval(g, "s", "g", "t", "n", 50).collect()}
    assert got == {"x": (2.0, 2.0), "y": (None, None)}


def test_latest_batch_forgets_older_fields(spark):
    r = spark.createDataFrame([(1, 1, "a", 1, "x"), (2, 1, "b", 2, "y"), (3, 1, "b", 2, "z")], "id int, document_id int, field_path string, batch int, confirmed_value string")
    assert [tuple(x) for x in records.latest_batch(r).collect()] == [(1, "b", 2, "z")]


def test_checks_find_each_code(spark):
    ing = spark.createDataFrame([(1, 1, "64-17-5", "60"), (1, 2, "64-17-6", "50"), (1, 3, "abc", "some")], "doc_id int, seq int, cas string, content string")
    assert sorted(r.code for r in rules.check_cas(ing).collect()) == ["CAS_CHECKSUM_INVALID", "CAS_FORMAT_INVALID"]
    assert sorted(r.code for r in rules.check_content_sum(ing).collect()) == ["CONTENT_SUM_EXCEEDS_100", "CONTENT_SUM_UNPARSEABLE"]


def test_sections_and_p_block(spark):
    t = "1. A\nx\n2. Hazards\nH225\nPrecautionary statements\nP210\nOther hazards\nz\n3. Composition\ny\n4. First-aid\nz"
    cut = one(spark, text.cut_to_section3(F.col("t")), t=t)
    assert cut["text"].endswith("3. Composition\ny\n") and cut["name"] == "EN_4"
    assert one(spark, text.cut_to_section3(F.col("t")), t="1. A") is None
    got = one(spark, text.remove_p_block(F.col("t")), t=t)
    assert got["status"] == "EN_P" and "P210" not in got["text"] and "Other hazards\nz" in got["text"]
    assert one(spark, text.remove_p_block(F.col("t")), t=t.replace("P210", "P210 H301"))["status"] == "ABORTED_H_LOSS: H301"
    assert one(spark, text.remove_p_block(F.col("t")), t=t.replace("Precautionary", "Some"))["status"] == "NONE"
    korean = "2. 유해성\nH225\n예방조치 문구: \nP210\n다. 기타\n3. 구성성분\n4. 응급조치 요령\n"
    assert one(spark, text.remove_p_block(F.col("t")), t=korean)["status"] == "KO_P"
    assert one(spark, text.cut_to_section3(F.col("t")), t=korean)["name"] == "KO_4"
    assert one(spark, text.collapse_repeats(F.col("t")), t="aaabb") == "ab"
    assert one(spark, text.undouble(F.col("t"), F.lit(4)), t="구구구구성성성성성성성성") == "구성성"


def test_chunks_at_gaps():
    words = " ".join(f"w{k}" for k in range(900))
    body = "\n\n".join([words, "short", "x" * 3000, words[:700]])
    got = text.split_recursively(body, 500, 80)
    assert max(map(len, got)) <= 500 and all(c == c.strip() and c for c in got)
    assert text.split_recursively("a b c", 100, 10) == ["a b c"] and text.split_recursively("", 100, 10) == []
    flat = text.split_recursively(words, 200, 50)
    assert all(set(a.split()[-3:]) & set(b.split()[:15]) for a, b in zip(flat, flat[1:]))  # neighbours share words
    assert sorted({w for c in flat for w in c.split()}) == sorted(words.split())


def test_bootstrap_draws_as_a_plain_loop_does(spark):
    rows = [("x", f"g{k:03}", (k * 37) % 11 - 4, k % 5 + 1) for k in range(40)]
    groups = spark.createDataFrame(rows, "by string, g string, t long, n long")
    got = scoring.bootstrap_interval(groups, "by", "g", "t", "n", 100).first()
    at = spark.range(100).selectExpr("cast(id as int) as boot", "explode(sequence(0, 39)) as k").selectExpr("boot", "pmod(xxhash64(42, boot, k), 40) as at").collect()
    stats = sorted(sum(rows[r.at][2] for r in at if r.boot == b) / sum(rows[r.at][3] for r in at if r.boot == b) for b in range(100))
    assert (got.ci_low, got.ci_high) == (round(stats[2], 6), round(stats[97], 6))


def test_keyed_csv_and_predictions(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffdoc_id,lang\n1,en\n2,fr\n1,ko\n", encoding="utf-8")
    got = readers.keyed_csv(spark, f"{tmp_path}/a.csv", "doc_id string, lang string", "doc_id")
    assert sorted(map(tuple, got.collect())) == [("1", "ko"), ("2", "fr")]
    mock = spark.createDataFrame([("1", 0), ("3", 0)], "doc_id string, n int")
    assert sorted(map(tuple, readers.predictions(spark, f"{tmp_path}/none", "n int", mock).collect())) == [("1", 0), ("3", 0)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text('{"n": 5}')
    assert sorted(map(tuple, readers.predictions(spark, f"{tmp_path}/p", "n int", mock).collect())) == [("1", 5), ("3", 0)]


def test_tail_takes_each_row_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.csv").write_text(f"step,loss\n{k},0.5\n")
        tail.tail_log(spark, f"{tmp_path}/in", "step int, loss double", f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.step for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_lookup_tables_and_histories(spark, tmp_path):
    (tmp_path / "p.csv").write_text("h_code,phrase_ko,accepted_variants\nH224,very flammable,very  flam.|\nH225,flammable,\n")
    got = [(r.code, r.phrase) for r in readers.phrase_table(spark, f"{tmp_path}/p.csv").orderBy("row_no").collect()]
    assert got == [("H224", "very flammable"), ("H224", "very  flam."), ("H225", "flammable")]
    (tmp_path / "c.csv").write_text("a,b,c,d,e,f\nx,1,위험,H224|H225,s,n\ny,2,,,s,n\n")
    assert [tuple(r) for r in readers.class_table(spark, f"{tmp_path}/c.csv").collect()] == [("x", "1", "위험", "H224|H225"), ("y", "2", None, "")]
    one_event = spark.createDataFrame([(1, "ingredients", [{"cas": "x"}])], "document_id int, field_path string, confirmed_value array<map<string,string>>")
    for _ in range(2):
        writers.append_reviews(one_event, f"{tmp_path}/h")
    assert [r.confirmed_value for r in spark.read.parquet(f"{tmp_path}/h").collect()] == ['[{"cas":"x"}]'] * 2
    lines = spark.createDataFrame([("a", "train", "orig", [("user", "x")], 5), ("b", "val", "orig", [("user", "y")], 900)], "doc_id string, split string, variant string, messages array<struct<role:string,content:string>>, n_tokens int")
    assert [r.doc_id for r in writers.training_lines(lines, f"{tmp_path}/t", 100).collect()] == ["b"]
    assert [(r.split, r.n) for r in writers.training_digest(spark, f"{tmp_path}/t").collect()] == [("train", 1)]


def test_tracked_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,0.5\n2,0.25\n")
    seen = []
    stream = spark.readStream.schema("step int, loss double").csv(f"{tmp_path}/in")
    for _ in range(2):
        writers.tracked(stream, lambda df, n: seen.extend(r.step for r in df.collect()), f"{tmp_path}/cp")
    assert sorted(seen) == [1, 2]


def test_logs_and_cuts(spark, tmp_path):
    from dossier.plans.fixtures import spread

    df = spark.createDataFrame([("a", "OK", '{"x":1}'), ("b", "NOT_FOUND", "{}"), ("c", None, None)], "doc_id string, status string, body string")
    writers.split_cut(df, f"{tmp_path}/cut")
    assert spark.read.parquet(f"{tmp_path}/cut/success").count() == 1 and spark.read.parquet(f"{tmp_path}/cut/review_required").count() == 2
    for _ in range(2):
        writers.append_failures(df.where("status <> 'OK'").select("doc_id", "status"), f"{tmp_path}/failures")
    assert [tuple(r) for r in readers.csv_table(spark, f"{tmp_path}/failures", "doc_id string, status string").collect()] == [("b", "NOT_FOUND")] * 2
    stamps = {r.doc_id: r.stamp for r in writers.stamped(df, "doc_id", "body").collect()}
    assert len(stamps["a"]) == 16 and stamps["a"] != stamps["b"] and stamps["c"] is None
    (tmp_path / "x.jsonl").write_text('{"n": 1}\n\n{"n": 2}\n')
    assert sorted(r.n for r in readers.json_lines(spark, f"{tmp_path}/x.jsonl", "n int").collect()) == [1, 2]
    assert spread(df).count() == 3


def test_stream_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a,2024-01-01 00:00:00\na,2024-01-01 00:01:00\nb,2024-01-01 00:02:00\n")
    stream = tail.latest_by_key(spark.readStream.schema("id string, ts timestamp").csv(f"{tmp_path}/in"), "id", "1 hour", "ts")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
