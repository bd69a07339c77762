import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import one

from dossier.functions import lenient_json, textnorm
from dossier.operators import augment, evidence, governance, headings, records, retrieval, review, schema, scoring
from dossier.sources import readers, writers

KOREAN = "1. 화학제품과 회사\n가. 제품명 : 가나(흡입: 가스)\n2) 용도 : x\n- 위험 구분 2\n2. 유해성\nCAS 번호 64-17-5 / KE-12345 80 이상\n3. 구성성분\n"


def valued(value, state):
    return {"value": value, "source_status": state}


GOOD = {
    "product_name": valued("A", "기재"), "recommended_use": valued(None, "자료없음"), "use_restrictions": valued(None, "해당없음"),
    "signal_word": valued("위험", "기재"), "supplier": {"company_name": None, "address": "x", "emergency_phone": None},
    "ingredients": [{"chemical_name": "e", "cas_number": "64-17-5", "ke_number": None, "content": "10", "is_substitute_data": False}],
    "ghs_classification": [{"hazard_class": "x", "category": "구분 1A"}], "hazard_statements": [{"code": "H225", "text": "t"}],
    "list_status": {"ingredients": "기재", "ghs_classification": "기재", "hazard_statements": "기재"},
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    *way, last = path
    at = out
    for p in way:
        at = at[p]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return out


CASES = [
    (GOOD, []),
    (changed(["product_name", "value"], ""), [("product_name", "value_error")]),
    (changed(["product_name", "value"], 3), [("product_name.value", "string_type")]),
    (changed(["signal_word", "value"], "DANGER"), [("signal_word.value", "value_error")]),
    (changed(["signal_word", "source_status"], "x"), [("signal_word.source_status", "literal_error")]),
    (changed(["supplier", "address"], KeyError), [("supplier.address", "missing")]),
    (changed(["supplier"], None), [("supplier", "object_type")]),
    (changed(["ingredients", 0, "cas_number"], "64-17-6"), [("ingredients.0.cas_number", "value_error")]),
    (changed(["ingredients", 0, "is_substitute_data"], True), [("ingredients.0", "value_error")]),
    (changed(["ingredients", 0, "is_substitute_data"], "yes"), [("ingredients.0.is_substitute_data", "bool_type")]),
    (changed(["ingredients", 0, "more"], 1), [("ingredients.0.more", "extra_forbidden")]),
    (changed(["ingredients"], []), [("", "value_error")]),
    (changed(["ingredients"], [3]), [("ingredients.0", "object_type")]),
    (changed(["hazard_statements"], None), [("hazard_statements", "list_type")]),
    (changed(["ghs_classification", 0, "category"], "2"), [("ghs_classification.0.category", "value_error")]),
    (changed(["hazard_statements", 0, "code"], "X"), [("hazard_statements.0.code", "value_error")]),
    (changed(["note"], 1), [("note", "extra_forbidden")]),
    ([1], [("", "object_type")]),
]


def test_schema_finds_each_error(spark):
    rows = [(n, json.dumps(d, ensure_ascii=False)) for n, (d, _) in enumerate(CASES)] + [(98, "x"), (99, None)]
    got = {}
    for r in schema.validate(spark.createDataFrame(rows, "doc_id int, json string")).collect():
        got.setdefault(r.doc_id, []).append((r["loc"], r["type"]))
    assert got.pop(98) == got.pop(99) == [("", "json_invalid")]
    assert got == {n: want for n, (_, want) in enumerate(CASES) if want}


def test_keys(spark):
    c = F.col("c")
    assert one(spark, textnorm.product_name_key(c), c="Ｅpoxy (a (b)), [x] Z·1") == "epoxyz1"
    assert one(spark, textnorm.cas_key(c), c="64–17‐5 ") == "64-17-5" and one(spark, textnorm.cas_key(c), c=" ") is None
    category = {"구분2": "구분 2", "Category 1 b": "구분 1B", "구분1(1A/1B)": "구분 1", "Refrigerated liquefied gas": "냉동액화가스", "1.1류": "1.1류", "-": None, None: None}
    assert {k: one(spark, textnorm.category_key(c), c=k) for k in category} == category
    assert one(spark, textnorm.is_sentinel(c), c=" N/A ") and one(spark, textnorm.is_sentinel(c), c="") and not one(spark, textnorm.is_sentinel(c), c=None)
    assert one(spark, textnorm.ec_check_digit(c), c="200578") == 6
    assert one(spark, textnorm.safe_url(c), c="javascript:x") == "" and one(spark, textnorm.safe_url(c), c="https://x") == "https://x"
    equal = lambda a, b: one(spark, textnorm.content_equal(F.col("a"), F.col("b")), a=a, b=b)
    assert equal("10 ~ 20", "10~20 %") and equal(None, None) and not equal(None, "1") and equal("n a", "na") and not equal("1", "2")


def test_lenient_json(spark):
    got = lambda t: tuple(one(spark, lenient_json.extract(F.col("c")), c=t))
    assert got('<think>{</think>```json\n{"a": 1}\n```') == ('{"a": 1}', None) and got('so {"a":1} ok') == ('{"a":1}', None)
    assert got("[1]") == (None, "not_object") and got("no") == (None, "not_json") and got(None) == got(" ") == (None, "empty")


def test_evidence_prefers_labelled_lines(spark):
    text = "요소\n가. 제품명\n\n - 요소\n신호어: 경고\n10 % 이상～20"
    labels = F.array(F.lit("제품명"))
    at = lambda v, *more: tuple(one(spark, evidence.locate(F.col("t"), F.col("v"), *more), t=text, v=v))
    assert at("요소", labels) == (True, "exact", "가. 제품명\n- 요소") and at("요소") == (True, "exact", "요소")
    assert at("10%이상~20") == (True, "normalized", None) and at("zz") == at("") == at(None) == (False, "not_found", None)
    assert one(spark, evidence.page_of(F.split("p", r"\|"), F.col("v")), p="xx|제제품품명 yy|z", v="제품명\nq") == 2


def plain_chain(text):
    """Best score over all increasing subsequences of candidate lines, by trying every one."""
    found = []
    for i, line in enumerate(text.split("\n")):
        m = re.match(r"(#* *)([0-9]+)\. (.+)", line)
        if m:
            word = re.search(headings.KEYWORDS[int(m[2])], m[3].lower()) is not None
            found.append((i, int(m[2]), 1 + 2 * word + bool(m[1]), word or bool(m[1])))
    best = 0
    for mask in range(1, 1 << len(found)):
        own = [f for k, f in enumerate(found) if mask >> k & 1]
        ok = own[0][1] == 1 or own[0][3]
        ok = ok and all(a[1] < b[1] and (b[3] or b[1] == a[1] + 1) for a, b in zip(own, own[1:], strict=False))
        best = max(best, sum(f[2] for f in own) if ok else 0)
    return best


def test_heading_chain_is_best(spark):
    rng = random.Random(3)
    words = ["x", "hazards", "first aid", "composition", "identification"]
    texts = ["\n".join(f"{rng.choice(['', '', '# '])}{rng.randint(1, 5)}. {rng.choice(words)}" for _ in range(rng.randint(0, 8))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = df.select("doc_id", headings.candidates(F.col("text")).alias("c"), headings.chain(F.col("text")).alias("chain")).collect()
    for r in rows:
        score = {c["line"]: c["score"] for c in r["c"]}
        assert sum(score[x["line"]] for x in r["chain"]) == plain_chain(texts[r["doc_id"]])
    got = headings.sections(spark.createDataFrame([(1, "a\n1. Identification\nb\n2. Hazards"), (2, None), (3, "")], "doc_id int, text string"))
    assert sorted((r.doc_id, r.section, r.body) for r in got.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "")]


def test_variants_keep_protected_tokens(spark):
    docs = spark.createDataFrame([(k, KOREAN) for k in range(20)] + [(20, None), (21, "")], "doc_id int, text string")
    made = augment.variants(docs, list(augment.RENDERERS))
    assert {r.variant for r in made.collect()} == set(augment.RENDERERS)
    for name in augment.RENDERERS:
        after = made.where(F.col("variant") == name)
        assert augment.token_changes(docs.join(after.select("doc_id"), "doc_id"), after).count() == 0
    assert all("(흡입: 가스)" in r.text for r in made.collect())
    lost = docs.withColumn("text", F.replace("text", F.lit("이상"), F.lit("")))
    assert {tuple(r)[1:] for r in augment.token_changes(docs, lost).collect()} == {("bound", "이상", 1, 0)}


def test_assembled_variants(spark):
    kind = "doc_id int, split string, form string, text string, ingredients array<struct<name:string,cas:string,ke:string,is_sub:boolean>>, statements array<struct<code:string,text:string>>"
    ing, haz = [("e", "64-17-5", "KE-12345", False)], [("H302", "t")]
    rows = [(1, "train", "a", KOREAN + "H302 t\n", ing, haz), (2, "val", "a", KOREAN, ing, haz), (3, "train", "b", "plain", [], []), (4, "train", "b", None, [], [])]
    made = augment.assemble(spark.createDataFrame(rows, kind))
    got = {(r.doc_id, r.variant): r for r in made.collect()}
    assert {v for d, v in got if d == 1} == {"orig", *augment.RENDERERS, "secret1", "nohcode"} and {v for d, v in got if d == 2} == {"orig", *augment.RENDERERS}
    assert all(got[1, v].state == "made" for v in ["orig", "secret1", "nohcode", "bullet", "colon"]) and got[3, "secret1"].state == "not_applicable"
    assert got[3, "bullet"].state == "rejected" and got[3, "bullet"].text is None and (4, "orig") not in got
    assert "64-17-5" not in got[1, "secret1"].text and "H302" not in got[1, "nohcode"].text
    for d in (1, 2):
        texts = [r.text for (k, _), r in got.items() if k == d and r.text is not None]
        assert len(texts) == len(set(texts))
    report = {r.form: r for r in augment.build_report(made).collect()}
    assert report["all"].n_docs == 3 and report["b"].n_examples == 1 and report["all"].n_examples == sum(r.state == "made" for r in got.values())


def test_mutators(spark):
    row = spark.createDataFrame([(KOREAN, [("e", "64-17-5", "KE-12345", False)])], "text string, ing array<struct<name:string,cas:string,ke:string,is_sub:boolean>>")
    m = row.select(augment.mask_ingredient(F.col("text"), F.col("ing"), F.lit(1)).alias("m")).first()["m"]
    assert "64-17-5" not in m["text"] and "KE-12345" not in m["text"] and m["ingredients"][0]["is_sub"] and m["gone"] == ["64-17-5", "KE-12345"]
    ec = row.select(augment.add_ec_numbers(F.col("text"), F.array(F.lit("64-17-5")), F.lit(1)).alias("t")).first()["t"]
    a, b, check = re.search(r"64-17-5 (\d{3})-(\d{3})-(\d)", ec).groups()
    assert sum((k + 1) * int(x) for k, x in enumerate(a + b)) % 11 == int(check)
    codes = F.expr("array(named_struct('code', 'H302', 'text', 't'))")
    assert one(spark, augment.drop_codes(F.col("t"), codes), t="H302+H332: bad")["text"] == "bad"


def test_review(spark):
    findings = spark.createDataFrame(
        [(1, "$.ingredients[0].cas", "cas", "error"), (1, "$.signal_word", "not_found", "warning"), (2, "$.ingredients", "evidence", "info")],
        "doc_id int, field string, check_name string, severity string",
    )
    fields = spark.createDataFrame([(1, "ingredients"), (1, "signal_word"), (2, "ingredients")], "doc_id int, field string")
    got = {(r[0], r[1]): tuple(r)[2:] for r in review.field_status(findings, fields).collect()}
    assert got == {(1, "ingredients"): ("REVIEW_REQUIRED", "FORMAT_ERROR", 1), (1, "signal_word"): ("SOURCE_CHECK_REQUIRED", None, 1), (2, "ingredients"): ("OK", None, 0)}
    saves = spark.createDataFrame([(1, 7, {"a": "x"}, {"l": "y"})], "document_id int, batch int, fields map<string,string>, states map<string,string>")
    assert sorted(tuple(r) for r in review.save_events(saves).collect()) == [(1, "a", "x", 7), (1, "list_status.l", "y", 7)]
    files = spark.createDataFrame([("a", b"%PDF-1"), ("b", b"zip"), ("c", b"%PDF-2"), ("d", None)], "path string, content binary")
    sealed = files.where("path = 'c'").select(F.sha2("content", 256).alias("sha256"))
    assert {r.path: r.reason for r in review.upload_gate(files, sealed).collect()} == {"a": None, "b": "not_pdf", "c": "sealed", "d": "not_pdf"}


def test_governance(spark):
    splits = spark.createDataFrame(
        [("a", "train", "ko", "g", "f"), ("a", "val", "ko", "g", "f"), ("b!", "test", "en", "h", "f"), ("c", "val", "en", "i", "f")],
        "doc_id string, split string, lang string, grp string, form string",
    )
    examples = spark.createDataFrame([("c",)], "doc_id string")
    got = {tuple(r) for r in governance.split_violations(splits, examples, "ko", ["train", "val"], "import", examples).collect()}
    assert got == {("repeated_id", "a"), ("malformed_id", "b!"), ("unknown_split", "b!"), ("other_language", "c"), ("group_in_two_splits", "g"),
                   ("example_not_in_train", "c"), ("form_not_in_val", "import"), ("no_label", "a")}
    with pytest.raises(ValueError):
        governance.require_none(splits, "rows")
    bag = records.bag_difference(splits, splits.dropDuplicates(["doc_id"]), "doc_id")
    assert [tuple(r) for r in bag.collect()] == [("a", 2, 1)]
    a, b = (spark.createDataFrame([("n", v)], "name string, value string") for v in "xy")
    assert governance.config_changes(a, a).count() == 0 and governance.config_changes(a, b).count() == 1


def test_retrieval(spark):
    n = spark.range(1).select(retrieval.chunks_wanted(F.lit(0), F.lit(False)), retrieval.chunks_wanted(F.lit(1), F.lit(True)), retrieval.chunks_wanted(F.lit(9), F.lit(True))).first()
    assert tuple(n) == (8, 4, 1)


def test_worsened_and_fabricated(spark):
    m = lambda *rows: spark.createDataFrame(rows, "metric string, value double")
    got = {r.metric: r.state for r in scoring.worsened(m(("cas_f1", 0.5), ("pair_f1", 0.2)), m(("cas_f1", 0.4), ("schema_rate", 1.0))).collect()}
    assert got == {"cas_f1": "worse", "pair_f1": "unknown", "schema_rate": "unknown"}
    values = spark.createDataFrame([(1, "hcode", "H300"), (1, "hcode", "H301"), (1, "cas", "64-17-5"), (1, "cas", "50-00-0")], "doc_id int, kind string, value string")
    source = spark.createDataFrame([(1, "H301 64-17-\n9")], "doc_id int, text string")
    assert {r.value for r in scoring.fabricated(values, source, "doc_id").collect()} == {"H300", "50-00-0"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    writers.commit_tables({"a": df, "b": df}, f"{tmp_path}/db", "r1")
    df.write.parquet(f"{tmp_path}/db/a/run=r2")  # never committed
    assert writers.committed(spark, f"{tmp_path}/db", "a", "id int, v string").count() == 2
    assert writers.write_once(df, f"{tmp_path}/once") and not writers.write_once(df.limit(1), f"{tmp_path}/once")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 2
    writers.export_json(df, f"{tmp_path}/json", ["id"], ["v"])
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/json").collect()) == ['{"v":"x"}', '{"v":"y"}']
    (tmp_path / "log.jsonl").write_text('{"doc_id": "a", "n": 1}\n\n{"doc_id": "a", "n": 2}\n{"model": "m"}\n')
    head, rows = readers.header_and_rows(spark, f"{tmp_path}/log.jsonl", "model string", "doc_id string, n int")
    assert [r.model for r in head.collect()] == ["m"] and rows.count() == 2
    assert {(r.doc_id, r.n) for r in readers.last_record(spark, f"{tmp_path}/log.jsonl", "doc_id string, n int", "doc_id").where("doc_id is not null").collect()} == {("a", 2)}
    with pytest.raises(ValueError):
        readers.unique_by(df.union(df), "id")
