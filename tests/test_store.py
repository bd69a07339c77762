"""Records flattened and nested again: round trips, order of items, odd texts; saved reviews with evidence and resolved findings."""

import json

from dossier.operators import store

GOOD = {
    "product_name": {"value": "p \"q\" é", "source_status": "기재"}, "recommended_use": {"value": None, "source_status": "자료없음"},
    "use_restrictions": {"value": None, "source_status": "해당없음"}, "signal_word": {"value": "위험", "source_status": "기재"},
    "supplier": {"company_name": "c", "address": None, "emergency_phone": "1"},
    "ingredients": [{"chemical_name": f"n{k}", "cas_number": None, "ke_number": "KE", "content": "1~2", "is_substitute_data": k == 2} for k in range(12)],
    "ghs_classification": [], "hazard_statements": [{"code": "H225", "text": "x"}, {"code": None, "text": "x"}, {"code": "H225", "text": "x"}],
    "list_status": {"ingredients": "기재", "ghs_classification": "자료없음", "hazard_statements": "기재"},
}


def test_round_trip(spark):
    bare = {**GOOD, "ingredients": [], "hazard_statements": []}
    lacking = {k: v for k, v in GOOD.items() if k not in ("supplier", "ingredients")}
    rows = [(1, json.dumps(GOOD, ensure_ascii=False)), (2, json.dumps(bare)), (3, "no json"), (4, None), (5, "[1]"), (6, json.dumps(lacking)), (7, json.dumps({**GOOD, "extra": 1}))]
    df = spark.createDataFrame(rows, "doc_id long, json string")
    tables = store.flattened(df)
    assert tables["ingredients"].where("doc_id = 1").orderBy("seq").select("seq", "chemical_name").collect() == [(k + 1, f"n{k}") for k in range(12)]
    got = {r.doc_id: r.record for r in store.renested(tables).collect()}
    assert got[1] == json.dumps(GOOD, ensure_ascii=False, separators=(",", ":")) and json.loads(got[2]) == bare
    assert got[3] is got[4] is got[5] is None and json.loads(got[7]) == GOOD
    assert json.loads(got[6]) == {**GOOD, "ingredients": [], "supplier": {"company_name": None, "address": None, "emergency_phone": None}}
    assert store.renested(store.flattened(df.limit(0))).count() == 0


def test_saved_reviews(spark):
    saved = spark.createDataFrame([(1, "cas", "a", True), (1, "name", "b", False), (2, "cas", None, True)], "document_id long, field_path string, value string, confirmed boolean")
    evidence = spark.createDataFrame([(1, "cas", "line"), (1, "name", None), (3, "cas", "x")], "document_id long, field_path string, snippet string")
    findings = spark.createDataFrame([(1, "cas", "F1"), (1, "cas", "F2"), (1, "name", "F3")], "document_id long, field_path string, code string")
    got = sorted(map(tuple, store.confirmed_rows(saved, evidence, findings).collect()), key=str)
    assert got == sorted([
        (1, "cas", "confirmed", "a"), (1, "name", "edited", "b"), (2, "cas", "confirmed", None), (1, "cas", "evidence", "line"),
        (1, "cas", "resolved", "F1"), (1, "cas", "resolved", "F2"),
    ], key=str)
