"""The rule engine: nine checks, each of which returns findings (doc_id, seq, check_name, severity, code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dossier.functions.chem import HCODE, cas_checksum_ok, cas_format_ok, content_lower, norm_phrase
from dossier.functions.textnorm import is_sentinel, strip

from .evidence import flat

#: Order of severities and of checks, and the checks of consistency.
SEVERITIES = ["error", "warning", "info"]
CHECKS = ["schema", "empty_value", "not_found", "evidence", "cas", "hcode", "phrase_to_hcode", "ghs_signal_hcode_consistency", "content_sum"]
CONSISTENCY = ["ghs_signal_hcode_consistency", "phrase_to_hcode"]


def finding(df: DataFrame, check: str, severity: Column | str, code: Column | str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(None).cast("long")
    return df.select(
        "doc_id", seq.alias("seq"), F.lit(check).alias("check_name"), lit(severity).alias("severity"), lit(code).alias("code")
    )


def bad_cas(cas: Column) -> Column:
    """What is wrong with an identifier; null where nothing is."""
    return F.when(~cas_format_ok(cas), "CAS_FORMAT_INVALID").when(~cas_checksum_ok(cas), "CAS_CHECKSUM_INVALID")


def check_cas(ingredients: DataFrame) -> DataFrame:
    return finding(ingredients.withColumn("bad", bad_cas(F.col("cas"))).where("bad is not null"), "cas", "error", F.col("bad"))


def check_hcode(statements: DataFrame, phrases: DataFrame) -> DataFrame:
    known = phrases.select("code").distinct().withColumn("known", F.lit(True))
    found = statements.join(known, "code", "left")
    malformed = ~F.col("code").rlike(HCODE)
    code = F.when(malformed, "HCODE_FORMAT_INVALID").when(F.col("known").isNull(), "HCODE_UNKNOWN_CODE")
    found = found.where(F.col("code").isNotNull()).withColumn("bad", code).where("bad is not null")
    return finding(found, "hcode", F.when(F.col("bad") == "HCODE_FORMAT_INVALID", "error").otherwise("warning"), F.col("bad"))


def check_schema(violations: DataFrame) -> DataFrame:
    """A finding for each error (doc_id, loc, type) of a record's structure."""
    return finding(violations, "schema", "error", "SCHEMA_FIELD_INVALID")


def check_empty(values: DataFrame) -> DataFrame:
    """Values (doc_id, name, value, source_status) that are said to be there and are blank or a word for none."""
    suspect = values.where((F.col("source_status") == "기재") & F.col("value").isNotNull() & is_sentinel(F.col("value")))
    return finding(suspect, "empty_value", "warning", "EMPTY_VALUE_SUSPECT")


def check_not_found(located: DataFrame) -> DataFrame:
    """Values (doc_id, found) that their source text lacks."""
    return finding(located.where("not found"), "not_found", "warning", "VALUE_NOT_FOUND_IN_SOURCE")


def check_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents without a source text (doc_id, text): their evidence is skipped."""
    own = docs.select("doc_id").join(sources.where("text <> ''").select("doc_id"), "doc_id", "left_anti")
    return finding(own, "evidence", "info", "EVIDENCE_SKIPPED_NO_SOURCE")


def check_phrase(statements: DataFrame, phrases: DataFrame) -> DataFrame:
    """Statements whose text is none of the phrases (code, phrase) accepted for their code."""
    accepted = phrases.groupBy("code").agg(F.collect_set(norm_phrase(F.col("phrase"))).alias("accepted"))
    found = statements.where(F.col("text").isNotNull()).join(accepted, "code")
    return finding(found.where(~F.array_contains("accepted", norm_phrase(F.col("text")))), "phrase_to_hcode", "error", "HCODE_PHRASE_MISMATCH")


def codes_by_phrase(phrases: DataFrame) -> DataFrame:
    """phrase, code: the first code, in the table's order (row_no), that has each phrase."""
    return phrases.groupBy(strip(F.col("phrase")).alias("phrase")).agg(F.min_by("code", "row_no").alias("code"))


def actual_codes(statements: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, code: the parts of each statement's code; of a statement without one, the code that its text is a phrase of."""
    own = statements.where("code <> ''").select("doc_id", F.explode(F.split("code", r"\+")).alias("code"))
    bare = statements.where("coalesce(code, '') = ''").select("doc_id", strip(F.col("text")).alias("phrase"))
    return own.union(bare.join(codes_by_phrase(phrases), "phrase").select("doc_id", "code")).distinct()


def check_signal(classes: DataFrame, statements: DataFrame, signals: DataFrame, dim: DataFrame, phrases: DataFrame) -> DataFrame:
    """Classes against the lookup table (hazard_class, category, signal_word, codes), their expected codes against the
    statements' and these against them, and the strongest expected signal word against the document's."""
    check, rank = "ghs_signal_hcode_consistency", F.when(F.col("expected_word") == "위험", 2).when(F.col("expected_word") == "경고", 1).otherwise(0)
    stated = actual_codes(statements, phrases).groupBy("doc_id").agg(F.collect_set("code").alias("stated"))
    looked_up = classes.join(dim.withColumnRenamed("signal_word", "expected_word"), ["hazard_class", "category"], "left")
    unknown = finding(looked_up.where("codes is null"), check, "info", "CLASSIFICATION_NOT_IN_TABLE")
    known = looked_up.where("codes is not null").withColumn("expected", F.split("codes", r"\|"))
    none = F.coalesce("stated", F.array().cast("array<string>"))
    missing = known.join(stated, "doc_id", "left").where("codes <> ''").where(~F.arrays_overlap("expected", none))
    per_doc = known.groupBy("doc_id").agg(F.max(rank).alias("want"), F.array_distinct(F.flatten(F.collect_set("expected"))).alias("expected"))
    per_doc = per_doc.join(stated, "doc_id", "left").join(signals.select("doc_id", "signal_word"), "doc_id", "left")
    expected_word = F.when(F.col("want") == 2, "위험").when(F.col("want") == 1, "경고")
    word = per_doc.where(~F.col("signal_word").eqNullSafe(expected_word))
    unexplained = per_doc.where(F.size(F.array_except(none, "expected")) > 0)
    return (
        unknown.union(finding(missing, check, "error", "HCODE_MISSING_FOR_CLASSIFICATION"))
        .union(finding(unexplained, check, "error", "HCODE_MISSING_FOR_CLASSIFICATION"))
        .union(finding(word, check, "error", "SIGNAL_WORD_MISMATCH"))
    )


def check_content_sum(ingredients: DataFrame) -> DataFrame:
    low = content_lower(F.col("content"))
    unread = finding(ingredients.where(F.col("content").isNotNull() & low.isNull()), "content_sum", "warning", "CONTENT_SUM_UNPARSEABLE")
    total = ingredients.groupBy("doc_id").agg(F.sum(low).alias("total")).where("total > 100.5")
    return unread.union(finding(total, "content_sum", "error", "CONTENT_SUM_EXCEEDS_100"))


#: Rows of a record that the checks look at; a row may be several of them at once.
ITEM = {
    "seq": "bigint", "cas": "string", "content": "string", "value": "string", "is_class": "boolean", "hazard_class": "string",
    "category": "string", "is_statement": "boolean", "code": "string", "text": "string", "line": "string",
}


def found(cond: Column, check: str, severity: Column | str, code: Column | str, seq: Column | None = None) -> Column:
    """A finding, or null where the condition doesn't hold."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    seq = F.lit(None).cast("bigint") if seq is None else seq.cast("bigint")
    return F.when(cond, F.struct(seq.alias("seq"), F.lit(check).alias("check_name"), lit(severity).alias("severity"), lit(code).alias("code")))


def one_pass(items: DataFrame, records: DataFrame, dim: DataFrame, phrases: DataFrame, partitions: int | None = None) -> DataFrame:
    """The findings (doc_id, seq, check_name, severity, code) of all nine checks, reading each table once.

    items: doc_id and the columns of ITEM, a row for each ingredient (cas, content, and value to be found in the source), class,
    statement and source line; columns that are lacking count as null. records: a row for each document that is checked
    (doc_id, problems of its structure, values, signal_word). dim and phrases are lookup tables, joined on their keys.

    Records are rows beside the items, so that nothing is joined by document. partitions: how many they are dealt into by
    document, which should grow with the tables; findings that are then gathered by document stay there."""
    items = items.withColumns({c: F.lit(None).cast(t) for c, t in ITEM.items() if c not in items.columns})
    seq, code = F.col("seq"), F.col("code")
    stated = F.coalesce("is_statement", F.lit(False))
    known = phrases.groupBy("code").agg(F.collect_set(norm_phrase(F.col("phrase"))).alias("accepted")).withColumnRenamed("code", "_code")
    named = codes_by_phrase(phrases).select(F.col("phrase").alias("_phrase"), F.col("code").alias("_named"))
    table = dim.select(F.col("hazard_class").alias("_class"), F.col("category").alias("_category"), "codes", F.col("signal_word").alias("_word"))
    bare = F.when(stated & (F.coalesce("code", F.lit("")) == ""), strip(F.col("text")))
    own = items.withColumn("_bare", bare).join(known, stated & (code == F.col("_code")), "left").join(named, F.col("_bare") == F.col("_phrase"), "left")
    own = own.join(table, F.col("is_class") & (F.col("hazard_class") == F.col("_class")) & (F.col("category") == F.col("_category")), "left")

    low, is_class = content_lower(F.col("content")), F.coalesce("is_class", F.lit(False))
    malformed, wrong = ~code.rlike(HCODE), bad_cas(F.col("cas"))
    bad_code = F.when(malformed, "HCODE_FORMAT_INVALID").when(F.col("_code").isNull(), "HCODE_UNKNOWN_CODE")
    mismatch = stated & F.col("text").isNotNull() & ~F.array_contains("accepted", norm_phrase(F.col("text")))
    consistency = "ghs_signal_hcode_consistency"
    bad = [
        wrong.alias("wrong"), F.when(stated & code.isNotNull(), bad_code).alias("bad_code"), malformed.alias("malformed"), mismatch.alias("mismatch"),
        (F.col("content").isNotNull() & F.col("low").isNull()).alias("unread"), (is_class & F.col("codes").isNull()).alias("unlisted"),
    ]
    codes = F.when(stated & (code != ""), F.split("code", r"\+")).when(F.col("_named").isNotNull(), F.array("_named"))
    listed = is_class & F.col("codes").isNotNull()
    rank = F.when(listed, F.when(F.col("_word") == "위험", 2).when(F.col("_word") == "경고", 1).otherwise(0))
    rows = own.withColumn("low", low).select(
        "doc_id", "seq", "low", codes.alias("stated"), F.when(listed, F.split("codes", r"\|")).alias("expected"), (F.col("codes") != "").alias("some"),
        rank.alias("rank"), "value", "line", flat(F.col("line")).alias("flat_line"), *bad,
    )
    told = records.select("doc_id", "signal_word", F.lit(True).alias("is_record"), problem_count(F.col("problems")).alias("n_schema"), empty_count(F.col("values")).alias("n_empty"))
    both = rows.unionByName(told, allowMissingColumns=True)
    return of_documents(both if partitions is None else both.repartition(partitions, "doc_id"), consistency)


def problem_count(problems: Column) -> Column:
    """Findings of a record's structure; a list of unknown keys is one for each."""
    n = lambda p: F.when(p.isNotNull(), F.greatest(F.lit(1), F.coalesce(F.size(p["keys"]), F.lit(1)))).otherwise(0)
    return F.coalesce(F.aggregate(problems, F.lit(0), lambda acc, p: acc + n(p)), F.lit(0))


def empty_count(values: Column) -> Column:
    suspect = lambda v: (v["source_status"] == "기재") & v["value"].isNotNull() & is_sentinel(v["value"])
    return F.coalesce(F.size(F.filter(values, suspect)), F.lit(0))


def lines_over(every: WindowSpec) -> list[Column]:
    """A document's source, from its rows' lines as they are and without white space."""
    return [F.array_join(F.collect_list("line").over(every), "\n").alias("lines"), F.array_join(F.collect_list("flat_line").over(every), "").alias("flat_lines")]


def stands(v: Column) -> Column:
    """Whether a value stands in a line, or in the lines without white space."""
    in_line = ~v.contains("\n") & F.col("lines").contains(v)
    return (v != "") & (F.col("flat_lines") != "") & (in_line | ((flat(v) != "") & F.col("flat_lines").contains(flat(v))))


def check_lines(items: DataFrame) -> DataFrame:
    """Values of rows (doc_id, seq, value, line) that the lines of their document lack, as `check_not_found` has them; a window
    over the document, so that rows which come dealt by document stay there. Documents without a line have no source to look in."""
    every = Window.partitionBy("doc_id").orderBy("seq", "line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = items.withColumn("flat_line", flat(F.col("line"))).select("doc_id", "seq", "value", *lines_over(every), F.count("line").over(every).alias("n_lines"))
    return check_not_found(rows.where("value is not null and n_lines > 0").withColumn("found", stands(F.col("value"))))


def of_documents(rows: DataFrame, consistency: str) -> DataFrame:
    """The findings of rows and their documents. What a row must know of its document (codes, source lines, sum) comes from a
    window over the document, so that rows stay where they were dealt; a document's own findings stand with its first row."""
    at = Window.partitionBy("doc_id").orderBy("seq", "line")
    every = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*", F.row_number().over(at).alias("_n"), F.flatten(F.collect_list("stated").over(every)).alias("all_stated"),
        F.flatten(F.collect_list("expected").over(every)).alias("explained"), F.count("expected").over(every).alias("n_classes"),
        F.sum("low").over(every).alias("total"), F.max("rank").over(every).alias("want"), F.max("signal_word").over(every).alias("word"),
        *lines_over(every),
        F.count("line").over(every).alias("n_lines"), F.max("is_record").over(every).alias("has_record"),
    )
    v, seq, first = F.col("value"), F.col("seq"), F.col("_n") == 1
    word = F.when(F.col("want") == 2, "위험").when(F.col("want") == 1, "경고")
    has_class = F.col("n_classes") > 0
    own = F.array(
        found(F.col("wrong").isNotNull(), "cas", "error", F.col("wrong"), seq),
        found(F.col("bad_code").isNotNull(), "hcode", F.when(F.col("malformed"), "error").otherwise("warning"), F.col("bad_code"), seq),
        found(F.col("mismatch"), "phrase_to_hcode", "error", "HCODE_PHRASE_MISMATCH", seq),
        found(F.col("unread"), "content_sum", "warning", "CONTENT_SUM_UNPARSEABLE", seq),
        found(F.col("unlisted"), consistency, "info", "CLASSIFICATION_NOT_IN_TABLE", seq),
        found(F.col("some") & ~F.arrays_overlap("expected", "all_stated"), consistency, "error", "HCODE_MISSING_FOR_CLASSIFICATION", seq),
        found(v.isNotNull() & ~stands(v), "not_found", "warning", "VALUE_NOT_FOUND_IN_SOURCE", seq),
        found(first & F.col("has_record") & (F.col("n_lines") == 0), "evidence", "info", "EVIDENCE_SKIPPED_NO_SOURCE"),
        found(first & (F.col("total") > 100.5), "content_sum", "error", "CONTENT_SUM_EXCEEDS_100"),
        found(first & has_class & (F.size(F.array_except("all_stated", "explained")) > 0), consistency, "error", "HCODE_MISSING_FOR_CLASSIFICATION"),
        found(first & has_class & ~F.col("word").eqNullSafe(word), consistency, "error", "SIGNAL_WORD_MISMATCH"),
    )
    many = lambda n, check, severity, code: F.array_repeat(found(F.lit(True), check, severity, code), F.coalesce(F.col(n), F.lit(0)))
    counted = [many("n_schema", "schema", "error", "SCHEMA_FIELD_INVALID"), many("n_empty", "empty_value", "warning", "EMPTY_VALUE_SUSPECT")]
    # A projection of its own, so that generated code makes the array; a generator would interpret it.
    made = rows.select("doc_id", F.concat(own, *counted).alias("made"))
    return made.select("doc_id", F.inline("made")).where("code is not null")


def _counted() -> list[Column]:
    is_error = F.col("severity") == "error"
    return [
        *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES),
        F.max(is_error & (F.col("check_name") == "schema")).alias("broken"), F.max(is_error & F.col("check_name").isin(CONSISTENCY)).alias("odd"),
    ]


def _state() -> Column:
    """An error of structure is graver than one of consistency, and that than any other error or warning."""
    return F.when(F.col("broken"), "SCHEMA_ERROR").when(F.col("odd"), "INCONSISTENT").when(F.col("n_error") + F.col("n_warning") > 0, "NEEDS_REVIEW").otherwise("OK")


def _ranked() -> Column:
    """A finding's place: by severity, then by check, then by place in the record."""
    at = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    return F.struct(at(SEVERITIES, "severity").alias("s"), at(CHECKS, "check_name").alias("c"), F.coalesce("seq", F.lit(0)).alias("seq"), "code")


def status(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Each document's state and its numbers of findings by severity."""
    n = findings.groupBy("doc_id").agg(*_counted())
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", *(zero(F.col(f"n_{s}")).alias(f"n_{s}") for s in SEVERITIES), _state().alias("status"))


def screens(findings: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, screen: what is shown of each record (doc_id, record as JSON), as one JSON text: state, findings in order, record."""
    shown = F.struct(_ranked().alias("at"), F.struct("check_name", "severity", "code", "seq").alias("finding"))
    n = findings.groupBy("doc_id").agg(*_counted(), F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["finding"]).alias("findings"))
    own = records.join(n, "doc_id", "left")
    found = F.coalesce(F.to_json("findings", {"ignoreNullFields": "false"}), F.lit("[]"))
    text = F.concat(F.lit('{"status":"'), _state(), F.lit('","findings":'), found, F.lit(',"record":'), F.coalesce("record", F.lit("null")), F.lit("}"))
    return own.select("doc_id", text.alias("screen"))


def in_order(findings: DataFrame) -> DataFrame:
    """doc_id and its findings' codes, by severity, then by check, then by place."""
    codes = F.transform(F.sort_array(F.collect_list(_ranked())), lambda x: x["code"])
    return findings.groupBy("doc_id").agg(F.array_join(codes, ",").alias("codes"))
