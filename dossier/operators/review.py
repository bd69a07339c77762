"""States of documents and fields on the review screen, review events, and which documents can be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.textnorm import top_field

#: The fields that are reviewed, and the checks of each kind.
CORE = ["product_name", "signal_word", "ingredients", "ghs_classification", "hazard_statements"]
FORMAT_CHECKS = ["schema", "cas", "hcode", "empty_value"]
CONSISTENCY_CHECKS = ["ghs_signal_hcode_consistency", "phrase_to_hcode"]
SOURCE_CHECKS = ["not_found", "content_sum"]


def document_status(n_confirmed: Column, pending: Column) -> Column:
    return (
        F.when(pending, "pending").when(n_confirmed == len(CORE), "confirmed").when(n_confirmed > 1, "needs_review").otherwise("unconfirmed")
    )


def field_status(findings: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, field, review_status, reason_code, n_findings for each row (doc_id, field) of fields; findings (doc_id, field
    as a path, check_name, severity) of severity info don't count."""
    own = findings.where("severity in ('error', 'warning')").withColumn("field", F.coalesce(top_field(F.col("field")), "field"))
    any_of = lambda names: F.max(F.col("check_name").isin(names))
    n = own.groupBy("doc_id", "field").agg(
        any_of(FORMAT_CHECKS).alias("bad_format"), any_of(CONSISTENCY_CHECKS).alias("bad_match"),
        any_of(SOURCE_CHECKS).alias("bad_source"), F.count("*").alias("n"),
    )
    state = F.when(F.col("bad_format") | F.col("bad_match"), "REVIEW_REQUIRED").when(F.col("bad_source"), "SOURCE_CHECK_REQUIRED").otherwise("OK")
    reason = F.when(F.col("bad_format"), "FORMAT_ERROR").when(F.col("bad_match"), "INCONSISTENT")
    return fields.select("doc_id", "field").join(n, ["doc_id", "field"], "left").select(
        "doc_id", "field", state.alias("review_status"), reason.alias("reason_code"), F.coalesce("n", F.lit(0)).cast("long").alias("n_findings")
    )


def badge(status: Column, has_evidence: Column, reviewed: Column, warned: Column) -> Column:
    return (
        F.when(reviewed, "confirmed").when(warned, "check_source").when(status != "OK", "review")
        .when(status.isNull(), "not_compared").when(has_evidence, "matches").otherwise("no_evidence")
    )


def can_confirm(status: Column, has_evidence: Column, pending: Column, confirmed: Column, reviewed: Column) -> Column:
    """Whether a field may be confirmed together with others, unseen."""
    return F.coalesce((status == "OK") & has_evidence & ~pending & ~confirmed & ~reviewed, F.lit(False))


def unverified_hazard(status: Column, evidence: Column, text: Column, code: Column, resolved: Column) -> Column:
    shown = F.coalesce(evidence, F.lit(""))
    absent = ~shown.contains(text) | F.coalesce((code != "") & ~shown.contains(code), F.lit(False))
    return F.when(resolved | (status != "SOURCE_CHECK_REQUIRED"), False).otherwise(absent)


def save_events(saves: DataFrame) -> DataFrame:
    """Events (document_id, field_path, confirmed_value, batch) of saved documents: one for each of the map `fields` and
    one for each list's state in the map `states`, all in the save's batch."""
    pairs = F.concat(
        F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("field_path"), e["value"].alias("confirmed_value"))),
        F.transform(
            F.map_entries("states"), lambda e: F.struct(F.concat(F.lit("list_status."), e["key"]).alias("field_path"), e["value"].alias("confirmed_value"))
        ),
    )
    return saves.select("document_id", "batch", F.inline(pairs)).select("document_id", "field_path", "confirmed_value", "batch")


def showable(docs: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents with all required values, and the others with the reason."""
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)), lambda x: x.isNotNull()), ",")
    own = docs.withColumn("missing", missing)
    return own.where("missing = ''").drop("missing"), own.where("missing <> ''").withColumn("reason", F.concat(F.lit("missing: "), "missing"))


def not_loaded(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't stored yet, one of each: loading twice adds nothing."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upload_gate(files: DataFrame, sealed: DataFrame, most_bytes: int = 30 << 20) -> DataFrame:
    """path, sha256, reason of files (path, content): `too_large`, `not_pdf`, `sealed`, or null where a file may be taken."""
    own = files.withColumn("sha256", F.sha2("content", 256)).withColumn("size", F.octet_length("content"))
    marked = own.join(sealed.select("sha256").distinct().withColumn("is_sealed", F.lit(True)), "sha256", "left")
    magic = F.coalesce(F.hex(F.substring("content", 1, 5)) == F.hex(F.lit("%PDF-")), F.lit(False))
    reason = F.when(F.col("size") > most_bytes, "too_large").when(~magic, "not_pdf").when(F.col("is_sealed"), "sealed")
    return marked.select("path", "sha256", reason.alias("reason"))


def question_gate(question: Column, most: int = 1000) -> Column:
    return F.coalesce((F.trim(question) != "") & (F.length(question) <= most), F.lit(False))


def confirmed_fields(events: DataFrame) -> DataFrame:
    """document_id, fields (sorted), complete: the core fields whose last event (document_id, field_path, action, id) confirms
    them; a later `unconfirm` takes one back. Only a complete document may be saved."""
    last = events.where(F.col("field_path").isin(CORE)).groupBy("document_id", "field_path").agg(F.max_by("action", "id").alias("action"))
    own = last.groupBy("document_id").agg(F.array_sort(F.collect_set(F.when(F.col("action") == "confirm", F.col("field_path")))).alias("own"))
    return own.select("document_id", F.array_join("own", ",").alias("fields"), (F.size("own") == len(CORE)).alias("complete"))


def bulk_confirm(fields: DataFrame) -> DataFrame:
    """Events that confirm all fields (document_id, field_path, status, has_evidence, pending, confirmed, reviewed) that may be
    confirmed unseen."""
    may = can_confirm(*(F.col(c) for c in ("status", "has_evidence", "pending", "confirmed", "reviewed")))
    return fields.where(may).select("document_id", "field_path", F.lit("confirm").alias("action"))
