"""A record as flat tables and back: one row of single fields and states, and a row for each item of its three lists.

Defined results: text that is no record's JSON gives a row of nulls and no items, and comes back as null; keys that the record
hasn't are lost, lacking ones come back as null; an empty list and a lacking one have no items and come back as `[]`; items come
back in the order of seq; repeated keys are one record each only if the caller's key tells them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import nest
from .schema import LISTS, SUPPLIER, VALUE_FIELDS

TEXT, FLAG = {"text", "text?"}, "bool"
_VALUE = "struct<value:string,source_status:string>"


def record_type() -> str:
    """The record as a DDL type, its fields in the stored order."""
    items = {n: ",".join(f"{f}:{'boolean' if k == FLAG else 'string'}" for f, k in fields.items()) for n, fields in LISTS.items()}
    parts = [*(f"{n}:{_VALUE}" for n in VALUE_FIELDS), f"supplier:struct<{','.join(f'{f}:string' for f in SUPPLIER)}>"]
    parts += [*(f"{n}:array<struct<{x}>>" for n, x in items.items()), f"list_status:struct<{','.join(f'{n}:string' for n in LISTS)}>"]
    return f"struct<{','.join(parts)}>"


def flattened(records: DataFrame, key: str = "doc_id", json: str = "json") -> dict[str, DataFrame]:
    """`documents` (key, each field and its state, the supplier's fields, each list's state) and a table (key, seq, fields) for
    each list; the text is parsed once for each table that is read."""
    is_record = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>").isNotNull()
    own = records.select(key, is_record.alias("is_record"), F.from_json(json, record_type()).alias("r"))
    single = [c for n in VALUE_FIELDS for c in (F.col(f"r.{n}.value").alias(n), F.col(f"r.{n}.source_status").alias(f"{n}_status"))]
    single += [F.col(f"r.supplier.{f}").alias(f) for f in SUPPLIER] + [F.col(f"r.list_status.{n}").alias(f"{n}_status") for n in LISTS]
    tables = {"documents": own.select(key, "is_record", *single)}
    for n in LISTS:
        items = own.select(key, F.posexplode(f"r.{n}").alias("at", "item"))
        tables[n] = items.select(key, (F.col("at") + 1).alias("seq"), *(F.col(f"item.{f}").alias(f) for f in LISTS[n]))
    return tables


def renested(tables: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """key, record: the tables of `flattened` as JSON again."""
    out = tables["documents"]
    for n, fields in LISTS.items():
        items = nest(tables[n], key, "seq").select(key, F.transform("items", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(n))  # noqa: B023
        out = out.join(items, key, "left")
    lists = [F.coalesce(F.col(n), F.array().cast(dict(out.dtypes)[n])).alias(n) for n in LISTS]
    record = F.struct(
        *(F.struct(F.col(n).alias("value"), F.col(f"{n}_status").alias("source_status")).alias(n) for n in VALUE_FIELDS),
        F.struct(*SUPPLIER).alias("supplier"), *lists, F.struct(*(F.col(f"{n}_status").alias(n) for n in LISTS)).alias("list_status"),
    )
    return out.select(key, F.when(F.col("is_record"), F.to_json(record, {"ignoreNullFields": "false"})).alias("record"))


def confirmed_rows(saved: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """What saving a review of fields (document_id, field_path, value, confirmed) writes: its event, the evidence that was shown
    (document_id, field_path, snippet), and a `resolved` row for each finding (document_id, field_path, code) of a confirmed
    field; document_id, field_path, kind, body."""
    on = ["document_id", "field_path"]
    event = saved.select(*on, F.when(F.col("confirmed"), "confirmed").otherwise("edited").alias("kind"), F.col("value").alias("body"))
    shown = saved.select(*on).join(evidence.where("snippet is not null"), on).select(*on, F.lit("evidence").alias("kind"), F.col("snippet").alias("body"))
    done = saved.where("confirmed").select(*on).join(findings, on).select(*on, F.lit("resolved").alias("kind"), F.col("code").alias("body"))
    return event.unionByName(shown).unionByName(done)
