"""Validation of stored records (JSON text): every error as (loc, type), found by generated code over a VARIANT parsed once.

Types: missing, extra_forbidden, string_type, bool_type, list_type, object_type, literal_error, value_error. As in nested
models, the rule across a level's fields is looked at only if each of them is right."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.chem import HCODE, KE, cas_checksum_ok, let

#: The record's fields, states and categories.
STATES = ["기재", "자료없음", "해당없음"]
SIGNALS = ["위험", "경고"]
CATEGORY = "^구분 [0-9][A-C]?$|^(액화가스|압축가스|냉동액화가스|용해가스)$"
VALUE_FIELDS = ["product_name", "recommended_use", "use_restrictions", "signal_word"]
SUPPLIER = ["company_name", "address", "emergency_phone"]
LISTS = {
    "ingredients": {
        "chemical_name": "text", "cas_number": "text?", "ke_number": "text?", "content": "text?", "is_substitute_data": "bool",
    },
    "ghs_classification": {"hazard_class": "text", "category": "text?"},
    "hazard_statements": {"code": "text?", "text": "text"},
}
#: Types of fields, as a VARIANT's schema names them.
TYPES = {"text": "STRING", "text?": "(?:STRING|VOID)", "bool": "BOOLEAN"}


def _shape() -> str:
    """What `schema_of_variant` says of records whose fields, states and items all have the right types; whether the supplier
    lacks a field is left to be looked at, and items of longer lists, whose schema is that of all of them together."""
    text = TYPES["text?"]
    some = [", ".join(f"{f}: {text}" for f in fs) for n in range(len(SUPPLIER) + 1) for fs in combinations(sorted(SUPPLIER), n)]
    of = {
        **{n: f"OBJECT<source_status: STRING, value: {text}>" for n in VALUE_FIELDS},
        "supplier": f"OBJECT<(?:{'|'.join(some)})>", "list_status": f"OBJECT<{', '.join(f'{n}: STRING' for n in sorted(LISTS))}>",
    }
    of |= {n: f"ARRAY<(?:VOID|OBJECT<{', '.join(f'{f}: {TYPES[k]}' for f, k in sorted(fields.items()))}>)>" for n, fields in LISTS.items()}
    return f"^OBJECT<{', '.join(f'{n}: {of[n]}' for n in sorted(of))}>$"


#: The shape that most records have; only others are looked at type by type.
SHAPE = _shape()


def kind(v: Column, path: str) -> Column:
    """Null where the path is missing, VOID for a null there, else STRING, BOOLEAN, OBJECT<…>, ARRAY<…> and so on."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def error(cond: Column, loc, kind_: Column | str) -> Column:
    loc = F.lit(loc) if isinstance(loc, str) else loc
    kind_ = F.lit(kind_) if isinstance(kind_, str) else kind_
    return F.when(cond, F.struct(loc.alias("loc"), kind_.alias("type")))


def typed(v: Column, path: str, want: str, loc) -> Column:
    k = kind(v, path)
    name, ok = {
        "text": ("string_type", k == "STRING"), "text?": ("string_type", k.isin("STRING", "VOID")),
        "bool": ("bool_type", k == "BOOLEAN"), "list": ("list_type", k.startswith("ARRAY")),
        "object": ("object_type", k.startswith("OBJECT")),
    }[want]
    return error(k.isNull() | ~ok, loc, F.when(k.isNull(), "missing").otherwise(name))


def extra(v: Column, allowed: list[str], loc) -> Column:
    """An error for each key of an object that isn't allowed."""
    keys = F.json_object_keys(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)))
    more = F.array_except(keys, F.array(*(F.lit(x) for x in allowed)))
    return F.coalesce(F.transform(more, lambda k: F.struct(F.concat(loc, k).alias("loc"), F.lit("extra_forbidden").alias("type"))), _none())


def _none() -> Column:
    return F.array().cast("array<struct<loc:string,type:string>>")


def some(*errors: Column) -> Column:
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def then(first: Column, rule: Column) -> Column:
    """The first errors; where there are none, those of the rule across fields."""
    return let(first, lambda e: F.when(F.size(e) > 0, e).otherwise(some(rule)))


def _values(name: str, at: Column, get, substitute: Column) -> tuple[list[Column], Column]:
    """Errors of an item's texts (`get` of a field), and whether its fields contradict each other."""
    bad = lambda f, cond: error(cond, F.concat(at, F.lit(f)), "value_error")
    if name == "ingredients":
        errors = [bad("cas_number", ~F.coalesce(cas_checksum_ok(get("cas_number")), get("cas_number").isNull())), bad("ke_number", ~get("ke_number").rlike(KE))]
        return errors, substitute & get("cas_number").isNotNull()
    if name == "ghs_classification":
        return [bad("category", ~get("category").rlike(CATEGORY))], F.lit(False)
    return [bad("code", ~get("code").rlike(HCODE))], F.lit(False)


def item(name: str, i: Column, x: Column) -> Column:
    """Errors of one list item."""
    spec, at = LISTS[name], F.concat(F.lit(f"{name}."), i.cast("string"), F.lit("."))
    own = [typed(x, f"$.{f}", want, F.concat(at, F.lit(f))) for f, want in spec.items()]
    errors, rule = _values(name, at, lambda f: text(x, f"$.{f}"), F.try_variant_get(x, "$.is_substitute_data", "boolean"))
    whole = F.concat(F.lit(f"{name}."), i.cast("string"))
    found = then(F.concat(some(*own, *errors), extra(x, list(spec), at)), error(rule, whole, "value_error"))
    return F.when(F.schema_of_variant(x).startswith("OBJECT"), found).otherwise(some(error(F.lit(True), whole, "object_type")))


def only_item(v: Column, name: str) -> list[Column]:
    """Errors of a list's first item, in a record of the right shape."""
    get = lambda f: F.try_variant_get(v, f"$.{name}[0].{f}", "string")
    errors, rule = _values(name, F.lit(f"{name}.0."), get, F.try_variant_get(v, f"$.{name}[0].is_substitute_data", "boolean"))
    if name != "ingredients":
        return errors
    return [*errors, F.when(~reduce(or_, (e.isNotNull() for e in errors)), error(rule, f"{name}.0", "value_error"))]


def _items(name: str):
    return lambda x, i: item(name, i, x)


def found(cond: Column, loc: str, kind_: Column | str, keys: Column | None = None) -> Column:
    """struct(loc, type, keys) or null; keys, where there are some, stand for one error each, after loc."""
    kind_ = F.lit(kind_) if isinstance(kind_, str) else kind_
    keys = F.lit(None).cast("array<string>") if keys is None else keys
    return F.when(cond, F.struct(F.lit(loc).alias("loc"), kind_.alias("type"), keys.alias("keys")))


def leaf(k: Column, want: str, loc: str) -> Column:
    """The error of a text, from its kind."""
    ok = {"text": k == "STRING", "text?": k.isin("STRING", "VOID")}[want]
    return found(k.isNull() | ~ok, loc, F.when(k.isNull(), "missing").otherwise("string_type"))


def container(v: Column, own: Column, name: str, want: str) -> Column:
    """The error of a value that must be a list or an object (`own`, null where it is none); its contents aren't looked at."""
    missing = F.try_variant_get(v, f"$.{name}", "variant").isNull()
    return found(own.isNull(), name, F.when(missing, "missing").otherwise(f"{want}_type"))


def more_keys(own: Column, allowed: list[str], loc: str) -> Column:
    more = F.array_except(F.map_keys(own), F.array(*map(F.lit, allowed)))
    return found(F.size(more) > 0, loc, "extra_forbidden", more)


def _object(v: Column, own: Column, name: str, allowed: list[str], errors: list[Column], shaped: Column) -> list[Column]:
    """Errors of an object's fields and of its other keys; of the object itself where it is none."""
    inside = shaped | own.isNotNull()
    return [*(F.when(inside, e) for e in (*errors, more_keys(own, allowed, f"{name}."))), F.when(~shaped, container(v, own, name, "object"))]


def _value_field(v: Column, own: Column, name: str, k: dict, t: dict, shaped: Column) -> tuple[Column, Column]:
    """Errors of a value and its state, and whether the two contradict each other."""
    at_value, at_state = f"{name}.value", f"{name}.source_status"
    state, value = t[at_state], t[at_value]
    errors = [
        F.when(~shaped, leaf(k[at_value], "text?", at_value)), F.when(~shaped, leaf(k[at_state], "text", at_state)),
        found(~state.isin(STATES), at_state, "literal_error"),
    ]
    if name == "signal_word":
        errors.append(found(~value.isin(SIGNALS), at_value, "value_error"))
    blank = F.coalesce(value, F.lit("")) == ""
    wrong = ((state == "기재") & blank) | ((state != "기재") & value.isNotNull())
    there = shaped | own.isNotNull()
    return F.array(*_object(v, own, name, ["value", "source_status"], errors, shaped)), there & F.coalesce(wrong, F.lit(False))


def _any(e: Column) -> Column:
    return F.exists(e, lambda x: x.isNotNull())


def problems(records: DataFrame, key: str | list[str], json: str) -> DataFrame:
    """key (one column, or several that are kept), problems: an array of structs (loc, type, keys) and nulls.

    A record of the right shape, with lists of one item at most, is known from one text, its schema; types and keys are looked up in others alone.

    Each step is a projection of its own, so that what it names several times is worked out once, in generated code: the
    parsed text, its objects and lists, the errors of each part, then the rules that only hold where a part, or the record,
    has none. Only list items are looked at by a function over their array."""
    # Java compiles no method of more than 8000 bytes; fused into one, these projections would be interpreted.
    records.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    keys = [key] if isinstance(key, str) else key
    v, odd, shaped, objects = F.col("v"), F.col("odd"), F.col("shaped"), [*VALUE_FIELDS, "supplier", "list_status"]
    parsed = records.select(*keys, F.try_parse_json(json).alias("v"))
    parsed = parsed.select("*", F.coalesce(F.schema_of_variant(v).rlike(SHAPE), F.lit(False)).alias("shaped"))
    parsed = parsed.select("*", F.when(~shaped, v).alias("odd"))
    own = lambda n: F.try_variant_get(odd, f"$.{n}".removesuffix("."), "map<string,variant>")
    opened = parsed.select(
        *keys, "v", "odd", "shaped", own("").alias("o_"), *(own(n).alias(f"o_{n}") for n in objects),
        *(F.try_variant_get(v, f"$.{n}", "array<variant>").alias(f"l_{n}") for n in LISTS),
    )
    leaves = [f"{n}.{f}" for n in VALUE_FIELDS for f in ("value", "source_status")]
    leaves += [*(f"supplier.{f}" for f in SUPPLIER), *(f"list_status.{f}" for f in LISTS)]
    k, t = ({p: F.col(f"{of}{i}") for i, p in enumerate(leaves)} for of in "kt")
    opened = opened.select("*", *(kind(v if p.startswith("supplier") else odd, f"$.{p}").alias(f"k{i}") for i, p in enumerate(leaves)))
    opened = opened.select("*", *(F.when(shaped | (k[p] == "STRING"), F.try_variant_get(v, f"$.{p}", "string")).alias(f"t{i}") for i, p in enumerate(leaves)))
    o = lambda n: F.col(f"o_{n}")
    states = {n: t[f"list_status.{n}"] for n in LISTS}
    supplier = [leaf(k[f"supplier.{f}"], "text?", f"supplier.{f}") for f in SUPPLIER]
    list_status = [F.when(~shaped, leaf(k[f"list_status.{f}"], "text", f"list_status.{f}")) for f in LISTS]
    list_status += [found(~states[f].isin(STATES), f"list_status.{f}", "literal_error") for f in LISTS]
    top = [
        *_object(v, o("supplier"), "supplier", SUPPLIER, supplier, shaped), *_object(v, o("list_status"), "list_status", list(LISTS), list_status, shaped),
        *(container(v, F.col(f"l_{n}"), n, "list") for n in LISTS), more_keys(o(""), [*VALUE_FIELDS, "supplier", *LISTS, "list_status"], ""),
    ]
    broken = F.lit(False)
    for n in LISTS:
        size = F.size(f"l_{n}")
        broken = broken | F.coalesce(((states[n] == "기재") & (size == 0)) | ((states[n] != "기재") & (size > 0)), F.lit(False))
    fields = {n: _value_field(v, o(n), n, k, t, shaped) for n in VALUE_FIELDS}
    keyed = lambda e: F.struct(e["loc"].alias("loc"), e["type"].alias("type"), F.lit(None).cast("array<string>").alias("keys"))
    empty = F.array().cast("array<struct<loc:string,type:string,keys:array<string>>>")
    many = lambda n: ~shaped | (F.size(f"l_{n}") > 1) | (F.schema_of_variant(F.get(f"l_{n}", F.lit(0))) == "VOID")
    items = [F.coalesce(F.transform(F.flatten(F.transform(F.when(many(n), F.col(f"l_{n}")), _items(n))), keyed), empty) for n in LISTS]
    items += [F.array(*(F.when(~many(n) & (F.size(f"l_{n}") == 1), F.when(e.isNotNull(), keyed(e))) for e in only_item(v, n))) for n in LISTS]
    # The functions over items keep this projection out of whole-stage code, where it would be one method too long to compile.
    parts = opened.select(
        *keys, v.isNull().alias("unread"), (shaped | o("").isNotNull()).alias("is_object"), F.concat(*items).alias("items"), broken.alias("broken"),
        *(e.alias(f"e_{n}") for n, (e, _) in fields.items()), *(w.alias(f"wrong_{n}") for n, (_, w) in fields.items()), F.array(*top).alias("top"),
    )
    ruled = [F.array(found(F.col(f"wrong_{n}") & ~_any(F.col(f"e_{n}")), n, "value_error")) for n in VALUE_FIELDS]
    every = F.concat(*(f"e_{n}" for n in VALUE_FIELDS), *ruled, "top", "items")
    found_ = parts.select(*keys, "unread", "is_object", "broken", every.alias("every"))
    return found_.select(*keys, F.when(F.col("unread"), F.array(found(F.lit(True), "", "json_invalid"))).when(
        ~F.col("is_object"), F.array(found(F.lit(True), "", "object_type"))
    ).otherwise(F.concat("every", F.array(found(F.col("broken") & ~_any(F.col("every")), "", "value_error")))).alias("problems"))


def validate(records: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """key, loc, type: a row for each error."""
    rows = problems(records, key, json).select(key, F.inline_outer("problems")).where("loc is not null")
    rows = rows.select(key, "loc", "type", F.explode_outer("keys").alias("extra"))
    return rows.select(key, F.concat("loc", F.coalesce("extra", F.lit(""))).alias("loc"), "type")


def totals(records: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """One row: numbers of records, of those that are JSON, of valid and of wrong ones."""
    e = problems(records, key, json)
    invalid = F.coalesce(F.get("problems", F.lit(0))["type"] == "json_invalid", F.lit(False))
    state = e.select(_any(F.col("problems")).alias("bad"), invalid.alias("invalid"))
    return state.agg(
        F.count("*").alias("n_files"), F.count_if(~F.col("invalid")).alias("n_parsed"), F.count_if(~F.col("bad")).alias("n_ok"), F.count_if("bad").alias("n_bad"),
    )
