"""Comparison keys of names, categories and identifiers.

Unicode compatibility forms (NFKC) aren't in Spark SQL: an Arrow function folds them, and only for values outside ASCII; the
rest stays in generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .chem import squash

#: Dashes that stand for a hyphen, marks left out of names, words of gas categories.
DASHES = "‐‑‒–—−"
NAME_MARKS = "[,，、;·ㆍ]"
GASES = {"refrigeratedliquefiedgas": "냉동액화가스", "liquefiedgas": "액화가스", "compressedgas": "압축가스", "dissolvedgas": "용해가스"}
NON_GHS = "(GHS 외"
SENTINELS = [
    "자료없음", "해당없음", "없음", "-", "--", "―", "‐", "미기재", "미상",
    "n/a", "na", "none", "unknown", "not available", "not applicable", "tbd",
]
#: Fixed value: an innermost bracketed note.
NOTE = r"\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）"


@F.pandas_udf(StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(c: Column) -> Column:
    """The compatibility form. Python sees an empty batch value where the text is plain ASCII."""
    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, c).otherwise(_folded(F.when(~plain, c)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key(c: Column, fold=nfkc) -> Column:
    return F.lower(squash(fold(c)))


def product_name_key(c: Column, fold=nfkc) -> Column:
    """A product's name without bracketed notes (from the inside out, however deep), list marks, white space and case."""
    s = fold(c)
    closing = F.length(F.regexp_replace(s, r"[^)\]）]", ""))  # no more rounds than closing brackets can change anything
    rounds = F.when(closing > 0, F.sequence(F.lit(1), closing)).otherwise(F.array().cast("array<int>"))
    bare = F.aggregate(rounds, s, lambda acc, _: F.regexp_replace(acc, NOTE, ""))
    return F.lower(squash(F.regexp_replace(bare, NAME_MARKS, "")))


def cas_key(c: Column, fold=nfkc) -> Column:
    """Hyphens for all dashes, no white space; null if nothing is left."""
    s = squash(F.translate(fold(c), DASHES, "-" * len(DASHES)))
    return F.when(s != "", s)


def category_key(c: Column, fold=nfkc) -> Column:
    """`구분 N` with its letter, a gas category, or the squashed text; null for nothing or a dash."""
    q = squash(F.regexp_replace(fold(c), r"\([^\n]*?\)", ""))
    low = F.lower(q)
    number = F.regexp_replace(q, r"(?i)구분|category|cat\.?", "")
    digit = F.regexp_extract(number, r"(?i)([0-9])([a-c])?", 1)
    out = F.when(q.isin("", "-", "—"), None).when(q.isin(*GASES.values()), q)
    for word, gas in GASES.items():  # the longest word comes first
        out = out.when(low.contains(word), gas)
    out = out.when(q.rlike("류|형"), q)
    letter = F.upper(F.regexp_extract(number, r"(?i)([0-9])([a-c])?", 2))
    return out.when(digit != "", F.concat(F.lit("구분 "), digit, letter)).otherwise(q)


def canonical_class(classes: DataFrame, aliases: DataFrame, column: str, fold=nfkc) -> DataFrame:
    """Rows with `canonical` and `known`: the name that the alias table (raw, canonical) gives a class, by the key of either
    (a later row wins for raw names, and these over canonical ones); a class that isn't there keeps its own, trimmed."""
    rows = aliases.where("trim(canonical) <> ''").withColumn("row_no", F.monotonically_increasing_id())
    named = lambda c, rank: rows.select(key(F.col(c), fold).alias("class_key"), F.struct(F.lit(rank), "row_no").alias("at"), strip(F.col("canonical")).alias("name"))
    table = named("raw", 1).union(named("canonical", 0)).groupBy("class_key").agg(F.max_by("name", "at").alias("name"))
    met = classes.withColumn("class_key", key(F.col(column), fold)).join(table, "class_key", "left").drop("class_key")
    return met.withColumn("known", F.col("name").isNotNull()).withColumn("canonical", F.coalesce("name", strip(F.col(column)))).drop("name")


def is_non_ghs(c: Column) -> Column:
    return F.coalesce(c.startswith(NON_GHS), F.lit(False))


def is_sentinel(c: Column) -> Column:
    """Blank text, or a word that stands for no value; null is none."""
    s = strip(c)
    return F.coalesce((s == "") | F.lower(s).isin(SENTINELS), F.lit(False))


def content_equal(a: Column, b: Column) -> Column:
    """Equal amounts, to a millionth; texts that can't be read are equal without white space."""
    from .chem import content_bounds

    x, y = content_bounds(a), content_bounds(b)
    near = (F.abs(x["lo"] - y["lo"]) < 1e-6) & (F.abs(x["hi"] - y["hi"]) < 1e-6)
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(x.isNotNull() & y.isNotNull(), near).otherwise(squash(a) == squash(b))
    )


def ke_misplaced(c: Column) -> Column:
    k = F.upper(squash(c))
    return F.coalesce((k != "") & ~k.rlike(r"^KE-[0-9]{3,6}$"), F.lit(False))


def content_misplaced(c: Column) -> Column:
    return F.coalesce(c.rlike("[0-9]{2,7}-[0-9]{2}-[0-9]"), F.lit(False))


def ec_check_digit(digits: Column) -> Column:
    """Of six digits: the sum of each times its place, modulo 11; null where that is 10."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit(0), lambda a, k: a + k * F.substring(digits, k, F.lit(1)).cast("int"))
    return F.when(digits.rlike("^[2-9][0-9]{5}$") & (total % 11 != 10), total % 11)


def top_field(path: Column) -> Column:
    """The first name of a path `$.name…`, or null."""
    return F.nullif(F.regexp_extract(path, r"^\$\.([a-z_]+)", 1), F.lit(""))


def without_thoughts(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def screen_time(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(c), "yyyy.MM.dd HH:mm")


def safe_url(c: Column) -> Column:
    """The address if its scheme is http, https or blob, else empty."""
    return F.when(F.lower(c).rlike("^(https?|blob):"), c).otherwise("")


def learning_rate(step: Column, steps: int, warmup: int, peak: float) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    done = (step - warmup) / F.lit(max(1, steps - warmup)).cast("double")
    cosine = 0.5 * peak * (1 + F.cos(F.lit(3.141592653589793) * F.least(done, F.lit(1.0))))
    return F.when(step < warmup, peak * step / F.lit(max(1, warmup)).cast("double")).otherwise(cosine)
