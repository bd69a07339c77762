"""Rules on splits and their violations as rows (rule, key), and the gates before a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SECTION2, SECTION3, SECTION4, first_match

ID = "^[A-Za-z0-9_-]+$"


def split_violations(splits: DataFrame, examples: DataFrame, language: str, splits_allowed: list[str], form: str | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """rule, key of each breach in splits(doc_id, split, lang, grp, form): repeated and malformed ids, unknown splits, other
    languages, groups across train and val, a form that val lacks, examples outside train, documents without labels."""
    rows = splits.withColumn("key", F.col("doc_id").cast("string"))
    both = rows.where("split in ('train', 'val')")
    named = lambda df, rule, key="key": df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    found = [
        named(rows.groupBy("key").count().where("count > 1"), "repeated_id"), named(rows.where(~F.col("key").rlike(ID)), "malformed_id"),
        named(rows.where(~F.col("split").isin(splits_allowed)), "unknown_split"),
        named(both.where(F.coalesce(F.col("lang"), F.lit("")) != language), "other_language"),
        named(both.groupBy("grp").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b"), "group_in_two_splits", "grp"),
        named(examples.join(rows.where("split = 'train'"), "doc_id", "left_anti"), "example_not_in_train", "doc_id"),
    ]
    if form is not None:
        has = rows.agg(F.count_if((F.col("split") == "val") & (F.col("form") == form)).alias("n"))
        found.append(named(has.where("n = 0").withColumn("key", F.lit(form)), "form_not_in_val"))
    if labelled is not None:
        found.append(named(both.join(labelled.select("doc_id"), "doc_id", "left_anti"), "no_label"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def outside(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Keys that aren't allowed; must be none before anything is trained or indexed."""
    return df.select(key).distinct().join(allowed.select(key), key, "left_anti")


def require_none(df: DataFrame, what: str) -> None:
    """Stop where a table of violations has a row."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and side of the ids that one of two conditions lacks."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    both = x.join(y, key, "full").where("in_a is null or in_b is null")
    return both.select(key, F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("side"))


def config_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, old, new of settings (name, value) that aren't the same in both."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "name", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def extraction_reason(pages: DataFrame, least: int = 200) -> DataFrame:
    """doc_id, reason of extracted texts: missing, too short, or without section 2, 3 or 4; null where all is there."""
    lines = F.split("text", "\n")
    reason = F.when(F.col("text").isNull(), "PDF_NOT_FOUND").when(F.length(F.trim("text")) < least, "TEXT_TOO_SHORT")
    for n, patterns in ((2, SECTION2), (3, SECTION3), (4, SECTION4)):
        reason = reason.when(first_match(lines, patterns, F.lit(0)).isNull(), f"NOT_FOUND_SECTION{n}")
    return pages.select("doc_id", reason.alias("reason"))


def prompt_mismatches(messages: DataFrame, prompt: str) -> DataFrame:
    """doc_id of rows (doc_id, messages) whose first system message isn't the prompt."""
    first = F.get(F.filter("messages", lambda m: m["role"] == "system"), F.lit(0))["content"]
    return messages.where(~first.eqNullSafe(F.lit(prompt))).select("doc_id")


def rename_plan(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (doc_id, old, new) to make where a document's file has another name, and documents without an old file."""
    pair = new.select("doc_id", F.col("source_file").alias("new")).join(old.select("doc_id", F.col("source_file").alias("old")), "doc_id", "left")
    return pair.where("old is not null and old <> new").select("doc_id", "old", "new"), pair.where("old is null").select("doc_id", "new")


def verify(sealed: DataFrame, current: DataFrame) -> DataFrame:
    """kind, n_missing, n_extra, renamed of two manifests (kind, name, sha256): hashes are compared as bags; where those are
    the same, names are looked at too."""
    side = lambda df, n: df.groupBy("kind", "sha256").agg(F.count("*").alias(n))
    bags = side(sealed, "a").join(side(current, "b"), ["kind", "sha256"], "full").na.fill(0, ["a", "b"])
    n = bags.groupBy("kind").agg(
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("n_missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("n_extra")
    )
    named = lambda df: df.select("kind", "name", "sha256")
    moved = named(sealed).exceptAll(named(current)).groupBy("kind").agg(F.count("*").alias("moved"))
    same = (F.col("n_missing") == 0) & (F.col("n_extra") == 0)
    return n.join(moved, "kind", "left").select("kind", "n_missing", "n_extra", (same & F.col("moved").isNotNull()).alias("renamed"))


def changed_hashes(report: DataFrame, current: DataFrame, name: str = "name") -> DataFrame:
    """name, sha256, now of a report's files that are gone (now is null) or have other contents."""
    now = current.select(name, F.col("sha256").alias("now"))
    return report.select(name, "sha256").join(now, name, "left").where(~F.col("sha256").eqNullSafe(F.col("now")))


def gate_violations(settings: DataFrame, required: DataFrame) -> DataFrame:
    """run, name, value, wanted of runs' settings (run, name, value) that aren't as the gates (name, wanted) demand; a setting
    that a run lacks has a null value."""
    runs = settings.select("run").distinct()
    demanded = runs.join(required)  # the gates are a fixed list of settings
    met = demanded.join(settings, ["run", "name"], "left")
    return met.where(~F.col("value").eqNullSafe(F.col("wanted"))).select("run", "name", "value", "wanted")


def source_violations(sources: DataFrame, required: list[str]) -> DataFrame:
    """rule, key of each breach in a list of sources (doc_id, source_file, …): required columns that are blank, malformed or
    repeated ids, files that aren't below the root."""
    rows = sources.withColumn("key", F.col("doc_id").cast("string"))
    blank = F.filter(F.array(*(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"blank_{c}")) for c in required)), lambda x: x.isNotNull())
    file = F.coalesce("source_file", F.lit(""))
    outside_root = file.startswith("/") | file.rlike(r"(^|/)\.\.(/|$)") | file.rlike(r"^[A-Za-z]:")
    found = rows.select(F.explode(blank).alias("rule"), "key")
    for rule, cond in (("malformed_id", ~F.col("key").rlike(ID)), ("outside_root", outside_root)):
        found = found.union(rows.where(cond).select(F.lit(rule), "key"))
    return found.union(rows.groupBy("key").count().where("count > 1").select(F.lit("repeated_id"), "key"))


def messages(prompt: str, examples: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, messages: the prompt, then the examples' texts and answers (place, text, answer; a handful), then the text."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    pair = F.struct("place", F.array(turn("user", F.trim("text")), turn("assistant", F.col("answer"))).alias("turns"))
    shots = examples.agg(F.flatten(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["turns"])).alias("shots"))
    start = F.array(turn("system", F.lit(prompt)))
    return docs.join(shots).select("doc_id", F.concat(start, "shots", F.array(turn("user", F.trim("text")))).alias("messages"))
