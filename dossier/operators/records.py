"""Stored records: revisions, latest logs and review batches, children of nested records, pages, splits and seals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import positions, selected


def last_by(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key; aggregated on both sides of the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(key, "r.*")


def latest_batch(reviews: DataFrame) -> DataFrame:
    """The rows of each document's latest batch, the last one of each field; fields of older batches alone are gone."""
    last = reviews.groupBy("document_id", "field_path", "batch").agg(F.max_by("confirmed_value", "id").alias("confirmed_value"))
    newest = F.max("batch").over(Window.partitionBy("document_id"))
    return last.withColumn("newest", newest).where("batch = newest").drop("newest")


def revisions(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("revision", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))


def nest(children: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key with its children as an array in order."""
    rest = [c for c in children.columns if c not in (key, order)]
    return children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("items"))


def unnest(nested: DataFrame, key: str) -> DataFrame:
    exploded = nested.select(key, F.posexplode("items").alias("pos", "item"))
    return exploded.select(key, (F.col("pos") + 1).cast("long").alias("position"), "item.*")


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(F.desc(order)).offset(offset).limit(limit)


def effective(records: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records overlaid with the confirmed values of their fields."""
    wide = current.groupBy("document_id").pivot("field_path", fields).agg(F.first("confirmed_value"))
    wide = wide.select(F.col("document_id").alias(key), *(F.col(f).alias(f"_{f}") for f in fields))
    return records.join(wide, key, "left").select(key, *(F.coalesce(f"_{f}", f).alias(f) for f in fields))


def sealed_out(df: DataFrame, sealed: DataFrame, key: str) -> DataFrame:
    return df.join(sealed, key, "left_anti")


def leaking_groups(splits: DataFrame, group: str) -> DataFrame:
    """Groups with documents in several splits."""
    n = splits.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count("*").alias("n_docs")
    )
    return n.where(F.col("splits").contains(","))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def manifest(df: DataFrame, kind: str, value: str) -> DataFrame:
    """The hash of each kind's set of hashes, in two levels, so that no kind's hashes are gathered in one task: each of 4096
    prefixes has the hash of its sorted hashes, one in a line; the kind has that of its prefixes' in order."""
    own = df.select(kind, F.sha2(value, 256).alias("h"))
    lines = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = own.groupBy(kind, F.substring("h", 1, 3).alias("prefix")).agg(F.count("*").alias("n"), lines("h").alias("part"))
    return parts.groupBy(kind).agg(F.sum("n").alias("n"), lines(F.concat("prefix", F.lit(":"), "part")).alias("set_sha256"))


def bag_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, n_a, n_b of the values whose multiplicities differ; counted on both sides before the join."""
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = count(a, "n_a").join(count(b, "n_b"), key, "full")
    return both.select(key, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b"))).where("n_a <> n_b")


def id_disagreement(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids that aren't in all of the named sets, with the names of those that lack them."""
    tagged = None
    for name, df in sets.items():
        own = df.select(key).distinct().withColumn("set", F.lit(name))
        tagged = own if tagged is None else tagged.union(own)
    every = F.array(*(F.lit(n) for n in sorted(sets)))
    lacking = F.array_except(every, F.collect_set("set"))
    return tagged.groupBy(key).agg(F.array_join(lacking, ",").alias("missing_in")).where("missing_in <> ''")


def inputs_digest(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """One hash of each group's rows (NUL between values), whatever their order; in two levels as for `manifest`."""
    row = F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return manifest(df.select(by, row.alias("_row")), by, "_row")


def percentiles(df: DataFrame, by: str, value: str, qs: list[int]) -> DataFrame:
    """Nearest-rank percentiles (rank q/100 of n - 1, half to even), mean and maximum of each group's numbers, whole or not.

    Ranks are places in the sorted table, so that neither a group with most rows nor one of distinct values meets in a task."""
    at = lambda q: F.bround(F.lit(q / 100) * (F.col("_rows") - 1)).cast("long")
    found = selected(df, by, value, {f"p{q}": at(q) for q in qs})
    return found.select(by, *(f"p{q}" for q in qs), F.round("mean", 6).alias("mean"), "max")


def next_revisions(new: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows with the revisions that follow the stored ones of their keys."""
    last = stored.groupBy(*keys).agg(F.max("revision").alias("last"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return new.withColumn("place", place).join(last, keys, "left").withColumn("revision", (F.coalesce("last", F.lit(0)) + F.col("place")).cast("long")).drop("place", "last")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with a number from 1 over all of them in the given order, by places in the sorted table."""
    return positions(df, *order, name="number").withColumn("number", F.col("number") + 1)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that depends on the seed and the key alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def calibration(df: DataFrame, key: str, tokens: str, least: int, n: int, seed: int) -> DataFrame:
    """The first n rows of a seeded order that have `least` tokens or more."""
    return shuffled(df.where(F.col(tokens) >= least), key, seed).limit(n)


def heads(df: DataFrame, by: str, order: str, value: str, n: int) -> DataFrame:
    """by and the first n values of each group, joined by line ends; no more than n values of a group reach its array."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    own = df.withColumn("rank", rank).where(F.col("rank") <= n)
    values = F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value])
    return own.groupBy(by).agg(F.array_join(values, "\n").alias("values"))


def matching(docs: DataFrame, text: str, words: list[str], facets: dict[str, str]) -> DataFrame:
    """Documents whose searched text has all of the words, whatever their case, and whose facets have the given values."""
    out = docs
    for w in words:
        out = out.where(F.contains(F.lower(text), F.lit(w.lower())))
    for column, value in facets.items():
        out = out.where(F.col(column) == value)
    return out


def run_means(log: DataFrame) -> DataFrame:
    """One row of the last log rows: documents, skipped ones, means of time and tokens over the others, and how many hit the
    limit of new tokens; null means where there are no others."""
    done = ~F.col("skipped")
    mean = lambda c: F.round(F.avg(F.when(done, F.col(c))), 4).alias(f"mean_{c}")
    return log.agg(
        F.count("*").alias("n"), F.count_if("skipped").alias("n_skipped"), mean("gen_time"), mean("input_tokens"), mean("output_tokens"),
        F.count_if("hit_max").alias("n_hit_max"),
    )


def rebuilt(documents: DataFrame, children: dict[str, DataFrame], key: str, json: str) -> DataFrame:
    """key and the record as JSON: each child table (key, seq, …) as a list in order, and list_status as the stored JSON has
    it; null where that is no JSON object with one."""
    out = documents.select(key, F.get_json_object(json, "$.list_status").alias("status"))
    for name, table in children.items():
        fields = [c for c in table.columns if c not in (key, "seq")]
        items = nest(table, key, "seq").select(key, F.transform("items", lambda x: F.struct(*(x[c].alias(c) for c in fields))).alias(name))  # noqa: B023
        out = out.join(items, key, "left").withColumn(name, F.coalesce(F.to_json(name, {"ignoreNullFields": "false"}), F.lit("[]")))
    parts = [x for name in children for x in (F.lit(f'"{name}":'), F.col(name), F.lit(","))]
    body = F.concat(F.lit("{"), *parts, F.lit('"list_status":'), F.col("status"), F.lit("}"))
    return out.select(key, body.alias("record"))


def bundle(docs: DataFrame, key: str, body: str) -> DataFrame:
    """One row: how many documents, and the stamp of their JSON texts, whatever their order (the first 16 hex digits)."""
    one = manifest(docs.select(F.lit("bundle").alias("kind"), F.concat(F.col(key).cast("string"), F.lit("\t"), F.col(body)).alias("line")), "kind", "line")
    return one.select("n", F.substring("set_sha256", 1, 16).alias("stamp"))
