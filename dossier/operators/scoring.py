"""Scoring of predictions against gold rows, and paired comparison of two conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.chem import content_key, f1, ratio
from dossier.sources.shared import written


def _sides(gold: DataFrame, pred: DataFrame, *columns) -> DataFrame:
    """Rows of both sides, with 1 under g or p: one aggregation over both needs no join."""
    side = lambda df, g, p: df.select(*columns, F.lit(g).alias("g"), F.lit(p).alias("p"))
    return side(gold, 1, 0).union(side(pred, 0, 1))


def set_counts(gold: DataFrame, pred: DataFrame, key: str, value: str) -> DataFrame:
    """tp, fp, fn of the distinct values of each key."""
    both = _sides(gold, pred, key, value).where(F.col(value).isNotNull()).groupBy(key, value).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return both.groupBy(key).agg(
        F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if(F.col("g") == 0).alias("fp"), F.count_if(F.col("p") == 0).alias("fn")
    )


def bag_counts(gold: DataFrame, pred: DataFrame, key: str, *parts: Column) -> DataFrame:
    """tp, fp, fn of one-to-one matching of equal rows: for each value, the smaller of the two multiplicities matches."""
    named = [p.alias(f"k{i}") for i, p in enumerate(parts)]
    both = _sides(gold, pred, key, *named).groupBy(key, *(f"k{i}" for i in range(len(parts)))).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    g, p = F.col("g"), F.col("p")
    return both.groupBy(key).agg(
        F.sum(F.least(g, p)).alias("tp"), F.sum(p - F.least(g, p)).alias("fp"), F.sum(g - F.least(g, p)).alias("fn")
    )


ENTRY = "struct<family:string,v:string,flag:boolean,content:string,g:int,p:int,lacking:boolean>"


def entries(family: str, gold: Column, pred: Column, there: tuple[Column, Column] | None = None, **more: Column) -> Column:
    """An array of ENTRY for a row's value on both sides (null: none): one where the sides are equal, else one for each. `there`
    says whether each side has the row, where a null is a value too; `more`: flag, content and lacking as pairs of both sides."""
    has_gold, has_pred = there or (gold.isNotNull(), pred.isNotNull())
    none = F.lit(None)
    sides = {k: more.get(k, (none, none)) for k in ("flag", "content", "lacking")}
    of = lambda k, v, g, p: F.struct(
        F.lit(family).alias("family"), v.alias("v"), sides["flag"][k].cast("boolean").alias("flag"), sides["content"][k].cast("string").alias("content"),
        g.alias("g"), p.alias("p"), sides["lacking"][k].cast("boolean").alias("lacking"),
    )
    same = has_gold & has_pred & gold.eqNullSafe(pred)
    for k in ("flag", "content", "lacking"):
        same = same & sides[k][0].eqNullSafe(sides[k][1])
    return F.array(F.when(has_gold, of(0, gold, F.lit(1), same.cast("int"))), F.when(has_pred & ~same, of(1, pred, F.lit(0), F.lit(1)))).cast(f"array<{ENTRY}>")


def listed(family: str, values: Column, gold: bool) -> Column:
    """An array of ENTRY for a row's list of values on one side."""
    own = lambda x: F.struct(
        F.lit(family).alias("family"), x.alias("v"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("content"),
        F.lit(int(gold)).alias("g"), F.lit(int(not gold)).alias("p"), F.lit(None).cast("boolean").alias("lacking"),
    )
    return F.coalesce(F.transform(values, own), F.array()).cast(f"array<{ENTRY}>")


def row_counts(rows: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """key, the counts of all FAMILIES, cas_paired (rows whose identifier both sides have), fab_hcode (codes of the prediction
    alone), fab_cas (its identifiers that are `lacking` in the source), and the sums of further columns, of rows
    (key, entries, sums). Families ghs, hcode and htext are sets; rows of family `ing` (identifier, substitute flag where there is
    none, content) make cas, pair and nocas.

    One pass: entries are counted by value and content, then by value, then by key. Rows that come dealt by key stay where they
    are."""
    n = lambda c: F.sum(c).alias(c)
    number = [F.lit(0).cast("long").alias(c) for c in sums]
    # The rows' own sums ride along with their first entry.
    every = rows.select(key, F.posexplode_outer("entries").alias("_at", "e"), *sums).where("e is not null or coalesce(_at, 0) = 0")
    own = every.select(key, "e.*", *(F.when(F.coalesce("_at", F.lit(0)) == 0, F.col(c)).otherwise(number[k]).cast("long").alias(c) for k, c in enumerate(sums)))
    by = [key, "family", "v", "flag"]
    own = own.groupBy(*by, "content").agg(n("g"), n("p"), F.max("lacking").alias("lacking"), *map(n, sums))
    own = own.groupBy(*by).agg(n("g"), n("p"), F.sum(F.least("g", "p")).alias("same"), F.max("lacking").alias("lacking"), *map(n, sums))
    g, p, same, v, family = F.col("g"), F.col("p"), F.col("same"), F.col("v"), F.col("family")
    total = lambda name, cond, x: F.sum(F.when(cond, x).otherwise(0)).alias(name)
    sets = [(f, (family == f) & v.isNotNull()) for f in ("ghs", "hcode", "htext")] + [("cas", (family == "ing") & v.isNotNull())]
    out = []
    for f, is_own in sets:
        out += [F.count_if(is_own & (g > 0) & (p > 0)).alias(f"{f}_tp"), F.count_if(is_own & (g == 0)).alias(f"{f}_fp"), F.count_if(is_own & (p == 0)).alias(f"{f}_fn")]
    for f, is_own in (("pair", (family == "ing") & v.isNotNull()), ("nocas", (family == "ing") & v.isNull())):
        out += [total(f"{f}_tp", is_own, same), total(f"{f}_fp", is_own, p - same), total(f"{f}_fn", is_own, g - same)]
    some = (family == "ing") & v.isNotNull()
    return own.groupBy(key).agg(
        *out, total("cas_paired", some, F.least(g, p)), F.count_if((family == "hcode") & v.isNotNull() & (g == 0)).alias("fab_hcode"),
        F.count_if(some & (p > 0) & F.col("lacking")).alias("fab_cas"), *map(n, sums),
    )


def set_sizes(sets: DataFrame, names: list[str]) -> DataFrame:
    """The rows with tp, fp, fn of each name, from the lists `name` and `p_name` of both sides, of which a null is no value and a
    repeated one counts once."""
    none = F.array(F.lit(None).cast("string"))
    sides = [side for f in names for side in (f, f"p_{f}")]
    own = sets.withColumns({side: F.array_except(side, none) for side in sides})
    own = own.withColumns({f"{f}_tp": F.size(F.array_intersect(f, f"p_{f}")).cast("long") for f in names})
    return own.withColumns({f"{f}_{c}": F.size(side).cast("long") - F.col(f"{f}_tp") for f in names for c, side in (("fp", f"p_{f}"), ("fn", f))})


def common(gold: Column, pred: Column) -> Column:
    """How many values two lists share, each as often as in the one that has it less often; a null is no value. A fold over the
    sorted values, so that long lists cost little more than short ones."""
    side = lambda xs, is_gold: F.transform(F.array_compact(xs), lambda x: F.struct(x.alias("v"), F.lit(is_gold).alias("is_gold")))
    every = F.sort_array(F.concat(side(pred, False), side(gold, True)))  # of equal values, those of the prediction come first
    zero = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).cast("long").alias("free"), F.lit(0).cast("long").alias("n"))

    def step(a, x):
        free = F.when(a["v"] == x["v"], a["free"]).otherwise(0)
        met = (x["is_gold"] & (free > 0)).cast("long")
        return F.struct(x["v"].alias("v"), F.when(x["is_gold"], free - met).otherwise(free + 1).alias("free"), (a["n"] + met).alias("n"))

    return F.when(F.arrays_overlap(gold, pred), F.aggregate(every, zero, step, lambda a: a["n"])).otherwise(0)


#: Columns of a line that `line_counts` reads as they are; those with p_ are the prediction's.
LINE = ["ghs", "p_ghs", "htext", "p_htext", "hcode", "p_hcode", "cas", "p_cas", "source"]


def line_counts(lines: DataFrame, key: str, place: str, sums: list[str]) -> DataFrame:
    """As `row_counts`, of lines (key, place, both sides of LINE and of content and is_sub, p_there, sums): hcode are lists, source
    a part of the source text or null, p_there whether the prediction has the line, is_sub what tells lines without identifier apart.

    A line that is equal on both sides is matched as it is, so amounts are read in the others alone; a document's lines are
    gathered once, and its sets are counted as lists. Lines that come dealt by key stay where they are."""
    c = F.col
    there, n = c("p_there"), (lambda x: F.sum(x).alias(x))
    same_cas = there & c("cas").eqNullSafe(c("p_cas"))
    same = same_cas & c("content").eqNullSafe(c("p_content")) & (c("cas").isNotNull() | c("is_sub").eqNullSafe(c("p_is_sub")))
    own = lines.select(key, place, *LINE, "is_sub", "p_is_sub", "content", "p_content", "p_there", *sums, same_cas.alias("same_cas"), same.alias("same"))
    other, no_cas = ~c("same"), c("cas").isNull()
    own = own.withColumn("amount", F.when(other, content_key(c("content"))))
    own = own.withColumn("p_amount", F.when(other & there, F.when(c("content").eqNullSafe(c("p_content")), c("amount")).otherwise(content_key(c("p_content")))))
    # The identifier's length first, so that no two pairs are written alike.
    pair = lambda cas, amount: F.concat(F.length(cas), F.lit(":"), cas, amount)
    sub = lambda cas, is_sub, amount: F.when(cas.isNull(), F.concat_ws(":", F.coalesce(is_sub.cast("string"), F.lit("")), amount))
    left = {
        "pair": pair(c("cas"), c("amount")), "p_pair": pair(c("p_cas"), c("p_amount")), "nocas": F.when(other, sub(c("cas"), c("is_sub"), c("amount"))),
        "p_nocas": F.when(other & there, sub(c("p_cas"), c("p_is_sub"), c("p_amount"))), "paired": F.when(~c("same_cas"), c("cas")),
        "p_paired": F.when(there & ~c("same_cas"), c("p_cas")),
    }
    line = F.struct(place, *LINE, *(x.alias(k) for k, x in left.items()))
    sizes = {
        "n_pair": F.count_if(~no_cas), "n_p_pair": F.count_if(c("p_cas").isNotNull()), "n_nocas": F.count_if(no_cas),
        "n_p_nocas": F.count_if(there & c("p_cas").isNull()), "same_pair": F.count_if(c("same") & ~no_cas), "same_nocas": F.count_if(c("same") & no_cas),
        "same_paired": F.count_if(c("same_cas") & ~no_cas),
    }
    docs = own.groupBy(key).agg(F.sort_array(F.collect_list(line)).alias("_lines"), *(x.alias(k) for k, x in sizes.items()), *map(n, sums))
    of = lambda k: c("_lines")[k]
    lists = {k: F.flatten(of(k)) if k.endswith("hcode") else of(k) for k in LINE}
    docs = docs.select(key, *(x.alias(k) for k, x in lists.items()), *(of(k).alias(k) for k in left), *sizes, *sums)
    docs = set_sizes(docs, ["ghs", "hcode", "htext", "cas"])
    docs = docs.withColumns({f"_{f}": c(f"same_{f}") + common(c(f), c(f"p_{f}")) for f in ("pair", "nocas", "paired")})
    docs = docs.withColumn("flat", F.when(F.size(F.array_compact("source")) > 0, F.regexp_replace(F.array_join("source", ""), r"\s+", "")))
    bags = [x.alias(f"{f}_{k}") for f in ("pair", "nocas") for k, x in (("tp", c(f"_{f}")), ("fp", c(f"n_p_{f}") - c(f"_{f}")), ("fn", c(f"n_{f}") - c(f"_{f}")))]
    lacking = F.size(F.filter("p_cas", lambda x: lacks(c("flat"), x))).cast("long")
    return docs.select(
        key, *(f"{f}_{k}" for f in ("ghs", "hcode", "htext", "cas") for k in ("tp", "fp", "fn")), *bags, c("_paired").alias("cas_paired"),
        c("hcode_fp").alias("fab_hcode"), F.when(c("flat").isNotNull(), lacking).otherwise(0).alias("fab_cas"), *sums,
    )


def micro(counts: DataFrame, by: str) -> DataFrame:
    """Micro precision, recall and F1; null where all counts are zero, 0 where one denominator is."""
    s = counts.groupBy(by).agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    some = tp + fp + fn > 0
    rate = lambda d: F.round(F.when(some, F.coalesce(ratio(tp, d), F.lit(0.0))), 6)
    return s.select(
        by, "tp", "fp", "fn", rate(tp + fp).alias("p"), rate(tp + fn).alias("r"), F.round(f1(tp, fp, fn), 6).alias("f1")
    )


def long_metrics(wide: DataFrame, by: str) -> DataFrame:
    metrics = [c for c in wide.columns if c != by]
    doubles = wide.select(by, *(F.col(c).cast("double") for c in metrics))
    return doubles.unpivot([by], metrics, "metric", "value")


def wide_metrics(long: DataFrame, by: str, subsets: list[str]) -> DataFrame:
    return long.groupBy("metric").pivot(by, subsets).agg(F.first("value"))


def win_loss_tie(a: DataFrame, b: DataFrame, key: str, by: list[str], value: str) -> DataFrame:
    """Of two conditions' values by key: how often b is above, below, equal; mean difference and numbers of keys and groups."""
    d = a.select(key, *by, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    diff = F.col("y") - F.col("x")
    return d.groupBy(by[0]).agg(
        F.count_if(diff > 0).alias("win"), F.count_if(diff < 0).alias("loss"), F.count_if(diff == 0).alias("tie"),
        F.round(F.avg(diff), 6).alias("mean_diff"), F.count("*").alias("n_docs"), F.countDistinct(by[1]).alias("n_groups"),
    )


#: Tasks that share the repeats of one subset.
SLICES = 16


def bootstrap_interval(groups: DataFrame, by: str, group: str, total: str, size: str, n_boot: int, seed: int = 42) -> DataFrame:
    """Percentile interval of sum(total) / sum(size) when whole groups are drawn with replacement; null for one group.

    Each repeat draws as many groups as there are; a draw is a 64-bit hash of (seed, repeat, place) modulo their number, so
    results are the same anywhere. Groups are an aggregate (a pair of numbers each); a subset's are one array, which goes to
    SLICES tasks that each work out their share of the repeats, so that no draw is a row."""
    pairs = F.struct(group, F.col(total).cast("double").alias("t"), F.col(size).cast("double").alias("n"))
    own = groups.groupBy(by).agg(F.array_sort(F.collect_list(pairs)).alias("_groups"))
    sliced = own.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).repartition(by, "_slice")
    repeats = sliced.withColumn("_boot", F.explode(F.sequence(F.col("_slice"), F.lit(n_boot + SLICES), F.lit(SLICES)))).where(F.col("_boot") < n_boot)
    many = F.size("_groups")
    drawn = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.get("_groups", F.pmod(F.xxhash64(F.lit(seed), F.col("_boot"), k), many).cast("int")))
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("n"))
    stat = F.aggregate(drawn, zero, lambda a, x: F.struct((a["t"] + x["t"]).alias("t"), (a["n"] + x["n"]).alias("n")), lambda a: a["t"] / a["n"])
    stats = repeats.select(by, stat.alias("_stat"), many.alias("_many"))
    lo, hi = int(0.025 * n_boot), min(n_boot - 1, int(0.975 * n_boot))
    ordered = stats.groupBy(by).agg(F.array_sort(F.collect_list("_stat")).alias("_stats"), F.max("_many").alias("_many"))
    at = lambda k: F.when(F.col("_many") > 1, F.round(F.get("_stats", F.lit(k)), 6))
    return ordered.select(by, at(lo).alias("ci_low"), at(hi).alias("ci_high"))


def conclusion(lo: Column, hi: Column, worsened: Column | None = None) -> Column:
    """What an interval of differences says; an advantage isn't claimed where fields that may not get worse did."""
    worse = F.lit(False) if worsened is None else F.coalesce(worsened, F.lit(False))
    return (
        F.when(lo.isNull() | hi.isNull(), "undecided").when((lo > 0) & worse, "better but worsened").when(lo > 0, "better")
        .when(hi < 0, "worse").otherwise("no difference")
    )


#: Outcomes of a document, and those that may not get worse.
NO_WORSE = ["parse_rate", "schema_rate", "product_name_acc", "cas_f1", "pair_f1"]


def with_missing(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Every gold document with its prediction's columns; a missing one has nulls and stays in all denominators."""
    return gold.join(pred.withColumn("has_prediction", F.lit(True)), key, "left").withColumn(
        "has_prediction", F.coalesce("has_prediction", F.lit(False))
    )


#: Families of precision and recall, single hits, and the order of a report's metrics.
FAMILIES = ["ghs", "hcode", "htext", "cas", "pair", "nocas"]
HITS = ["product_name", "signal_word", "ghs_status", "hazard_status"]
METRICS = [
    "n_docs", "n_missing_output", "parse_rate", "schema_rate", *(f"{h}_acc" for h in HITS), *(f"{f}_{m}" for f in FAMILIES for m in ("p", "r", "f1")),
    "content_acc", "doc_exact_rate", "doc_exact_ext_rate", "fab_hcode_n", "fab_hcode_docs", "fab_ghs_docs", "fab_cas_n", "fab_any_docs",
    "misplace_ke_n", "misplace_content_n", "gen_time_mean_s", "input_tokens_mean", "output_tokens_mean", "n_hit_max_new_tokens",
]
#: Numbers of invented and misplaced values.
EXTRA = ["fab_hcode", "fab_ghs", "fab_cas", "ke_misplaced", "content_misplaced"]
#: The outcomes of a paired comparison.
OUTCOMES = [
    "parse_rate", "schema_rate", "product_name_acc", "signal_word_acc", "ghs_classification", "hazard_statements", "cas", "pair", "nocas",
    "doc_exact", "doc_exact_ext",
]


def by_document(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a document: the run's flags and hits, its numbers of `counts` (doc_id, those of `row_counts` and of EXTRA; 0 where
    there are no rows), and `exact` and `exact_ext`."""
    numbers = [*(f"{f}_{c}" for f in FAMILIES for c in ("tp", "fp", "fn")), "cas_paired", *EXTRA]
    own = counts.select("doc_id", *(F.col(c).cast("long").alias(c) for c in numbers))
    out = runs.join(own, "doc_id", "left").na.fill(0, numbers)
    right = lambda f: F.col(f"{f}_fp") + F.col(f"{f}_fn") == 0
    exact = F.col("parsed") & F.col("schema_ok")
    for h in HITS:
        exact = exact & F.col(h)
    for f in ("ghs", "hcode", "htext", "cas", "pair"):
        exact = exact & right(f)
    ext = F.col("exact") & right("nocas") & (F.col("ke_misplaced") + F.col("content_misplaced") == 0)
    return out.withColumn("exact", exact).withColumn("exact_ext", ext)


def report(docs: DataFrame, by: str) -> DataFrame:
    """by, metric, value (null where there is nothing to measure), place in the report, of the rows of `by_document`."""
    n, total = (lambda c: F.count_if(F.col(c))), (lambda c: F.sum(c))
    made = ~F.col("skipped")
    mean = lambda c: F.avg(F.when(made, F.col(c)))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    sums = docs.groupBy(by).agg(
        F.count("*").alias("n_docs"), F.count_if(~F.col("has_output")).alias("n_missing_output"), rate("parsed").alias("parse_rate"),
        rate("schema_ok").alias("schema_rate"), *(rate(h).alias(f"{h}_acc") for h in HITS),
        *(total(f"{f}_{c}").alias(f"{f}_{c}") for f in FAMILIES for c in ("tp", "fp", "fn")), total("cas_paired").alias("cas_paired"),
        rate("exact").alias("doc_exact_rate"), rate("exact_ext").alias("doc_exact_ext_rate"), total("fab_hcode").alias("fab_hcode_n"),
        F.count_if(F.col("fab_hcode") > 0).alias("fab_hcode_docs"), F.count_if(F.col("fab_ghs") > 0).alias("fab_ghs_docs"),
        total("fab_cas").alias("fab_cas_n"), F.count_if(F.col("fab_hcode") + F.col("fab_ghs") + F.col("fab_cas") > 0).alias("fab_any_docs"),
        total("ke_misplaced").alias("misplace_ke_n"), total("content_misplaced").alias("misplace_content_n"),
        mean("gen_time").alias("gen_time_mean_s"), mean("input_tokens").alias("input_tokens_mean"),
        mean("output_tokens").alias("output_tokens_mean"), n("hit_max").alias("n_hit_max_new_tokens"),
    )
    for f in FAMILIES:
        tp, fp, fn = (F.col(f"{f}_{c}") for c in ("tp", "fp", "fn"))
        some = lambda x: F.when(tp + fp + fn > 0, F.coalesce(x, F.lit(0.0)))  # noqa: B023, E731
        sums = sums.withColumns({f"{f}_p": some(ratio(tp, tp + fp)), f"{f}_r": some(ratio(tp, tp + fn)), f"{f}_f1": f1(tp, fp, fn)})
    sums = sums.withColumn("content_acc", ratio(F.col("pair_tp"), F.col("cas_paired")))
    doubles = sums.select(by, *(F.round(F.col(m).cast("double"), 6).alias(m) for m in METRICS))
    place = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric")).cast("int")
    return doubles.unpivot([by], METRICS, "metric", "value").withColumn("place", place)


def outcomes(docs: DataFrame) -> DataFrame:
    """doc_id and the eleven outcomes, 0 or 1, of the rows of `by_document`; a list field is right only with its state."""
    right = lambda f: F.col(f"{f}_fp") + F.col(f"{f}_fn") == 0
    flags = {
        "parse_rate": F.col("parsed"), "schema_rate": F.col("parsed") & F.col("schema_ok"), "product_name_acc": F.col("product_name"),
        "signal_word_acc": F.col("signal_word"), "ghs_classification": right("ghs") & F.col("ghs_status"),
        "hazard_statements": right("hcode") & right("htext") & F.col("hazard_status"), "cas": right("cas"), "pair": right("pair"),
        "nocas": right("nocas"), "doc_exact": F.col("exact"), "doc_exact_ext": F.col("exact_ext"),
    }
    return docs.select("doc_id", *(flags[k].cast("int").alias(k) for k in OUTCOMES))


def both_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The join of two tables that must have the same keys: one pass, which fails at a key that either side lacks."""
    both = a.withColumn("_in_a", F.lit(True)).join(b.withColumn("_in_b", F.lit(True)), key, "full")
    lacking = F.when(F.col("_in_a").isNull(), "first").when(F.col("_in_b").isNull(), "second")
    told = F.concat(F.lit("the "), lacking, F.lit(f" side lacks {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return both.where(F.when(lacking.isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True)).drop("_in_a", "_in_b")


def paired(a: DataFrame, b: DataFrame, groups: DataFrame, n_boot: int, seed: int = 42) -> DataFrame:
    """subset, metric, win, loss, tie, mean_diff, n_docs, n_groups, ci_low, ci_high of outcomes a less b, for `all` and, where
    there are several, for each subset; groups: doc_id, subset, grp. Both sides must have the same documents, else reading the
    result fails with the name of one that a side lacks."""
    wide = both_sides(a, b.select("doc_id", *(F.col(c).alias(f"_{c}") for c in OUTCOMES)), "doc_id").join(groups, "doc_id")
    diffs = F.array(*(F.struct(F.lit(c).alias("metric"), (F.col(c) - F.col(f"_{c}")).alias("diff")) for c in OUTCOMES))
    own = wide.select("subset", "grp", F.inline(diffs))
    several = groups.agg(F.countDistinct("subset").alias("n")).where("n > 1").select(F.lit(True).alias("several"))
    every = own.withColumn("subset", F.lit("all")).unionByName(own.join(several).drop("several"))
    every = every.withColumn("key", F.concat_ws("\x00", "subset", "metric"))
    sums = every.groupBy("key", "grp").agg(
        F.sum("diff").alias("t"), F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("win"), F.count_if(F.col("diff") < 0).alias("loss")
    )
    sums = written(sums, "sums")  # a row for each subset, metric and group, read by the totals and by the draws
    totals = sums.groupBy("key").agg(
        F.sum("win").alias("win"), F.sum("loss").alias("loss"), F.sum("n").alias("n_docs"), F.count("*").alias("n_groups"),
        F.round(F.sum("t") / F.sum("n"), 6).alias("mean_diff"),
    )
    found = totals.join(bootstrap_interval(sums, "key", "grp", "t", "n", n_boot, seed), "key")
    parts = F.split("key", "\x00")
    return found.select(
        parts[0].alias("subset"), parts[1].alias("metric"), "win", "loss", (F.col("n_docs") - F.col("win") - F.col("loss")).alias("tie"),
        "mean_diff", "n_docs", "n_groups", "ci_low", "ci_high",
    )


def average_f1(report_: DataFrame, base: str) -> DataFrame:
    """condition, average (of the F1 of identifiers, pairs and codes), delta against the base condition; rows (condition,
    metric, value); null unless all three are there."""
    names = ["cas_f1", "pair_f1", "hcode_f1"]
    own = report_.where(F.col("metric").isin(names)).groupBy("condition").agg(F.count("value").alias("n"), (F.sum("value") / 3).alias("average"))
    own = own.select("condition", F.when(F.col("n") == 3, F.col("average")).alias("average"))
    first = own.where(F.col("condition") == base).select(F.col("average").alias("base"))
    return own.join(first, how="left").select("condition", F.round("average", 6).alias("average"), F.round(F.col("average") - F.col("base"), 6).alias("delta"))


def shown(value: Column, metric: Column) -> Column:
    """A report's text of a value: a dash for none; counts and tokens whole, with commas; seconds and means with one digit;
    rates with three at most."""
    whole = metric.rlike("(_n|_docs)$") | metric.startswith("n_") | metric.contains("tokens")
    digits = lambda k: F.replace(F.format_number(value, k), F.lit(","), F.lit(""))  # noqa: E731  (half to even, of the exact value)
    plain = F.regexp_replace(F.regexp_replace(digits(3), "0+$", ""), r"\.$", "")
    return (
        F.when(value.isNull(), "—").when(whole, F.format_number(value, 0)).when(metric.rlike("(_s|_mean)$") | value.isin(0.0, 1.0), digits(1)).otherwise(plain)
    )


def markdown(wide: DataFrame, metric: str, conditions: list[str]) -> DataFrame:
    """line_no, line of a Markdown table of a comparison (metric, one column a condition), in order of the metric's name."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", metric, *(shown(F.col(c), F.col(metric)) for c in conditions)), F.lit(" |"))
    head = ["| " + " | ".join(["metric", *conditions]) + " |", "|" + "---|" * (len(conditions) + 1)]
    spark = wide.sparkSession
    body = wide.select(F.lit(2).alias("part"), F.col(metric).alias("at"), row.alias("line"))
    top = spark.createDataFrame([(k, "", x) for k, x in enumerate(head)], "part int, at string, line string")
    order = Window.orderBy("part", "at")  # a report has few rows
    return top.union(body).select(F.row_number().over(order).alias("line_no"), "line")


def document_outcomes(docs: DataFrame, families: dict[str, DataFrame], key: str) -> DataFrame:
    """key, one flag a family (no false positive, no false negative; so no rows at all are right), and `exact`: all of them,
    with a prediction there. docs: key, has_prediction."""
    out = docs.select(key, "has_prediction")
    for name, counts in families.items():
        right = (F.col("fp") + F.col("fn") == 0).alias(name)
        out = out.join(counts.select(key, right), key, "left").withColumn(name, F.coalesce(name, F.lit(True)))
    every = F.col("has_prediction")
    for name in families:
        every = every & F.col(name)
    return out.withColumn("exact", every)


def accuracy(outcomes: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """Share of all documents of each subset with each flag."""
    return outcomes.groupBy(by).agg(
        F.count("*").alias("n_docs"), *(F.round(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")), 6).alias(f) for f in flags)
    )


def misplaced(pred: DataFrame, key: str) -> DataFrame:
    """Values in a wrong column by document: numbers of another kind under KE, identifiers under content."""
    from dossier.functions.textnorm import content_misplaced, ke_misplaced

    return pred.groupBy(key).agg(
        F.count_if(ke_misplaced(F.col("ke"))).alias("ke_misplaced"), F.count_if(content_misplaced(F.col("content"))).alias("content_misplaced")
    )


def lacks(flat: Column, value: Column) -> Column:
    """Whether an identifier isn't in a source text without white space, not even all but its last digit."""
    body = F.regexp_replace(value, "[^-]*$", "")
    return ~(flat.contains(value) | ((body != "") & flat.contains(body)))


def fabricated(values: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, kind, value) of predicted codes (kind `hcode`) and identifiers (kind `cas`) that the source text lacks; an
    identifier broken across lines counts as there if all but its last digit is."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")
    own = sources.where("text is not null").select(key, F.col("text"), flat.alias("flat"))
    body = F.regexp_replace("value", "[^-]*$", "")
    there = F.when(F.col("kind") == "hcode", F.regexp_like("text", F.concat(F.lit(r"(?<![A-Za-z])\Q"), "value", F.lit(r"\E"))))
    there = there.otherwise(F.col("flat").contains(F.col("value")) | ((body != "") & F.col("flat").contains(body)))
    return values.where("value is not null").distinct().join(own, key).where(~there).select(key, "kind", "value")


def worsened(a: DataFrame, b: DataFrame, names: list[str] | None = None) -> DataFrame:
    """metric, a, b, state (`worse` or `unknown`, if one side has no value) of metrics (metric, value) that may not get worse."""
    names = NO_WORSE if names is None else names
    x, y = (df.where(F.col("metric").isin(names)).select("metric", F.col("value").alias(n)) for df, n in ((a, "a"), (b, "b")))
    state = F.when(F.col("a").isNull() | F.col("b").isNull(), "unknown").when(F.col("b") < F.col("a"), "worse")
    return x.join(y, "metric", "full").withColumn("state", state).where("state is not null")


def token_ratio(log: DataFrame, condition: str, numerator: str, denominator: str, tokens: str) -> DataFrame:
    """One row: the ratio of two conditions' mean tokens; null where one has none."""
    mean = lambda c: F.avg(F.when(F.col(condition) == c, F.col(tokens)))
    return log.agg(F.round(mean(numerator) / F.nullif(mean(denominator), F.lit(0.0)), 6).alias("ratio"))


def unknown_classes(gold: DataFrame, pred: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Classes that the table lacks, and the sides that use them."""
    both = gold.select(column, F.lit("gold").alias("side")).union(pred.select(column, F.lit("pred").alias("side")))
    own = both.where(F.col(column).isNotNull()).distinct().join(known.select(column).distinct(), column, "left_anti")
    return own.groupBy(column).agg(F.array_join(F.array_sort(F.collect_set("side")), ",").alias("sides"))


def failures(log: DataFrame, by: str, error: str, prefix: str = "API_ERROR") -> DataFrame:
    """Runs, those that failed with the prefix, distinct models and mean tokens of the others."""
    failed = F.coalesce(F.col(error).startswith(prefix), F.lit(False))
    return log.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.countDistinct("model").alias("n_models"),
        F.round(F.avg(F.when(~failed, F.col("tokens"))), 4).alias("mean_tokens"),
    )
