"""Where a record's values stand in its source text, as expressions over the text's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.chem import let, squash
from dossier.functions.textnorm import strip

#: Marks that read as a tilde; labels sought beside a value.
TILDES = "∼～–—"
LABELS = {"product_name": ["제품명", "상품명"], "signal_word": ["신호어"]}


def flat(c: Column) -> Column:
    return squash(F.translate(c, TILDES, "~~~~"))


def last_token(line: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(strip(line), r"(?U)[:\s]+"), -1), "[.)]+$", "")


def marked(lines: Column) -> Column:
    return F.transform(lines, lambda s: F.struct(s.alias("raw"), strip(s).alias("line"), last_token(s).alias("last")))


def lines_of(text: Column) -> Column:
    """struct(lines, flat) of a text: what values are looked up in. Bound by `let`, it is made once for all of them."""
    return F.struct(marked(F.split(text, "\n")).alias("lines"), flat(text).alias("flat"))


def locate(text: Column, value: Column, labels: Column | None = None) -> Column:
    """struct(found, match_type, snippet) of a value in a text.

    A line whose last token is the value is better than one that merely contains it, and the first line is best among
    equals. Where labels are given, a line that has one (or whose nearest line above with text has one, which then comes
    along) is better than any without. Else the value may be found without white space, and then has no snippet."""
    return let(lines_of(text), lambda t: locate_in(t, value, labels))


def locate_in(source: Column, value: Column, labels: Column | None = None) -> Column:
    """As `locate`, in lines_of a text."""
    lines = source["lines"]
    at = F.transform(lines, lambda s, i: F.when(s["raw"].contains(value), F.struct(F.when(s["last"] == value, 0).otherwise(1).alias("rank"), i.alias("i"), s["line"].alias("line"))))
    return let(F.filter(at, lambda h: h.isNotNull()), lambda hits: shown(source, hits, value, labels))


def shown(source: Column, hits: Column, value: Column, labels: Column | None) -> Column:
    lines, first = source["lines"], F.array_min(hits)["line"]
    snippet = first
    if labels is not None:
        has_label = lambda line: F.exists(labels, lambda h: line.contains(h))

        def labelled(h):
            above = F.filter(F.slice(lines, 1, h["i"]), lambda s: s["line"] != "")
            return let(F.get(above, F.size(above) - 1)["line"], lambda near: F.struct(
                h["rank"].alias("rank"), h["i"].alias("i"),
                F.when(has_label(h["line"]), h["line"]).when(has_label(near), F.concat(near, F.lit("\n"), h["line"])).alias("line"),
            ))

        with_label = F.array_min(F.filter(F.transform(hits, labelled), lambda h: h["line"].isNotNull()))["line"]
        snippet = F.when(F.size(labels) == 0, first).otherwise(F.coalesce(with_label, first))
    kind = kind_of(source["flat"], hits, value)
    return F.struct((kind != "not_found").alias("found"), kind.alias("match_type"), F.when(kind == "exact", snippet).alias("snippet"))


def kind_of(source: Column, hits: Column, value: Column) -> Column:
    """How a value is found: in lines (hits), in the source without white space, or not at all."""
    return (
        F.when((value == "") | value.isNull() | (source == "") | source.isNull(), "not_found").when(F.size(hits) > 0, "exact")
        .when((flat(value) != "") & source.contains(flat(value)), "normalized").otherwise("not_found")
    )


def evidence(targets: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each target (key, field, value) located in its source (key, text); fields `product_name` and `signal_word` have labels.

    Targets are gathered by document first, so a text is joined and split once for all its values."""
    own = targets.groupBy(key).agg(F.collect_list(F.struct("field", "value")).alias("targets"))
    return located(own.join(sources.select(key, "text"), key, "left"), key)


def evidence_in_lines(rows: DataFrame, key: str, place: str) -> DataFrame:
    """As `evidence`, of rows (key, place, line, field, value), whose lines by place are the source: values and lines are gathered
    together, without a join. Rows that come dealt by key stay where they are."""
    own = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place, "line", "field", "value"))).alias("targets"))
    return located(own.withColumn("text", F.array_join(F.col("targets")["line"], "\n")), key)


def located(docs: DataFrame, key: str) -> DataFrame:
    """The targets of documents (key, text, targets with field and value), located. A value without labels needs no more of a line
    than whether the value is in it; last tokens are only looked at where several lines have the value."""
    c = F.col
    own = docs.select(key, "targets", F.split("text", "\n").alias("lines"), flat(c("text")).alias("flat"))
    rows = own.select(key, F.explode("targets").alias("t"), "lines", "flat").select(key, "t.field", "t.value", "lines", "flat")
    rows = rows.withColumn("hits", F.filter("lines", lambda s: s.contains(c("value"))))
    rows = rows.withColumn("match_type", kind_of(c("flat"), c("hits"), c("value"))).withColumn("name", F.regexp_extract("field", "([a-z_]+)", 1))
    hints = F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    source = F.struct(marked(c("lines")).alias("lines"), c("flat").alias("flat"))
    beside = let(source, lambda t: locate_in(t, c("value"), F.try_element_at(hints, c("name"))))["snippet"]
    first = F.get("hits", F.lit(0))
    best = F.when(F.size("hits") > 1, F.coalesce(F.get(F.filter("hits", lambda s: last_token(s) == c("value")), F.lit(0)), first)).otherwise(first)
    snippet = F.when(c("match_type") == "exact", F.when(c("name").isin(*LABELS), beside).otherwise(strip(best)))
    return rows.select(key, "field", "value", (c("match_type") != "not_found").alias("found"), "match_type", snippet.alias("snippet"))


def not_found(located: DataFrame, key: str = "doc_id") -> DataFrame:
    return located.where("not found").select(
        F.col(key).alias("doc_id"), "field", F.lit("not_found").alias("check_name"), F.lit("warning").alias("severity"),
        F.lit("VALUE_NOT_FOUND_IN_SOURCE").alias("code"),
    )


def page_of(pages: Column, snippet: Column) -> Column:
    """The first page (from 1) that has the snippet's first line, both without white space and repeated characters."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"(.)\1+", "$1")
    want = plain(F.split(snippet, "\n")[0])
    at = F.array_position(F.transform(pages, lambda p: plain(p).contains(want)), True)
    return F.when((want != "") & (at > 0), at)
