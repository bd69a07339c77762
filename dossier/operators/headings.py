"""Numbered headings of a document: the best increasing chain of candidate lines, and the sections that it cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a heading looks like, and words that its title should have.
HEADING = r"(?iu)^\s*\|?\s*(?:#{1,6}\s*)?\**\s*(?:SECTION\s*|항목\s*)?([0-9]{1,2})\s*[.:)\-](?![0-9])\s*(.+)$"
KEYWORDS = {
    1: "회사|identification", 2: "유해|hazard", 3: "구성|composition", 4: "응급|first", 5: "화재|폭발|fire", 6: "누출|release",
    7: "취급|저장|handling", 8: "노출|보호구|exposure", 9: "물리|physical", 10: "안정성|반응성|stability", 11: "독성|toxicolog",
    12: "환경|ecolog", 13: "폐기|disposal", 14: "운송|transport", 15: "법적|규제|regulatory", 16: "참고|other",
}
LONGEST_LINE = 100
CHAIN = "array<struct<line:int,number:int,title:string>>"


def candidates(text: Column) -> Column:
    """array<struct<line, number, title, score, jump>> of the lines that look like headings; a title with a word of its
    section scores two more, a styled line one more, and either may follow any lower number."""
    words = F.create_map(*(x for k, v in KEYWORDS.items() for x in (F.lit(k), F.lit(v))))

    def look(line, i):
        number = F.regexp_extract(line, HEADING, 1)
        title = F.regexp_replace(F.regexp_extract(line, HEADING, 2), r"^[ #*|]+|[ #*|]+$", "")
        n = F.when((F.length(line) <= LONGEST_LINE) & (number != ""), number.cast("int"))
        word = F.coalesce(F.regexp_like(F.lower(title), F.try_element_at(words, n)), F.lit(False))
        styled = line.rlike(r"^\s*(#|\*\*|\|)")
        score = 1 + 2 * word.cast("int") + styled.cast("int")
        return F.struct(i.alias("line"), n.alias("number"), title.alias("title"), score.alias("score"), (word | styled).alias("jump"))

    return F.filter(F.transform(F.split(text, "\n"), look), lambda c: c["number"].between(1, 16))


def chain(text: Column) -> Column:
    """The chain of candidates with increasing numbers and the greatest total score; of equal ones the first.

    A fold over the candidates keeps the best chain that ends at each of them, so it runs in generated code, without
    Python; its work grows with the square of a document's candidates."""
    ranked = lambda e: F.struct(e["score"].alias("score"), (-e["at"]).alias("order"), e["chain"].alias("chain"))
    start = F.array().cast(f"array<struct<score:int,at:int,number:int,chain:{CHAIN}>>")

    def extend(ends, c):
        before = F.filter(ends, lambda e: (e["number"] < c["number"]) & (c["jump"] | (e["number"] + 1 == c["number"])))
        best = F.array_max(F.transform(before, ranked))
        own = F.struct(c["line"].alias("line"), c["number"].alias("number"), c["title"].alias("title"))
        end = lambda score, links: F.array(
            F.struct(score.alias("score"), c["line"].alias("at"), c["number"].alias("number"), links.cast(CHAIN).alias("chain"))
        )
        joined = end(best["score"] + c["score"], F.concat(best["chain"], F.array(own)))
        alone = F.when((c["number"] == 1) | c["jump"], end(c["score"], F.array(own))).otherwise(start)
        return F.concat(ends, F.when(best.isNotNull(), joined).otherwise(alone))

    def finish(ends):
        best = F.array_max(F.transform(ends, ranked))
        return F.coalesce(best["chain"], F.array().cast(CHAIN))

    return F.aggregate(candidates(text), start, extend, finish)


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, title, body: the lines under each heading of the chain; 0 for those before the first."""
    lines = F.split("text", "\n")
    front = F.struct(F.lit(-1).alias("line"), F.lit(0).alias("number"), F.lit("front matter").alias("title"))
    own = docs.select("doc_id", lines.alias("lines"), F.concat(F.array(front), chain(F.col("text"))).alias("cuts"))
    cut = own.select("doc_id", "lines", "cuts", F.posexplode("cuts").alias("k", "cut"))
    until = F.coalesce(F.get("cuts", F.col("k") + 1)["line"], F.size("lines"))
    body = F.array_join(F.slice("lines", F.col("cut.line") + 2, until - F.col("cut.line") - 1), "\n")
    out = cut.select("doc_id", F.col("cut.number").alias("section"), F.col("cut.title").alias("title"), body.alias("body"))
    return out.where("section > 0 or trim(body) <> ''")
