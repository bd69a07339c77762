"""Sectioning, cleaning and chunking of document text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.chem import hcodes_of, let

#: Section headings and marks of the precaution block, as (name, pattern), in order; one line each.
SECTION2 = [
    ("KO_2", r"^\s*2\s*[.:)\-–]?\s*유+\s*해+|^\s*2\s*[.:)\-–]?\s*위+\s*험+"), ("EN_2", r"(?i)^\s*2\s*[.:)\-–]?\s*Hazards?\b"),
    ("EN_SECTION2", r"(?i)^\s*SECTION\s*2\b"),
]
SECTION3 = [
    ("KO_3", r"^\s*3\s*[.:)\-–]?\s*구+\s*성+"), ("EN_3", r"(?i)^\s*3\s*[.:)\-–]?\s*Composition"), ("EN_SECTION3", r"(?i)^\s*SECTION\s*3\b"),
]
SECTION4 = [
    ("KO_4", r"^\s*4\s*[.:)\-–]?\s*응+\s*급+\s*[조처]+\s*치+"), ("KO_4_JE", r"^\s*제\s*4\s*항"),
    ("EN_4", r"(?i)^\s*4\s*[.:)\-–]?\s*first[\s\-]*aid"), ("EN_SECTION4", r"(?i)^\s*SECTION\s*4\b"),
]
P_START = [
    ("KO_P", r"^\s*(?:[○◦oO•●▶\-]\s*|\d+\)\s*|\d+(?:\.\d+)*\.?\s*)?예\s*방\s*조\s*치\s*문\s*구\s*(?:\(GHS\s*KR\))?\s*(?:[:：]|-|$|(?:예방|대응|저장|폐기)\b)"),
    ("EN_P", r"(?i)^\s*(?:[•\-]\s*|\d+(?:\.\d+)*\.?\s*)?Precautionary\s+statements?\b(?!.*including)"),
]
P_END = [
    ("KO_DA", r"^\s*다\s*[.)]"), ("KO_OTHER", r"^\s*(?:[○◦\-•]\s*)?기\s*타\s*유\s*해"),
    ("EN_OTHER", r"(?i)^\s*(?:2\.3\.?|C[.)])?\s*(?:Other\s+hazards|Hazards\s+not\s+otherwise\s+classified)"), ("EN_23", r"^\s*2\.3\b"),
]


def join_codes(text: Column) -> Column:
    """Codes that stand apart by one space, such as `H 412`, joined."""
    return F.regexp_replace(text, r"(?<![A-Za-z])([HP]) ([0-9]{3})(?![0-9])", "$1$2")


def first_match(lines: Column, patterns: list[tuple[str, str]], start: Column, end: Column | None = None) -> Column:
    """struct(i, name) of the first line from `start` (before `end`) that a pattern fits, and that pattern's name; or null."""

    def name(line):
        out = F.lit(None).cast("string")
        for label, pattern in reversed(patterns):
            out = F.when(line.rlike(pattern), label).otherwise(out)
        return out

    # The pattern of all is tried first, so that a line is looked at closely only if it fits one.
    either = "|".join(f"(?:{p})" for _, p in patterns)
    stop = F.size(lines) if end is None else end
    hits = F.filter(F.transform(lines, lambda s, i: F.when((i >= start) & (i < stop) & s.rlike(either), F.struct(i.alias("i"), s.alias("line")))), lambda h: h.isNotNull())
    return let(F.get(hits, F.lit(0)), lambda hit: F.when(hit.isNotNull(), F.struct(hit["i"].alias("i"), name(hit["line"]).alias("name"))))


def cut_to_section3(text: Column) -> Column:
    """struct(text, name): the lines before section 4, which is sought after section 3 where there is one; null if none."""

    def cut(lines):
        return let(F.coalesce(first_match(lines, SECTION3, F.lit(0))["i"] + 1, F.lit(0)), lambda start: fourth(lines, start))

    def fourth(lines, start):
        return let(first_match(lines, SECTION4, start), lambda at: F.when(at.isNotNull(), before(lines, at)))

    def before(lines, at):
        kept = F.regexp_replace(F.array_join(F.slice(lines, 1, at["i"]), "\n"), r"\s+$", "")
        return F.struct(F.concat(kept, F.lit("\n")).alias("text"), at["name"].alias("name"))

    return let(F.split(text, "\n"), cut)


def remove_p_block(text: Column) -> Column:
    """struct(text, status): within section 2, the lines from the block's heading to its end go. The status is the heading's
    pattern, `NONE`, or `ABORTED_H_LOSS: …` with the codes that would be lost, and then all stays."""

    def cut(lines):
        return let(F.coalesce(first_match(lines, SECTION2, F.lit(0))["i"], F.lit(-1)), lambda begin: until(lines, begin))

    def until(lines, begin):
        stop = F.coalesce(first_match(lines, SECTION3, begin + 1)["i"], F.size(lines))
        return let(stop, lambda hi: within(lines, F.greatest(begin, F.lit(0)), hi))

    def within(lines, lo, hi):
        return let(first_match(lines, P_START, lo, hi), lambda at: block(lines, hi, at))

    def block(lines, hi, at):
        return let(F.coalesce(first_match(lines, P_END, at["i"] + 1, hi)["i"], hi), lambda end: without(lines, at, end))

    def without(lines, at, end):
        lost = F.array_sort(hcodes_of(F.array_join(F.slice(lines, at["i"] + 1, end - at["i"]), "\n")))
        kept = F.array_join(F.concat(F.slice(lines, 1, at["i"]), F.slice(lines, end + 1, F.size(lines))), "\n")
        status = lambda x: F.when(at.isNull(), "NONE").when(F.size(x) > 0, F.concat(F.lit("ABORTED_H_LOSS: "), F.array_join(x, ","))).otherwise(at["name"])
        return let(lost, lambda x: F.struct(F.when(at.isNotNull() & (F.size(x) == 0), kept).otherwise(text).alias("text"), status(x).alias("status")))

    return let(F.split(text, "\n"), cut)


def preprocess(docs: DataFrame) -> DataFrame:
    """doc_id, status, text, section4_pattern, p_block_pattern, h_code_before, h_code_after, note of each (doc_id, text). A
    document without section 4 is NOT_FOUND and has no text, so that no model is given it."""
    own = docs.select("doc_id", join_codes(F.coalesce("text", F.lit(""))).alias("raw"))
    own = own.withColumn("cut", cut_to_section3(F.col("raw"))).withColumn("p", F.when(F.col("cut").isNotNull(), remove_p_block(F.col("cut.text"))))
    found, info = F.col("cut").isNotNull(), F.col("p.status")
    removed = ~info.startswith("ABORTED") & (info != "NONE")
    before = F.size(hcodes_of(F.when(found, F.col("cut.text")).otherwise(F.col("raw"))))
    after = F.when(found, F.size(hcodes_of(F.col("p.text")))).otherwise(0)
    note = F.when(~found, "NO_SECTION4").when(info.startswith("ABORTED"), "P_BLOCK_KEPT").when(
        (info == "NONE") & F.col("cut.text").rlike(r"(?<![A-Za-z])P[0-9]{3}"), "P_LABEL_NOT_FOUND"
    ).otherwise("")
    return own.select(
        "doc_id", F.when(found, "SUCCESS").otherwise("NOT_FOUND").alias("status"), F.col("p.text").alias("text"),
        F.col("cut.name").alias("section4_pattern"), F.when(removed, info).alias("p_block_pattern"),
        before.alias("h_code_before"), after.alias("h_code_after"), note.alias("note"),
    )


def undouble(text: Column, factor: Column) -> Column:
    """Each run of `factor` equal letters (of Hangul and its marks) becomes one: letters that bold print repeats."""
    pattern = F.concat(F.lit(r"([가-힣ㆍ․])\1{"), (factor - 1).cast("string"), F.lit("}"))
    return F.when(factor > 1, F.regexp_replace(text, pattern, F.lit("$1"))).otherwise(text)


def cut_page(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page: the first page (doc_id, page, n_lines) up to whose end the line (doc_id, line_no, from 0) lies."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = pages.withColumn("line_end", F.sum("n_lines").over(w)).join(lines, "doc_id").where("line_no < line_end")
    return upto.groupBy("doc_id").agg(F.min("page").alias("page"))


def repeat_factor(docs: DataFrame, least: int = 20) -> DataFrame:
    """doc_id and the commonest length of runs of one character of three and more, if `least` runs have it."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"((\S)\2{2,})"), 1)).alias("run"))
    n = runs.groupBy("doc_id", F.length("run").alias("k")).agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"), F.max("n").alias("n")).where(F.col("n") >= least)


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, r"(.)\1+", "$1")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, body: lines under each numbered heading (1 to 16), 0 for what comes before the first."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    number = F.try_to_number(F.regexp_extract("line", r"^\s*(1[0-6]|[1-9])\s*[.)]", 1), F.lit("99"))
    w = Window.partitionBy("doc_id").orderBy("n")
    own = lines.withColumn("section", F.coalesce(F.last(number, ignorenulls=True).over(w), F.lit(0)).cast("int"))
    return own.groupBy("doc_id", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body")
    )


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """doc_id, chunk, text: windows of `size` characters that overlap."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(step)))
    own = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk"))
    return own.select("doc_id", "chunk", F.substring(F.col("text"), F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def top_k(chunks: DataFrame, query: list[float], k: int, product: str = "label") -> DataFrame:
    """The k nearest chunks of each product by cosine in double precision; ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    e = F.transform("embedding", lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = F.round(dot(e, q) / F.sqrt(dot(e, e) * dot(q, q)), 6)
    scored = chunks.select(product, "vec_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy(product).orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


#: What a text is cut at, the widest gap first.
SEPARATORS = ["\n\n", "\n", " ", ""]


def split_recursively(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the widest gap that is there and merged up to that size with up to
    `overlap` characters in common; what is still too long is cut at the next gap."""
    gap = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(gap) + 1 :]
    out, held = [], []

    def emit():
        joined = gap.join(held).strip()
        if joined:
            out.append(joined)

    for part in filter(None, text.split(gap) if gap else list(text)):
        if len(part) >= size and finer:
            emit()
            held.clear()
            out.extend(split_recursively(part, size, overlap, finer))
            continue
        length = sum(map(len, held)) + len(gap) * max(0, len(held) - 1)
        if held and length + len(gap) + len(part) > size:
            emit()
            while held and (length > overlap or length + len(gap) + len(part) > size):
                length -= len(held.pop(0)) + (len(gap) if held else 0)
        held.append(part)
    emit()
    return out


def recursive_chunks(sections: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """doc_id, section, section_title, chunk, text of sections (doc_id, product, section, title, body): each chunk under a line
    that says where it is from. Cutting depends on what was cut before, so it runs by text in Python over Arrow batches."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "product", "section", "title", "body"))
            rows = [
                (doc_id, section, title, n, f"[출처: {product} · {f'{section}. {title}' if section else title}]\n{piece}")
                for doc_id, product, section, title, body in zip(*columns, strict=True)
                for n, piece in enumerate(split_recursively(body or "", size, overlap))
            ]
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.string(), pa.int32(), pa.string())
            cut = list(zip(*rows, strict=True)) or [()] * 5
            names = ["doc_id", "section", "section_title", "chunk", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cut, kinds, strict=True)], names=names)

    own = sections.select("doc_id", "product", F.col("section").cast("int").alias("section"), "title", "body")
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, section int, section_title string, chunk int, text string")
