"""Variants of documents for training: renderers keep every protected token, mutators change the labels with the text.

Choices come from a hash of (seed, doc_id, variant), so a variant is the same wherever and whenever it is made. Patterns that may
begin anywhere look at the next character first (`(?=[...])`), which changes no match and spares most places the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.chem import let

HANGUL = "가나다라마바사아자차카타파하"
#: What each renderer looks for, and what stands there instead; `$1` is the pattern's group. Bullets; numbers of
#: sections 1 to 3 before their titles; colons after a Hangul label, but not within brackets; names of the CAS column.
SECTION = r"(?m)^[ \t]*(?:제[ \t]*)?([123])[ \t]*(?:항)?[ \t]*[.)]?[ \t]*(?=(?:화학\s*제품|유해|구성\s*성분))"
STYLES = {
    "bullet": (r"(?m)^([ \t]*)(?:[◦○•·▶※\-]|[ㅇo](?=[ \t]))[ \t]*", ["$1◦ ", "$1○ ", "$1- ", "$1• ", "$1· ", "$1▶ ", "$1※ ", "$1"]),
    "section": (SECTION, ["$1. ", "$1) ", "제$1항 ", "【$1】 ", "$1.", "SECTION $1. "]),
    "colon": (r"(?=[ \t:：])(?<=[가-힣)])[ \t]*[:：][ \t]*(?![^()\n]*\))", [" : ", ": ", ":", " ： ", " - "]),
    "caslabel": (r"(?i)(?=C)\bCAS[ \t]*(?:Registry[ \t]*)?(?:No\.?|번호|Number)", ["CAS No.", "CAS 번호", "CAS NO.", "CAS번호", "CAS Registry No."]),
}
#: Sub-item numbers, by syllable {h} or digit {d}; header lines; words for a masked identifier, one twice as often.
SUB_STYLES = ["{h}. ", "{h}) ", "({h}) ", "{d}) ", "({d}) "]
PAGE_HEADERS = [
    "물질안전보건자료(MSDS)", "Page {p} of {t}", "페이지 {p} / {t}", "- {p} -", "MSDS번호 : AA{num}", "개정일자 : 2024.0{m}.1{p}", "{p}/{t}",
]
SECRETS = ["영업비밀", "영업비밀", "비공개", "자료없음(영업비밀)", "Trade Secret"]
#: Fixed patterns of tokens that decide a label, and of a statement's codes with what stands between them and the phrase.
PROTECTED = {
    "signal": r"(?i)(?=[위경DW])(?:위[ \t]*험|경[ \t]*고|\bDANGER\b|\bWARNING\b)", "category": r"(?i)(?=[구C])(?:구[ \t]*분|Category)[ \t]*[0-9][A-C]?",
    "gas": r"(?i)(?=[압냉액용LC])(?:압축[ \t]*가스|냉동[ \t]*액화[ \t]*가스|액화[ \t]*가스|용해[ \t]*가스|Liquefied gas|Compressed gas)",
    "state": r"(?i)(?=[자해분N])(?:자[ \t]*료[ \t]*없[ \t]*음|해[ \t]*당[ \t]*없[ \t]*음|분류[ \t]*되지[ \t]*않|Not applicable)",
    "bound": "(?=[<>≤≥＜＞이미초])(?:[<>≤≥＜＞]=?|이상|이하|미만|초과)",
}
#: What a line with a protected token has at least; no token reaches over the end of a line.
MAYBE = r"[<>≤-＞]", r"(?i)(?=[DGQWP])(?:danger\b|warning\b|gory[ \t]*[0-9]|quefied gas|pressed gas|pplicable)"
CODES = r"(?=H)\bH[0-9]{3}(?:[ \t]*\+[ \t]*H[0-9]{3})*[ \t]*[:：\-]?[ \t]*"
#: Draws of a variant until one passes the checks.
TRIES = 6


def draw(seed: int, doc_id: Column, variant: Column, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("string"), variant.cast("string"), F.lit(salt)), F.lit(n)).cast("int")


def choose(pick: Column, styles: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, styles)), pick)


def restyled(name: str):
    """The renderer that puts one style in the place of all matches of a pattern."""
    pattern, styles = STYLES[name]
    return (lambda text, pick: F.regexp_replace(text, F.lit(pattern), choose(pick, styles))), len(styles)


def sub_numbers(text: Column, pick: Column) -> Column:
    """Sub-items numbered by syllables or by digits before a Hangul label, all in one style."""
    syllable, digit = rf"^(\s*)([{HANGUL}])\s*[.)]\s*(?=[^ ])", r"^(\s*)\(?([1-9]|1[0-4])\)\s*(?=[가-힣])"

    def renumber(s):
        # Most lines are told by their first characters, without a look at the rest.
        begin = F.substring(F.ltrim(s, F.lit(" \t\n\x0b\f\r")), 1, 1)
        return F.when(begin.isin(*HANGUL, *"(123456789"), numbered(s)).otherwise(s)

    def numbered(s):
        by = lambda p, g: F.regexp_extract(s, p, g)
        own = F.when(s.rlike(syllable), F.instr(F.lit(HANGUL), by(syllable, 2))).when(s.rlike(digit), by(digit, 2).try_cast("int"))
        mark = F.replace(F.replace(choose(pick, SUB_STYLES), F.lit("{d}"), own.cast("string")), F.lit("{h}"), F.substring(F.lit(HANGUL), own, F.lit(1)))
        rest = F.regexp_replace(s, rf"{syllable}|{digit}", "")
        return F.when(own.isNotNull(), F.concat(F.regexp_extract(s, r"^(\s*)", 1), mark, rest)).otherwise(s)

    return F.array_join(F.transform(F.split(text, "\n"), renumber), "\n")


def page_headers(text: Column, pick: Column) -> Column:
    """A header line before each section heading but one in the first line, each drawn anew; pages count from 2."""
    number = lambda k, low, n: (F.pmod(F.xxhash64(pick, k), F.lit(n)) + low).cast("string")

    def put(heads, s, i):
        page = F.array_position(heads, i).cast("int") + 1
        header = choose(F.pmod(F.xxhash64(pick, page), F.lit(len(PAGE_HEADERS))).cast("int"), PAGE_HEADERS)
        values = {"{p}": page.cast("string"), "{t}": number(F.lit(0), 3, 10), "{num}": number(page + 1000, 10**9, 9 * 10**9), "{m}": number(page + 2000, 1, 9)}
        for mark, value in values.items():
            header = F.replace(header, F.lit(mark), value)
        return F.when(F.array_contains(heads, i), F.concat(header, F.lit("\n"), s)).otherwise(s)

    def paged(lines):  # the headings' places are worked out once for all lines
        heads = F.filter(F.transform(lines, lambda s, i: F.when((i > 0) & s.rlike(SECTION), i)), lambda i: i.isNotNull())
        return let(heads, lambda found: F.array_join(F.transform(lines, lambda s, i: put(found, s, i)), "\n"))

    return let(F.split(text, "\n"), paged)


RENDERERS = {
    "bullet": restyled("bullet"), "section": restyled("section"), "subnum": (sub_numbers, len(SUB_STYLES)), "colon": restyled("colon"),
    "pagehdr": (page_headers, 1 << 20), "caslabel": restyled("caslabel"),
}


def occurrences(text: Column, value: Column) -> Column:
    return F.when(value != "", F.size(F.split(text, F.concat(F.lit(r"\Q"), value, F.lit(r"\E")), -1)) - 1).otherwise(0)


def mask_ingredient(text: Column, ingredients: Column, pick: Column) -> Column:
    """struct(text, ingredients, gone): one ingredient whose CAS number stands in the text once becomes a trade secret;
    null if there is none. ingredients: array<struct<name, cas, ke, is_sub>>."""
    usable = F.filter(
        F.transform(ingredients, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda c: (occurrences(text, c["x"]["cas"]) == 1) & ~c["x"]["is_sub"]
        & (occurrences(text, F.coalesce(c["x"]["ke"], F.lit(""))) <= 1),
    )

    def masked(c):
        cas, ke = c["x"]["cas"], c["x"]["ke"]
        joined = F.concat(F.lit(r"\Q"), cas, F.lit(r"\E"), F.coalesce(F.concat(F.lit(r"(?:\s*/?\s*\Q"), ke, F.lit(r"\E)?")), F.lit("")))
        hidden = F.regexp_replace(text, joined, choose(F.pmod(pick, F.lit(len(SECRETS))), SECRETS))
        hidden = F.when(ke.isNotNull(), F.replace(hidden, ke, F.lit(""))).otherwise(hidden)
        others = F.transform(
            ingredients,
            lambda x, i: F.when(i == c["i"], x.withField("cas", F.lit(None).cast("string")).withField("ke", F.lit(None).cast("string")).withField("is_sub", F.lit(True))).otherwise(x),
        )
        gone = F.filter(F.array(cas, ke), lambda x: x.isNotNull())
        return F.when(c.isNotNull(), F.struct(hidden.alias("text"), others.alias("ingredients"), gone.alias("gone")))

    return let(let(usable, lambda u: F.get(u, F.pmod(pick, F.greatest(F.size(u), F.lit(1))))), masked)


def drop_codes(text: Column, statements: Column) -> Column:
    """struct(text, statements): no code in the text or the statements; null if there was none, or one stays."""
    some = F.exists(statements, lambda h: h["code"].isNotNull())
    cleared = F.transform(statements, lambda h: h.withField("code", F.lit(None).cast("string")))
    own = lambda bare: F.when(some & ~bare.rlike(r"(?=H)\bH[0-9]{3}\b"), F.struct(bare.alias("text"), cleared.alias("statements")))
    return let(F.regexp_replace(text, CODES, ""), own)


def add_ec_numbers(text: Column, cas_numbers: Column, pick: Column) -> Column:
    """An EC number with a right check digit after each CAS number that stands in the text once; null if none does."""
    from dossier.functions.textnorm import ec_check_digit

    usable = F.filter(cas_numbers, lambda c: occurrences(text, c) == 1)

    def put(acc, c):
        at = lambda k: (200_000 + F.pmod(F.xxhash64(c, pick, F.lit(k)), F.lit(800_000))).cast("string")
        digits = F.coalesce(*(F.when(ec_check_digit(at(k)).isNotNull(), at(k)) for k in range(8)), F.lit("200000"))
        number = F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 3), F.lit("-"), ec_check_digit(digits).cast("string"))
        return F.replace(acc, c, F.concat(c, F.lit(" "), number))

    return F.when(F.size(usable) > 0, F.aggregate(usable, text, put))


def protected_tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, token, n: protected tokens without white space, in capitals."""
    return docs.select(key, F.inline(found_tokens(F.col("text")))).groupBy(key, "kind", "token").agg(F.count("*").alias("n"))


def _found(kind: str, pattern: str, text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), F.upper(F.regexp_replace(t, r"\s+", "")).alias("token")))


def found_tokens(text: Column) -> Column:
    """array<struct<kind, token>> of a text: the patterns are sought in those lines alone that may have a token."""
    lines = F.array_join(F.filter(F.split(text, "\n"), lambda s: s.rlike(MAYBE[0]) | s.rlike(MAYBE[1])), "\n")
    return let(lines, lambda own: F.flatten(F.array(*(_found(k, p, own) for k, p in PROTECTED.items()))))


def token_changes(before: DataFrame, after: DataFrame, more_allowed: bool = False, key: str = "doc_id") -> DataFrame:
    """Tokens whose number fell, or changed at all where more aren't allowed."""
    a = protected_tokens(before, key).withColumnRenamed("n", "n_before")
    b = protected_tokens(after, key).withColumnRenamed("n", "n_after")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    both = a.join(b, [key, "kind", "token"], "full").select(key, "kind", "token", zero("n_before"), zero("n_after"))
    return both.where("n_after < n_before" if more_allowed else "n_after <> n_before")


def token_changes_in_rows(rows: DataFrame, before: str, after: str, more_allowed: bool = False, key: str = "doc_id") -> DataFrame:
    """As `token_changes`, of rows that hold both texts (a document each): equal texts are not searched, and nothing is joined."""
    times = lambda of, x: F.size(F.filter(of, lambda y: y == x)).cast("long")

    def told(x, own):
        n = F.struct(x["kind"].alias("kind"), x["token"].alias("token"), times(own["a"], x).alias("n_before"), times(own["b"], x).alias("n_after"))
        return let(n, lambda c: F.when(c["n_after"] < c["n_before"] if more_allowed else c["n_after"] != c["n_before"], c))

    none = F.array().cast("array<struct<kind:string,token:string>>")
    both = F.struct(F.coalesce(found_tokens(F.col(before)), none).alias("a"), F.coalesce(found_tokens(F.col(after)), none).alias("b"))
    changed = let(both, lambda own: F.transform(F.array_distinct(F.concat(own["a"], own["b"])), lambda x: told(x, own)))
    found = rows.where(~F.col(before).eqNullSafe(F.col(after))).select(key, F.explode(changed).alias("c"))
    return found.where("c is not null").select(key, "c.*")


def variants(docs: DataFrame, names: list[str], seed: int = 42) -> DataFrame:
    """doc_id, variant, text of the renderers' variants that differ from the text, and from each other within a document."""
    doc = F.col("doc_id")
    made = F.array(*(
        F.struct(F.lit(v).alias("variant"), RENDERERS[v][0](F.col("text"), draw(seed, doc, F.lit(v), "style", RENDERERS[v][1])).alias("text"))
        for v in names
    ))
    own = docs.where("text is not null").select("doc_id", F.col("text").alias("old"), F.inline(made)).where("text <> old")
    return own.groupBy("doc_id", F.xxhash64("text").alias("h"), "text").agg(F.min("variant").alias("variant")).select("doc_id", "variant", "text")


def tokens_of(text: Column) -> Column:
    """The protected tokens of a text, sorted."""
    return F.array_sort(found_tokens(text))


def assemble(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, form, variant, state, text of documents (doc_id, split, form, text, ingredients as for `mask_ingredient`,
    statements): the original, each renderer's variant, and for split train a masked ingredient and a text without codes.

    A variant is drawn TRIES times at most, until its protected tokens are the original's (a mutator may add some, and what
    it took away must be gone) and its text is that of no variant before it. State: `made`, `rejected` where no draw passed,
    `not_applicable` where the document has nothing to change; only made ones have a text."""
    doc, text = F.col("doc_id"), F.col("text")
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    row = lambda variant, state, t: F.struct(F.lit(variant).alias("variant"), state.alias("state"), t.alias("text"))
    times = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    none = F.lit(None).cast("string")

    def fewer(t):  # whether the new text has some token less often
        return let(tokens_of(t), lambda new: F.exists(F.array_distinct("_tokens"), lambda x: times(F.col("_tokens"), x) > times(new, x)))

    def secret(k):
        return mask_ingredient(text, F.col("ingredients"), draw(seed, doc, F.lit("secret1"), str(k), 1 << 20))

    def no_codes(k):
        empty = F.array().cast("array<string>")
        return let(drop_codes(text, F.col("statements")), lambda m: F.when(m.isNotNull(), F.struct(m["text"].alias("text"), empty.alias("gone"))))

    def rendered(name):
        render, n = RENDERERS[name]
        own = lambda k: render(text, draw(seed, doc, F.lit(name), str(k), n))
        return lambda k, seen: let(own(k), lambda t: F.when(~F.array_contains(seen, t) & (tokens_of(t) == F.col("_tokens")), t))

    def mutated(make):
        gone = lambda m: F.exists(m["gone"], lambda g: bare(m["text"]).contains(bare(g)))
        passed = lambda m, seen: F.when(m.isNotNull() & ~F.array_contains(seen, m["text"]) & ~gone(m) & ~fewer(m["text"]), m["text"])
        return lambda k, seen: let(make(k), lambda m: passed(m, seen))

    mutators = {"secret1": (secret, TRIES), "nohcode": (no_codes, 1)}
    steps = [(v, rendered(v), TRIES, None) for v in RENDERERS] + [(v, mutated(m), n, m) for v, (m, n) in mutators.items()]

    # A column for each variant, not expressions within each other: their types would be worked out anew for each row.
    own = docs.where("text is not null").withColumn("_tokens", tokens_of(text))
    out = [row("orig", F.lit("made"), F.coalesce(text, none))]
    for at, (name, attempt, tries, make) in enumerate(steps):
        seen = F.filter(F.array(text, *(F.col(f"_made{k}") for k in range(at))), lambda t: t.isNotNull())
        found, lost = F.coalesce(*(attempt(k, seen) for k in range(tries))), F.lit("rejected")
        if make is not None:  # for training alone
            found = F.when(F.col("split") == "train", found)
            lost = F.when(F.col("split") == "train", let(make(0), lambda m: F.when(m.isNull(), "not_applicable").otherwise("rejected")))
        own, t = own.withColumn(f"_made{at}", found), F.col(f"_made{at}")
        out.append(row(name, F.when(t.isNotNull(), "made").otherwise(lost), t))
    made = own.select("doc_id", "form", F.inline(F.array(*out)))
    return made.where("state is not null").select("doc_id", "form", "variant", "state", "text")


def build_report(assembled: DataFrame) -> DataFrame:
    """form (`all` for every one), n_docs, n_examples, multiplier (examples a document), n_rejected, n_not_applicable."""
    count = lambda state: F.count_if(F.col("state") == state)
    every = assembled.select("doc_id", "state", F.explode(F.array(F.coalesce("form", F.lit("?")), F.lit("all"))).alias("form"))
    n = every.groupBy("form").agg(
        F.countDistinct("doc_id").alias("n_docs"), count("made").alias("n_examples"), count("rejected").alias("n_rejected"),
        count("not_applicable").alias("n_not_applicable"),
    )
    return n.select("form", "n_docs", "n_examples", F.round(F.col("n_examples") / F.col("n_docs"), 2).alias("multiplier"), "n_rejected", "n_not_applicable")


def report(made: DataFrame) -> DataFrame:
    """Numbers of variants by name without its trailing digits."""
    return made.groupBy(F.regexp_replace("variant", "[0-9]+$", "").alias("variant")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
