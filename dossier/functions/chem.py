"""Scalar functions on chemical identifiers, contents and phrases, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of identifiers.
CAS = r"^([0-9]{2,7})-([0-9]{2})-([0-9])$"
KE = r"^KE-[0-9]{5}$"
HCODE = r"^H[0-9]{3}[A-Za-z]{0,2}(\+H[0-9]{3}[A-Za-z]{0,2})*$"
#: Fixed value: the characters of `(?U)\s`, as a class that is quick to look up.
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def let(x: Column, f) -> Column:
    """f of x, with x worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def squash(c: Column) -> Column:
    """All white space of Unicode removed."""
    return F.regexp_replace(c, f"[{SPACE}]+", "")


def cas_format_ok(cas: Column) -> Column:
    return cas.rlike(CAS)


def cas_checksum_ok(cas: Column) -> Column:
    """The last digit is the sum of the digits before it, weighted 1, 2, ... from the right, modulo 10; null for other text."""
    def right(digits):
        # Ten digits at most, and 0 for places there are not.
        digit = lambda k: F.greatest(F.ascii(F.substring(digits, k, 1)) - 48, F.lit(0))
        return F.pmod(reduce(add, ((k - 1) * digit(k) for k in range(2, 11))), F.lit(10)) == digit(1)

    return F.when(cas_format_ok(cas), let(F.reverse(F.translate(cas, "-", "")), right))


def norm_signal_word(c: Column) -> Column:
    low = F.lower(squash(c))
    return F.when(low.isin("danger", "위험"), "위험").when(low.isin("warning", "경고"), "경고").otherwise(squash(c))


def content_bounds(content: Column) -> Column:
    """struct(lo, hi) of a content such as `10~20`, `<1` or `15 %`; null if it has no or more than two numbers."""
    text = F.replace(content, F.lit("%"), F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1).cast("array<double>")
    upper, lower = (reduce(or_, map(text.contains, marks.split())) for marks in ("< ≤ 미만 이하", "> ≥ 이상 초과"))
    pair = lambda a, b: F.struct(a.cast("double").alias("lo"), b.cast("double").alias("hi"))
    single = lambda one: F.when(upper, pair(F.lit(0), one)).when(lower, pair(one, F.lit(100))).otherwise(pair(one, one))
    return let(
        numbers, lambda n: F.when(F.size(n) == 2, pair(F.array_min(n), F.array_max(n))).when(F.size(n) == 1, single(F.get(n, F.lit(0))))
    )


def content_key(content: Column) -> Column:
    """A string that is equal for equal contents: `null`, `P:lo:hi` to six digits, or the squashed text."""
    fixed = lambda x: F.coalesce(x.try_cast("decimal(38,6)").cast("string"), F.format_string("%.6f", x))  # noqa: E731  (the first is quicker)
    amount = lambda b: F.when(b.isNotNull(), F.concat(F.lit("P:"), fixed(b["lo"]), F.lit(":"), fixed(b["hi"])))
    return F.when(content.isNull(), "null").otherwise(F.coalesce(let(content_bounds(content), amount), F.concat(F.lit("S:"), squash(content))))


def content_lower(content: Column) -> Column:
    """The amount a content stands for at least: 0 for one number with an upper mark, else its smallest number."""
    numbers = F.regexp_extract_all(content, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1).cast("array<double>")
    return F.when((F.size(numbers) == 1) & content.rlike("미만|이하|<"), F.lit(0.0)).otherwise(F.array_min(numbers))


def split_hcodes(code: Column) -> Column:
    return F.filter(F.split(F.upper(squash(code)), r"\+"), lambda x: x != "")


def hcodes_of(text: Column) -> Column:
    """Distinct codes of a text; a letter before the H makes it none."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])(H[0-9]{3})"), 1))


def norm_phrase(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, " ", ""), "[.。]+$", "")


def safe_csv(c: Column) -> Column:
    """A value that a spreadsheet doesn't take for a formula."""
    return F.when(c.rlike("^[=+@\\-\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, None).otherwise(a.cast("double") / b.cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Null if all are zero."""
    return ratio(2 * tp, 2 * tp + fp + fn)
