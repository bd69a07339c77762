"""Records out of a model's answer: thoughts and fences go, and the outermost braces are tried where the rest fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textnorm import strip, without_thoughts


def extract(answer: Column) -> Column:
    """struct(json, error): the text of the JSON object in an answer; error is null, `empty`, `not_json` or `not_object`.

    An object with a repeated key isn't JSON here."""
    s = strip(F.regexp_replace(without_thoughts(answer), r"^```[A-Za-z]*\s*|\s*```$", ""))
    braces = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    whole, part = F.try_parse_json(s), F.try_parse_json(F.when(braces != "", braces))
    text = F.when(whole.isNotNull(), s).when(part.isNotNull(), braces)
    is_object = F.schema_of_variant(F.coalesce(whole, part)).startswith("OBJECT")
    error = (
        F.when(answer.isNull() | (s == ""), "empty").when(text.isNull(), "not_json").when(~is_object, "not_object")
    )
    return F.struct(F.when(error.isNull(), text).alias("json"), error.alias("error"))
