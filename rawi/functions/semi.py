"""Column functions on half-structured text: JSON inside prose, and HTML."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rawi.functions.text import SPACE, strip


def json_text(text: Column) -> Column:
    """JSON inside free text: a fenced json block, else from the first ``{`` to the last ``}``; null without braces."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.when(strip(fenced) != "", strip(fenced)).otherwise(braces)
    return F.when(found != "", found)


def without_fence(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(json)?\s*", ""), r"```$", ""))


def no_null_text(c: Column) -> Column:
    """The text 'null' as null."""
    return F.nullif(c, F.lit("null"))


def no_null_list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def verses_of_response(text: Column) -> Column:
    """``verses`` of a JSON answer, else its lines that are not blank."""
    told = F.from_json(json_text(text), "verses array<string>")["verses"]
    plain = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda v: v != "")
    return F.coalesce(F.when(F.size(told) > 0, told), plain)


def has_fields(json: Column, required: list[str]) -> Column:
    """Is the text a JSON object with all required fields?"""
    ok = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*[F.lit(x) for x in required]), ok)) == 0


#: Named entities that are replaced in text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Text of flat HTML: paragraphs and breaks end lines, blank lines go."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", "")
    body = F.regexp_replace(body, r"(?i)<br\s*/?>|</p\s*>|</div\s*>|</h[1-6]\s*>|</li\s*>", "\n")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", "")
    for name, sign in ENTITIES:
        body = F.replace(body, F.lit(name), F.lit(sign))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda v: F.btrim(v, F.lit(SPACE))), lambda v: v != "")
    return F.array_join(lines, "\n")


def id_of_file(name: Column) -> Column:
    """Poem id in a response file's name; null for other names."""
    return F.nullif(F.regexp_extract(name, r"poem_(\d+)_response\.html", 1), F.lit("")).cast("long")


def custom_result(line: Column) -> Column:
    """(custom_id, content) of a batch output line; null where the line is not such JSON."""
    shape = "custom_id string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>"
    row = F.from_json(line, shape)
    return F.when(row["custom_id"].isNotNull(), F.struct(row["custom_id"].alias("custom_id"), F.get(row["response"]["body"]["choices"], F.lit(0))["message"]["content"].alias("content")))


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object in each text, up to its closing brace; null where none closes.

    Braces nest, which regular expressions cannot follow; braces in strings do not count.
    """
    return texts.map(_balanced, na_action="ignore")


_SIGN = re.compile(r'\\.|["{}]', re.DOTALL)


def _balanced(text: str) -> str | None:
    begin = text.find("{")
    depth, quoted = 0, False
    for m in _SIGN.finditer(text, begin) if begin >= 0 else ():
        if m[0] == '"':
            quoted = not quoted
        elif not quoted and m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return text[begin : m.end()]
    return None


def lists_hold(json: Column, names: list[str]) -> Column:
    """Are all these fields of a JSON object arrays?"""
    ok = F.lit(True)
    for name in names:
        ok = ok & F.coalesce(F.json_array_length(F.get_json_object(json, f"$.{name}")).isNotNull(), F.lit(False))
    return ok


def verdict_of(text: Column, yes: list[str], field: str = "is_valid") -> Column:
    """A verdict from a JSON answer; from prose, whether it holds one of the words for yes."""
    told = F.from_json(json_text(text), f"{field} boolean")[field]
    said = F.lit(False)
    for word in yes:
        said = said | F.lower(text).contains(word)
    return F.coalesce(told, said)
