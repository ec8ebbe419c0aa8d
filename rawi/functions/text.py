"""Column functions on plain text: trimming, lines and pairs of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, which trimming removes from both ends.
SPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def norm(c: Column) -> Column:
    """Key form of an attribute: lower case, trimmed, null as empty."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def lines(text: Column) -> Column:
    """All lines of a text, null as no line."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def verses(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(lines(text), strip), lambda v: v != "")


def verse_count(verses_: Column) -> Column:
    """Number of lines that are not blank in an array of lines."""
    return F.size(F.filter(F.coalesce(verses_, F.array().cast("array<string>")), lambda v: strip(v) != ""))


def pairs(verses_: Column) -> Column:
    """Lines two by two as (first, second); an odd number of lines, or none, gives no pairs."""
    n = F.size(verses_)
    empty = F.array().cast("array<struct<first:string,second:string>>")
    made = F.transform(F.sequence(F.lit(0), n - 2, F.lit(2)), lambda i: F.struct(F.get(verses_, i).alias("first"), F.get(verses_, i + 1).alias("second")))
    return F.when((n > 0) & (n % 2 == 0), made).otherwise(empty)


def every_second(verses_: Column) -> Column:
    """Second, fourth, ... lines."""
    return F.filter(verses_, lambda v, i: i % 2 == 1)


def joined(verses_: Column) -> Column:
    return F.array_join(verses_, "\n")


def pairs_text(pairs_: Column) -> Column:
    """Pairs as text, a line per half, with a newline at the end."""
    return F.array_join(F.transform(pairs_, lambda p: F.concat(p["first"], F.lit("\n"), p["second"], F.lit("\n"))), "")


def final_poem(text: Column) -> Column:
    """What follows ``Final Poem:`` up to a blank line; null without the mark."""
    found = F.regexp_extract(text, r"(?s)Final Poem:(.*?)(\n\n|$)", 1)
    return F.when(text.contains("Final Poem:"), strip(found))


def clean_content(text: Column) -> Column:
    """Text without fenced code and without more than one blank line in a row."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"\n{3,}", "\n\n"))


def parameters(template: Column) -> Column:
    """Distinct ``{name}`` parameters of a template, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([0-9A-Za-z_]+)\}"), F.lit(1)))


def missing_parameters(template: Column, given: Column) -> Column:
    return F.array_except(parameters(template), given)


def render(template: Column, values: dict[str, Column]) -> Column:
    """The template with its parameters replaced; null where one of its parameters is not given."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    missing = missing_parameters(template, F.array(*[F.lit(n) for n in values]) if values else F.array().cast("array<string>"))
    return F.when(F.size(missing) == 0, out)


#: Error kinds by the first of these texts that a message holds.
ERROR_KINDS = (("timeout", ("timeout",)), ("rate_limit", ("rate limit", "quota")), ("connection", ("connection", "network")), ("invalid_request", ("invalid", "bad request")))


def error_kind(message: Column) -> Column:
    low = F.lower(message)
    out = None
    for kind, words in ERROR_KINDS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.when(message.isNotNull(), out.otherwise("other"))


def known_model(name: Column, sizes: list[tuple[str, int]], default: int) -> Column:
    """Value of a model name: the exact entry, else the first entry it starts with, else the default."""
    exact = F.when(F.lit(False), F.lit(default))
    prefix = F.when(F.lit(False), F.lit(default))
    for key, value in sizes:
        exact = exact.when(name == key, F.lit(value))
        prefix = prefix.when(name.startswith(key), F.lit(value))
    return F.coalesce(exact.otherwise(None), prefix.otherwise(None), F.lit(default))
