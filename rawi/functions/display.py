"""Texts made from rows: examples, constraints, listings, clarifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def example_text(title: Column, poet: Column, era: Column, meter: Column, qafiya: Column, theme: Column, verses: Column) -> Column:
    """``title (poet, era)``, then ``meter | qafiya`` with the theme if there is one, then the lines."""
    head = F.concat(title, F.lit(" ("), poet, F.lit(", "), era, F.lit(")"))
    kind = F.concat_ws(" | ", meter, qafiya, filled(theme))
    return F.concat(head, F.lit("\n"), kind, F.lit("\n"), F.array_join(verses, "\n"), F.lit("\n"))


def web_example_text(title: Column, url: Column, snippet: Column, score: Column) -> Column:
    """Title, url and snippet of a web result; the score only where it is not zero."""
    told = F.when(F.coalesce(score, F.lit(0.0)) != 0, F.concat(F.lit("score "), F.format_string("%.1f", score)))
    return F.concat_ws("\n", title, url, snippet, told)


def constraint_text(parts: dict[str, Column]) -> Column:
    """``name: value`` of the values that are not empty, joined by bars."""
    return F.concat_ws(" | ", *[F.when(filled(c.cast("string")).isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in parts.items()])


def clarifications(ambiguities: Column, markers: list[str]) -> Column:
    """Bullets of the ambiguities that hold a marker word; null where none does."""
    hit = F.filter(ambiguities, _holds_any(markers))
    return F.when(F.size(hit) > 0, F.array_join(F.transform(hit, lambda a: F.concat(F.lit("- "), a)), "\n"))


def _holds_any(markers: list[str]):
    def test(a: Column) -> Column:
        out = F.lit(False)
        for m in markers:
            out = out | a.contains(m)
        return out

    return test


def listing(items: Column, head: str) -> Column:
    """Numbered blocks of an array of texts."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(f"{head} "), (i + 1).cast("string"), F.lit(":\n"), x)), "\n\n")


def parity_message(n: Column) -> Column:
    """Verdict on the number of lines: even counts are pairs."""
    pairs = F.floor(n / 2).cast("string")
    return F.when(n % 2 == 0, F.concat(F.lit("even: "), pairs, F.lit(" pairs"))).otherwise(F.concat(F.lit("odd: "), n.cast("string"), F.lit(" lines")))


def narrative_lines(json: Column) -> Column:
    """Analysis steps, poem and conclusion of a JSON narrative, a line each; other text as it is."""
    told = F.from_json(json, "analysis array<string>, final_poem string, conclusion string")
    lines = F.concat(F.coalesce(told["analysis"], F.array().cast("array<string>")), F.array(told["final_poem"], told["conclusion"]))
    kept = F.filter(lines, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(json)
