"""Multi-criteria corpus search as one predicate on one scan.

A ``Criteria`` compiles to a single Catalyst predicate, so a search is a filter
over the columns it names; limits are by ``poem_idx``.  Attribute values that are
null or empty never match.  In AND mode all given attributes must match, in OR
mode one of them; bounds, language and location hold in both modes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawi.functions.text import norm, verse_count

#: Searchable attributes, in the order in which the diverse strategy takes them.
ATTRIBUTES = ("meter", "theme", "qafiya", "poet_name", "poet_era")


@dataclass(frozen=True)
class Criteria:
    meter: str | None = None
    theme: str | None = None
    qafiya: str | None = None
    poet_name: str | None = None
    poet_era: str | None = None
    language_type: str | None = None
    poet_location: str | None = None
    min_verses: int | None = None
    max_verses: int | None = None
    keywords: tuple[str, ...] = field(default_factory=tuple)
    mode: str = "AND"


def attribute_hit(attribute: str, key: str) -> Column:
    """Does the attribute hold the key, both lower-cased and trimmed?  An empty attribute does not."""
    value = norm(F.col(attribute))
    return (value != "") & value.contains(key.strip().lower())


def hits(criteria: Criteria) -> list[Column]:
    return [attribute_hit(a, getattr(criteria, a)) for a in ATTRIBUTES if getattr(criteria, a)]


def corpus_text() -> Column:
    """What keywords are looked up in: title, lines and description, lower-cased."""
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("verses", F.array().cast("array<string>")), "\n"), F.coalesce("description", F.lit(""))))


def residual(criteria: Criteria, n_verses: Column | None = None, body: Column | None = None) -> Column:
    """Bounds, language, location and keywords; ``n_verses`` and ``body`` where a table holds them."""
    count, out = verse_count(F.col("verses")) if n_verses is None else n_verses, F.lit(True)
    if criteria.min_verses:
        out = out & (count >= criteria.min_verses)
    if criteria.max_verses:
        out = out & (count <= criteria.max_verses)
    if criteria.language_type:
        have = F.lower(F.coalesce("language_type", F.lit("")))
        out = out & ((have == "") | have.contains(criteria.language_type.lower()))
    if criteria.poet_location:
        out = out & F.lower(F.coalesce("poet_location", F.lit(""))).contains(criteria.poet_location.lower())
    if criteria.keywords:
        text = corpus_text() if body is None else body
        found = [text.contains(k.lower()) for k in criteria.keywords]
        out = out & reduce((lambda a, b: a | b) if criteria.mode == "OR" else (lambda a, b: a & b), found)
    return out


def predicate(criteria: Criteria) -> Column:
    found = hits(criteria)
    if not found:
        main = F.lit(True)
    else:
        main = reduce((lambda a, b: a | b) if criteria.mode == "OR" else (lambda a, b: a & b), found)
    return main & residual(criteria)


def search(corpus: DataFrame, criteria: Criteria, limit: int | None = None) -> DataFrame:
    """Matching rows; with a limit, the first by ``poem_idx``."""
    found = corpus.filter(predicate(criteria))
    return found.orderBy("poem_idx").limit(limit) if limit else found


def from_constraints(constraints: dict) -> Criteria:
    """Search criteria of a request: era, register as language, and the line count give or take one."""
    n = constraints.get("line_count")
    return Criteria(
        meter=constraints.get("meter"),
        theme=constraints.get("theme"),
        qafiya=constraints.get("qafiya"),
        poet_name=constraints.get("poet_style"),
        poet_era=constraints.get("era"),
        language_type=constraints.get("register"),
        min_verses=n - 1 if n else None,
        max_verses=n + 1 if n else None,
        keywords=tuple(constraints.get("keywords") or ()),
    )


def examples(corpus: DataFrame, meter: str | None, theme: str | None, qafiya: str | None, line_count: int | None, limit: int = 5) -> DataFrame:
    """Corpus examples for a request, within one line of the wanted count."""
    bounds = {"min_verses": line_count - 1, "max_verses": line_count + 1} if line_count else {}
    return search(corpus, Criteria(meter=meter, theme=theme, qafiya=qafiya, **bounds), limit)


def diverse(corpus: DataFrame, criteria: Criteria, limit: int = 5, per_attribute: int = 2, seed: int = 7) -> DataFrame:
    """Up to ``per_attribute`` rows for each given attribute in turn, then a seeded random fill.

    A row found for an earlier attribute is not taken again.  Every branch is a
    small top-k by ``poem_idx`` of one read; ``rank`` is the order of the result.
    """
    order = ("meter", "theme", "qafiya", "poet_name")
    most = limit + per_attribute * len(order)
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("poem_idx").cast("string")))
    branches = [F.when(attribute_hit(a, getattr(criteria, a)), F.lit(i)) for i, a in enumerate(a for a in order if getattr(criteria, a))]
    rows = corpus.select("poem_idx", shuffled.alias("key"), F.explode(F.array(*branches, F.lit(len(order)))).alias("branch")).filter("branch is not null")
    rows = rows.withColumn("key", F.when(F.col("branch") == len(order), F.col("key")))
    # one read: the window keeps the first rows of each branch before the shuffle
    place = F.row_number().over(Window.partitionBy("branch").orderBy("key", "poem_idx"))
    both = rows.withColumn("place", place).filter(F.col("place") <= max(most, per_attribute)).filter((F.col("branch") == len(order)) | (F.col("place") <= per_attribute))
    first = both.groupBy("poem_idx").agg(F.min(F.struct("branch", "key")).alias("at"))
    ranked = first.select("poem_idx", "at.branch", "at.key").orderBy("branch", F.when(F.col("branch") < len(order), F.col("poem_idx")), "key").limit(limit)
    place = Window.orderBy("branch", F.when(F.col("branch") < len(order), F.col("poem_idx")), "key")
    return ranked.select("poem_idx", F.row_number().over(place).alias("rank"))


def retrieve(corpus: DataFrame, criteria: Criteria, limit: int = 5, strategy: str = "best_match") -> DataFrame:
    """exact_match: all attributes; diverse: a mix; anything else: any attribute."""
    if strategy == "diverse":
        return corpus.join(diverse(corpus, criteria, limit), "poem_idx")
    return search(corpus, replace(criteria, mode="AND" if strategy == "exact_match" else "OR"), limit)


def matched(wanted: dict[str, str]) -> Column:
    """Names of the wanted attributes that a row matches; all of them where none does."""
    names = F.array(*[F.when(attribute_hit(a, k), F.lit(a)) for a, k in wanted.items()])
    found = F.filter(names, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(a) for a in wanted]))


def should_search(requested: list[str] | None, constraints: dict) -> bool:
    """Without requested attributes always, else when one of them has a value."""
    return not requested or any(constraints.get(a) for a in requested)


def active_criteria(requested: list[str], constraints: dict) -> list[str]:
    return [a for a in requested if constraints.get(a)] or list(requested)
