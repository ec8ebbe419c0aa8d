"""Requests for verse: from a prompt to constraints, a meter, examples and repairs.

Model calls go through ``providers.generate``, once per row that needs one: a row
with nothing to ask has a null prompt and is passed through in the same scan.
Failures are values in ``error``, never exceptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawi.functions import semi as J
from rawi.operators import meter_guide as G
from rawi.operators import web
from rawi.operators.providers import Provider, generate

#: The fields that an answer must hold, and those of them that are lists or null.
FIELDS = ("meter", "qafiya", "line_count", "theme", "tone", "imagery", "keywords", "register", "era", "poet_style", "sections", "ambiguities", "suggestions", "reasoning")
LISTS = ("imagery", "keywords", "sections", "ambiguities")

_SHAPE = ", ".join(f"{f} {'array<string>' if f in LISTS else 'string'}" for f in FIELDS)

Make = Callable[[], Provider]


def answer_json(answer: Column) -> Column:
    """The JSON object of an answer: of its first fenced block, else the first in the text; null where none closes."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*\n(.*?)\n```", 1), F.lit(""))
    return J.first_object(F.coalesce(fenced, answer))


def constraint_error(json: Column) -> Column:
    """Why an answer's JSON gives no constraints; null where it does."""
    present = F.json_object_keys(json)
    missing = F.array_except(F.array(*[F.lit(f) for f in FIELDS]), present)
    # an object of three fields at least, so its text cannot be a list or null by accident
    wrong = F.filter(F.array(*[F.when(F.ltrim(F.get_json_object(json, f"$.{f}")).rlike(r"^\[").__invert__(), F.lit(f)) for f in LISTS]), lambda f: f.isNotNull())
    return (
        F.when(json.isNull() | present.isNull(), "no JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(F.size(wrong) > 0, F.concat(F.lit("not a list: "), F.array_join(wrong, ", ")))
    )


def constraints(json: Column) -> Column:
    """Constraints of an answer's JSON: 'null' texts are null, missing lists empty, the line count a number or null."""
    told = F.from_json(json, _SHAPE)
    fields = []
    for f in FIELDS:
        value = J.no_null_list(told[f]) if f in LISTS else J.no_null_text(told[f])
        fields.append((F.try_to_number(F.regexp_extract(value, r"^\d{1,9}$", 0), F.lit("999999999")).cast("int") if f == "line_count" else value).alias(f))
    return F.struct(*fields)


def understood(requests: DataFrame, prompt: str, make: Make) -> DataFrame:
    """``requests`` with ``constraints`` as a model reads them from the prompt, and ``error`` where it gave none."""
    said = generate(requests, prompt, make).withColumnRenamed("error", "_failed").withColumn("_json", answer_json(F.col("answer")))
    said = said.withColumn("error", F.coalesce("_failed", constraint_error(F.col("_json"))))
    return said.withColumn("constraints", F.when(F.col("error").isNull(), constraints(F.col("_json")))).drop("answer", "duration_ms", "_failed", "_json")


def with_meter(requests: DataFrame, make: Make, meter: str = "meter", theme: str = "theme") -> DataFrame:
    """``requests`` with a known ``meter``, its ``feet_text`` and ``error``.

    A spelling that the guide knows stays and asks no model.  Other rows ask one,
    whose ``meter_name`` must be known too; all other columns stay as they are.
    """
    known = G.named(requests, meter, "_known")
    ask = F.when(F.col("_known").isNull(), F.concat(F.lit("meter for theme "), F.coalesce(theme, F.lit("?")), F.lit(", asked: "), F.coalesce(meter, F.lit("?"))))
    said = generate(known.withColumn("_prompt", ask), "_prompt", make).withColumnRenamed("error", "_failed")
    told = F.get_json_object(J.json_text(F.col("answer")), "$.meter_name")
    said = said.withColumn("_told", F.when(F.col("_known").isNull(), told)).withColumn(meter, F.coalesce(F.when(F.col("_known").isNotNull(), F.col(meter)), "_told"))
    found = G.enriched(said.drop("_known").withColumnRenamed(meter, "_meter"), "_meter").withColumn("_unknown", F.col("meter").isNull()).drop("meter", "parent")
    wrong = F.when(F.col("_meter").isNull(), "no meter name").when(F.col("_unknown"), F.concat(F.lit("unknown meter: "), "_meter"))
    out = found.withColumn("error", F.coalesce("_failed", wrong)).withColumn(meter, F.when(F.col("error").isNull(), F.col("_meter")))
    return out.select(*requests.columns, "feet_text", "error")


def corpus_examples(requests: DataFrame, key: str, corpus: DataFrame, criteria: list[str], most: int = 5) -> DataFrame:
    """key and ``examples``: the first ``most`` poems (by ``poem_idx``) that hold all the values a request has among ``criteria``.

    Requests without any of the values have no row.  Only distinct values are
    compared with each other; each combination of values in the corpus brings its
    first poems, so no join emits more than ``most`` rows for a pair of combinations.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    asked = requests.select(key, *[low(c).alias(c) for c in criteria]).filter(F.concat(*criteria) != "")
    has = corpus.select("poem_idx", "title", *[low(c).alias(f"_{c}") for c in criteria])
    held = [f"_{c}" for c in criteria]
    place = F.row_number().over(Window.partitionBy(*held).orderBy("poem_idx"))
    first = has.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")
    # pairs of distinct values, one criterion after the other, then the combinations that fit in all of them
    combos, wanted = has.select(*held).distinct(), asked.select(*criteria).distinct()
    fit = wanted
    for c in criteria:
        a, b = wanted.select(c).distinct(), combos.select(f"_{c}").distinct()
        ok = a.join(b, (F.col(c) == "") | F.col(f"_{c}").contains(F.col(c)))
        fit = fit.join(ok, c)
        combos_now = combos.select(*held[: criteria.index(c) + 1]).distinct()
        fit = fit.join(combos_now, held[: criteria.index(c) + 1], "left_semi")
    rows = fit.join(first, held).withColumn("_n", F.row_number().over(Window.partitionBy(*criteria).orderBy("poem_idx"))).filter(F.col("_n") <= most)
    lists = rows.groupBy(*criteria).agg(F.array_sort(F.collect_list(F.struct("poem_idx", "title"))).alias("examples"))
    return asked.join(lists, criteria).select(key, "examples")


def web_examples(requests: DataFrame, key: str, criteria: list[str], make: Callable[[], web.Search], most: int = 5) -> DataFrame:
    """key and ``pages``: what a search for the values of the criteria finds."""
    query = requests.select(F.col(key).alias("query_id"), F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in criteria]).alias("query")).filter("query <> ''")
    found = web.results(web.fetch(query, make, most), most)
    return found.groupBy(F.col("query_id").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "url"))), lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"))).alias("pages"))


def sources_of(config: dict, given: list[dict] | None = None) -> list[dict]:
    """Sources of a node's configuration, else of its ``data_enrichment`` part, else the given ones."""
    return config.get("sources") or config.get("data_enrichment", {}).get("sources") or list(given or [])


def enriched(requests: DataFrame, key: str, config: dict, corpus: DataFrame | None = None, make_search: Callable[[], web.Search] | None = None, given: list[dict] | None = None) -> DataFrame:
    """``requests`` with ``examples`` and ``pages`` of the configured sources, and ``enriched``: was there any source?

    A source has ``type`` (corpus or web_search), ``search_criteria`` and ``top_k``
    (5).  Later sources of one type replace earlier ones.  Rows without a finding
    have null.  ``key`` must be a whole number, one for each request.
    """
    sources = sources_of(config, given)
    out = requests.withColumn("enriched", F.lit(bool(sources)))
    for s in sources:
        criteria, most = list(s.get("search_criteria") or ("meter", "qafiya", "theme")), s.get("top_k", 5)
        if s.get("type") == "corpus" and corpus is not None:
            column, found = "examples", corpus_examples(requests, key, corpus, criteria, most)
        elif s.get("type") == "web_search" and make_search is not None:
            column, found = "pages", web_examples(requests, key, criteria, make_search, most)
        else:
            continue
        out = out.drop(column).join(found, key, "left")
    return out


def right_length(verses: Column, line_count: Column, default: int = 4) -> Column:
    """Does a poem have the lines that were asked for, four where nothing was?"""
    return F.size(verses) == F.coalesce(F.nullif(line_count, F.lit(0)), F.lit(default))


def rewritten(poems: DataFrame, prompt: Column, make: Make, verses: str = "verses") -> DataFrame:
    """``poems`` with their lines as a model writes them anew; without lines in its answer they stay."""
    said = generate(poems.withColumn("_prompt", prompt), "_prompt", make)
    new = J.verses_of_response(F.col("answer"))
    return said.withColumn(verses, F.when(F.col("answer").isNotNull() & (F.size(new) > 0), new).otherwise(F.col(verses))).select(*poems.columns)


def repaired_pairs(pairs: DataFrame, make: Make, reason: str = "reason", whole: str | None = None) -> DataFrame:
    """``pairs`` (first, second) as a model repairs them from the pair, the reason and, if named, the whole text.

    Rows with a null reason are in order and ask no model.  A repair counts if it
    has two lines at least; its first two are taken.
    """
    told = [F.col("first"), F.lit("\n"), F.col("second"), F.lit("\n# "), F.col(reason)]
    prompt = F.when(F.col(reason).isNotNull(), F.concat(*told, *([F.lit("\n"), F.col(whole)] if whole else [])))
    said = generate(pairs.withColumn("_prompt", prompt), "_prompt", make)
    new = J.verses_of_response(F.col("answer"))
    good = F.col("answer").isNotNull() & (F.size(new) >= 2)
    said = said.withColumn("_first", F.when(good, F.get(new, F.lit(0))).otherwise(F.col("first"))).withColumn("_second", F.when(good, F.get(new, F.lit(1))).otherwise(F.col("second")))
    return said.withColumn("first", F.col("_first")).withColumn("second", F.col("_second")).select(*pairs.columns)
