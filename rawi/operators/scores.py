"""Judge scores: request fan-out, validation, un-swapping, two-level means and rankings."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawi.functions.text import strip

#: The metrics of a judgement.
METRICS = ("meter", "rhyme", "meaning", "beauty", "creativity", "consistency", "vocab", "total")
HUMAN = "human"


def side(item_id: Column, source: Column) -> Column:
    """Which side the candidate is shown on: 0 or 1, the same in every run."""
    return F.pmod(F.crc32(F.concat_ws("_", item_id.cast("string"), source).cast("binary")), F.lit(2)).cast("int")


def custom_id(item_id: Column, source: Column, kind: Column) -> Column:
    return F.translate(F.concat_ws("_", item_id.cast("string"), source, kind), "-.", "__")


def decode_id(df: DataFrame, sources: list[str], column: str = "custom_id") -> DataFrame:
    """item_id, source and kind of a custom id; ids may hold underscores, as the source is found from the end."""
    out = df.withColumn("kind", F.regexp_extract(column, r"_([^_]+)$", 1))
    body = F.regexp_replace(F.col(column), r"_[^_]+$", "")
    name = item = F.lit(None).cast("string")
    for s in sorted(sources, key=len):
        coded = "_" + s.replace("-", "_").replace(".", "_")
        hit = body.endswith(coded)
        name = F.when(hit, s).otherwise(name)
        item = F.when(hit, F.expr("''") if not coded else body.substr(F.lit(1), F.length(body) - len(coded))).otherwise(item)
    return out.withColumns({"source": name, "item_id": item})


def fan_out(items: DataFrame, item_id: str, sources: list[str]) -> DataFrame:
    """One single request per source with a text, and one comparison with the human text where both exist.

    Columns: item_id, source, kind, first and second text, ai_first and custom_id.
    """
    names = [HUMAN, *[s for s in sources if s != HUMAN]]
    texts = F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"`{s}`").alias("text")) for s in names])
    both = items.select(item_id, F.col(HUMAN).alias("human_text"), F.inline(texts))
    both = both.filter(F.col("text").isNotNull() & (strip(F.col("text")) != ""))
    compare = (F.col("source") != HUMAN) & F.col("human_text").isNotNull() & (strip(F.col("human_text")) != "")
    kinds = F.explode(F.when(compare, F.array(F.lit("single"), F.lit("comparative"))).otherwise(F.array(F.lit("single"))))
    rows = both.select(F.col(item_id).alias("item_id"), "source", "text", "human_text", kinds.alias("kind"))
    ai_first = (F.col("kind") == "single") | (side(F.col("item_id"), F.col("source")) == 0)
    rows = rows.withColumn("ai_first", ai_first)
    second = F.when(F.col("kind") == "comparative", F.when(F.col("ai_first"), F.col("human_text")).otherwise(F.col("text")))
    return rows.select(
        "item_id", "source", "kind", F.when(F.col("ai_first"), F.col("text")).otherwise(F.col("human_text")).alias("first"), second.alias("second"), "ai_first", custom_id(F.col("item_id"), F.col("source"), F.col("kind")).alias("custom_id")
    )


def request_total(items: DataFrame, sources: list[str]) -> DataFrame:
    """Planned requests: 1 for a human text, 2 for each other text."""
    count = reduce(lambda a, b: a + b, [F.when(F.col(f"`{s}`").isNotNull(), F.lit(1 if s == HUMAN else 2)).otherwise(F.lit(0)) for s in [HUMAN, *[s for s in sources if s != HUMAN]]])
    return items.agg(F.coalesce(F.sum(count), F.lit(0)).alias("requests"))


def valid_single(metrics: dict[str, Column]) -> Column:
    """All metrics are numbers from 0 to 10."""
    ok = [F.coalesce(m.try_cast("double").between(0, 10), F.lit(False)) for m in metrics.values()]
    return reduce(lambda a, b: a & b, ok)


def valid_pair(metrics: dict[str, Column]) -> Column:
    """All metrics are arrays of two numbers from 0 to 10."""
    ok = [F.coalesce((F.size(m) == 2) & F.forall(m, lambda x: F.coalesce(x.try_cast("double").between(0, 10), F.lit(False))), F.lit(False)) for m in metrics.values()]
    return reduce(lambda a, b: a & b, ok)


def unswap(compared: DataFrame, metric: str = "scores") -> DataFrame:
    """A comparison's two scores as two rows: ``X_vs_human`` and ``human_vs_X``."""
    ai, human = F.when(F.col("ai_first"), F.col(metric)[0]).otherwise(F.col(metric)[1]), F.when(F.col("ai_first"), F.col(metric)[1]).otherwise(F.col(metric)[0])
    rows = F.array(
        F.struct(F.concat(F.col("source"), F.lit("_vs_human")).alias("side"), ai.alias("score")),
        F.struct(F.concat(F.lit("human_vs_"), F.col("source")).alias("side"), human.alias("score")),
    )
    return compared.select("item_id", F.explode(rows).alias("r")).select("item_id", F.col("r.side").alias("source"), F.col("r.score").alias("score"))


def base_source(source: Column) -> Column:
    """What stands before ``_vs_``."""
    return F.substring_index(source, "_vs_", 1)


def display(source: Column, names: dict[str, str]) -> Column:
    if not names:
        return source
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[source], source)


def in_all_files(scores: DataFrame, keys: list[str], file: str = "file") -> DataFrame:
    """Rows whose key occurs in every file.  The number of files is one row, so it is broadcast."""
    files = scores.agg(F.countDistinct(file).alias("files"))
    full = scores.groupBy(*keys).agg(F.countDistinct(file).alias("in_files")).join(F.broadcast(files), F.col("in_files") == F.col("files"))
    return scores.join(full.select(*keys), keys, "left_semi")


def two_level_mean(scores: DataFrame, keys: list[str], metrics: list[str], file: str = "file", in_all: bool = False) -> DataFrame:
    """Mean per key inside each file, then the mean of these over the files; ``in_all`` keeps keys that occur in every file.

    The number of files, one row, is counted from the per-file means, whose exchange both
    branches of the plan share.
    """
    inner = scores.groupBy(*keys, file).agg(*[F.avg(m).alias(m) for m in metrics])
    out = inner.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(file).alias("_files"))
    if in_all:
        files = inner.agg(F.countDistinct(file).alias("_all"))
        out = out.join(F.broadcast(files), F.col("_files") == F.col("_all"))
    return out.select(*keys, *metrics)


def ranking(scores: DataFrame, by: str, total: str, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and count of the total, means of the others, to three places, best first."""
    out = scores.groupBy(by).agg(F.avg(total).alias("mean"), F.stddev_samp(total).alias("std"), F.count(total).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    return out.select(by, *[F.bround(c, 3).alias(c) for c in ("mean", "std")], "n", *[F.bround(m, 3).alias(m) for m in metrics]).orderBy(F.desc("mean"), by)


def summary(scores: DataFrame, by: str, total: str) -> DataFrame:
    return scores.groupBy(by).agg(F.min(total).alias("min"), F.max(total).alias("max"), F.avg(total).alias("mean"), F.stddev_samp(total).alias("std"), F.count(total).alias("n"))


def box_plot(scores: DataFrame, by: str, total: str) -> DataFrame:
    """Exact quartiles, between neighbours where they fall there, and ends per group.

    Values are counted first, so a group is a running sum over its distinct values.
    """
    counted = scores.filter(F.col(total).isNotNull()).groupBy(by, F.col(total).alias("_v")).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(by)
    counted = counted.withColumns({"_upto": F.sum("_n").over(over.orderBy("_v")), "_all": F.sum("_n").over(over)})
    cuts = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    out = []
    for name, share in cuts.items():
        place = (F.col("_all") - 1) * F.lit(share)
        for side, at in (("a", F.floor(place)), ("b", F.ceil(place))):
            out.append(F.min(F.when(F.col("_upto") > at, F.col("_v"))).alias(f"{name}_{side}"))
    rows = counted.groupBy(by).agg(F.first("_all").alias("_all"), *out)
    inside = {name: (F.col("_all") - 1) * F.lit(share) - F.floor((F.col("_all") - 1) * F.lit(share)) for name, share in cuts.items()}
    return rows.select(by, *[(F.col(f"{n}_a") + part * (F.col(f"{n}_b") - F.col(f"{n}_a"))).alias(n) for n, part in inside.items()])


def correlations(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Pearson correlation of each pair of metrics over rows where both are present, from one aggregation."""
    pairs = list(combinations(metrics, 2))
    row = scores.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.a", "x.b", "x.r")


def human_correlation(scores: DataFrame, key: str, by: str, total: str, human: str) -> DataFrame:
    """Correlation of each source's totals with the human totals of the same items."""
    base = scores.filter(F.col(by) == human).select(key, F.col(total).alias("_human"))
    return scores.filter(F.col(by) != human).join(base, key).groupBy(by).agg(F.corr(total, "_human").alias("r"), F.count("*").alias("n"))


def best_and_closest(scores: DataFrame, by: str, total: str, human: str) -> DataFrame:
    """One row: the source of highest mean, and the one whose mean is nearest to the human mean."""
    means = scores.groupBy(by).agg(F.avg(total).alias("mean"))
    base = means.filter(F.col(by) == human).select(F.col("mean").alias("_human"))
    both = means.crossJoin(F.broadcast(base))  # one row
    # the smaller name wins a tie
    return both.agg(
        F.min_by(by, F.struct(-F.col("mean"), F.col(by))).alias("best"),
        F.min_by(F.when(F.col(by) != human, F.col(by)), F.when(F.col(by) != human, F.struct(F.abs(F.col("mean") - F.col("_human")), F.col(by)))).alias("closest"),
    ).select("best", "closest")


def kind_counts(scores: DataFrame, source: str = "source") -> DataFrame:
    compared = F.col(source).contains("_vs_")
    return scores.agg(F.count_if(~compared).alias("single"), F.count_if(compared).alias("comparative"))


def success_rate(batches: DataFrame, status: str = "status", done: str = "succeeded") -> DataFrame:
    n = F.count("*")
    return batches.agg(F.count_if(F.col(status) == done).alias("done"), n.alias("all"), F.when(n > 0, F.count_if(F.col(status) == done) / n).otherwise(F.lit(0.0)).alias("rate"))


def quality(bad_prosody: Column, bad_rhyme: Column, overall: Column) -> Column:
    """1 less 0.4 and 0.3 for what failed, at most the overall score, at least 0; a missing verdict costs nothing."""
    base = F.lit(1.0) - F.when(F.coalesce(bad_prosody, F.lit(False)), 0.4).otherwise(0.0) - F.when(F.coalesce(bad_rhyme, F.lit(False)), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(base, overall))


def roll_up(pairs: DataFrame, key: str, number: str = "pair_no", valid: str = "valid") -> DataFrame:
    """Per poem: valid and invalid pairs, the numbers of the invalid ones and a sentence about them."""
    bad = F.sort_array(F.collect_list(F.when(~F.col(valid), F.col(number))))
    out = pairs.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(valid)).alias("n_valid"), F.bool_and(valid).alias("all_valid"), bad.alias("invalid"))
    text = F.when(F.col("all_valid"), "all pairs are valid").when(F.col("n_valid") == 0, "no pair is valid")
    text = text.when(F.size("invalid") < 5, F.concat(F.lit("invalid pairs: "), F.array_join("invalid", ", "))).otherwise(F.concat(F.size("invalid").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" pairs are invalid")))
    return out.select(key, "n", "n_valid", "all_valid", "invalid", text.alias("said"))


def early_stop(iterations: DataFrame, key: str, iteration: str, score: str, target: float) -> DataFrame:
    """Iterations up to the first that reaches the target."""
    first = F.min(F.when(F.col(score) >= target, F.col(iteration))).over(Window.partitionBy(key))
    return iterations.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col(iteration) <= F.col("_first"))).drop("_first")


def best_of(candidates: DataFrame, key: str, index: str, score: str) -> DataFrame:
    """The candidate of highest score; the smallest index wins a tie, and is taken where no score is known."""
    worth = F.coalesce(F.col(score), F.lit(float("-inf")))
    return candidates.groupBy(key).agg(F.max(F.struct(worth.alias("score"), (-F.col(index)).alias("back"))).alias("m")).select(key, (-F.col("m.back")).alias(index), F.when(F.col("m.score") != float("-inf"), F.col("m.score")).alias(score))


def flattened(answers: DataFrame, column: str) -> DataFrame:
    """``answers`` with a number column for each metric of the scores in a JSON text; a missing or other value is null."""
    told = F.from_json(F.col(column), ", ".join(f"{m} string" for m in METRICS))
    return answers.withColumn("_told", told).select("*", *[F.col(f"_told.{m}").try_cast("double").alias(m) for m in METRICS]).drop("_told")


def resumed(results: DataFrame, items: DataFrame, item_id: str, sources: list[str]) -> DataFrame:
    """Results of an earlier run joined to their items by the ids in their custom ids; results of unknown items go."""
    told = decode_id(results, sources)
    return told.join(items, told["item_id"] == items[item_id].cast("string")).drop("item_id")
