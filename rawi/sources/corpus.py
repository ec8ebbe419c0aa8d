"""Corpus rows: loading, renaming and the documents table seen as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rawi.functions.text import lines

#: Field names of a corpus row and the source columns they come from (first present wins).
COLUMNS = {
    "title": ("poem title",),
    "meter": ("poem meter",),
    "verses": ("poem verses",),
    "qafiya": ("rhyme", "poem qafiya"),
    "theme": ("poem theme",),
    "url": ("poem url",),
    "poet_name": ("poet name",),
    "poet_description": ("poet description",),
    "poet_url": ("poet url",),
    "poet_era": ("poet era",),
    "poet_location": ("poem location", "poet location"),
    "description": ("poem description",),
    "language_type": ("poem language type",),
}


def rename(raw: DataFrame, order: Column | None = None) -> DataFrame:
    """Source columns under their field names; missing columns and nulls are empty, text verses become lines.

    ``poem_idx`` is a stable number: the given order, else the digest of the row.
    """
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    out = []
    for name, sources in COLUMNS.items():
        have = [s for s in sources if s in kinds]
        if name == "verses":
            if not have:
                out.append(F.array().cast("array<string>").alias(name))
            elif isinstance(kinds[have[0]], T.ArrayType):
                out.append(F.coalesce(F.col(f"`{have[0]}`"), F.array().cast("array<string>")).alias(name))
            else:
                out.append(lines(F.col(f"`{have[0]}`")).alias(name))
        else:
            out.append(F.coalesce(*[F.col(f"`{s}`").cast("string") for s in have], F.lit("")).alias(name))
    index = order if order is not None else F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])
    return raw.select(index.cast("long").alias("poem_idx"), *out)


def load_parquet(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """All Parquet files under a folder or glob, one after the other, as a corpus."""
    raw = spark.read.parquet(path)
    return rename(raw, F.col(order) if order else None)


def choose_split(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """The ``train`` split of a dataset folder, else its first."""
    return spark.read.parquet(f"{folder}/{'train' if 'train' in names else names[0]}")


def from_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents table as a corpus: language as meter, source as poet, labels as theme."""
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    both = docs.join(marks, "doc_id", "left")
    theme = F.when(F.col("toxic") == 1, "satire").when(F.col("quality") == 1, "praise").when(F.col("quality") == 0, "elegy").otherwise("")
    text = F.coalesce("text", F.lit(""))
    return both.select(
        F.col("doc_id").alias("poem_idx"),
        F.get(F.split(text, "\n"), F.lit(0)).alias("title"),
        F.coalesce("lang", F.lit("")).alias("meter"),
        F.split(text, "\n").alias("verses"),
        F.regexp_extract(text, "([a-z])[^a-z]*$", 1).alias("qafiya"),
        theme.alias("theme"),
        F.coalesce("source", F.lit("")).alias("poet_name"),
        F.concat(F.lit("Era "), F.floor(F.col("n_chars") / 1000) % 4).alias("poet_era"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("Place "), F.col("doc_id") % 7)).alias("poet_location"),
        F.lit("").alias("description"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.coalesce("lang", F.lit(""))).alias("language_type"),
    )
