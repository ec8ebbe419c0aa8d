"""File sources and sinks of the curation jobs."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawi.functions.semi import custom_result, id_of_file
from rawi.functions.text import strip


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array (or object)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def batch_output(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, content) of judge output lines; lines that are not such JSON are skipped."""
    return parsed_output(spark.read.text(path))


def parsed_output(lines: DataFrame) -> DataFrame:
    extra = [c for c in lines.columns if c != "value"]
    return lines.select(custom_result(F.col("value")).alias("r"), *extra).filter("r is not null").select("r.custom_id", "r.content", *extra)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of text files."""
    return spark.read.text(path).select(strip(F.col("value")).alias("line"))


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(poem_id, html) of the response pages of a folder."""
    pages = spark.read.text(folder, wholetext=True).select(id_of_file(F.col("_metadata.file_name")).alias("poem_id"), F.col("value").alias("html"))
    return pages.filter("poem_id is not null")


def substituted(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` replaced from the environment; unknown names stay."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{([^}]+)\}", lambda m: env.get(m[1], m[0]), text)


#: Suffixes of template names and their languages.
SUFFIXES = (("_en", "english"), ("_ar", "arabic"))


def template_table(spark: SparkSession, templates: list[dict]) -> DataFrame:
    """Templates as rows (name, base, category, language, template); the language is the told one, else the suffix's, else Arabic."""
    rows = []
    for t in templates:
        suffix = next((s for s, _ in SUFFIXES if t["name"].endswith(s)), "")
        language = t.get("language") or dict(SUFFIXES).get(suffix, "arabic")
        rows.append((t["name"], t["name"].removesuffix(suffix), t.get("category", "general"), language, t["template"]))
    return spark.createDataFrame(rows, "name string, base string, category string, language string, template string")


def resolve_template(templates: DataFrame, name: str, language: str, default: str = "arabic") -> DataFrame:
    """The template of a name: in the language, else by its full name, else in the default language, else the first by language."""
    found = templates.filter((F.col("base") == name) | (F.col("name") == name))
    place = F.when(F.col("language") == language, 0).when(F.col("name") == name, 1).when(F.col("language") == default, 2).otherwise(3)
    return found.orderBy(place, "language", "name").limit(1)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for rankings of a row per source."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_requests(df: DataFrame, path: str) -> None:
    """One JSON request a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
