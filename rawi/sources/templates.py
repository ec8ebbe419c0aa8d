"""A catalogue of prompt templates from a folder of YAML files."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from rawi.sources.files import SUFFIXES

#: Categories of templates, named by folders.
CATEGORIES = ("constraint_inference", "generation", "evaluation", "refinement", "planning", "search", "analysis", "compiler")
_TEXT = ("name", "base", "description", "category", "language", "template", "metadata", "error")
_SHAPE = StructType([*[StructField(n, StringType()) for n in _TEXT], StructField("parameters", ArrayType(StringType()))])


def read_template(path: str, text: str) -> dict:
    """The columns of one file; for a broken one only its ``error``."""
    row = dict.fromkeys((*_TEXT, "parameters"))
    try:
        import yaml

        told = yaml.safe_load(text)
        if not isinstance(told, dict):
            raise ValueError("not a table of fields")
        folders = path.split("/")[-2:-4:-1]
        category = next((f for f in folders if f in CATEGORIES), None)
        if category is None:
            raise ValueError(f"no category among the folders {', '.join(folders)}")
        missing = [f for f in ("name", "description", "template") if not isinstance(told.get(f), str)]
        if missing:
            raise ValueError(f"no text for {', '.join(missing)}")
        metadata = told.get("metadata") or {}
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        language = metadata.get("language") or next((said for suffix, said in SUFFIXES if stem.endswith(suffix)), "arabic")
        suffix = next((s for s, _ in SUFFIXES if told["name"].endswith(s)), "")
        parameters = list(dict.fromkeys(re.findall(r"\{(\w+)\}", told["template"])))
        row |= {"name": told["name"], "base": told["name"].removesuffix(suffix), "description": told["description"], "category": category, "language": language}
        row |= {"template": told["template"], "metadata": json.dumps(metadata, ensure_ascii=False, default=str), "parameters": parameters}
    except Exception as e:  # noqa: BLE001 a broken file is a row
        row["error"] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return row


@F.pandas_udf(_SHAPE)
def _read(paths: pd.Series, texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_template(p, t) for p, t in zip(paths, texts, strict=True)], columns=_SHAPE.names)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each ``.yaml`` file under a folder: path, name, base (without a language suffix), description, category, language, template, metadata (JSON), parameters and error.

    The category is the name of the file's folder, else of the one above.  The language
    is the one told in the metadata, else that of the file name's suffix, else Arabic.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    # broken bytes stay visible as such; a file that is empty has a row as well
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("t", _read("path", F.coalesce("text", F.lit("")))).select("path", "t.*")


def chosen(templates: DataFrame, category: str | None = None, language: str | None = None) -> DataFrame:
    """Sound templates of a category and a language, where given."""
    out = templates.filter("error IS NULL")
    out = out if category is None else out.filter(F.col("category") == category)
    return out if language is None else out.filter(F.col("language") == language)


def names(templates: DataFrame, language: str | None = None) -> DataFrame:
    """Sorted distinct names."""
    return chosen(templates, language=language).select("name").distinct().orderBy("name")


def broken(templates: DataFrame) -> DataFrame:
    return templates.filter("error IS NOT NULL").select("path", "error")
