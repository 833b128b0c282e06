"""Small configured inputs: the manual dictionary and the allowlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.runtime import path_exists
from recallspark.schemas import ALLOWLIST, DICTIONARY, empty


def dictionary_from_json(documents: DataFrame, json: str = "value") -> DataFrame:
    """Entries of JSON objects: `pos, real_value, placeholder`, in the order of `pos`.

    Of equal keys the last value counts, at the place of the first. An empty key
    has no meaning as a search text and is left out.
    """
    pairs = F.map_entries(F.from_json(F.col(json), "map<string,string>"))
    entries = documents.select(F.posexplode(pairs).alias("_at", "_e")).filter("_e.key <> ''")
    return entries.groupBy(F.col("_e.key").alias("real_value")).agg(
        F.min("_at").alias("pos"), F.max_by("_e.value", "_at").alias("placeholder")
    ).select("pos", "real_value", "placeholder")


def allowlist_from_json(documents: DataFrame, json: str = "value") -> DataFrame:
    words = F.from_json(F.col(json), "array<string>")
    return documents.select(F.explode(words).alias("word")).distinct()


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """`pos, real_value, placeholder`; no rows when the file is missing."""
    if not path_exists(spark, path):
        return empty(spark, DICTIONARY)
    return dictionary_from_json(spark.read.text(path, wholetext=True))


def load_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """One column `word`; no rows when the file is missing."""
    if not path_exists(spark, path):
        return empty(spark, ALLOWLIST)
    return allowlist_from_json(spark.read.text(path, wholetext=True))
