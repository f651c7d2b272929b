"""Readers of text folders, edge lists, URL maps and dictionaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import first_line_id, second_line
from quillspark.operators.handle import Index, Settings


def folder(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, text)``: each file is one document, in order of its numeric name; others come last, by name."""
    raw = spark.read.text(path, wholetext=True).withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    stem = F.regexp_extract("name", r"^(\d+)", 1)
    return raw.select(F.when(stem != "", stem.cast("long")).alias("ordinal"), "name", F.col("value").alias("text"))


def web_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, url, text)`` of files whose first line is an id and whose second is a URL."""
    return folder(spark, path).select(first_line_id(F.col("text")).alias("doc_id"), second_line(F.col("text")).alias("url"), "text")


def index_folder(spark: SparkSession, texts: str, path: str, settings: Settings = Settings()) -> Index:
    """An index at ``path`` over a folder of files with id, URL and text; files without an id have none and are left out."""
    return Index.create(spark, path, settings).add(web_documents(spark, texts))


def _pair(spark: SparkSession, path: str, names: tuple[str, str], kinds: tuple[str, str], **options) -> DataFrame:
    lines = spark.read.options(**options).text(path)
    parts = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.trim("value") != "").select(*(F.get(parts, F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(zip(names, kinds))))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of lines with two ids and blanks between; parallel edges stay."""
    return _pair(spark, path, ("src", "dst"), ("bigint", "bigint"))


def urls(spark: SparkSession, path: str) -> DataFrame:
    """``(id, url)``."""
    return _pair(spark, path, ("id", "url"), ("bigint", "string"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(word, freq)`` of lines ``word freq``: lower case, byte order mark removed."""
    return _pair(spark, path, ("word", "freq"), ("string", "bigint")).select(F.lower(F.regexp_replace("word", "^﻿", "")).alias("word"), "freq").filter("freq IS NOT NULL")


def japanese_dictionary(spark: SparkSession, path: str, encoding: str = "GBK") -> DataFrame:
    """``(word, freq)`` of lines ``freq word`` in the given character set."""

    @F.pandas_udf("array<string>")
    def lines(content: pd.Series) -> pd.Series:
        return content.map(lambda c: bytes(c).decode(encoding, "replace").splitlines())

    # Spark's own readers know few character sets; a dictionary is one small file, decoded where it is read.
    raw = spark.read.format("binaryFile").load(path).select(F.explode(lines("content")).alias("value"))
    parts = F.split(F.trim("value"), r"\s+")
    return raw.select(F.get(parts, F.lit(1)).alias("word"), F.get(parts, F.lit(0)).try_cast("bigint").alias("freq")).filter("word IS NOT NULL AND freq IS NOT NULL")
