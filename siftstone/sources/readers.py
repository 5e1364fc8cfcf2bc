"""Readers that give the canonical record: content, url, id and extras."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STARS = "full_name string, description string, topics array<string>, language string, html_url string, stargazers_count long"


def ingest(spark: SparkSession, data) -> DataFrame:
    """A table from a DataFrame, rows as dicts, strings (content), other scalars (value) or nothing. The
    first element decides; one dict or scalar is one row."""
    if isinstance(data, DataFrame):
        return data
    if data is None:
        data = []
    if not isinstance(data, (list, tuple)):
        data = [data]
    if not data:
        return spark.createDataFrame([], "content string")
    if isinstance(data[0], dict):
        names = list(dict.fromkeys(k for r in data for k in r))
        return spark.createDataFrame([tuple(r.get(k) for k in names) for r in data], names) if len({*map(type, data[0].values())} - {type(None)}) else spark.createDataFrame(data)
    if isinstance(data[0], str):
        return spark.createDataFrame([(None if x is None else str(x),) for x in data], "content string")
    return spark.createDataFrame([(x,) for x in data], ["value"])


def read_json(spark: SparkSession, path: str, column: str | None = None, lines: bool = False) -> DataFrame:
    """JSON rows, an array of them in each file, or with ``lines`` one a line, where files are read in splits; a missing
    ``column`` is an error that names those there."""
    df = spark.read.json(path, multiLine=not lines)
    if column and column not in df.columns:
        raise ValueError(f"Column '{column}' not found. Available: {', '.join(df.columns)}")
    return df


def _or(c: str, other) -> F.Column:
    return F.coalesce(F.col(c), F.lit(other))


def read_stars(spark: SparkSession, path: str, min_stars: int = 0) -> DataFrame:
    """Starred repositories; the filter is pushed to the scan's output before anything else."""
    df = spark.read.schema(STARS).json(path, multiLine=True)
    if min_stars > 0:
        df = df.where(_or("stargazers_count", 0) >= min_stars)
    words = F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ")
    return df.select(
        F.concat_ws(" ", _or("full_name", ""), _or("description", ""), words, _or("language", "")).alias("content"),
        _or("html_url", "").alias("url"),
        _or("full_name", "unknown").alias("id"),
        _or("language", "unknown").alias("language"),
        _or("stargazers_count", 0).alias("stars"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
    )


def read_bookmarks(spark: SparkSession, path: str, include_javascript: bool = False) -> DataFrame:
    """A browser's bookmark tree, which is one small file: flattened on the driver with its folders' paths."""
    with open(path, encoding="utf-8") as f:
        roots = json.load(f).get("roots", {})
    rows = []

    def walk(node, folder):
        if node.get("type") == "url":
            link = node.get("url") or ""
            if include_javascript or not link.startswith("javascript:"):
                rows.append((node.get("name") or "", link, folder))
        for child in node.get("children") or ():
            walk(child, f"{folder}/{node.get('name')}" if folder and node.get("name") else folder or node.get("name") or "")

    for root in ("bookmark_bar", "other", "synced"):
        if root in roots:
            for child in roots[root].get("children") or ():
                walk(child, root)
    df = spark.createDataFrame(rows, "name string, url string, folder_path string")
    return df.select(F.concat_ws(" ", "name", "url", "folder_path").alias("content"), "url", F.concat_ws("/", "folder_path", "name").alias("id"), "folder_path")


def read_directory(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """Files below a directory, contents unread; ``exclude`` is a pattern of names."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    df = df.withColumn("name", name).withColumn("parent", F.element_at(F.split("path", "/"), -2)).withColumn("ext", F.when(F.col("name").rlike(r".\.[^.]+$"), F.regexp_extract("name", r"\.([^.]+)$", 1)).otherwise(""))
    if exclude:
        df = df.where(~F.col("name").rlike(exclude))
    return df.select(F.concat_ws(" ", "name", "parent", "ext").alias("content"), F.col("path").alias("url"), F.col("name").alias("id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("ext").alias("extension"))
