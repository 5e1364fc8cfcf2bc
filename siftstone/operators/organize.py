"""Output paths, reports and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance
from ..functions import url as urls
from ..functions.text import slugify
from . import cache as cache_store
from . import cluster, corpus, dedup, profile, sample, topics


def organize(df: DataFrame, format: str = "folders", output_dir: str = "./organized", category_field: str = "_category", name_field: str = "id") -> DataFrame:
    """``df`` with _output_path: ``flat`` dir/cat--name, ``nested`` dir/each level/name, else dir/cat/name."""
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in df.columns else F.lit(other)
    cat, name, root = text(category_field, "Uncategorized"), text(name_field, "unknown"), F.lit(output_dir)
    if format == "flat":
        path = F.concat(root, F.lit("/"), slugify(cat), F.lit("--"), slugify(name))
    elif format == "nested":
        levels = F.coalesce(F.col("_hierarchy"), cat) if "_hierarchy" in df.columns else cat
        path = F.concat_ws("/", root, F.array_join(F.transform(F.split(levels, " > "), slugify), "/"), slugify(name))
    else:
        path = F.concat_ws("/", root, slugify(cat), slugify(name))
    return df.withColumn("_output_path", path)


def category_stats(df: DataFrame, category_field: str = "_category") -> DataFrame:
    """(category, count), most first."""
    return df.groupBy(F.col(category_field).alias("category")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "category")


def group_stats(df: DataFrame, field: str, size_field: str | None = None, limit: int | None = 15) -> DataFrame:
    """(group, count[, total_size]): the largest groups of a field, empty as (none)."""
    name = F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit("(none)"))
    aggs = [F.count(F.lit(1)).alias("count")] + ([F.sum(size_field).alias("total_size")] if size_field else [])
    out = df.groupBy(name.alias("group")).agg(*aggs).orderBy(F.col("count").desc(), "group")
    return out.limit(limit) if limit else out


def duplicates(df: DataFrame) -> DataFrame:
    """Rows that aren't the first of their group."""
    return df.where(~F.coalesce("_is_primary", F.lit(True))) if "_is_primary" in df.columns else df.limit(0)


def summary(df: DataFrame, category_field: str = "_category", top: int = 15) -> DataFrame:
    """One row: total_items, num_categories, num_duplicates, num_unique, top_categories."""
    primary = F.coalesce("_is_primary", F.lit(True)) if "_is_primary" in df.columns else F.lit(True)
    counts = df.groupBy(F.col(category_field).alias("category")).agg(F.count(F.lit(1)).alias("count"), F.count_if(~primary).alias("dups"))
    best = counts.orderBy(F.col("count").desc(), "category").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "category", "count"))).alias("t"))
    best = best.select(F.transform("t", lambda x: F.struct(x["category"].alias("category"), x["count"].alias("count"))).alias("top_categories"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    all_ = counts.agg(zero("count").alias("total_items"), F.count(F.lit(1)).alias("num_categories"), zero("dups").alias("num_duplicates"), (zero("count") - zero("dups")).alias("num_unique"))
    return all_.join(F.broadcast(best))  # one row each


def pipeline(df: DataFrame, field: str = "content", url_field: str = "url", clusters: int = 15, count: int = 5, dedup_strategy: str | None = "combined", threshold: float = 0.5, format: str = "folders", output_dir: str = "./output", name_field: str = "id", taxonomy: dict | None = None) -> DataFrame:
    """classify, tags, dedup (unless None), organize."""
    rows = df if "row_idx" in df.columns else corpus.with_row_index(df)
    out = cluster.classify_auto(rows, field, taxonomy, clusters, threshold=threshold)
    out = corpus.tags(out, field, count)
    if dedup_strategy:
        out = dedup.dedup(out, field, url_field, dedup_strategy)
    return organize(out, format, output_dir, name_field=name_field)


#: Defaults of the three ready-made runs.
PRESETS = {"stars": {"clusters": 15, "dedup_strategy": "combined"}, "bookmarks": {"clusters": 1000, "count": 10, "dedup_strategy": "fuzzy"}, "directory": {"clusters": 10, "dedup_strategy": None}}

def similarity(df: DataFrame, a: str = "a", b: str = "b", metric: str = "levenshtein", all: bool = False) -> DataFrame:
    """``df`` with the similarity of two columns, or with ``all`` that of every metric."""
    if all:
        return df.withColumns({m: distance.similarity(a, b, m) for m in ("levenshtein", "jaro-winkler", "cosine")})
    return df.withColumn("metric", F.lit(metric)).withColumn("similarity", distance.similarity(a, b, metric))


def normalize_url(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with original, normalized and canonical_key; null where a URL can't be parsed."""
    return df.withColumns({"original": F.col(url), "normalized": urls.normalized(url), "canonical_key": urls.canonical_key(url)})


def cache_report(path: str, clear: bool = False, kind: str | None = None) -> dict:
    """What a cache holds, or what was deleted of it."""
    found = cache_store.Cache(path)
    return found.clear(kind) if clear else found.info()


OPERATIONS = {
    "fingerprint": corpus.fingerprint,
    "sample": sample.sample,
    "analyze": profile.profile,
    "classify": cluster.classify_auto,
    "tags": corpus.tags,
    "dedup": dedup.dedup,
    "similarity": similarity,
    "normalize_url": normalize_url,
    "generate": cluster.generate,
    "topics": topics.topics,
    "organize": organize,
    "pipeline": pipeline,
}
_ROWS_ALONE = ("analyze", "organize", "similarity", "normalize_url")


def run(op: str, df: DataFrame | None = None, cache: cache_store.Cache | str | None = None, **params):
    """One operation by name, with the rows' positions added where they are missing. With a cache, a table that an
    operation makes is kept for the same rows and parameters. ``cache`` (path, clear, kind) is an operation itself."""
    if op == "cache":
        return cache_report(**params)
    if op not in OPERATIONS:
        raise ValueError(f"Unknown operation: {op}")

    def make(rows):
        needs = op not in _ROWS_ALONE and "row_idx" not in rows.columns and params.get("id_col", "row_idx") == "row_idx"
        return OPERATIONS[op](corpus.with_row_index(rows) if needs else rows, **params)

    if cache is None or op in ("generate", "topics"):  # these give reports, not tables
        return make(df)
    store = cache_store.Cache(cache, df.sparkSession) if isinstance(cache, str) else cache
    return store.cached(df, op, params, make)


def register(spark) -> None:
    """The scalar pieces as SQL functions."""
    import pandas as pd
    from pyspark.sql import types as T

    from ..functions import hashing, text, url

    def mapped(f, kind):
        return F.pandas_udf(lambda s: pd.Series([f(x) for x in s]), kind)

    spark.udf.register("normalize_url", mapped(url.normalize_url, T.StringType()))
    spark.udf.register("sip_hash", hashing.sip_hash)
    # what is an expression in the JVM is a SQL function of that expression
    word = text.JAVA_WORD.replace("\\", "\\\\").replace("'", "\\'")
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(s STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(lower(coalesce(s, '')), '{word}', 0), t -> octet_length(t) >= 2 AND replace(t, '_', '') <> '' AND t NOT IN ({stop}))")
    spark.udf.register("simhash", F.pandas_udf(hashing.simhash_lists, T.StringType()))
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION slugify(s STRING) RETURNS STRING RETURN trim(BOTH '-' FROM regexp_replace(lower(s), '[^\\p{IsAlphabetic}\\p{N}]+', '-'))")
    spark.udf.register("jaro_winkler", distance.jaro_winkler_similarity)
