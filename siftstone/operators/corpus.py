"""Term statistics: TF-IDF, fingerprints, tags, BM25 classification."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, terms
from ..functions.terms import term_counts
from .graph import saved

#: Common terms are at most so many, of at most so many bytes each.
COMMON, LONGEST = 1 << 18, 64


def with_row_index(df: DataFrame, col: str = "row_idx") -> DataFrame:
    """Positions from 0 in the input's order: the number within the partition and the sizes of those before, of which
    the driver sees one number each. Rows are written with both first: a sort's partitions are cut anew each time it runs."""
    mid = F.monotonically_increasing_id()
    part, within = F.shiftright(mid, 33), mid.bitwiseAND(F.lit((1 << 33) - 1))
    void = [f.name for f in df.schema if f.dataType.typeName() == "void"]
    rows, before, above = saved(df.drop(*void).withColumns({"__p": part, "__within": within})), 0, []
    for r in sorted(rows.groupBy("__p").count().collect()):
        above.append((r["__p"], before))
        before += r["count"]
    above = df.sparkSession.createDataFrame(above, "__p long, __above long")
    rows = rows.withColumns({c: F.lit(None) for c in void}).join(F.broadcast(above), "__p")  # a row for each partition
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c != col), (F.col("__above") + F.col("__within")).alias(col))


def idf(n: int, df: Column) -> Column:
    return F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1)


def tfidf(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """(id, term, tf, dl, df, idf, weight) of every term of every row, for tables of bounded size: every term of every row is
    joined. Texts are read once, into a table of counted terms."""
    tf = saved(term_counts(df, id_col, field))
    freq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf(df.count(), F.col("df")))
    return tf.join(freq, "term").withColumn("weight", F.col("tf") / F.col("dl") * F.col("idf"))


def frequencies(df: DataFrame, id_col: str, field: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(id, term, tf, dl) of every term of every row; (term, df, common) of every term; the number of rows; the least df of
    common terms. Of all occurrences most are of common terms, at most ``COMMON`` short ones that are broadcast. Both tables
    are saved, the texts read once."""
    tf = saved(term_counts(df, id_col, field))
    freq = saved(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    short = F.octet_length("term") <= LONGEST
    # as many numbers as there are different frequencies: n of them need n * n / 2 occurrences
    many, cut = 0, 1
    for r in sorted(freq.where(short).groupBy("df").count().collect(), reverse=True):
        many += r["count"]
        if many > COMMON:
            cut = r["df"] + 1
            break
    return tf, freq.withColumn("common", short & (F.col("df") >= cut)), df.count(), cut


def top_terms(df: DataFrame, id_col: str, field: str, count: int = 5) -> DataFrame:
    """(id, rank, term, score): the strongest terms of every row, ties by term. A term of another frequency than the
    common ones' has bounds; only those which may be among the strongest are joined with all frequencies."""
    tf, freq, n, cut = frequencies(df, id_col, field)
    known = tf.join(F.broadcast(freq.where("common").select("term", "df")), "term", "left")
    most = F.when(F.octet_length("term") <= LONGEST, F.lit(max(cut - 1, 1))).otherwise(F.lit(n))
    share = F.col("tf") / F.col("dl")
    bound = lambda other: share * idf(n, F.coalesce("df", other))
    able = terms.strongest(known.select(id_col, "term", "tf", "dl", bound(most).alias("least"), bound(F.lit(1)).alias("most")), id_col, count)
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), "term")
    scored = able.join(freq, "term").select(id_col, "term", F.round(share * idf(n, F.col("df")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count).select(id_col, "rank", "term", "score")


def tags(df: DataFrame, field: str = "content", count: int = 5, id_col: str = "row_idx") -> DataFrame:
    """``df`` with _tags, empty where a row has no terms."""
    best = top_terms(df, id_col, field, count).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    best = best.select(id_col, F.transform("t", lambda x: x["term"]).alias("_tags"))
    # few bytes a row are looked up by hash, so that rows with their texts need no sort
    return df.drop("_tags").join(best.hint("shuffle_hash"), id_col, "left").withColumn("_tags", F.coalesce("_tags", F.array().cast("array<string>")))


def fingerprints(df: DataFrame, field: str = "content", weighted: bool = False, id_col: str = "row_idx", hash_fn: str = "sip13") -> DataFrame:
    """(id, fingerprint) of every row, 0 without terms."""
    if not weighted:
        return terms.fingerprints(df, id_col, field, hash_fn)
    tf, freq, n, _ = frequencies(df, id_col, field)
    freq = freq.withColumn("h", hashing.term_hash(F.col("term"), hash_fn))
    common = F.broadcast(freq.where("common"))
    # rows' votes are 64 sums, so they are summed where a row's terms lie together: common ones as they were read, others by row
    rest = tf.join(common.select("term"), "term", "left_anti").join(freq.where("NOT common"), "term")
    # once for each occurrence: tf times the weight of one
    own = [id_col, (F.col("tf") * (F.col("tf") / F.col("dl") * idf(n, F.col("df")))).alias("weight"), "h"]
    found = tf.join(common, "term").select(*own).union(rest.select(*own).repartition(id_col))
    return df.select(id_col).join(hashing.simhash(found, id_col), id_col, "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit(0)))


def fingerprint(df: DataFrame, field: str = "content", weighted: bool = False, id_col: str = "row_idx", hash_fn: str = "sip13") -> DataFrame:
    """``df`` with _fingerprint, 16 hexadecimal digits."""
    f = fingerprints(df, field, weighted, id_col, hash_fn)
    return df.drop("_fingerprint").join(f.select(id_col, hashing.to_hex("fingerprint").alias("_fingerprint")), id_col)


# ---------------------------------------------------------------- taxonomies

def parse_taxonomy(text: str) -> dict:
    """A taxonomy from JSON: name, version, categories of name, keywords and maybe children."""
    try:
        t = json.loads(text)

        def check(c):
            if not isinstance(c["name"], str) or not all(isinstance(k, str) for k in c["keywords"]):
                raise ValueError("a category needs a name and keywords")
            for child in c.get("children") or ():
                check(child)

        t["name"], t["version"]
        for c in t["categories"]:
            check(c)
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"Failed to parse taxonomy: {e}") from e
    return t


def load_taxonomy(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError as e:
        raise ValueError(f"Failed to read '{path}': {e}") from e
    return parse_taxonomy(text)


def category_names(taxonomy: dict) -> list[str]:
    return [c["name"] for c in taxonomy["categories"]]


def flatten(taxonomy: dict) -> list[tuple[str, list[str]]]:
    """(path, keywords) of every category, parents before children."""
    out = []

    def walk(cats, above):
        for c in cats:
            path = [*above, c["name"]]
            out.append((" > ".join(path), list(c["keywords"])))
            walk(c.get("children") or (), path)

    walk(taxonomy["categories"], [])
    return out


def bm25_weights(documents: list[list[str]], k1: float = 1.2, b: float = 0.75) -> list[tuple[int, str, float]]:
    """(document, term, score of one query occurrence) for a small corpus of term lists."""
    import math
    from collections import Counter

    counts = [Counter(d) for d in documents]
    df = Counter(t for c in counts for t in c)
    n, mean = len(documents), sum(map(len, documents)) / max(len(documents), 1)
    out = []
    for i, (c, d) in enumerate(zip(counts, documents)):
        for t, tf in sorted(c.items()):
            weight = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
            out.append((i, t, weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))))
    return out


def classify(df: DataFrame, taxonomy: dict, field: str = "content", threshold: float = 0.5, id_col: str = "row_idx") -> DataFrame:
    """``df`` with _category, _hierarchy and _confidence: the category of the best BM25 score, the
    earlier of equal ones; Uncategorized below the threshold."""
    cats = flatten(taxonomy)
    spark = df.sparkSession
    weights = spark.createDataFrame(bm25_weights([k for _, k in cats]) or [(0, "", 0.0)], "cat int, term string, w double")
    names = spark.createDataFrame([(i, p.split(" > ")[-1], p) for i, (p, _) in enumerate(cats)] or [(0, "", "")], "cat int, category string, path string")
    # a taxonomy is written by hand or cut from a bounded sample; a larger one is joined by a shuffle
    if sum(len(k) for _, k in cats) <= 100_000:
        weights, names = F.broadcast(weights), F.broadcast(names)
    scores = term_counts(df, id_col, field).join(weights, "term").groupBy(id_col, "cat").agg(F.sum(F.col("tf") * F.col("w")).alias("score"))
    best = scores.groupBy(id_col).agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("cat")).alias("cat"))).alias("best"))
    best = best.select(id_col, F.col("best.score").alias("score"), (-F.col("best.cat")).alias("cat")).join(names, "cat", "left").drop("cat")
    ok = F.col("score") >= threshold
    none = "Uncategorized" if threshold > 0 else ""
    out = df.drop("_category", "_hierarchy", "_confidence").join(best, id_col, "left")
    return (
        out.withColumn("_category", F.when(ok, F.col("category")).otherwise(F.lit(none)))
        .withColumn("_hierarchy", F.when(ok, F.col("path")).otherwise(F.lit(none)))
        .withColumn("_confidence", F.when(ok, F.col("score")).otherwise(F.lit(0.0)))
        .drop("score", "category", "path")
    )
