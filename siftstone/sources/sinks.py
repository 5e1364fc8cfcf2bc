"""Writers: JSON, Parquet, a category table in Markdown, a report directory, output folders."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import organize


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def to_json(df: DataFrame, indent: int = 2) -> str:
    """A small result as one pretty array."""
    return json.dumps([json.loads(r) for r in df.toJSON().collect()], indent=indent, ensure_ascii=False)


def markdown(df: DataFrame, category_field: str = "_category") -> str:
    """Categories with counts and percentages; one row a category reaches the driver."""
    rows = organize.category_stats(df, category_field).collect()
    total = sum(r["count"] for r in rows)
    lines = ["| Category | Count | Percent |", "|---|---:|---:|"]
    lines += [f"| {r['category']} | {r['count']} | {100 * r['count'] / total:.1f}% |" for r in rows]
    return "\n".join(lines) + "\n"


def write_report(df: DataFrame, path: str, category_field: str = "_category") -> None:
    """report.json (summary), categories.json, duplicates.json."""
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "report.json"), "w") as f:
        f.write(to_json(organize.summary(df, category_field)))
    with open(os.path.join(path, "categories.json"), "w") as f:
        f.write(to_json(organize.category_stats(df, category_field)))
    write_json(organize.duplicates(df), os.path.join(path, "duplicates.json"))


def make_folders(df: DataFrame, dry_run: bool = False) -> list[str]:
    """Makes the parents of the primary rows' output paths; distinct parents alone reach the driver."""
    primary = df.where(F.coalesce("_is_primary", F.lit(True))) if "_is_primary" in df.columns else df
    parents = sorted(r[0] for r in primary.select(F.regexp_replace("_output_path", "/[^/]*$", "")).distinct().collect())
    if not dry_run:
        for p in parents:
            os.makedirs(p, exist_ok=True)
    return parents
