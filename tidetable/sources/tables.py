"""Parquet tables of this library: partitioned scans, evolving schemas, guarded writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, *, dates: Sequence[str] | None = None, start: str | None = None, end: str | None = None, column: str = "date") -> DataFrame:
    """A table partitioned by date; only the named dates, or those from start on and before end (all prune partitions)."""
    df = spark.read.parquet(root)
    if dates is not None:
        df = df.where(F.col(column).isin(*dates))
    if start is not None:
        df = df.where(F.col(column) >= start)
    if end is not None:
        df = df.where(F.col(column) < end)
    return df


def scan_evolving(spark: SparkSession, root: str, optional: dict[str, str] | None = None) -> DataFrame:
    """A table whose files have different columns: their union, with the optional ones (name to type) there in any case."""
    df = spark.read.option("mergeSchema", "true").parquet(root)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in (optional or {}).items() if c not in df.columns})


def dates_of(spark: SparkSession, root: str, column: str = "date") -> DataFrame:
    """The partitions that are there; read from file names, not from files."""
    return spark.read.parquet(root).select(column).distinct()


def write(df: DataFrame, root: str, *, partition: str | None = "date", overwrite: bool = False) -> None:
    """Snappy Parquet. Without overwrite an existing table is refused; with it only the partitions written are replaced."""
    writer = df.write.option("compression", "snappy").mode("overwrite" if overwrite else "errorifexists")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.parquet(root)


def write_summary(df: DataFrame, root: str, *, overwrite: bool = False) -> None:
    """A summary twice: Parquet, and one CSV file with a header."""
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).parquet(f"{root}.parquet")
    df.coalesce(1).write.mode(mode).option("header", "true").csv(f"{root}.csv")


def markdown(df: DataFrame, n: int = 50) -> str:
    """The first n rows as a Markdown table: the report of a summary."""
    rows = df.limit(n).collect()
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join(lines) + "\n"


def cell(value, kind: str = "") -> str:
    """A value in a report: kind 'percent', 'seconds' or none."""
    if value is None:
        return ""
    if kind == "percent":
        return f"{value * 100:.1f}%"
    if kind == "seconds":
        return f"{value:.0f}s"
    return f"{value:.3f}" if isinstance(value, float) else str(value)


def kind_of(column: str) -> str:
    """How a column of a summary is shown: rates and coverage as percent, delays, waits, margins and errors in seconds."""
    if column.endswith("_rate") or column == "coverage":
        return "percent"
    return "seconds" if column.endswith("_seconds") or column in ("mae", "median_ae", "rmse", "bias", "mean_width") else ""


def report(title: str, sections: Sequence[tuple[str, DataFrame | str]], *, n: int = 50) -> str:
    """A Markdown report: a heading and the first n rows for each section (or its text). Tables are short summaries."""
    lines = [f"# {title}", ""]
    for heading, body in sections:
        lines += [f"## {heading}", ""]
        if isinstance(body, str):
            lines += [body, ""]
            continue
        rows = body.limit(n).collect()
        lines += ["| " + " | ".join(body.columns) + " |", "|" + "---|" * len(body.columns), *("| " + " | ".join(cell(v, kind_of(c)) for c, v in zip(body.columns, r)) + " |" for r in rows), ""]
    return "\n".join(lines)
