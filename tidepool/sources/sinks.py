"""Sinks: CSV and JSON files, a sitemap, fixed-width report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import xml_escape


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sitemap_lines(rows: DataFrame, base: str, slug: str = "slug", lastmod: str = "lastmod") -> DataFrame:
    """One url element per row. Lines stay rows, so a sitemap of any size is written by many tasks; the frame around them is two lines more."""
    loc = F.concat(F.lit(base), xml_escape(F.col(slug)))
    return rows.select(F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), F.col(lastmod), F.lit("</lastmod></url>")).alias("line"))


def report_lines(rows: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """Rows through a printf pattern."""
    return rows.select(F.format_string(pattern, *columns).alias("line"))


def markdown_lines(rows: DataFrame) -> DataFrame:
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
