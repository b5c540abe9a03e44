"""Article files and their manifest."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ARTICLE

TRACKING_FILE = "seen_articles.json"


def read_articles_json(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """All article files below ``path``; the tracking file and unreadable files are skipped.

    ``one_per_file=False`` reads compacted files with one article per line, which split.
    """
    return (
        spark.read.schema(ARTICLE)
        .option("multiLine", one_per_file)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("mode", "DROPMALFORMED")
        .json(path)
        .withColumns({"file_path": F.col("_metadata.file_path"), "file_size_bytes": F.col("_metadata.file_size")})
        .filter(~F.col("file_path").endswith("/" + TRACKING_FILE))
    )


def article_text_by_id(df: DataFrame) -> DataFrame:
    """Id and full text: headline, blank, body (or summary when there is no body)."""
    key = F.coalesce(F.nullif(F.col("article_id"), F.lit("")), F.col("story_id"))
    body = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("summary"), F.lit(""))
    return df.select(
        key.alias("article_id"), F.concat(F.coalesce("headline", F.lit("")), F.lit(" "), body).alias("full_text")
    ).filter(F.length("article_id") > 0)


def article_prompt_text(df: DataFrame, name: str = "prompt_text") -> DataFrame:
    """Labelled headline, address and body blocks; a blank body is left out."""

    def text(column: str):
        return F.coalesce(F.col(column), F.lit(""))

    body = F.trim(text("body"))
    parts = F.array(
        F.trim(F.concat(F.lit("Headline: "), text("headline"))),
        F.trim(F.concat(F.lit("URL: "), text("url"))),
        F.lit("Body:"),
        F.when(F.length(body) > 0, body),
    )
    return df.withColumn(name, F.array_join(F.array_compact(parts), "\n\n"))


MANIFEST = ("article_id", "headline", "source", "published_at", "collected_at", "language", "sp500_relevant",
            "file_path", "content_fetched", "file_size_bytes")


def build_manifest(articles: DataFrame) -> DataFrame:
    """Light metadata per article; times parsed, unreadable ones null."""
    return articles.withColumns(
        {c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") for c in ("published_at", "collected_at")}
    ).select(*MANIFEST)


def filter_manifest(
    manifest: DataFrame, start=None, end=None, limit: int | None = None, sources: Iterable[str] | None = None
) -> DataFrame:
    """Inclusive time bounds, source list, oldest first; a limit becomes a top-k."""
    if start is not None:
        manifest = manifest.filter(F.col("published_at") >= start)
    if end is not None:
        manifest = manifest.filter(F.col("published_at") <= end)
    if sources:
        manifest = manifest.filter(F.col("source").isin(*sources))
    ordered = manifest.orderBy(F.col("published_at").asc_nulls_last(), "article_id")
    return ordered.limit(limit) if limit else ordered
