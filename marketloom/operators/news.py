"""Article identity, relevance, cleaning and page text."""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import BUCKET, carry_forward, epoch_seconds, floor_div
from ..functions.pages import main_text
from ..functions.text import RELEVANCE_KEYWORDS


def article_id_md5(df: DataFrame, title: str = "headline", url: str = "url", name: str = "article_id") -> DataFrame:
    return df.withColumn(name, F.md5(F.concat_ws("_", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")))))


def keyword_relevance(
    df: DataFrame, title: str = "headline", body: str = "body", keywords: Sequence[str] = RELEVANCE_KEYWORDS
) -> DataFrame:
    """Does the title, or else title plus body, contain any keyword?"""

    def any_of(text: Column) -> Column:
        low = F.lower(text)
        found = F.lit(False)
        for k in keywords:
            found = found | low.contains(k)
        return F.coalesce(found, F.lit(False))

    both = F.concat_ws(" ", title, body)
    return df.withColumns({"title_relevant": any_of(F.col(title)), "relevant": any_of(F.col(title)) | any_of(both)})


TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy",
    "dd MMM yyyy HH:mm:ss", "yyyy/MM/dd HH:mm",
)


def normalize_timestamp(df: DataFrame, column: str, name: str = "published_at") -> DataFrame:
    """UTC time of several text forms; texts without a zone count as UTC, others become null."""
    text = F.col(column)
    forms = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]
    return df.withColumn(name, F.coalesce(*forms).cast("timestamp_ntz"))


def html_main_text(df: DataFrame, html: str = "html", name: str = "main_text", minimum: int = 100) -> DataFrame:
    """Paragraph text of a page's main container, blanks collapsed, null when too short.

    Nesting, any way of quoting attributes and all character references need a tokenizer, which SQL
    has not: pages go through the standard library's in Arrow batches.
    """
    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: main_text(page, minimum), na_action="ignore")

    return df.withColumn(name, text(F.col(html).cast("string")))


def dedup_headline_earliest(df: DataFrame, time: str = "published_at", key: str = "article_id") -> DataFrame:
    """First article per headline in time order; articles without a headline are dropped.

    An aggregate with partial results, so a headline copied a billion times stays cheap.
    """
    row = F.min_by(F.struct(*df.columns), F.struct(F.col(time), F.col(key)))
    return (
        df.filter(F.col("headline").isNotNull()).groupBy("headline").agg(row.alias("_row")).select("_row.*")
    )


def drop_empty_body(df: DataFrame, fetched: str = "content_fetched", body: str | None = None) -> DataFrame:
    """Keep fetched articles; with ``body`` also those with any text."""
    keep = F.coalesce(F.col(fetched), F.lit(False)) if fetched in df.columns else F.lit(False)
    if body:
        keep = keep | (F.length(F.trim(F.col(body))) > 0)
    return df.filter(keep)


def clean_manifest(df: DataFrame) -> DataFrame:
    return drop_empty_body(dedup_headline_earliest(df))


def dedup_report(df: DataFrame, time: str = "published_at", key: str = "article_id") -> DataFrame:
    """Rows left and dropped per cleaning step from one aggregation per headline."""
    fetched = F.min_by("content_fetched", F.struct(F.col(time), F.col(key)))
    per = df.groupBy("headline").agg(F.count(F.lit(1)).alias("n"), fetched.alias("kept"))
    has = F.col("headline").isNotNull()
    total = per.agg(
        F.sum("n").alias("rows_in"),
        F.sum(F.when(~has, F.col("n")).otherwise(0)).alias("dropped_without_headline"),
        F.sum(F.when(has, F.col("n") - 1).otherwise(0)).alias("dropped_duplicate_headlines"),
        F.sum(F.when(has & ~F.coalesce("kept", F.lit(False)), 1).otherwise(0)).alias("dropped_empty_bodies"),
    )
    left = F.col("rows_in")
    for c in total.columns[1:]:
        left = left - F.col(c)
    return total.withColumn("rows_out", left)


def rolling_context(
    df: DataFrame, summary: str = "context_history_summary", time: str = "published_at", key: str = "article_id",
    seed: str = "", bucket_seconds: int = 3_600,
) -> DataFrame:
    """Give every article the last non-blank summary before it in time order."""
    staged = df.withColumn(BUCKET, floor_div(epoch_seconds(time), bucket_seconds))
    value = F.when(F.length(F.trim(F.col(summary))) > 0, F.col(summary))
    out = carry_forward(staged, [], BUCKET, [time, key], {"context_in": value}, inclusive=False)
    return out.withColumn("context_in", F.coalesce("context_in", F.lit(seed))).drop(BUCKET)


def anti_join_seen(df: DataFrame, seen: DataFrame, key: str = "article_id") -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")
