"""Lexicon and model sentiment."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

PROBS = ("positive_prob", "negative_prob", "neutral_prob")


def lexicon_score(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    words = tx.distinct_words(text)
    pos = F.size(F.array_intersect(words, tx.literals(positive)))
    neg = F.size(F.array_intersect(words, tx.literals(negative)))
    return tx.balance(pos, neg)


def lexicon_sentiment(
    df: DataFrame, text: str = "text", positive=tx.POSITIVE_WORDS, negative=tx.NEGATIVE_WORDS,
    name: str = "financial_sentiment",
) -> DataFrame:
    """Balance of distinct positive and negative words."""
    return df.withColumn(name, lexicon_score(F.col(text), positive, negative))


def policy_tone(
    df: DataFrame, text: str = "text", hawkish=tx.HAWKISH_PHRASES, dovish=tx.DOVISH_PHRASES, name: str = "policy_tone"
) -> DataFrame:
    h, d = tx.hits(F.col(text), hawkish), tx.hits(F.col(text), dovish)
    return df.withColumn(name, F.when(h > d, "hawkish").when(d > h, "dovish").otherwise("neutral"))


def substring_sentiment(
    df: DataFrame, text: str = "text", positive=tx.POSITIVE_SUBSTRINGS, negative=tx.NEGATIVE_SUBSTRINGS,
    name: str = "sentiment_score",
) -> DataFrame:
    return df.withColumn(name, tx.balance(tx.hits(F.col(text), positive), tx.hits(F.col(text), negative)))


def sentiment_class(df: DataFrame, score: str = "sentiment_score", bound: float = 0.2, name: str = "sentiment_type") -> DataFrame:
    """Positive/negative beyond the bound (0.2 for stored articles, 0.1 for free text)."""
    s = F.col(score)
    return df.withColumn(name, F.when(s > bound, "positive").when(s < -bound, "negative").otherwise("neutral"))


def sentiment_class_counts(df: DataFrame, score: str = "sentiment_score", bound: float = 0.2) -> DataFrame:
    return sentiment_class(df, score, bound).groupBy("sentiment_type").agg(F.count(F.lit(1)).alias("articles"))


def polarity_signal(df: DataFrame, polarity: str = "polarity", subjectivity: str = "subjectivity") -> DataFrame:
    """Direction, strength, confidence and probabilities from polarity and subjectivity."""
    p, s = F.col(polarity), F.col(subjectivity)
    up, down = p > 0.1, p < -0.1
    strength = F.when(up | down, F.least(F.abs(p), F.lit(1.0))).otherwise(F.lit(0.1))
    return df.withColumns(
        {
            "sentiment_type": F.when(up, "positive").when(down, "negative").otherwise("neutral"),
            "prediction": F.when(up, "UP").when(down, "DOWN").otherwise("NEUTRAL"),
            "signal_strength": strength,
            "confidence": strength * (1 - s * 0.5),
            "prob_up": 0.5 + p * 0.5,
            "prob_down": 0.5 - p * 0.5,
        }
    )


def truncate_text(df: DataFrame, text: str = "text", length: int = 150, name: str = "short_text") -> DataFrame:
    """Cut at the last blank within ``length`` characters and add dots."""
    t = F.col(text)
    cut = F.substring(t, 1, length)
    return df.withColumn(
        name, F.when(F.length(t) <= length, t).otherwise(F.concat(F.regexp_replace(cut, r"(?s)^(.*) .*$", "$1"), F.lit("...")))
    )


def sentiment_row(
    df: DataFrame, positive=tx.POSITIVE_WORDS, negative=tx.NEGATIVE_WORDS, hawkish=tx.HAWKISH_PHRASES,
    dovish=tx.DOVISH_PHRASES, polarity: str = "polarity", subjectivity: str = "subjectivity",
) -> DataFrame:
    """The silver sentiment row of an article; polarity columns come from any scorer."""
    headline, body = F.coalesce("headline", F.lit("")), F.coalesce("body", F.lit(""))
    full = df.withColumn("_full", F.concat(headline, F.lit(" "), body))
    scored = policy_tone(lexicon_sentiment(full, "_full", positive, negative), "_full", hawkish, dovish)
    return scored.select(
        "article_id",
        "published_at",
        "source",
        F.substring(headline, 1, 100).alias("headline"),
        F.col(polarity).cast("double").alias("polarity"),
        F.col(subjectivity).cast("double").alias("subjectivity"),
        "financial_sentiment",
        (1.0 - F.col(subjectivity)).alias("confidence"),
        "policy_tone",
        F.length(headline).alias("headline_length"),
        F.length(body).alias("body_length"),
    )


def sentiment_from_probs(df: DataFrame) -> DataFrame:
    """Label, score and confidence of three class probabilities (first of equals wins)."""
    pos, neg, neu = (F.col(c) for c in PROBS)
    top = F.greatest(pos, neg, neu)
    return df.withColumns(
        {
            "sentiment": F.when(pos == top, "positive").when(neg == top, "negative").otherwise("neutral"),
            "sentiment_score": pos - neg,
            "confidence": top,
        }
    )


Scorer = Callable[[Sequence[str]], Iterable[Sequence[float]]]


def lexicon_scorer(positive=tx.POSITIVE_WORDS, negative=tx.NEGATIVE_WORDS) -> Scorer:
    """Class probabilities from the word balance; stands in for a trained model."""
    pos_set, neg_set, word = set(positive), set(negative), re.compile(r"\w+")

    def score(texts: Sequence[str]):
        out = []
        for t in texts:
            words = set(word.findall(t.lower()))
            p, n = len(words & pos_set), len(words & neg_set)
            s = (p - n) / (p + n) if p + n else 0.0
            out.append((max(s, 0.0), max(-s, 0.0), 1.0 - abs(s)))
        return out

    return score


def model_sentiment_batch(
    df: DataFrame, make_scorer: Callable[[], Scorer] = lexicon_scorer, text: str = "text", batch: int = 64
) -> DataFrame:
    """Class probabilities from a batched model, loaded once per Python worker.

    A failing batch is retried text by text; a text that still fails counts as neutral.
    """
    neutral = (0.0, 0.0, 1.0)

    @F.pandas_udf("struct<positive_prob: double, negative_prob: double, neutral_prob: double>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()

        def one(t: str):
            try:
                return tuple(next(iter(scorer([t]))))
            except Exception:  # noqa: BLE001 - a bad text must not fail the job
                return neutral

        for texts in batches:
            values = texts.fillna("").tolist()
            rows: list[tuple] = []
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                try:
                    scored = [tuple(r) for r in scorer(part)]
                    if len(scored) != len(part):
                        raise ValueError("scorer returned a different number of rows")
                except Exception:  # noqa: BLE001
                    scored = [one(t) for t in part]
                rows.extend(scored)
            yield pd.DataFrame(rows, columns=list(PROBS), dtype="float64")

    scored = df.withColumn("_p", probabilities(F.col(text))).select(*df.columns, "_p.*")
    return sentiment_from_probs(scored)
