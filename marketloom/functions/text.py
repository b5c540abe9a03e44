"""Text expressions and the fixed word lists."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Financial sentiment words.
POSITIVE_WORDS = (
    "rally", "surge", "gain", "jump", "rise", "soar", "climb", "advance",
    "bullish", "optimistic", "growth", "profit", "beat", "strong", "robust",
)
NEGATIVE_WORDS = (
    "plunge", "crash", "drop", "fall", "decline", "sink", "slide", "tumble",
    "bearish", "pessimistic", "loss", "miss", "weak", "concern", "worry",
)

# Monetary policy phrases.
HAWKISH_PHRASES = ("hawkish", "tighten", "raise rates", "inflation", "restrictive", "hike")
DOVISH_PHRASES = ("dovish", "ease", "cut rates", "accommodative", "stimulus", "support")

# Short substring lists.
POSITIVE_SUBSTRINGS = ("gain", "surge", "rise", "boost", "positive", "growth", "rally", "bullish", "up")
NEGATIVE_SUBSTRINGS = ("fall", "drop", "decline", "loss", "negative", "crash", "bearish", "down", "plunge")

# Phrases that make an article relevant to the index.
RELEVANCE_KEYWORDS = (
    "s&p 500", "sp500", "s&p500", "spx", "spy", "standard and poor", "wall street", "nasdaq", "dow jones",
    "us equities", "broad market", "stock market", "index fund",
    "federal reserve", "fed", "fomc", "interest rate", "rate hike", "rate cut", "inflation", "cpi", "ppi",
    "core inflation", "economic growth", "gdp", "unemployment", "jobless claims", "recession", "soft landing",
    "hard landing", "deflation", "disinflation", "stagflation",
    "treasury yields", "10-year yield", "2-year yield", "bond market", "treasuries", "government bonds",
    "sovereign debt", "yield curve", "inverted yield curve", "bond selloff", "bond rally", "fixed income",
    "market rally", "market selloff", "bull market", "bear market", "volatility", "vix", "fear index",
    "risk-on", "risk-off", "flight to safety", "safe haven",
    "earnings season", "big tech earnings", "bank earnings", "earnings outlook", "earnings",
    "oil prices", "brent", "wti", "commodity shock", "geopolitical risk", "sanctions", "trade war", "tariffs",
    "pandemic", "supply chain disruption",
)


def literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def distinct_words(text: Column) -> Column:
    """Distinct lower-case words, letters and digits of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))


def hits(text: Column, phrases: Sequence[str]) -> Column:
    """Number of phrases contained in the lower-cased text."""
    low = F.lower(text)
    return sum((low.contains(p).cast("int") for p in phrases), F.lit(0))


def balance(pos: Column, neg: Column) -> Column:
    """(pos - neg) / (pos + neg), 0 when both are 0."""
    return F.coalesce(F.try_divide((pos - neg).cast("double"), (pos + neg).cast("double")), F.lit(0.0))
