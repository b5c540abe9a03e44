"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Measures of every whole text: word length, share of symbols, of repeated lines and of repeated
5-word windows.  A sketch is the histogram of a measure over logarithmic buckets (relative error
`ACCURACY`): sketches merge by adding counts, so the groups are summed up in the map tasks before
the shuffle, a hot source costs no more than a cold one, and the result doesn't depend on the order
of rows or on which executors live.  Thresholds are outlier fences around a group's own middle
half; groups with few documents borrow from their language, then from all documents.  Thresholds
are joined back to the measures by language and source.

Defined results: null or empty texts have no words and fail the base rule; null languages and
sources are groups of their own; repeated rows count each; extra columns are ignored.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ids_and_texts, materialize, per_batch, words_of

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # fixed values of the base rule
SYMBOL = re.compile(rb"[#*$%&|<>]")
ACCURACY = 0.01
#: A sketch of this many documents stands on its own.
ENOUGH = 500
#: measure, is the lower side bad too, fence in half-ranges, least distance of the fence from the quartile
MEASURES = (("word_length", True, 6.0, 1.5), ("symbol_share", False, 6.0, 0.10), ("line_share", False, 6.0, 0.30), ("repeat_share", False, 6.0, 0.15))


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside n-word windows that occur twice or more, the first occurrence included; exact."""
    count = len(words) - n + 1
    if count < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    base = len(seen)
    if base == len(words):
        return 0
    if base ** n < 1 << 62:
        code = np.zeros(count, np.int64)
        for k in range(n):
            code = code * base + ids[k:count + k]
    else:
        # pairs of numbers are numbered anew before they grow beyond 63 bits, so no two windows collide
        code = ids[:count]
        for k in range(1, n):
            code = np.unique(code * base + ids[k:count + k], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:count] += twice
    edge[n:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    words = words_of(text)
    if not words:
        return (0, 0, len(SYMBOL.findall(text.encode())) if text else 0, 0, 0, 0)
    raw = text.encode("utf-8")
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), len(b"".join(words).decode("utf-8")), len(SYMBOL.findall(raw)), len(lines) - len(set(lines)), repeated_words(words), len(lines))


MEASURED = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(docs: DataFrame) -> DataFrame:
    """One row of counts per document, with its language and source."""
    def make():
        names = [x.split()[0] for x in MEASURED.split(", ")][3:]

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(zip(*map(text_measures, b.column(1).to_pylist()))) or [[]] * len(names)
            return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "lang": b.column(2), "source": b.column(3)} | {n: pa.array(r, pa.int64()) for n, r in zip(names, rows)})
        return work
    return per_batch(ids_and_texts(docs, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")), make, MEASURED)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def shares() -> dict[str, Column]:
    """Measures for which thresholds are learned; symbols are counted against words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"word_length": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / n,
            "line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / n}


# --- sketches ---

GROWTH = math.log((1 + ACCURACY) / (1 - ACCURACY))
TINY = 1e-4  # values below are one bucket


def bucket_of(value: Column) -> Column:
    """Bucket number of a value that isn't negative; bucket 0 holds values up to TINY."""
    return F.when(value <= TINY, 0).otherwise(F.ceil(F.log(value / TINY) / GROWTH)).cast("int")


def value_of(bucket: Column) -> Column:
    """The value of a bucket: within ACCURACY of everything in it."""
    return F.when(bucket == 0, 0.0).otherwise(TINY * F.exp(bucket * GROWTH) * (1 - ACCURACY))


def sketch(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Sketches of several measures: keys, measure, bucket, n.  Merge two by adding n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(c).alias("bucket")) for m, c in measures.items()]))
    return rows.select(*keys, pairs.alias("x")).groupBy(*keys, F.col("x.measure").alias("measure"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, measure, total and one column per quantile.  A sketch has a bounded number of buckets."""
    w = Window.partitionBy(*keys, "measure")
    run = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    return run.groupBy(*keys, "measure").agg(F.first("total").alias("total"), *[
        F.min(F.when(F.col("upto") >= q * F.col("total"), value_of(F.col("bucket")))).alias(name) for name, q in at.items()])


def thresholds(rows: DataFrame) -> DataFrame:
    """Fences per language and source, from the documents that pass the base rule.

    Columns lang, source, measure, low, high.  A fence lies `k` times the half range beyond the
    quartile, and at least a fixed distance, so that a group without spread keeps its usual texts.
    """
    fine = materialize(sketch(rows.filter(~base_failed()), ["lang", "source"], shares()), "quality-sketch")
    at = {"q1": 0.25, "q3": 0.75}
    own = quantiles(fine, ["lang", "source"], at)
    by_lang = quantiles(merge(fine, ["lang"]), ["lang"], at).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("total").alias("lt"), F.col("q1").alias("l1"), F.col("q3").alias("l3"))
    overall = quantiles(merge(fine, []), [], at).select(F.col("measure").alias("o"), F.col("q1").alias("o1"), F.col("q3").alias("o3"))
    joined = own.join(by_lang, own.lang.eqNullSafe(F.col("l")) & (own.measure == F.col("m"))).join(overall, F.col("measure") == F.col("o"))
    pick = lambda a, b, c: F.when(F.col("total") >= ENOUGH, F.col(a)).when(F.col("lt") >= ENOUGH, F.col(b)).otherwise(F.col(c))
    q1, q3 = pick("q1", "l1", "o1"), pick("q3", "l3", "o3")
    low = high = F.lit(None).cast("double")
    for name, two_sided, k, least in MEASURES:
        reach = F.greatest(k * (q3 - q1) / 2, F.lit(least))
        high = F.when(F.col("measure") == name, q3 + reach).otherwise(high)
        if two_sided:
            low = F.when(F.col("measure") == name, q1 - reach).otherwise(low)
    return joined.select("lang", "source", "measure", low.alias("low"), high.alias("high"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, base_failed, kept, and reasons (the measures outside their fence)."""
    rows = materialize(measure(docs), "quality-measures")
    wide = thresholds(rows).groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m, *_ in MEASURES for side in ("low", "high")])
    wide = wide.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    out = rows.withColumn("base_failed", base_failed()).join(wide, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    # a mean over few words scatters more: its fences move out by the standard error's growth
    slack = {"word_length": 4 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))}
    outside = [F.when((c > F.col(f"{m}_high") + slack.get(m, F.lit(0.0))) | F.coalesce(c < F.col(f"{m}_low") - slack.get(m, F.lit(0.0)), F.lit(False)), F.lit(m)) for m, c in shares().items()]
    reasons = F.array_compact(F.array(*outside))
    return out.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size(reasons) == 0)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")
