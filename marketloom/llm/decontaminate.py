"""Benchmark decontamination: which words of which documents lie inside a window of a benchmark item.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one
window.  The join is a prefix-filtered set join at full containment:

1. Windows and documents are sets of shingles (`shingle` consecutive words; a shorter window is its
   own shingle).  The positions of all shingles that some window holds are looked up in the documents.
2. The shingles of a window are ordered by rarity in the documents.  At full containment a prefix of
   one shingle is necessary and enough: a window is joined through its rarest shingle only, and a
   window with a shingle that no document holds is out.
3. A match says where the window would start.  Length and positional bounds drop starts before the
   first word and ends behind the last.
4. What is left is compared word by word with the text at that place, so hashes of shingles never decide.

All of it are DataFrame operations.  Texts are cut into overlapping segments of `SEGMENT` words before
words become rows, so that a very long text is no larger a row than others.  Equal texts are known by
their SHA-256 and verified once.  The lookups of shingles and of texts with candidates are broadcast only if
they hold at most `MOST_KEYS` 64-bit keys (counted); else they are shuffle joins, in which Spark splits
hot keys.

Defined results: null or empty texts have no words and are clean; an item without words has no window;
repeated rows and repeated or null doc_ids give a row each; items that share an item_id are one item;
an item with null item_id marks words but is neither counted nor listed; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Everything but digits, letters a-z (after lower-casing) and characters beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENT = 4096
#: Keys up to which a lookup table (8 bytes each) is broadcast.
MOST_KEYS = 4_000_000


def folded_words(text: Column) -> Column:
    """Words of a text with A-Z, and no other letter, lower-cased; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, BETWEEN_WORDS), "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def shingle_keys(hashes: str, size: int, most: int | None = None) -> Column:
    """Key of the `size` words from each position on (the first `most` positions), given the words' hashes."""
    h = F.col(hashes)
    last = F.size(h) - size if most is None else F.least(F.size(h) - size, F.lit(most - 1))
    keys = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))
    return F.when(last >= 0, keys).otherwise(F.array().cast("array<bigint>"))


def with_hashes(rows: DataFrame, words: str) -> DataFrame:
    return rows.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))


def phrases_of(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, phrase (the words of a window joined by spaces), length."""
    words = benchmark.select(F.col("item_id"), folded_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    every = F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda i: F.concat_ws(" ", F.slice("words", i + 1, length)))
    return words.select("item_id", length.alias("length"), F.explode(every).alias("phrase")).distinct()


def phrase_shingles(phrases: DataFrame, sizes: list[int]) -> DataFrame:
    """phrase, length, offset, key of every shingle of every different phrase."""
    words = with_hashes(phrases.select("phrase", "length").distinct().withColumn("words", F.split("phrase", " ")), "words")
    parts = [words.filter(F.size("words") >= n if n == max(sizes) else F.size("words") == n).select("phrase", "length", F.posexplode(shingle_keys("hashes", n)).alias("offset", "key")) for n in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def segments(texts: DataFrame, halo: int) -> DataFrame:
    """digest, n_words, at (first word), words: SEGMENT words of a text and `halo` more."""
    words = texts.select("digest", folded_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(SEGMENT)), lambda i: F.struct(i.alias("at"), n.alias("n_words"), F.slice("words", i + 1, SEGMENT + halo).alias("words")))
    return words.select("digest", F.explode(cut).alias("s")).select("digest", "s.*")


def small(keys: DataFrame) -> DataFrame:
    """A table of one long, broadcast if it is counted to be small."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def matches(texts: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """digest, n_words, position, key of the shingles of the texts that some window holds."""
    hashed = with_hashes(segments(texts, max(sizes) - 1), "words").drop("words")
    every = F.concat(*[F.transform(shingle_keys("hashes", n, SEGMENT), lambda k, i: F.struct(i.alias("i"), k.alias("key"))) for n in sizes])
    rows = hashed.select("digest", "n_words", "at", F.explode(every).alias("s")).select("digest", "n_words", (F.col("at") + F.col("s.i")).alias("position"), F.col("s.key").alias("key"))
    return rows.join(small(keys), "key").distinct()


def prefixes(shingles: DataFrame, found: DataFrame) -> DataFrame:
    """phrase, length, offset, key: the rarest shingle of each window all of whose shingles occur."""
    counted = shingles.join(found.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset"))
    return counted.groupBy("phrase", "length").agg(rarest.alias("r")).filter("r.n > 0").select("phrase", "length", "r.offset", "r.key")


def verified(texts: DataFrame, found: DataFrame, prefix: DataFrame, window: int) -> DataFrame:
    """digest, start, length, phrase of every occurrence of a window."""
    start = F.col("position") - F.col("offset")
    told = found.join(prefix, "key").select("digest", "n_words", start.alias("start"), "length", "phrase")
    told = materialize(told.filter("start >= 0 AND start + length <= n_words").drop("n_words"), "leak-candidates")
    # only texts with candidates go on (others whose 64-bit hash is the same fall out below), and copies are compared once
    hashes = materialize(told.select(F.xxhash64("digest").alias("hash")).distinct(), "leak-texts")
    some = texts.join(small(hashes), F.xxhash64("digest") == F.col("hash"), "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    asked = told.withColumn("at", F.col("start") - F.col("start") % SEGMENT).groupBy("digest", "at").agg(F.collect_list(F.struct("start", "length", "phrase")).alias("asked"))
    there = lambda x: x.phrase == F.concat_ws(" ", F.slice("words", x.start - F.col("at") + 1, x.length))
    held = segments(some, window - 1).join(asked, ["digest", "at"]).select("digest", F.explode(F.filter("asked", there)).alias("s"))
    return held.select("digest", "s.*")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 4) -> tuple[DataFrame, DataFrame]:
    """Occurrences of windows in texts (digest, start, length, phrase) and the items' phrases (item_id, length, phrase)."""
    phrases = materialize(phrases_of(benchmark, window), "leak-phrases")
    shingle = min(shingle, window)
    texts = docs.select(digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    sizes = sorted({min(shingle, r.length) for r in phrases.select(F.least("length", F.lit(shingle)).alias("length")).distinct().collect()})  # `shingle` rows at most
    shingles = materialize(phrase_shingles(phrases, sizes or [shingle]), "leak-shingles")
    keys = materialize(shingles.select("key").distinct(), "leak-keys")
    found = materialize(matches(texts, keys, sizes or [shingle]), "leak-matches")
    return materialize(verified(texts, found, prefixes(shingles, found), window), "leak-occurrences"), phrases


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 4) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of docs."""
    seen, phrases = occurrences(docs, benchmark, window, shingle)
    # words covered: how far each span reaches beyond all spans that start before it
    spans = seen.groupBy("digest", "start").agg((F.col("start") + F.max("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy("digest").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    hits = spans.select("digest", fresh.alias("fresh")).groupBy("digest").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = seen.select("digest", "phrase").distinct().join(phrases.select("phrase", F.col("item_id").cast("string").alias("item")), "phrase").groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = hits.join(items, "digest", "left").select(F.col("digest").alias("hit_digest"), "n_hit", "items")
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.size(folded_words(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(told, F.col("digest") == F.col("hit_digest"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
