"""Queries over articles: text, sentiment, signals, manifest, structured features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import news as nw
from ..operators import news_schema as ns
from ..operators import sentiment as se
from ..operators import signals as sg
from ..sources import articles as ar
from .catalog import query, rnd, sql, table
from .inputs import (
    DOVISH, HAWKISH, KEYWORDS, NEGATIVE, POSITIVE, SIGNAL_FLOATS, SIGNAL_REST, articles, scored, signals, sql_lexicon,
)

SIGNAL_SQL = f"{rnd(*SIGNAL_FLOATS)}, {', '.join(SIGNAL_REST)}"
AS_OF = "2024-01-15 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def contains_sum(x: str, words) -> str:
    return "(" + " + ".join(f"contains(lower({x}), '{w}')::INTEGER" for w in words) + ")"


query("article_id_md5", sql("SELECT article_id AS doc_id, md5(headline || '_' || source) AS article_id FROM articles", "articles"))(
    lambda s, d: nw.article_id_md5(articles(s, d).withColumnRenamed("article_id", "doc_id"), url="source").select("doc_id", "article_id")
)

_kw = {x: " OR ".join(f"contains(lower({x}), '{w}')" for w in KEYWORDS) for x in ("headline", "body")}
query(
    "keyword_relevance",
    sql(f"SELECT article_id, ({_kw['headline']}) AS title_relevant, ({_kw['headline']} OR {_kw['body']}) AS relevant FROM articles", "articles"),
)(lambda s, d: nw.keyword_relevance(articles(s, d), keywords=KEYWORDS).select("article_id", "title_relevant", "relevant"))

_forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyyMMdd'T'HHmmss", "'not a time' yyyy")


@query(
    "normalize_timestamp",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR "
    "WHEN 2 THEN date_trunc('second', ts) END AS published_at FROM events",
)
def _normalize_timestamp(s, d):
    e = table(s, d, "events", "event_id", "ts")
    text = F.lit(None).cast("string")
    for k, form in enumerate(_forms):
        text = F.when(F.col("event_id") % 4 == k, F.date_format("ts", form)).otherwise(text)
    return nw.normalize_timestamp(e.withColumn("text", text), "text").select("event_id", "published_at")


# The check's own reading of a page by regular expressions; the test pages have no nesting that it would miss.
CONTAINER_CLASSES = ("article-content", "article-body", "story-body", "content-body", "entry-content")
PAGE_NOISE = ("script", "style", "nav", "header", "footer", "aside")
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&amp;", "&"),
)
NOISE_PATTERN = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in PAGE_NOISE)
CONTAINER_PATTERNS = (
    (r"(?is)<article\b[^>]*>(.*?)</article\s*>",)
    + tuple(rf'(?is)<[a-z0-9]+\b[^>]*class="[^"]*{c}[^"]*"[^>]*>(.*)' for c in CONTAINER_CLASSES)
    + (
        r'(?is)<[a-z0-9]+\b[^>]*itemprop="articleBody"[^>]*>(.*)',
        r"(?is)<main\b[^>]*>(.*?)</main\s*>",
        r'(?is)<[a-z0-9]+\b[^>]*role="main"[^>]*>(.*)',
        r'(?is)<[a-z0-9]+\b[^>]*class="(?:[^"]* )?content(?: [^"]*)?"[^>]*>(.*)',
        r'(?is)<[a-z0-9]+\b[^>]*id="content"[^>]*>(.*)',
        r"(?is)<body\b[^>]*>(.*)",
    )
)


def html_sql() -> str:
    def q(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    found = ", ".join(f"nullif(regexp_extract(clean, {q(p)}, 1), '')" for p in CONTAINER_PATTERNS)
    plain = "regexp_replace(split_part(x, chr(2), 1), '(?s)<[^>]*>', '', 'g')"
    for entity, char in ENTITIES:
        plain = f"replace({plain}, {q(entity)}, {q(char)})"
    plain = f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"
    return sql(
        f"c AS (SELECT page_id, regexp_replace(html, {q(NOISE_PATTERN)}, ' ', 'g') AS clean FROM pages), "
        f"m AS (SELECT page_id, coalesce({found}, clean) AS main FROM c), "
        "k AS (SELECT page_id, regexp_replace(regexp_replace(main, '(?i)<p\\b[^>]*>', chr(1), 'g'), '(?i)</p\\s*>', chr(2), 'g') AS marked FROM m), "
        f"t AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(marked, chr(1))[2:], lambda x: {plain}), "
        "lambda x: length(x) > 0), ' ') AS main_text FROM k) "
        "SELECT page_id, CASE WHEN length(main_text) > 100 THEN main_text END AS main_text FROM t"
    )


query("html_main_text", html_sql())(
    lambda s, d: nw.html_main_text(table(s, d, "pages", "page_id", "html")).select("page_id", "main_text")
)

_first = "row_number() OVER (PARTITION BY headline ORDER BY published_at, article_id) = 1"
query(
    "dedup_headline_earliest",
    sql(f"SELECT article_id, headline, published_at, source FROM articles WHERE headline IS NOT NULL QUALIFY {_first}", "articles"),
)(lambda s, d: nw.dedup_headline_earliest(articles(s, d).select("article_id", "headline", "published_at", "source")))

query("drop_empty_body", sql("SELECT article_id, source FROM articles WHERE content_fetched", "articles"))(
    lambda s, d: nw.drop_empty_body(articles(s, d)).select("article_id", "source")
)
query(
    "clean_manifest",
    sql(f"SELECT article_id, headline, published_at FROM (SELECT * FROM articles WHERE headline IS NOT NULL QUALIFY {_first}) WHERE content_fetched", "articles"),
)(lambda s, d: nw.clean_manifest(articles(s, d).drop("body")).select("article_id", "headline", "published_at"))
query(
    "dedup_report",
    sql(
        f"k AS (SELECT * FROM articles QUALIFY {_first}) SELECT (SELECT count(*) FROM articles) AS rows_in, 0::BIGINT AS dropped_without_headline, "
        "(SELECT count(*) FROM articles) - (SELECT count(*) FROM k) AS dropped_duplicate_headlines, "
        "(SELECT count(*) FROM k WHERE NOT content_fetched) AS dropped_empty_bodies, (SELECT count(*) FROM k WHERE content_fetched) AS rows_out",
        "articles",
    ),
)(lambda s, d: nw.dedup_report(articles(s, d)))

query("lexicon_sentiment", sql("SELECT article_id, R6(s) AS financial_sentiment FROM lexicon", "lexicon"))(
    lambda s, d: se.lexicon_sentiment(articles(s, d), "body", POSITIVE, NEGATIVE).select("article_id", "financial_sentiment")
)
_tone = (
    f"CASE WHEN {contains_sum('{x}', HAWKISH)} > {contains_sum('{x}', DOVISH)} THEN 'hawkish' "
    f"WHEN {contains_sum('{x}', DOVISH)} > {contains_sum('{x}', HAWKISH)} THEN 'dovish' ELSE 'neutral' END"
)
query("policy_tone", sql(f"SELECT article_id, {_tone.replace('{x}', 'body')} AS policy_tone FROM articles", "articles"))(
    lambda s, d: se.policy_tone(articles(s, d), "body", HAWKISH, DOVISH).select("article_id", "policy_tone")
)
_full = "(headline || ' ' || body)"
query(
    "sentiment_row",
    sql(
        f"SELECT article_id, published_at, source, substr(headline, 1, 100) AS headline, R6(((article_id % 21) - 10) / 10.0) AS polarity, "
        f"R6((article_id % 11) / 10.0) AS subjectivity, R6({sql_lexicon(_full)}) AS financial_sentiment, R6(1 - (article_id % 11) / 10.0) AS confidence, "
        f"{_tone.replace('{x}', _full)} AS policy_tone, length(headline)::INTEGER AS headline_length, length(body)::INTEGER AS body_length FROM articles",
        "articles",
    ),
)(
    lambda s, d: se.sentiment_row(
        articles(s, d).withColumns(
            {"polarity": ((F.col("article_id") % 21) - 10) / 10.0, "subjectivity": (F.col("article_id") % 11) / 10.0}
        ),
        POSITIVE, NEGATIVE, HAWKISH, DOVISH,
    )
)
_sub = (
    f"coalesce(({contains_sum('body', POSITIVE)} - {contains_sum('body', NEGATIVE)})::DOUBLE / "
    f"nullif({contains_sum('body', POSITIVE)} + {contains_sum('body', NEGATIVE)}, 0), 0.0)"
)
query("substring_sentiment", sql(f"SELECT article_id, R6({_sub}) AS sentiment_score FROM articles", "articles"))(
    lambda s, d: se.substring_sentiment(articles(s, d), "body", POSITIVE, NEGATIVE).select("article_id", "sentiment_score")
)


def class_sql(x: str, b: float) -> str:
    return f"CASE WHEN {x} > {b} THEN 'positive' WHEN {x} < -{b} THEN 'negative' ELSE 'neutral' END"


query("sentiment_class", sql(f"SELECT article_id, {class_sql('s', 0.2)} AS stored_type, {class_sql('s', 0.1)} AS text_type FROM lexicon", "lexicon"))(
    lambda s, d: se.sentiment_class(
        se.sentiment_class(scored(s, d), bound=0.2, name="stored_type"), bound=0.1, name="text_type"
    ).select("article_id", "stored_type", "text_type")
)
query("sentiment_class_counts", sql(f"SELECT {class_sql('s', 0.2)} AS sentiment_type, count(*) AS articles FROM lexicon GROUP BY 1", "lexicon"))(
    lambda s, d: se.sentiment_class_counts(scored(s, d))
)
_str = "CASE WHEN abs(p) > 0.1 THEN least(abs(p), 1) ELSE 0.1 END"
query(
    "polarity_signal",
    sql(
        "x AS (SELECT article_id, s AS p, (article_id % 11) / 10.0::DOUBLE AS u FROM lexicon) SELECT article_id, "
        f"{class_sql('p', 0.1)} AS sentiment_type, CASE WHEN p > 0.1 THEN 'UP' WHEN p < -0.1 THEN 'DOWN' ELSE 'NEUTRAL' END AS prediction, "
        f"R6({_str}) AS signal_strength, R6(({_str}) * (1 - u * 0.5)) AS confidence, R6(0.5 + p * 0.5) AS prob_up, R6(0.5 - p * 0.5) AS prob_down FROM x",
        "lexicon",
    ),
)(
    lambda s, d: se.polarity_signal(
        scored(s, d).select("article_id", F.col("sentiment_score").alias("polarity"), (F.col("article_id") % 11 / 10.0).alias("subjectivity"))
    ).drop("polarity", "subjectivity")
)
query(
    "truncate_text",
    sql(
        "SELECT article_id, CASE WHEN length(body) <= 150 THEN body ELSE regexp_replace(substr(body, 1, 150), '(?s)^(.*) .*$', '\\1') || '...' END AS short_text FROM articles",
        "articles",
    ),
)(lambda s, d: se.truncate_text(articles(s, d), "body").select("article_id", "short_text"))


@query("model_sentiment_batch")
def _model_sentiment_batch(s, d):
    make = lambda: se.lexicon_scorer(POSITIVE, NEGATIVE)
    out = se.model_sentiment_batch(articles(s, d).select("article_id", "body"), make, "body")
    return out.drop("body")


query(
    "sentiment_from_probs",
    sql(f"SELECT article_id, sentiment, {rnd('sentiment_score', 'confidence', 'positive_prob', 'negative_prob', 'neutral_prob')} FROM scored", "scored"),
)(lambda s, d: scored(s, d).select("article_id", "sentiment", "sentiment_score", "confidence", "positive_prob", "negative_prob", "neutral_prob"))
for _m in (60, 15):
    query("news_signal_windows" + ("" if _m == 60 else "_15m"), sql(f"SELECT {SIGNAL_SQL} FROM signals_{_m}m", f"signals_{_m}m"))(
        lambda s, d, _m=_m: signals(s, d, _m)
    )
query("signal_strength", sql(f"SELECT signal_time, {rnd('signal_strength')} FROM signals_60m", "signals_60m"))(
    lambda s, d: sg.signal_strength(signals(s, d).drop("signal_strength")).select("signal_time", "signal_strength")
)
query("trading_signal", sql("SELECT signal_time, trading_signal FROM signals_60m", "signals_60m"))(
    lambda s, d: sg.trading_signal(signals(s, d).drop("trading_signal")).select("signal_time", "trading_signal")
)
query(
    "signal_distribution",
    sql(
        "SELECT count(*) FILTER (trading_signal = 1) AS buy, count(*) FILTER (trading_signal = -1) AS sell, count(*) FILTER (trading_signal = 0) AS hold, "
        "R6(avg(avg_sentiment)) AS mean_sentiment, R6(avg(signal_strength)) AS mean_strength FROM signals_60m",
        "signals_60m",
    ),
)(lambda s, d: sg.signal_distribution(signals(s, d)))
query(
    "sentiment_label_counts",
    sql("SELECT sentiment, count(*) AS articles, R6(avg(sentiment_score)) AS mean_score, R6(avg(confidence)) AS mean_confidence FROM scored GROUP BY 1", "scored"),
)(lambda s, d: sg.sentiment_label_counts(scored(s, d)))
query(
    "decayed_sentiment",
    sql(
        "t AS (SELECT sentiment_score, exp(-0.5 * (row_number() OVER (ORDER BY published_at DESC, article_id DESC) - 1)) AS w FROM scored "
        "ORDER BY published_at DESC, article_id DESC LIMIT 5) SELECT R6(sum(sentiment_score * w) / sum(w)) AS decayed_sentiment, count(*) AS articles FROM t",
        "scored",
    ),
)(lambda s, d: sg.decayed_sentiment(scored(s, d)))
query(
    "news_impact_level",
    sql(
        "SELECT signal_time, CASE WHEN signal_strength > 0.7 THEN 'high' WHEN signal_strength > 0.4 THEN 'medium' ELSE 'low' END AS impact FROM signals_60m",
        "signals_60m",
    ),
)(lambda s, d: sg.news_impact_level(signals(s, d)).select("signal_time", "impact"))
query("recent_news", sql(f"SELECT {SIGNAL_SQL} FROM signals_60m ORDER BY signal_time DESC LIMIT 10", "signals_60m"))(
    lambda s, d: sg.recent_news(signals(s, d))
)
query(
    "news_sentiment_summary",
    sql(
        "SELECT R6(avg(sentiment_score)) AS mean_sentiment, count(*) FILTER (sentiment_score > 0.1) AS positive, "
        "count(*) FILTER (sentiment_score < -0.1) AS negative, count(*) FILTER (sentiment_score BETWEEN -0.1 AND 0.1) AS neutral FROM scored",
        "scored",
    ),
)(lambda s, d: sg.news_sentiment_summary(scored(s, d)))
query(
    "recent_lookback_join",
    sql(
        f"r AS (SELECT * FROM scored WHERE published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR AND TIMESTAMP '{AS_OF}') "
        "SELECT R6(coalesce(avg(sentiment_score), 0)) AS news_avg_sentiment, R6(abs(coalesce(avg(sentiment_score), 0))) AS news_signal_strength, "
        "count(*) AS news_article_count, R6(CASE WHEN count(*) = 0 THEN 0 ELSE 1 END) AS news_quality_score, "
        f"R6((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(published_at))) / 60000000.0) AS news_age_minutes, "
        "CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS news_available FROM r",
        "scored",
    ),
)(lambda s, d: sg.recent_lookback_join(scored(s, d), as_of()))

# --- article text and manifest ------------------------------------------------------------------

def _half():
    return F.when(F.col("article_id") % 3 == 0, F.lit(None)).otherwise(F.col("body"))


def _with_summary(s, d):
    a = articles(s, d)
    return a.withColumns(
        {
            "article_id": F.when(F.col("article_id") % 5 == 0, F.lit("")).otherwise(F.col("article_id").cast("string")),
            "story_id": F.concat(F.lit("s"), F.col("article_id").cast("string")),
            "summary": F.concat(F.lit("summary of "), F.col("source")),
            "body": _half(),
            "url": F.when(F.col("article_id") % 2 == 0, F.concat(F.lit("http://example.org/"), F.col("article_id"))),
        }
    )


query(
    "article_text_by_id",
    sql(
        "SELECT CASE WHEN article_id % 5 = 0 THEN 's' || article_id ELSE article_id::VARCHAR END AS article_id, "
        "headline || ' ' || CASE WHEN article_id % 3 = 0 OR body = '' THEN 'summary of ' || source ELSE body END AS full_text FROM articles",
        "articles",
    ),
)(lambda s, d: ar.article_text_by_id(_with_summary(s, d)))
query(
    "article_prompt_text",
    sql(
        "SELECT article_id, trim('Headline: ' || headline, ' ') || chr(10) || chr(10) || trim('URL: ' || CASE WHEN article_id % 2 = 0 THEN 'http://example.org/' || article_id "
        "ELSE '' END, ' ') || chr(10) || chr(10) || 'Body:' || CASE WHEN article_id % 3 = 0 OR trim(body, ' ') = '' THEN '' ELSE chr(10) || chr(10) || trim(body, ' ') END AS prompt_text FROM articles",
        "articles",
    ),
)(
    lambda s, d: ar.article_prompt_text(
        articles(s, d).withColumns(
            {"body": _half(), "url": F.when(F.col("article_id") % 2 == 0, F.concat(F.lit("http://example.org/"), F.col("article_id")))}
        )
    ).select("article_id", "prompt_text")
)
WANTED = ("src0", "src1", "src10", "src11", "src12", "src13", "src14", "src15")


def _filter_manifest(s, d):
    a = articles(s, d).drop("body")
    return ar.filter_manifest(a, "2024-01-05", "2024-01-20", 100, WANTED).select("article_id", "headline", "source", "published_at")


query(
    "filter_manifest",
    sql(
        "SELECT article_id, headline, source, published_at FROM articles WHERE published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' "
        f"AND source IN {WANTED} ORDER BY published_at, article_id LIMIT 100",
        "articles",
    ),
)(_filter_manifest)

query(
    "join_article_body",
    sql(
        "x AS (SELECT article_id, source, CASE WHEN article_id % 3 = 0 OR length(trim(body, ' ')) < 10 THEN headline || ' ' || source ELSE body END AS full_text FROM articles) "
        "SELECT article_id, source, full_text FROM x WHERE length(trim(full_text, ' ')) >= 10",
        "articles",
    ),
)(
    lambda s, d: sg.join_article_body(
        articles(s, d).select("article_id", "source", "headline", F.col("source").alias("body")),
        articles(s, d).filter(F.col("article_id") % 3 != 0).select("article_id", F.col("body").alias("full_text")),
    ).select("article_id", "source", "full_text")
)
query("anti_join_seen", sql("SELECT article_id, source FROM articles WHERE article_id NOT IN (SELECT doc_id FROM labels)", "articles"))(
    lambda s, d: nw.anti_join_seen(
        articles(s, d).select("article_id", "source"), table(s, d, "labels", "doc_id").withColumnRenamed("doc_id", "article_id")
    )
)
query(
    "rolling_context",
    sql(
        "x AS (SELECT article_id, published_at, CASE article_id % 3 WHEN 0 THEN 'context ' || article_id WHEN 1 THEN '  ' END AS c FROM articles) "
        "SELECT article_id, coalesce(last_value(CASE WHEN trim(c) <> '' THEN c END IGNORE NULLS) OVER (ORDER BY published_at, article_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context_in FROM x",
        "articles",
    ),
)(
    lambda s, d: nw.rolling_context(
        articles(s, d).select("article_id", "published_at").withColumn(
            "context_history_summary",
            F.when(F.col("article_id") % 3 == 0, F.concat(F.lit("context "), F.col("article_id"))).when(F.col("article_id") % 3 == 1, F.lit("  ")),
        )
    ).select("article_id", "context_in")
)

# --- structured features ------------------------------------------------------------------------

_BOUNDED = list(ns.BOUNDS)


def _structured(s, d):
    """Feature JSON derived from each document: some values out of bounds, some keys missing."""
    doc = F.col("doc_id")
    cells = []
    for i, n in enumerate(_BOUNDED):
        low, high = ns.BOUNDS[n]
        cells.append((((doc * 7 + i) % 104 - 2) / 100.0 * (high - low) + low).alias(n))
    for i, n in enumerate(ns.FLAGS):
        cells.append(F.when(doc % (40 + i) != 0, doc % 2 == 0).alias(n))
    for n in ns.LISTS:
        cells.append(F.split("text", " ").alias(n))
    cells.append(F.create_map(F.col("source"), F.lit(0.5)).alias("entity_sentiment"))
    for n in ns.TEXTS:
        cells.append(F.col("text").alias(n))
    for i, n in enumerate(ns.NULLABLE_TEXTS):
        cells.append(F.when(doc % (30 + i) != 0, F.col("lang")).alias(n))
    return table(s, d, "documents").select("doc_id", F.to_json(F.struct(*cells)).alias("features_json"))


def _structured_sql() -> str:
    bad = []
    for i, n in enumerate(_BOUNDED):
        low, high = ns.BOUNDS[n]
        bad.append((n, f"(doc_id * 7 + {i}) % 104 - 2 NOT BETWEEN 0 AND 100"))
    bad += [(n, f"doc_id % {40 + i} = 0") for i, n in enumerate(ns.FLAGS)]
    bad += [(n, f"doc_id % {30 + i} = 0") for i, n in enumerate(ns.NULLABLE_TEXTS)]
    names = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in bad)
    return sql(
        f"v AS (SELECT doc_id, list_sort(list_filter([{names}], lambda x: x IS NOT NULL)) AS v FROM documents) "
        "SELECT doc_id, array_to_string(v, ',') AS violations, (len(v) = 0)::INTEGER AS valid FROM v"
    )


query("llm_schema_validate", _structured_sql())(
    lambda s, d: ns.news_schema_validate(_structured(s, d)).select(
        "doc_id", F.array_join("violations", ",").alias("violations"), "valid"
    )
)
