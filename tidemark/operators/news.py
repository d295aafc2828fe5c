"""News articles: normalization, search windows, dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_key, clean_text, language_matches, url_domain
from ..functions.values import article_ts
from .tables import first_by_key

COLUMNS = ["timestamp_utc", "title", "url", "source", "language", "domain"]
# Fixed values of the data model: names by which a field may come, in order of preference.
TIMES = ("seendate", "seenDate", "published", "publishedAt", "date")
URLS = ("url", "sourceurl", "urlmobile", "urlMobile")
SOURCES = ("source", "sourcename", "sourceName", "sourcecountry", "sourceCountry")
LANGUAGES = ("language", "lang", "sourceLanguage", "sourcelang")


def normalize_articles(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed articles; the domain falls back to the url's, the source to the domain, and rows without a time go."""

    def pick(*names: str) -> Column:
        return clean_text(F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string")))

    times = [F.col(n) for n in TIMES if n in raw.columns] or [F.lit(None).cast("string")]
    out = raw.select(article_ts(*times).alias("timestamp_utc"), pick("title").alias("title"), pick(*URLS).alias("url"), pick(*SOURCES).alias("source"), pick(*LANGUAGES).alias("language"), pick("domain").alias("domain"), *keep)
    out = out.withColumn("domain", F.coalesce("domain", url_domain(F.col("url"))))
    return out.withColumn("source", F.coalesce("source", "domain")).where(F.col("timestamp_utc").isNotNull())


def filter_language(df: DataFrame, language: str | None) -> DataFrame:
    return df if language is None else df.where(language_matches(F.col("language"), language))


def filter_news_window(df: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """Articles from start to end, both included, newest first, at most that many."""
    held = df.where(F.col("timestamp_utc").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy(F.col("timestamp_utc").desc(), F.col("url").asc_nulls_last(), F.col("title").asc_nulls_last())
    return held if most is None else held.limit(most)


def sort_news(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("timestamp_utc").asc_nulls_last(), F.col("url").asc_nulls_last(), F.col("title").asc_nulls_last())


def dedupe_articles(df: DataFrame, keep: str = "earliest") -> DataFrame:
    """One article of each key, the earliest or the newest; articles without a key all stay."""
    if keep not in ("earliest", "newest"):
        raise ValueError(f"keep is earliest or newest, not {keep!r}")
    time = F.unix_micros("timestamp_utc")
    blank = lambda c: F.struct(F.col(c).isNull(), F.col(c))
    return first_by_key(df, article_key(F.col("title"), F.col("url"), F.col("domain"), F.col("source")), time if keep == "earliest" else -time, blank("url"), blank("title"))


def distinct_titles(df: DataFrame) -> DataFrame:
    return df.select("title").distinct()
